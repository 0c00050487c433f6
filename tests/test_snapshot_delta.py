import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from sillar.operators.snapshot_delta import hash_value, page_deltas, snapshot_delta, tidy_title

SCHEMA = "page_id long, title string, revid long, snapshot_ts timestamp, size int, hash string, gen int, title_key string, delta string, key string"
T = dt.datetime(2025, 1, 1)


def row(title, gen, hash_, ts=T):
    return (1, title, None, ts, None, hash_, gen, None, "clash", "clash")


def deltas(spark, rows):
    return sorted(map(tuple, page_deltas(spark.createDataFrame(rows, SCHEMA)).select("gen", "title", "delta").collect()))


def test_added_removed_changed_over_a_hole(spark):
    rows = [row("A", 1, "aa"), row("B", 1, "bb"), row("C", 1, "cc"), row("A", 4, "aa"), row("B", 4, "b2"), row("D", 4, "dd")]
    assert deltas(spark, rows) == [(4, "B", "changed"), (4, "C", "removed"), (4, "D", "added")]


def test_spellings_are_no_change(spark):
    rows = [row(" Lago_de  X", 1, "BLAKE2B:AA11"), row("Lago de X ", 2, "aa11 "), row("Y", 1, "0x0F"), row("Y", 2, "0f")]
    assert deltas(spark, rows) == []


def test_latest_row_counts_and_null_time_is_earliest(spark):
    rows = [row("A", 1, "11"), row("A", 2, "99", None), row("A", 2, "11", T), row("A", 2, "77", T - dt.timedelta(days=1)), row("B", 1, "1"), row("B", 2, "2", None)]
    assert deltas(spark, rows) == [(2, "B", "changed")]


def test_nulls(spark):
    rows = [row("A", 1, None), row("A", 2, "11"), row("B", 1, " "), row("B", 2, "11"), row(None, 1, "1"), row("C", None, "1"), row("D", 1, "1"), row("D", 2, None)]
    assert deltas(spark, rows) == []


def test_ties_repeats_and_determinism(spark):
    rows = [row("A", 1, "11"), row("A", 1, "11"), row("A", 2, "22"), row("A", 2, None)]
    assert deltas(spark, rows) == deltas(spark, rows[::-1]) == [(2, "A", "changed")]


@pytest.mark.parametrize("rows", [[], [row("A", 1, "1")]])
def test_empty_and_single_snapshot(spark, rows):
    assert deltas(spark, rows) == []


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [row(f"T{rng.randrange(40)}" if rng.random() > 0.3 else "Hot", rng.choice([2, 3, 7]), rng.choice(["a", "b", None]), T + dt.timedelta(seconds=rng.randrange(10**6))) for _ in range(600)]
    newest = {}
    for r in rows:
        key = (r[6], r[1])
        if key not in newest or r[3] > newest[key][3]:
            newest[key] = r
    want = []
    for before, gen in ((2, 3), (3, 7)):
        for t in {k[1] for k in newest}:
            a, b = newest.get((before, t)), newest.get((gen, t))
            if a is None and b is not None:
                want.append((gen, t, "added"))
            elif b is None and a is not None:
                want.append((gen, t, "removed"))
            elif a and b and a[5] and b[5] and a[5] != b[5]:
                want.append((gen, t, "changed"))
    assert deltas(spark, rows) == sorted(want)
    df = spark.createDataFrame(rows, SCHEMA)
    by_shuffle = snapshot_delta(df, tidy_title(F.col("title")), hash_value(F.col("hash")), few_keys=0)
    assert sorted(map(tuple, by_shuffle.select("gen", "title", "delta").collect())) == sorted(want)
