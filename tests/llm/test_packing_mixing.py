import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sillar.llm.mixing import finish_time, mixture
from sillar.llm.packing import pack, packing_report, plan, slots
from sillar.llm.tokens import FOLDER, NAME, encoding, token_sizes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, title string, tokens string, container string, size string"
TARGETS = "source string, target_share double, max_repeats int"


def doc(i, text, source="a"):
    return (i, text, None, source, None, None, "clash", "clash", "clash")


@settings(max_examples=300, deadline=None)
@given(st.integers(3, 40), st.lists(st.integers(1, 40), max_size=80))
def test_plan_equals_best_fit_item_by_item(capacity, items):
    items = [min(i, capacity) for i in items]
    bins = []
    for size in sorted(items, reverse=True):
        fitting = [i for i, free in enumerate(bins) if free >= size]
        if fitting:
            bins[min(fitting, key=lambda i: bins[i])] -= size
        else:
            bins.append(capacity - size)
    groups = plan(Counter(items), capacity)
    assert sum(g.bins for g in groups) == len(bins)
    held = Counter()
    for g in groups:
        assert g.free >= 0 and sum(s * n for s, n in g.held) + g.free == capacity
        for s, n in g.held:
            held[s] += n * g.bins
    assert held == Counter(items)
    table = slots(groups)
    assert set(table) == set(items)


def test_tokens_are_exact_and_whole(spark):
    from pathlib import Path

    coder = encoding((Path(FOLDER) / NAME).read_bytes())
    texts = ["Año nuevo <|endoftext|>", "a" * 5000, "", " \n", None, "🙂ñ"]
    got = {r.doc_id: r.tokens for r in token_sizes(spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS), "doc_id", "text").collect()}
    assert got == {i: len(coder.encode_ordinary(t)) for i, t in enumerate(texts) if t and not t.isspace()}
    assert all(coder.decode(coder.encode_ordinary(t)) == t for t in texts if t)


def test_pack(spark):
    rng = random.Random(3)
    texts = ["uno dos tres " * rng.randrange(1, 40) for _ in range(120)] + ["cuatro cinco"] * 90 + ["seis siete " * 400, None, " "]
    df = spark.createDataFrame([doc(i if i != 5 else None, t) for i, t in enumerate(texts)] + [doc(7, texts[7])], DOCS)
    packed = pack(df, 64)
    rows = packed.collect()
    sizes = Counter((r.doc_id, r.tokens) for r in token_sizes(df, "doc_id", "text").collect())
    fill = Counter()
    for r in rows:
        fill[r.container] += r.tokens
    assert max(fill.values()) <= 64 and sorted(fill) == list(range(len(fill)))
    assert sum(fill.values()) == sum(t * n for (_, t), n in sizes.items())
    whole = {d for d, t in sizes if t <= 64}
    assert all(r.piece == 0 for r in rows if r.doc_id in whole and r.doc_id != 7)
    big = sorted((r.piece, r.tok_start, r.tokens) for r in rows if r.doc_id == 210)
    assert [b[0] for b in big] == list(range(len(big))) and all(b[1] == 64 * b[0] for b in big) and all(b[2] == 64 for b in big[:-1])
    report = packing_report(packed, 64).first()
    assert report.containers == len(fill) and report.containers <= 1.1 * report.least
    assert sorted(map(tuple, pack(df, 64).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_pack_empty(spark):
    df = spark.createDataFrame([doc(1, None), doc(2, " ")], DOCS)
    assert pack(df).count() == 0 and packing_report(pack(df)).first().containers == 0


def test_finish_time():
    assert finish_time({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 100) == pytest.approx(100)
    assert finish_time({"a": 10, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}, 100) == pytest.approx(160)
    assert finish_time({"a": 10}, {"a": 1.0}, {"a": 2}, 100) == float("inf")


def test_mixture(spark):
    rng = random.Random(4)
    docs = [doc(i, "palabra " * rng.randrange(1, 30), rng.choice(["a", " A ", "a", "b", "c", "zz", None])) for i in range(900)]
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("A", 0.3, 1), ("b", 0.2, 2), ("b", 0.1, None), ("c", 0.3, 3), ("ghost", 0.1, 3), ("bad", -1.0, 1), (None, 0.5, 1), ("zero", 0.2, 0)], TARGETS)
    uses, report = mixture(df, targets)
    rows = sorted(uses.collect(), key=lambda r: r.position)
    total = sum(r.tokens for r in token_sizes(df, "doc_id", "text").collect())
    assert total * 0.995 <= sum(r.tokens for r in rows) <= total
    at = 0
    for r in rows:
        assert r.position == at
        at += r.tokens
    used = Counter((r.source, r.doc_id) for r in rows)
    assert max(n for (s, _), n in used.items() if s == "a") == 1 and max(used.values()) <= 3
    assert len({(r.doc_id, r.use) for r in rows}) == len(rows)
    shares = {r.source: r for r in report.collect()}
    assert set(shares) == {"a", "b", "c", "ghost", "bad", "zero"} and shares["ghost"].tokens == shares["zero"].tokens == 0
    assert shares["a"].tokens == shares["a"].available or abs(shares["a"].actual_share - shares["c"].actual_share) < 0.01
    assert shares["b"].tokens == 2 * shares["b"].available or abs(shares["b"].actual_share - shares["c"].actual_share) < 0.01
    tenth = rows[: len(rows) // 10]
    early = Counter()
    for r in tenth:
        early[r.source] += r.tokens
    assert max(early.values()) < 1.4 * min(early.values())


def test_mixture_empty(spark):
    none = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    uses, report = mixture(none, targets)
    assert uses.count() == 0 and report.first().actual_share == 0.0
    uses, report = mixture(spark.createDataFrame([doc(1, "x", "b")], DOCS), spark.createDataFrame([], TARGETS))
    assert uses.count() == 0 and report.count() == 0
