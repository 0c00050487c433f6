import random

import pytest

from sillar.operators.ordered import running_sum
from sillar.session import spread


def test_running_sum_over_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.randrange(9), "x") for i in range(500)]
    rng.shuffle(rows)
    got = running_sum(spark.createDataFrame(rows, "g string, i long, v long, __x string"), "g", ["i"], "v").collect()
    assert len(got) == 500
    assert all(r.before == sum(x[2] for x in rows if x[0] == r.g and x[1] < r.i) for r in got)
    assert running_sum(spark.createDataFrame([], "g string, i long"), "g", ["i"]).count() == 0


def test_spread(spark):
    one = spark.range(0, 10, 1, 1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 50)
    assert spread(many) is many
    grouped = one.groupBy("id").count()
    assert spread(grouped) is grouped


@pytest.mark.parametrize("few", [0, 10_000])
def test_offsets_sent_or_joined(spark, few):
    rows = [(f"g{i % 3}", i, i % 5) for i in range(200)]
    got = running_sum(spark.createDataFrame(rows, "g string, i long, v long"), "g", ["i"], "v", few=few).collect()
    for g in ("g0", "g1", "g2"):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.i):
            assert r.before == total
            total += r.v
    assert len(got) == 200
