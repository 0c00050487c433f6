import numpy as np
import pytest

from sillar.llm.nearest import VantageTree, distances, nearest_pages, search_block, similar_pairs, unit

DIMS = 16
SCHEMA = "vec_id long, page_id long, vec array<tinyint>, cls long, near string"


def clustered(n, seed=0, topics=5, noise=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(topics, DIMS))
    x = centres[rng.integers(0, topics, n)] + noise * rng.normal(size=(n, DIMS))
    return np.clip(np.rint(unit(x) * 90), -127, 127).astype(np.int8)


def frame(spark, rows):
    return spark.createDataFrame([(a, b, None if v is None else [None if x is None else int(x) for x in v], 7, "clash") for a, b, v in rows], SCHEMA)


def brute(x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.sort(s, axis=1)[:, -k:]


@pytest.mark.parametrize("noise", [0.2, 5.0])
def test_factor_one_is_exact(noise):
    x = clustered(700, 1, noise=noise)
    raw = x.astype(np.float32)
    norms = np.linalg.norm(raw, axis=1)
    tree = VantageTree(unit(raw), 20)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(700))
    ids = np.arange(700)
    _, sims = search_block(tree, raw, norms, ids, raw, norms, ids, 10, 1.0)
    assert np.allclose(np.sort(sims, axis=1), brute(x, 10)[1], atol=1e-6)


def test_bounds_hold():
    x = unit(clustered(500, 2).astype(np.float32))
    tree = VantageTree(x, 10)
    owner = {r: i for i, leaf in enumerate(tree.leaves) for r in leaf.tolist()}
    for leaf, rows, bounds in tree.descend(x, np.full(500, 9.0, dtype=np.float32), 1.0):
        members = [r for r, i in owner.items() if i == leaf]
        assert (distances(x[rows], x[members]).min(axis=1) >= bounds - 1e-4).all()


@pytest.mark.parametrize(("shard", "queries", "sample"), [(10_000, 10_000, 10_000), (60, 50, 150)])
def test_recall(spark, shard, queries, sample):
    x = clustered(400, 3)
    got = nearest_pages(frame(spark, [(i, i * 3, v) for i, v in enumerate(x)]), 10, dims=DIMS, shard_rows=shard, query_rows=queries, sample_rows=sample).collect()
    s, top = brute(x, 10)
    assert len(got) == 4000
    hits = sum(s[r.page_id // 3, r.neighbour // 3] >= top[r.page_id // 3, 0] - 1e-9 for r in got)
    assert hits >= 0.95 * 4000
    assert all(abs(s[r.page_id // 3, r.neighbour // 3] - r.similarity) < 1e-9 for r in got)
    for p in (0, 3, 300):
        mine = sorted((r.place, -r.similarity) for r in got if r.page_id == p)
        assert [m[0] for m in mine] == list(range(1, 11)) and mine == sorted(mine, key=lambda m: m[1])


def test_copies_are_not_expanded_and_ties_go_to_the_smaller_page(spark):
    x = clustered(30, 4)
    rows = [(i, i, v) for i, v in enumerate(x)] + [(100 + i, 100 + i, x[0]) for i in range(60)]
    got = nearest_pages(frame(spark, rows), 5, dims=DIMS).collect()
    assert len(got) == 90 * 5
    first = sorted((r.place, r.neighbour) for r in got if r.page_id == 130)
    assert first == [(1, 0), (2, 100), (3, 101), (4, 102), (5, 103)]
    assert [r.neighbour for r in sorted(got, key=lambda r: r.place) if r.page_id == 100] == [0, 101, 102, 103, 104]


def test_dirty_rows(spark):
    x = clustered(4, 5)
    rows = [(1, 1, x[0]), (5, 1, x[1]), (5, 1, x[1]), (2, 2, x[1]), (3, 3, None), (4, 4, []), (6, 5, [0] * DIMS), (7, 6, x[2][:5]), (8, None, x[2]), (9, 7, x[2]), (10, 7, [0] * DIMS), (None, 8, x[3]), (11, 9, [None] + [1] * (DIMS - 1))]
    got = nearest_pages(frame(spark, rows), 10, dims=DIMS).collect()
    assert {r.page_id for r in got} == {1, 2, 8} and all(r.neighbour in (1, 2, 8) for r in got)
    assert max(r.similarity for r in got if r.page_id == 1) == pytest.approx(1.0)


def test_empty_and_pairs(spark):
    assert nearest_pages(frame(spark, []), dims=DIMS).count() == 0
    one = np.ones((1, 384), dtype=np.int8)[0]
    other = one.copy()
    other[:10] = 3
    got = similar_pairs(frame(spark, [(1, 20, one), (2, 10, other), (3, 30, -one)])).collect()
    assert list(map(tuple, got)) == [(10, 20)]


def test_a_class_with_most_of_the_pages(spark):
    x = clustered(40, 6)
    rows = [(i, i, v) for i, v in enumerate(x)] + [(1_000 + i, 1_000 + i, x[3]) for i in range(1_100)]
    got = nearest_pages(frame(spark, rows), 5, dims=DIMS).collect()
    assert len(got) == 1_140 * 5
    assert [r.neighbour for r in sorted((r for r in got if r.page_id == 1_700), key=lambda r: r.place)] == [3, 1_000, 1_001, 1_002, 1_003]
    near = {r.page_id: r.neighbour for r in got if r.place == 1}
    s, _ = brute(np.delete(x, 3, axis=0), 5)
    assert near[3] == 1_000 and all(r.similarity > 0.999 for r in got if r.page_id >= 1_000)


def test_large_leaves_are_divided_and_few_shards_visited(spark, monkeypatch):
    from sillar.llm import nearest

    seen = []
    follow, divide = nearest._follow, nearest._divide
    monkeypatch.setattr(nearest, "_follow", lambda asks, *rest: seen.append(("visits", (out := follow(asks, *rest)).count())) or out)
    monkeypatch.setattr(nearest, "_divide", lambda *rest: seen.append(("levels", len((out := divide(*rest))[1]))) or out)
    x = clustered(3_000, 7, topics=60, noise=0.15)
    got = nearest_pages(frame(spark, list(zip(range(3_000), range(3_000), x))), 10, dims=DIMS, shard_rows=100, query_rows=400, sample_rows=300, leaf_sample=400).collect()
    s, top = brute(x, 10)
    assert len(got) == 30_000 and sum(s[r.page_id, r.neighbour] >= top[r.page_id, 0] - 1e-9 for r in got) >= 0.95 * 30_000
    assert dict(seen)["levels"] >= 1 and dict(seen)["visits"] <= 12 * 3_000


def test_what_no_tree_tells_apart_is_divided_by_hash(spark):
    rng = np.random.default_rng(8)
    x = np.clip(np.rint(unit(rng.normal(size=(600, DIMS))) * 127), -127, 127).astype(np.int8)
    got = nearest_pages(frame(spark, list(zip(range(600), range(600), x))), 10, factor=1.0, dims=DIMS, shard_rows=150, query_rows=200, sample_rows=100, leaf_sample=100).collect()
    s, top = brute(x, 10)
    assert len(got) == 6_000 and all(s[r.page_id, r.neighbour] >= top[r.page_id, 0] - 1e-9 for r in got)
