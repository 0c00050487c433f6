"""The most similar vectors for every vector, by cosine similarity.

Vantage-point trees with triangle-inequality pruning, relaxed by a factor: a branch
whose least possible distance is ``b`` is skipped when ``factor * b`` exceeds the
distance of the k-th neighbour found so far. With ``factor = 1`` the search is exact.

Plan
----
1. The live vector of each key is the one with the greatest version; equal vectors are
   one class, so copies are searched once however many there are.
2. A routing tree is built on the driver from a bounded sample (``sample_rows``). Its
   vantage points are means of dense neighbourhoods and its thresholds lie in gaps
   between distances where there are any, else at the median. One pass over all vectors
   gives the exact ranges of the distances in its branches. Every vector is routed to
   its leaf.
3. A leaf that is larger than a shard gets a routing tree of its own, from a bounded sample
   of its rows (``leaf_sample``), built in a task. Its rows are routed on in blocks, each
   with the tree. This is repeated until every leaf fits, so the number of leaves follows
   the number of vectors. Rows that no tree tells apart are divided by their hash.
4. Each vector is searched among the rows of its own shard: the task builds the shard's
   vantage-point tree and searches all rows at once, leaf after leaf, by matrix products.
   Dot products of int8 vectors are exact in float32, so the similarities are too. The k-th
   neighbour found there bounds the distance of the true one.
5. With that bound each vector descends the routing trees, which gives the other shards that
   it must visit; their number follows from how near the k-th neighbour is, not from the
   number of vectors. One shuffle brings the rows of a shard together with a block of
   visitors. A shard with many visitors is sent to several tasks, one per block, so no
   task holds more than ``shard_rows`` plus ``query_rows`` vectors.
6. The lists of a vector are merged and the classes spread out over their members. Classes
   with many members are few, and are sent to all executors.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillar.session import cut, default_parallelism, shuffle_width

#: Pruning is relaxed by this factor; 1 is exact.
FACTOR = 4.0
#: The same between the parts of a divided leaf, whose rows are alike, so that bounds say less.
PART_FACTOR = 1.5
#: A tree divides a leaf only if its rows then visit at most so much of it on average.
WORTH = 0.5
#: Rows of the sample in the least part of a routing tree, so that a shard has neighbours for its rows.
LEAST_PART = 24
SAMPLE_ROWS = 20_000
LEAF_SAMPLE = 4_096
#: A class with at least this part of all pages is a large one; there are no more than its inverse.
LARGE_CLASS, LEAST_LARGE = 1e-4, 1_000
SHARD_ROWS = 16_384
QUERY_ROWS = 16_384
LEAF_ROWS = 512
MIN_GAP = 0.04
#: Up to so many visitors are compared with all rows of a shard.
FEW_VISITORS = 128
SLACK = np.float32(1e-3)


def unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(norms, 1e-12)).astype(np.float32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class VantageTree:
    """A binary tree of balls: points within ``radius`` of a node's vantage point lie in
    its inner branch, all others in its outer branch.

    ``whole`` tells that the points are all there are, so that the ranges of their
    distances bound a branch; else only the radius does.
    """

    def __init__(self, points: np.ndarray, leaf_rows: int, whole: bool = True, seed: int = 7, picks: int = 6, look: int = 4096, least: int = 2):
        self.points, self.whole = points, whole
        self.centres: list[np.ndarray] = []
        self.nodes: list[tuple[float, int, int]] = []  # radius, inner, outer; leaves are ~number
        self.ranges: list[tuple[float, float, float, float]] = []  # of distances, inner and outer
        self.leaves: list[np.ndarray] = []
        self._rng = np.random.default_rng(seed)
        self._picks, self._look, self._least = picks, look, least
        self.root = self._build(np.arange(len(points)), max(1, leaf_rows))
        self.matrix = np.stack(self.centres) if self.centres else np.zeros((0, points.shape[1]), dtype=np.float32)

    def _build(self, everything: np.ndarray, leaf_rows: int) -> int:
        root: list[int] = [0]
        todo = [(everything, root, 0)]
        holders: list[list[int]] = []
        while todo:
            rows, holder, at = todo.pop()
            split = self._split(rows) if len(rows) > leaf_rows else None
            if split is None:
                holder[at] = ~len(self.leaves)
                self.leaves.append(rows)
                continue
            centre, radius, near = split
            holder[at] = len(self.centres)
            self.centres.append(centre)
            children = [0, 0]
            holders.append(children)
            self.nodes.append((radius, 0, 0))
            d = distances(self.points[rows], centre[None])[:, 0]
            self.ranges.append((d[near].min(), d[near].max(), d[~near].min(), d[~near].max()) if self.whole else (0.0, radius, radius, 2.0))
            todo.append((rows[near], children, 0))
            todo.append((rows[~near], children, 1))
        self.nodes = [(r, *c) for (r, _, _), c in zip(self.nodes, holders)]
        return root[0]

    def _split(self, rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
        some = rows if len(rows) <= self._look else self._rng.choice(rows, self._look, replace=False)
        points = self.points[some]
        margin = max(self._least, len(some) // 200)
        best_gap = best_spread = None
        for pick in self._rng.choice(len(some), min(self._picks, len(some)), replace=False):
            centre = points[pick]
            for _ in range(2):  # towards the middle of the dense region around it
                near = np.argpartition(-(points @ centre), min(len(some) - 1, max(4, len(some) // 50)))[: max(4, len(some) // 50)]
                centre = unit(points[near].mean(axis=0, keepdims=True))[0]
            d = np.sort(distances(points, centre[None])[:, 0])
            gaps = np.diff(d)[margin - 1 : len(d) - margin]
            if len(gaps):
                g = int(np.argmax(gaps))
                if best_gap is None or gaps[g] > best_gap[0]:
                    best_gap = (float(gaps[g]), centre, float(d[margin - 1 + g] + gaps[g] / 2))
            if best_spread is None or d.std() > best_spread[0]:
                best_spread = (float(d.std()), centre, float(np.median(d)))
        options = ([best_gap] if best_gap and best_gap[0] >= MIN_GAP else []) + [best_spread]
        for _, centre, radius in options:
            near = distances(self.points[rows], centre[None])[:, 0] <= radius
            if min(self._least, len(rows) // 2) <= near.sum() <= len(rows) - min(self._least, len(rows) // 2) and 0 < near.sum() < len(rows):
                return centre, radius, near
        return None

    def descend(self, queries: np.ndarray, limits: np.ndarray | None, factor: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(leaf, rows, bounds)`` of the leaves that the queries must visit, nearer branches
        first; ``limits`` may shrink between steps. None: each query's own leaf only."""
        to_centres = distances(queries, self.matrix) if len(self.matrix) else np.zeros((len(queries), 0), dtype=np.float32)
        todo = [(self.root, np.arange(len(queries)), np.zeros(len(queries), dtype=np.float32))]
        while todo:
            node, rows, bounds = todo.pop()
            if limits is not None:
                alive = bounds * factor <= limits[rows]
                rows, bounds = rows[alive], bounds[alive]
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows, bounds
                continue
            radius, inner, outer = self.nodes[node]
            d = to_centres[rows, node]
            if limits is None:
                near = d <= radius
                todo += [(outer, rows[~near], bounds[~near]), (inner, rows[near], bounds[near])]
                continue
            a, b, e, f = self.ranges[node]
            d_low, d = d - SLACK, d + SLACK  # float32 distances of near equal points are only so exact
            steps = [(outer, rows, np.maximum(bounds, np.maximum(e - d, d_low - f))), (inner, rows, np.maximum(bounds, np.maximum(a - d, d_low - b)))]
            todo += steps if np.median(d) <= radius else steps[::-1]

    def observe(self, queries: np.ndarray, seen: dict[tuple[int, int], tuple[float, float]]) -> None:
        """Widens ``seen``, per node and side (0 inner, 1 outer), by the distances of these rows."""
        to_centres = distances(queries, self.matrix) if len(self.matrix) else np.zeros((len(queries), 0), dtype=np.float32)
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, rows = todo.pop()
            if node < 0 or not len(rows):
                continue
            radius, *branches = self.nodes[node]
            d = to_centres[rows, node]
            for side, inside in enumerate((d <= radius, d > radius)):
                if inside.any():
                    lo, hi = seen.get((node, side), (9.0, -1.0))
                    seen[node, side] = min(lo, float(d[inside].min())), max(hi, float(d[inside].max()))
                    todo.append((branches[side], rows[inside]))

    def own_leaf(self, queries: np.ndarray) -> np.ndarray:
        out = np.zeros(len(queries), dtype=np.int32)
        for leaf, rows, _ in self.descend(queries, None, 1.0):
            out[rows] = leaf
        return out


def search_block(tree: VantageTree, raw: np.ndarray, norms: np.ndarray, ids: np.ndarray, q_raw: np.ndarray, q_norms: np.ndarray, q_ids: np.ndarray, k: int, factor: float, limits: np.ndarray | None = None, order: np.ndarray | None = None, fill: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, similarities)`` of the k nearest points of each query but itself, best first;
    places that stay empty have similarity -2. ``order`` sorts ``ids``. With
    ``limits`` only points nearer than these are wanted; with ``fill`` places that pruning left empty are filled."""
    n = len(q_raw)
    queries = (q_raw / q_norms[:, None]).astype(np.float32)
    best = np.full((n, k), -2.0, dtype=np.float32)
    found = np.full((n, k), -1, dtype=np.int64)  # rows of the tree's points
    kth = np.full(n, -2.0, dtype=np.float32) if limits is None else (1.0 - np.minimum(limits, 2.0) ** 2 / 2.0 - 1e-6).astype(np.float32)
    tau = np.full(n, np.inf, dtype=np.float32) if limits is None else limits.astype(np.float32).copy()
    order = np.argsort(ids, kind="stable") if order is None else order
    at = np.minimum(np.searchsorted(ids, q_ids, sorter=order), len(ids) - 1)
    own = np.where(ids[order[at]] == q_ids, order[at], -1)
    for leaf, rows, _ in tree.descend(queries, tau, factor):
        at = tree.leaves[leaf]
        sims = queries[rows] @ tree.points[at].T
        sims[own[rows, None] == at[None]] = -2.0
        better = np.flatnonzero((sims.max(axis=1) > kth[rows]))
        if not len(better):
            continue
        rows, sims = rows[better], sims[better]
        pool = np.concatenate([best[rows], sims], axis=1)
        top = np.argpartition(-pool, k - 1, axis=1)[:, :k]
        best[rows] = np.take_along_axis(pool, top, axis=1)
        found[rows] = np.where(top < k, np.take_along_axis(found[rows], np.minimum(top, k - 1), axis=1), at[np.maximum(top - k, 0)])
        worst = best[rows].min(axis=1)
        kth[rows] = np.maximum(kth[rows], worst)
        full = worst > -2.0
        reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * worst[full])) + 1e-3
        tau[rows[full]] = np.minimum(tau[rows[full]], reach)
    found[best <= -2.0] = -1
    # the similarities that are given come from exact dot products
    exact = np.einsum("id,ikd->ik", q_raw, raw[np.maximum(found, 0)]).astype(np.float64) / q_norms[:, None] / norms[np.maximum(found, 0)]
    exact[found < 0] = -2.0
    names = np.where(found < 0, -1, ids[np.maximum(found, 0)])
    short = np.flatnonzero((found < 0).any(axis=1))
    if fill and factor > 1.0 and len(short) and len(raw) > k:  # pruned too much to fill the places
        names[short], exact[short] = search_block(tree, raw, norms, ids, q_raw[short], q_norms[short], q_ids[short], k, 1.0, order=order)
    best_first = np.lexsort((names, -exact), axis=1)
    return np.take_along_axis(names, best_first, axis=1), np.take_along_axis(exact, best_first, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long int8 lists as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


ROUTED = "cls long, vec array<tinyint>, leaf long"
ASKED = "cls long, vec array<tinyint>, leaf long, reach float, visits array<long>"
SPANS = "tree long, node long, side long, lo double, hi double"


def _span_rows(seen: dict[tuple[int, int], tuple[float, float]]) -> list[tuple[int, int, float, float]]:
    return [(node, side, lo, hi) for (node, side), (lo, hi) in seen.items()]


def _observe(tree: VantageTree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[float, float]] = {}
        for b in batches:
            if b.num_rows:
                tree.observe(unit(_matrix(b.column("vec")).astype(np.float32)), seen)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*((0, *row) for row in _span_rows(seen)))], names=["tree", "node", "side", "lo", "hi"])

    return run


def _take_spans(tree: VantageTree, rows) -> None:
    """Gives the tree the exact ranges of the distances in its branches, from ``(node, side, lo, hi)``."""
    for node, side, lo, hi in rows:
        span = list(tree.ranges[node])
        span[2 * side : 2 * side + 2] = lo, hi
        tree.ranges[node] = tuple(span)


def _visits(tree: VantageTree, queries: np.ndarray, reach: np.ndarray, factor: float, base: int, own: np.ndarray) -> pa.Array:
    """The leaves each query must visit, as numbers from ``base``, its own among them if it has one here. A query without
    a bound, of a shard with no more than k others, is not pruned by the factor."""
    width = len(tree.leaves)
    here = np.flatnonzero(own >= 0)
    pairs = [here * width + own[here].astype(np.int64)]  # by row
    for rows, by in ((np.flatnonzero(reach < 2.0), factor), (np.flatnonzero(reach >= 2.0), 1.0)):
        pairs += [rows[some].astype(np.int64) * width + leaf for leaf, some, _ in tree.descend(queries[rows], reach[rows], by)]
    rows, leaves = np.divmod(np.unique(np.concatenate(pairs)), width)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(queries) + 1)).astype(np.int32)), pa.array(leaves + base))


def _route(tree: VantageTree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = tree.own_leaf(unit(_matrix(b.column("vec")).astype(np.float32)))
                yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("vec"), pa.array(leaf.astype(np.int64))], names=["cls", "vec", "leaf"])

    return run


def _ask(tree: VantageTree, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                queries = unit(_matrix(b.column("vec")).astype(np.float32))
                leaf, reach = tree.own_leaf(queries), b.column("reach").to_numpy()
                yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("vec"), pa.array(leaf.astype(np.int64)), b.column("reach"), _visits(tree, queries, reach, factor, 0, leaf)], names=["cls", "vec", "leaf", "reach", "visits"])

    return run


# ------------------------------------------------------------------ trees of large leaves


def _tells_apart(tree: VantageTree, rows: int, k: int, factor: float) -> bool:
    """A row would visit at most ``WORTH`` of the leaf on average. Its k-th neighbour among all ``rows`` of the leaf is
    about as near as the first few in the sample."""
    sample = tree.points
    some = np.random.default_rng(3).permutation(len(sample))[:256]
    nth = min(len(sample) - 1, max(1, round(k * len(sample) / rows)))
    near = -np.partition(-(sample[some] @ sample.T), nth, axis=1)[:, nth]  # the first is the row itself
    reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * near)) + 1e-3
    met = sum(len(at) * len(tree.leaves[leaf]) for leaf, at, _ in tree.descend(sample[some], reach, factor))
    return met <= WORTH * len(some) * len(sample)


def _grow(shard_rows: int, k: int, factor: float):
    """``(leaf, n, vec)`` sorted by leaf to one tree per leaf; of one leaf where a tree would save too little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, size, held = None, 0, []

        def tree() -> pa.RecordBatch:
            sample = np.concatenate(held)
            grown = VantageTree(unit(sample.astype(np.float32)), max(16, int(shard_rows * len(sample) / size)), whole=False, least=LEAST_PART)
            parts = len(grown.leaves) if _tells_apart(grown, size, k, factor) else 1
            grown.points, points = sample, grown.points  # kept as int8
            kept = pickle.dumps(grown, protocol=5)
            grown.points = points
            return pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([parts], pa.int64()), pa.array([kept], pa.binary())], names=["leaf", "leaves", "kept"])

        for b in batches:
            leaves = b.column("leaf").to_numpy()
            edges = np.flatnonzero(leaves[1:] != leaves[:-1]) + 1
            for start, stop in zip([0, *edges], [*edges, b.num_rows]):
                if start == stop:
                    continue
                if leaves[start] != leaf:
                    if held:
                        yield tree()
                    leaf, size, held = int(leaves[start]), b.column("n")[int(start)].as_py(), []
                held.append(_matrix(b.column("vec").slice(start, stop - start)))
        if held:
            yield tree()

    return run


def _read(kept: bytes, spans: list | None) -> VantageTree:
    tree = pickle.loads(kept)  # made by a task of this query
    tree.points = unit(tree.points.astype(np.float32))
    _take_spans(tree, ((s["node"], s["side"], s["lo"], s["hi"]) for s in spans or ()))
    return tree


PASSED = "cls long, vec array<tinyint>, leaf long, reach float, visits array<long>, tree long, node long, side long, lo double, hi double"


def _pass_on(factor: float, asking: bool):
    """Rows of a large leaf, behind its tree: to their new leaves with the ranges seen, or, if ``asking``, to the new
    leaves that they must visit."""
    names = [f.split(" ")[0] for f in PASSED.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int8()), pa.int64(), pa.float32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)) for name, kind in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base, tree, seen = None, 0, None, {}

        def spans() -> Iterator[pa.RecordBatch]:
            if seen:
                node, side, lo, hi = zip(*_span_rows(seen))
                yield batch(len(node), tree=pa.array([at] * len(node), pa.int64()), node=pa.array(node, pa.int64()), side=pa.array(side, pa.int64()), lo=pa.array(lo, pa.float64()), hi=pa.array(hi, pa.float64()))

        for b in batches:
            leaves, trees = b.column("at").to_numpy(), b.column("is_tree").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((leaves[1:] != leaves[:-1]) | (trees[1:] != trees[:-1])) + 1
            for start, stop in zip([0, *edges], [*edges, b.num_rows]):
                if start == stop:
                    continue
                part = b.slice(start, stop - start)
                if trees[start]:
                    if leaves[start] != at:
                        yield from spans()
                        at, base, seen = int(leaves[start]), part.column("base")[0].as_py(), {}
                        tree = _read(part.column("kept")[0].as_py(), part.column("spans")[0].as_py())
                    continue
                queries = unit(_matrix(part.column("vec")).astype(np.float32))
                own = tree.own_leaf(queries)
                if asking:
                    home = part.column("leaf").to_numpy()
                    inside = np.where(home == at, own, -1)
                    visits = _visits(tree, queries, part.column("reach").to_numpy(), factor, base, inside)
                    yield batch(part.num_rows, cls=part.column("cls"), vec=part.column("vec"), leaf=pa.array(np.where(home == at, own + base, home).astype(np.int64)), reach=part.column("reach"), visits=visits)
                else:
                    tree.observe(queries, seen)
                    yield batch(part.num_rows, cls=part.column("cls"), vec=part.column("vec"), leaf=pa.array(own.astype(np.int64) + base))
        yield from spans()

    return run


def _with_trees(rows: DataFrame, trees: DataFrame, counts: dict[int, int], block_rows: int, job) -> DataFrame:
    """``rows(at, cls, vec, leaf, reach)`` of large leaves in blocks, each behind its leaf's tree, through ``job``."""
    spark = rows.sparkSession
    layout, tasks = [], 0
    for at in sorted(counts):
        blocks = -(-counts[at] // block_rows)
        layout.append((at, blocks, tasks))
        tasks += blocks
    plan = F.broadcast(spark.createDataFrame(layout, "at long, blocks int, first int"))  # one row per large leaf
    empty = {"cls": "long", "vec": "array<tinyint>", "leaf": "long", "reach": "float", "base": "long", "kept": "binary", "spans": "array<struct<node:long,side:long,lo:double,hi:double>>"}
    pick = lambda df, is_tree: df.select("task", "at", F.lit(is_tree).alias("is_tree"), *(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    placed = rows.join(plan, "at").withColumn("task", F.col("first") + F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int"))
    copies = trees.join(plan, "at").withColumn("task", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)))
    width = max(1, min(tasks, max(2 * default_parallelism(spark), tasks // 4)))
    both = pick(copies, True).unionByName(pick(placed, False))
    return both.repartitionById(width, F.pmod("task", F.lit(width)).cast("int")).sortWithinPartitions("task", F.col("is_tree").desc()).mapInArrow(job, PASSED)


def _divide(rows: DataFrame, k: int, factor: float, shard_rows: int, leaf_sample: int) -> tuple[DataFrame, list[tuple[DataFrame, set[int]]]]:
    """``(rows(cls, vec, leaf), levels)``: leaves of at most ``shard_rows``, but for those whose rows no tree tells apart, and
    per level the trees of the leaves divided there."""
    spark = rows.sparkSession
    sizes = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}
    following, whole, levels = max(sizes, default=0) + 1, set(), []
    while large := {at: n for at, n in sizes.items() if n > shard_rows and at not in whole}:
        table = F.broadcast(spark.createDataFrame(list(large.items()), "leaf long, n long"))  # one row per large leaf
        share = F.least(F.lit(1.0), F.lit(1.0 * leaf_sample) / F.col("n"))
        sample = rows.join(table, "leaf").filter(F.pmod(F.xxhash64("cls", F.lit(29)), F.lit(1 << 30)) < share * (1 << 30)).select("leaf", "n", "vec")
        trees = cut(sample.repartition(max(1, min(len(large), 4 * default_parallelism(spark))), "leaf").sortWithinPartitions("leaf").mapInArrow(_grow(shard_rows, k, factor), "leaf long, leaves long, kept binary"))
        bases = []
        for r in sorted(trees.select("leaf", "leaves").collect()):
            if r["leaves"] > 1:
                bases.append((r["leaf"], following))
                following += r["leaves"]
        divided = {at for at, _ in bases}
        whole |= large.keys() - divided
        if not divided:
            break
        trees = trees.join(F.broadcast(spark.createDataFrame(bases, "leaf long, base long")), "leaf").withColumnRenamed("leaf", "at")
        chosen = F.broadcast(spark.createDataFrame([(at,) for at in divided], "at long"))
        moved = cut(_with_trees(rows.join(chosen, rows["leaf"] == chosen["at"]), trees, {at: large[at] for at in divided}, shard_rows, _pass_on(factor, False)))
        spans = moved.filter("node is not null").groupBy(F.col("tree").alias("at"), "node", "side").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        spans = spans.groupBy("at").agg(F.collect_list(F.struct("node", "side", "lo", "hi")).alias("spans"))
        levels.append((cut(trees.join(spans, "at", "left")), divided))
        rows = rows.join(chosen, rows["leaf"] == chosen["at"], "left_anti").unionByName(moved.filter("node is null").select("cls", "vec", "leaf"))
        new = {r["leaf"]: r["count"] for r in moved.filter("node is null").groupBy("leaf").count().collect()}
        sizes = {at: n for at, n in sizes.items() if at not in divided} | new
        for at, base in bases:  # a tree that leaves nearly all rows together has told nothing apart
            whole |= {leaf for leaf, n in new.items() if leaf >= base and n > 0.95 * large[at]}
    return rows, levels


def _follow(asks: DataFrame, levels: list[tuple[DataFrame, set[int]]], factor: float, block_rows: int) -> DataFrame:
    """``asks(cls, vec, leaf, reach, at)`` with the visits to divided leaves turned into visits to their parts."""
    spark = asks.sparkSession
    for trees, divided in levels:
        chosen = F.broadcast(spark.createDataFrame([(at,) for at in divided], "at long"))
        visit = asks.join(chosen, "at")
        counts = {r["at"]: r["count"] for r in visit.groupBy("at").count().collect()}
        parts = cut(_with_trees(visit, trees, counts, block_rows, _pass_on(factor, True)))
        asks = asks.join(chosen, "at", "left_anti").unionByName(parts.select("cls", "vec", "leaf", "reach", F.explode("visits").alias("at")))
    return asks


FOUND = "cls long, near array<struct<s:double,id:long>>"


_ENTRY = pa.struct([("s", pa.float64()), ("id", pa.int64())])
HOMED = "cls long, vec array<tinyint>, leaf long, reach float, near array<struct<s:double,id:long>>"


def _lists(ids: np.ndarray, sims: np.ndarray) -> pa.Array:
    full = sims > -2.0
    ends = np.concatenate([[0], np.cumsum(full.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(sims[full]), pa.array(ids[full].astype(np.int64))], fields=list(_ENTRY)))


def _loaded(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray] | None:
    """All rows of a task's partition with their vectors and norms."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None
    table = pa.Table.from_batches(parts).combine_chunks()
    vec = table.column("vec")
    raw = _matrix(vec.chunk(0) if vec.num_chunks else vec.combine_chunks()).astype(np.float32)
    return table, raw, np.sqrt((raw.astype(np.float64) ** 2).sum(axis=1))


def _search_home(k: int, factor: float):
    """Each row among those of its own shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _loaded(batches)
        if held is None:
            return
        table, raw, norms = held
        task, cls = table.column("task").to_numpy(), table.column("cls").to_numpy()
        by_task = np.argsort(task, kind="stable")
        for rows in np.split(by_task, np.flatnonzero(np.diff(task[by_task])) + 1):
            points, lengths, ids = raw[rows], norms[rows], cls[rows]
            tree = VantageTree((points / lengths[:, None]).astype(np.float32), LEAF_ROWS)
            order = np.argsort(ids, kind="stable")
            for some in _blocks(tree, len(rows)):  # of like rows, which prune alike
                found, sims = search_block(tree, points, lengths, ids, points[some], lengths[some], ids[some], k, factor, order=order)
                kth = sims[:, k - 1] if sims.shape[1] >= k else np.full(len(some), -2.0)
                reach = np.where(kth > -2.0, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * kth)) + 1e-3, 2.0).astype(np.float32)
                mine = table.take(pa.array(rows[some]))
                columns = [mine.column(c).combine_chunks() for c in ("cls", "vec", "leaf")]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(reach), _lists(found, sims)], names=["cls", "vec", "leaf", "reach", "near"])

    return run


def _blocks(tree: VantageTree, n: int, size: int = 1024) -> Iterator[np.ndarray]:
    by_leaf = np.concatenate(tree.leaves) if tree.leaves else np.arange(n)
    for start in range(0, len(by_leaf), size):
        yield by_leaf[start : start + size]


def _search(k: int, factor: float):
    """Visitors among the rows of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _loaded(batches)
        if held is None:
            return
        table, raw, norms = held
        task, asks = table.column("task").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        cls, reach = table.column("cls").to_numpy(), table.column("reach").to_numpy()
        by_task = np.argsort(task, kind="stable")
        for rows in np.split(by_task, np.flatnonzero(np.diff(task[by_task])) + 1):
            data, queries = rows[~asks[rows]], rows[asks[rows]]
            if not len(data) or not len(queries):
                continue
            points = raw[data]
            # a tree is not worth its making for a few visitors: one leaf is all rows
            tree = VantageTree((points / norms[data, None]).astype(np.float32), LEAF_ROWS if len(queries) > FEW_VISITORS else len(data))
            leaf = tree.own_leaf((raw[queries] / norms[queries, None]).astype(np.float32))
            queries = queries[np.argsort(leaf, kind="stable")]  # blocks of like queries prune alike
            order = np.argsort(cls[data], kind="stable")
            for start in range(0, len(queries), 1024):
                q = queries[start : start + 1024]
                ids, sims = search_block(tree, points, norms[data], cls[data], raw[q], norms[q], cls[q], k, factor, reach[q], order, fill=False)
                yield pa.RecordBatch.from_arrays([pa.array(cls[q]), _lists(ids, sims)], names=["cls", "near"])

    return run


def _packed(weights: list[float], width: int) -> list[tuple[int, int]]:
    """``(task, bin)``: small tasks share a partition, the largest placed first where there is least."""
    loads, bins = [(0.0, i) for i in range(width)], []
    for t in sorted(range(len(weights)), key=lambda t: -weights[t]):
        load, i = heapq.heappop(loads)
        bins.append((t, i))
        heapq.heappush(loads, (load + weights[t], i))
    return bins


def _placed(both: DataFrame, weights: list[float], rows: int) -> DataFrame:
    """Rows with a ``task`` in partitions of about ``rows`` rows, but at least two for each core."""
    spark = both.sparkSession
    width = max(1, min(len(weights), max(2 * default_parallelism(spark), -(-int(sum(weights)) // rows))))
    places = F.broadcast(spark.createDataFrame(_packed(weights, width), "task int, bin int"))  # 8 bytes per task
    return both.join(places, "task").repartitionById(width, F.col("bin")).drop("bin")


def live_vectors(vectors: DataFrame, dims: int = 384) -> DataFrame:
    """``(page_id, vec)``: of each page the row with the greatest ``vec_id``, if its vector has
    ``dims`` elements, none of them null, and is not all zero. Rows without page are left out."""
    newest = vectors.filter(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max(F.struct("vec_id", "vec")).alias("top"))
    vec = F.col("top.vec")
    good = (F.size(vec) == dims) & F.exists(vec, lambda x: x != 0) & F.forall(vec, lambda x: x.isNotNull())
    return newest.filter(good).select("page_id", vec.cast("array<tinyint>").alias("vec"))


def nearest_pages(vectors: DataFrame, k: int = 10, factor: float = FACTOR, dims: int = 384, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, sample_rows: int = SAMPLE_ROWS, leaf_sample: int = LEAF_SAMPLE, part_factor: float = PART_FACTOR) -> DataFrame:
    """``(page_id, place, neighbour, similarity)``: for every page with a live vector the ``k``
    other pages with the most similar ones, places 1 to ``k``; fewer if there are fewer.

    Equal similarities: the smaller page first. Of a group of equal vectors each member
    gets the group's first ``k`` others, not all of them. Null, short, long and zero
    vectors take no part; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    # equal vectors meet by a digest of 128 bits, so that what is joined and grouped stays small
    digest = [F.xxhash64("vec").alias("d1"), F.xxhash64("vec", F.lit(1)).alias("d2")]
    live = cut(live_vectors(vectors, dims).select("page_id", "vec", *digest))
    classes = cut(live.groupBy("d1", "d2").agg(F.min("page_id").alias("cls"), F.count(F.lit(1)).alias("pages"), F.first("vec").alias("vec")))
    total = classes.count()
    if total == 0:
        return spark.createDataFrame([], "page_id long, place int, neighbour long, similarity double")
    # a sample that depends on the rows only; its bound is sample_rows
    share = min(1.0, 1.1 * sample_rows / total)
    picked = classes.filter(F.pmod(F.xxhash64(F.col("cls"), F.lit(11)), F.lit(1 << 30)) <= int(share * (1 << 30))).select("vec").limit(sample_rows).toArrow()
    sample = _matrix(picked.column("vec").combine_chunks() if picked.num_rows else pa.array([], pa.list_(pa.int8()))) if picked.num_rows else np.zeros((0, dims), dtype=np.int8)
    tree = VantageTree(unit(sample.astype(np.float32)), max(64, int(shard_rows * len(sample) / total)), whole=False, least=LEAST_PART)
    # exact ranges of the distances in each branch, two rows per node of the tree
    spans = classes.select("vec").mapInArrow(_observe(tree), SPANS).groupBy("node", "side").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    _take_spans(tree, map(tuple, spans))
    routed = cut(classes.repartition(max(shuffle_width(spark), -(-total // shard_rows)), "cls").select("cls", "vec").mapInArrow(_route(tree), ROUTED))
    rows, levels = _divide(routed, k, min(factor, part_factor), shard_rows, leaf_sample)
    # on the driver one row per leaf, and leaves are about as large as shards; what could not be divided is by hash
    sizes = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}
    by = F.pmod(F.xxhash64("cls"), F.lit(1 << 40))
    shards, base, weights = [], 0, []
    for leaf in sorted(sizes):
        parts = -(-sizes[leaf] // shard_rows)
        shards.append((leaf, parts, base))
        weights += [sizes[leaf] / parts] * parts
        base += parts
    table = F.broadcast(spark.createDataFrame(shards, "leaf long, parts int, base int"))
    placed = rows.join(table, "leaf").select((F.col("base") + by % F.col("parts")).cast("int").alias("task"), "cls", "vec", "leaf")
    homed = cut(_placed(placed, weights, shard_rows).mapInArrow(_search_home(k, factor), HOMED))
    asks = homed.select("cls", "vec", "reach").mapInArrow(_ask(tree, factor), ASKED).select("cls", "vec", "leaf", "reach", F.explode("visits").alias("at"))
    asks = _follow(asks, levels, min(factor, part_factor), shard_rows)
    asks = asks.join(table.select(F.col("leaf").alias("at"), "parts"), "at").filter((F.col("at") != F.col("leaf")) | (F.col("parts") > 1)).drop("parts")
    asks = cut(asks)  # the visits to other shards, counted and then made
    asked = {r["at"]: r["count"] for r in asks.groupBy("at").count().collect()}
    layout, tasks, weights = [], 0, []
    for leaf, parts, _ in shards:
        blocks = -(-asked.get(leaf, 0) // query_rows)
        if blocks:
            layout.append((leaf, parts, blocks, tasks))
            weights += [sizes[leaf] / parts + asked[leaf] / blocks] * (parts * blocks)
            tasks += parts * blocks
    merged = homed.select("cls", "near")
    if tasks:
        plan = F.broadcast(spark.createDataFrame(layout, "at long, parts int, blocks int, first int"))
        data = homed.select("cls", "vec", "reach", F.col("leaf").alias("at"), by.alias("h")).join(plan, "at")
        data = data.select((F.col("first") + (F.col("h") % F.col("parts")) * F.col("blocks")).alias("task"), "blocks", "cls", "vec", "reach")
        data = data.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: (F.col("task") + b).cast("int"))).alias("task"), F.lit(False).alias("asks"), "cls", "vec", "reach")
        asks = asks.select("*", by.alias("h"), F.pmod(F.xxhash64(F.col("cls"), F.lit(5)), F.lit(1 << 40)).alias("g")).join(plan, "at")
        asks = asks.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        asks = asks.filter((F.col("at") != F.col("leaf")) | (F.col("part") != F.col("h") % F.col("parts")))  # the own shard has been searched
        asks = asks.select((F.col("first") + F.col("part") * F.col("blocks") + F.col("g") % F.col("blocks")).cast("int").alias("task"), F.lit(True).alias("asks"), "cls", "vec", "reach")
        found = _placed(data.unionByName(asks), weights, shard_rows + query_rows).mapInArrow(_search(k, factor), FOUND)
        merged = merged.unionByName(found)
    merged = merged.groupBy("cls").agg(F.flatten(F.collect_list("near")).alias("near"))
    # best k per class, then classes to members
    worse_last = lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    merged = merged.select("cls", F.slice(F.array_sort("near", worse_last), 1, k).alias("near"))
    # a class may hold a third of all pages: the large ones, a bounded number, are sent to their members
    large = F.col("pages") >= max(LEAST_LARGE, int(LARGE_CLASS * live.count()))
    keys = classes.select("d1", "d2", "cls", "pages")
    held = live.select("page_id", "d1", "d2").join(F.broadcast(keys.filter(large)), ["d1", "d2"], "left")
    known = held.filter("cls is not null").select("page_id", "cls", "pages")
    members = known.unionByName(held.filter("cls is null").select("page_id", "d1", "d2").join(keys.filter(~large), ["d1", "d2"]).select("page_id", "cls", "pages"))
    places = Window.partitionBy("cls").orderBy("page_id")
    heads = members.filter("pages > 1").select("cls", "page_id").withColumn("p", F.row_number().over(places)).filter(F.col("p") <= k + 1)
    heads = heads.groupBy("cls").agg(F.sort_array(F.collect_list("page_id")).alias("members"))
    near = merged.select("cls", F.explode("near").alias("n")).select("cls", F.col("n.id").alias("other"), F.col("n.s").alias("s"))
    near = near.unionByName(heads.select("cls", F.col("cls").alias("other"), F.lit(1.0).alias("s")))
    near = near.join(heads.select(F.col("cls").alias("other"), "members"), "other", "left").select("cls", "s", F.coalesce("members", F.array("other")).alias("pages"))
    lists = near.groupBy("cls").agg(F.flatten(F.collect_list(F.transform("pages", lambda p: F.struct(F.col("s"), p.alias("id"))))).alias("near"))
    lists = lists.select("cls", F.slice(F.array_sort("near", worse_last), 1, 3 * k + 1).alias("near"))
    of_large = F.broadcast(lists.join(F.broadcast(keys.filter(large).select("cls")), "cls", "left_semi"))
    many = members.filter(large).select("page_id", "cls").join(of_large, "cls")
    out = many.unionByName(members.filter(~large).select("page_id", "cls").join(lists, "cls")).select("page_id", F.slice(F.filter("near", lambda n: n["id"] != F.col("page_id")), 1, k).alias("near"))
    out = out.select("page_id", F.posexplode("near").alias("p", "n"))
    return out.select("page_id", (F.col("p") + 1).cast("int").alias("place"), F.col("n.id").alias("neighbour"), F.col("n.s").alias("similarity"))


def similar_pairs(vectors: DataFrame, least: float = 0.80, k: int = 10, factor: float = FACTOR) -> DataFrame:
    """``(page_a, page_b)``, ``page_a < page_b``: pairs with a similarity of at least ``least``
    of which one is among the ``k`` most similar of the other."""
    near = nearest_pages(vectors, k, factor).filter(F.col("similarity") >= least)
    return near.select(F.least("page_id", "neighbour").alias("page_a"), F.greatest("page_id", "neighbour").alias("page_b")).distinct()
