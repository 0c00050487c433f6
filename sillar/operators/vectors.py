"""int8 vectors: quantization, exact top-k by blocks, liveness, work queue, embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillar.functions.text import bind
from sillar.session import children, default_parallelism, exists

DATA_ROWS = 65_536


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))


def head(vec: Column, dims: int) -> Column:
    return F.transform(F.slice(vec, 1, dims), lambda x: x.cast("double"))


def normalised(vec: Column, dims: int) -> Column:
    """The first ``dims`` elements at length one; null for zero vectors."""
    cut = head(vec, dims)
    # bound: else the length would be summed up again for each element
    return bind(norm(cut), lambda length: F.when(length > 0, F.transform(cut, lambda x: x / length)))


def quantize(vec: Column, dims: int) -> Column:
    """The first ``dims`` elements at length one, times 127, rounded half to even, within ±127."""
    return F.transform(normalised(vec, dims), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x * 127.0))).cast("tinyint"))


def stored_dims(vectors: DataFrame) -> int | None:
    """The length of the stored vectors, by the first that is found; None without any."""
    row = vectors.filter("vec is not null").select(F.size("vec").alias("n")).first()
    return row["n"] if row else None


def of_dims(vectors: DataFrame, dims: int) -> DataFrame:
    """Vectors of the configured length; others are passed over."""
    return vectors.filter(F.size("vec") == dims)


def newer_than(vectors: DataFrame, last_id: int) -> DataFrame:
    """What an index that has read up to ``last_id`` has still to read, in order."""
    return vectors.filter(F.col("vec_id") > last_id).orderBy("vec_id")


def live(vectors: DataFrame, pages: DataFrame) -> DataFrame:
    """Vectors of pages that exist."""
    return vectors.join(pages.select("page_id").distinct(), "page_id", "left_semi")


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def _nearest_in_blocks(k: int):
    def answers(batch: pa.RecordBatch, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        asked = batch.column("id").to_numpy()
        queries = _matrix(batch.column("unit"), np.float64)
        n = len(asked)
        rough = queries.astype(np.float32)
        of, best, names = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)
        floor = np.full(n, -np.inf)  # what the k-th of each list has
        for start in range(0, len(ids), 8192):
            some, some_ids = rows[start : start + 8192], ids[start : start + 8192]
            near = some.astype(np.float32)
            sims = rough @ near.T
            # single precision is off by no more than this, for unit queries; rounding adds its half
            slack = 127e-6 + 4 * (queries.shape[1] + 2) * 2.0**-24 * float(np.sqrt((near * near).sum(axis=1).max()))
            least = floor * 127.0
            if len(some) > k and not np.isfinite(floor).all():
                least = np.maximum(least, np.partition(sims, len(some) - k, axis=1)[:, len(some) - k])
            at, col = np.nonzero(~(sims < (least - slack).astype(np.float32)[:, None]))  # a query that is no number has all
            exact = np.zeros(len(at))
            for i in range(0, len(at), 65_536):
                j = slice(i, i + 65_536)
                exact[j] = np.einsum("ij,ij->i", queries[at[j]], some[col[j]].astype(np.float64))
            of, best, names = np.concatenate([of, at]), np.concatenate([best, np.round(exact / 127.0, 6)]), np.concatenate([names, some_ids[col]])
            order = np.lexsort((names, -best, of))
            of, best, names = of[order], best[order], names[order]
            kept = np.arange(len(of)) - np.searchsorted(of, of) < k
            of, best, names = of[kept], best[kept], names[kept]
            full = np.flatnonzero(np.bincount(of, minlength=n) == k)
            floor[full] = best[np.searchsorted(of, full, side="right") - 1]
        return pa.RecordBatch.from_arrays([pa.array(asked[of]), pa.array(names), pa.array(best)], names=["qid", "id", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block in the partition first the rows come, which are held, then the queries, which pass."""
        block, held, ids, rows = None, [], np.zeros(0, dtype=np.int64), np.zeros((0, 0), dtype=np.int8)
        for b in batches:
            blocks, asks = b.column("block").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, stop in zip([0, *edges], [*edges, b.num_rows]):
                if start == stop:
                    continue
                part = b.slice(start, stop - start)
                if blocks[start] != block:
                    block, held, ids = int(blocks[start]), [], ids[:0]
                if not asks[start]:
                    held.append((part.column("id").to_numpy(), _matrix(part.column("vec"), np.int8)))
                    continue
                if held:
                    ids, rows = (np.concatenate(x) for x in zip(*held))
                    held = []
                if len(ids):
                    for at in range(0, part.num_rows, 1024):
                        yield answers(part.slice(at, 1024), ids, rows)

    return run


def exact_top_k(queries: DataFrame, data: DataFrame, k: int, data_rows: int = DATA_ROWS, rows: int | None = None) -> DataFrame:
    """``(qid, pos, id, similarity)``: for ``queries(qid, vec)`` (unit length, not quantized) the ``k`` rows of
    ``data(id, vec)`` (quantized) with the greatest dot product over 127.

    A stated query set against all rows, in blocks of about ``data_rows``: a block is held by one task as int8 and the
    queries pass it by; the lists are merged per query. ``rows`` is the number of rows, counted if it is not given.
    Equal similarities go to the smaller id. Null vectors take no part.
    """
    data, queries = data.filter("vec is not null and id is not null"), queries.filter("vec is not null and qid is not null")
    blocks = max(1, -(-(data.count() if rows is None else rows) // data_rows))
    left = data.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), F.col("id").cast("long"), F.col("vec").cast("array<tinyint>").alias("vec"), F.lit(None).cast("array<double>").alias("unit"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), F.col("qid").cast("long").alias("id"), F.lit(None).cast("array<tinyint>").alias("vec"), F.transform("vec", lambda x: x.cast("double")).alias("unit"))
    found = left.unionByName(right).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks").mapInArrow(_nearest_in_blocks(k), "qid long, id long, similarity double")
    by = Window.partitionBy("qid").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("pos", F.row_number().over(by)).filter(F.col("pos") <= k).select("qid", "pos", "id", "similarity")


def embedding_queue(pages: DataFrame, vectors: DataFrame, chunks: DataFrame, most: int | None = None, after: tuple[int, int] | None = None) -> DataFrame:
    """``(page_id, size, input)``: pages without a vector with what is to be embedded: the title and the page's first
    chunk. A null size counts as 0. With ``most`` the first so many of one round of work, longest first, then by id;
    with ``after`` those that follow a ``(size, page_id)`` in this order."""
    first = chunks.filter("page_id is not null").groupBy("page_id").agg(F.min(F.struct("chunk_id", "text")).alias("c")).select("page_id", F.col("c.text").alias("text"))
    from sillar.functions.text import embedding_text

    waiting = pages.join(vectors.select("page_id").distinct(), "page_id", "left_anti")
    length = F.coalesce("size", F.lit(0))
    if after is not None:
        waiting = waiting.filter((length < after[0]) | ((length == after[0]) & (F.col("page_id") > after[1])))
    if most is not None:  # before the texts are joined
        waiting = waiting.orderBy(length.desc(), "page_id").limit(most)
    waiting = waiting.join(first, "page_id", "left").select("page_id", "size", embedding_text(F.coalesce("title", F.lit("")), F.col("text")).alias("input"))
    return waiting if most is None else waiting.orderBy(F.coalesce("size", F.lit(0)).desc(), "page_id")


def stored_vectors(spark: SparkSession, store: str) -> DataFrame:
    """``(vec_id, page_id, vec)`` of all rounds that were completed."""
    done = [f"{store}/{n}" for n in children(spark, store) if n.startswith("round=") and exists(spark, f"{store}/{n}/_SUCCESS")]
    reader = spark.read.schema("vec_id long, page_id long, vec array<tinyint>")
    return reader.parquet(*done) if done else spark.createDataFrame([], "vec_id long, page_id long, vec array<tinyint>")


def embed_pending(pages: DataFrame, chunks: DataFrame, store: str, embedder: Callable[[list[str]], np.ndarray], dims: int, round_rows: int = 2000, batch: int = 32, most: int | None = None, stop: Callable[[], bool] = lambda: False) -> int:
    """Embeds the pages without a vector, longest first, in rounds of ``round_rows`` that are each written to ``store``.

    What is stored is not embedded again, so the work goes on where it ended, whatever ended it. ``most`` bounds the
    pages of one call, ``stop`` is asked between rounds. Gives the number of pages embedded.
    """
    spark = pages.sparkSession
    made = 0
    while not stop() and (most is None or made < most):
        have = stored_vectors(spark, store)
        size = round_rows if most is None else min(round_rows, most - made)
        todo = embedding_queue(pages, have, chunks, size)
        number = 1 + max((int(n.split("=")[1]) for n in children(spark, store) if n.startswith("round=")), default=0)
        base = have.agg(F.coalesce(F.max("vec_id"), F.lit(0)).alias("v")).first()["v"]
        order = Window.orderBy(F.col("page_id"))  # the rows of one round only
        spread = todo.repartition(default_parallelism(spark))
        rows = embed(spread, embedder, dims, batch).withColumn("vec_id", F.row_number().over(order) + F.lit(base)).select(F.col("vec_id").cast("long"), "page_id", "vec")
        rows.write.parquet(f"{store}/round={number:06d}")
        count = spark.read.parquet(f"{store}/round={number:06d}").count()
        if not count:
            break
        made += count
    return made


def embed(rows: DataFrame, embedder: Callable[[list[str]], np.ndarray], dims: int, batch: int = 32) -> DataFrame:
    """``(page_id, vec)`` of a queue: the embedder gets ``batch`` texts at a time and the result is quantized."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, batch):
                some = b.slice(start, batch)
                vectors = np.asarray(embedder(some.column("input").to_pylist()), dtype=np.float64)[:, :dims]
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                ints = np.clip(np.rint(vectors * 127), -127, 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([some.column("page_id"), pa.array(list(ints), pa.list_(pa.int8()))], names=["page_id", "vec"])

    return rows.select("page_id", "input").mapInArrow(run, "page_id long, vec array<tinyint>")


def embed_queries(queries: DataFrame, embedder: Callable[[list[str]], np.ndarray], dims: int, batch: int = 32) -> DataFrame:
    """``(qid, vec)`` of unit length, not quantized. A batch that the embedder fails on gives no vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, batch):
                some = b.slice(start, batch)
                try:
                    found = np.asarray(embedder(some.column("query").to_pylist()), dtype=np.float64)[:, :dims]
                except Exception:
                    continue
                found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([some.column("qid"), pa.array(list(found), pa.list_(pa.float64()))], names=["qid", "vec"])

    return queries.select(F.col("qid").cast("long").alias("qid"), F.coalesce("query", F.lit("")).alias("query")).mapInArrow(run, "qid long, vec array<double>")


def hash_embedder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder for tests: keywords hashed to signed axes."""
    import hashlib

    from sillar.functions.text import py_keywords

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, text in enumerate(texts):
            for word in py_keywords(text):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % dims] += 1 if h >> 63 else -1
        return out

    return run


def letter_embedder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An embedder that SQL can follow: how often characters occur, by code point modulo ``dims``."""

    def run(texts: list[str]) -> np.ndarray:
        return np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) % dims, minlength=dims) for t in texts]).astype(np.float64)

    return run
