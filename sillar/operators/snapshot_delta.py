"""What changed between consecutive full snapshots of a table.

Every snapshot (``gen``) lists all records that existed then. The operator
reports, per snapshot but the first, the keys added, removed or changed against
the snapshot before it.

Plan
----
1. ``(gen, key)`` is reduced to its newest row by a hash aggregate, so copies are
   folded before they are shuffled and a key repeated without end cannot crowd a
   task. What travels is compact: a 16-byte key digest and an 8-byte digest of
   the value, never the value itself.
2. The compact rows are bucketed by key digest. Each bucket sorts its digests in
   numpy per snapshot and takes set differences with ``searchsorted``.
3. Only the digests that differ go back to the table for the full key: the second and last time it is read. While
   they are few (``FEW_KEYS``) they are sent to all executors and no other title is shuffled; beyond that titles
   and digests meet by a shuffle.

The number of buckets follows the row count (``rows_per_bucket``), so a bucket
holds about 30 bytes times that many rows, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillar.session import cut, shuffle_width

DELTA_SCHEMA = "gen int, key binary, delta string"
ADDED, REMOVED, CHANGED = "added", "removed", "changed"
#: Up to so many differing keys, of 16 bytes, are sent to all executors.
FEW_KEYS = 1_000_000


def tidy_title(title: Column) -> Column:
    """Spaces for underscores, single, none at the ends."""
    return F.trim(F.regexp_replace(title, r"[\s_]+", " "))


def hash_value(spelling: Column) -> Column:
    """One spelling of a fingerprint: no algorithm prefix, no padding, lower case.
    Blank is null."""
    bare = F.lower(F.trim(F.regexp_replace(spelling, r"^\s*(?:0[xX]|[A-Za-z][A-Za-z0-9_-]*\s*:)|\s+", "")))
    return F.nullif(bare, F.lit(""))


def delta_of_bucket(gens: np.ndarray, keys: np.ndarray, values: np.ndarray, known: np.ndarray, order: list[int]):
    """Set differences of one bucket.

    ``keys`` are 16-byte digests, ``values`` 64-bit digests valid where ``known``.
    ``order`` has all snapshots of the table, ascending; one without rows in this
    bucket is empty here. Yields ``(gen, keys, delta)``.
    """
    rank = np.searchsorted(np.asarray(order, dtype=np.int64), gens)
    by = np.lexsort((keys, rank))
    rank, keys, values, known = rank[by], keys[by], values[by], known[by]
    ends = np.searchsorted(rank, np.arange(len(order) + 1))
    for i in range(1, len(order)):
        a, b = slice(ends[i - 1], ends[i]), slice(ends[i], ends[i + 1])
        old, new = keys[a], keys[b]
        at = np.searchsorted(old, new)
        inside = at < len(old)
        both = np.zeros(len(new), dtype=bool)
        both[inside] = old[at[inside]] == new[inside]
        yield order[i], new[~both], ADDED
        gone = np.ones(len(old), dtype=bool)
        gone[at[both]] = False
        yield order[i], old[gone], REMOVED
        was = at[both]
        differs = known[a][was] & known[b][both] & (values[a][was] != values[b][both])
        yield order[i], new[both][differs], CHANGED


def _bucket_task(order: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("gen").to_numpy(zero_copy_only=False), _digests(b.column("key")), b.column("value").fill_null(0).to_numpy(zero_copy_only=False), ~np.asarray(b.column("value").is_null())) for b in batches if b.num_rows]
        if not parts:
            return
        gens, keys, values, known = (np.concatenate(x) for x in zip(*parts))
        for gen, found, delta in delta_of_bucket(gens, keys, values, known, order):
            for start in range(0, len(found), 1 << 16):
                some = found[start : start + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), gen, dtype=np.int32)), _binary(some), pa.array([delta] * len(some))],
                    names=["gen", "key", "delta"],
                )

    return run


def _digests(column: pa.Array) -> np.ndarray:
    """A binary column of 16-byte values as a fixed-width array, without a Python loop."""
    return np.frombuffer(column.cast(pa.binary(16)).buffers()[1], dtype="S16", count=len(column) + column.offset)[column.offset :]


def _binary(digests: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(digests), [None, pa.py_buffer(np.ascontiguousarray(digests).tobytes())]).cast(pa.binary())


def snapshot_delta(
    rows: DataFrame,
    key: Column,
    value: Column,
    gen: str = "gen",
    version: str = "snapshot_ts",
    key_name: str = "title",
    rows_per_bucket: int = 2_000_000,
    few_keys: int = FEW_KEYS,
) -> DataFrame:
    """``(gen, <key_name>, delta)`` for every snapshot but the first.

    * Rows whose ``gen`` or ``key`` is null belong to no snapshot or record.
    * If a snapshot lists a record twice, the row with the greatest ``version``
      counts; a null version is the earliest. Equal versions: a row with a value
      goes before one without, then the greater value digest, so the result is
      the same on every run.
    * ``changed`` needs a value on both sides; a null value tells of no change.
    * The snapshot before is the next lower ``gen`` that exists; holes are skipped.
    * An empty table or a single snapshot gives no rows. Other columns are not read.

    The list of snapshots is brought to the driver: one integer per delivery.
    """
    spark = rows.sparkSession
    slim = rows.select(F.col(gen).cast("int").alias("gen"), key.alias("__name"), F.col(version).alias("__version"), value.alias("__value"))
    slim = slim.filter(F.col("gen").isNotNull() & F.col("__name").isNotNull())
    newest = (
        slim.select("gen", F.unhex(F.md5(F.col("__name").cast("binary"))).alias("key"), F.unix_micros(F.col("__version").cast("timestamp")).alias("v"), F.when(F.col("__value").isNotNull(), F.xxhash64("__value")).alias("value"))
        .groupBy("gen", "key")
        .agg(F.max(F.struct(F.coalesce("v", F.lit(-(2**63))).alias("v"), F.col("value").isNotNull().alias("known"), F.coalesce("value", F.lit(0)).alias("value"))).alias("top"))
        .select("gen", "key", F.when(F.col("top.known"), F.col("top.value")).alias("value"))
    )
    newest = cut(newest)  # compact rows; the list of snapshots comes from them, not from the table again
    counts = newest.groupBy("gen").count().collect()
    order = sorted(r["gen"] for r in counts)
    buckets = max(shuffle_width(spark), -(-sum(r["count"] for r in counts) // rows_per_bucket))
    deltas = cut(newest.repartition(buckets, "key").mapInArrow(_bucket_task(order), DELTA_SCHEMA))
    wanted = deltas.select("key").distinct()
    if deltas.count() <= few_keys:
        wanted = F.broadcast(wanted)
    names = slim.select(F.unhex(F.md5(F.col("__name").cast("binary"))).alias("key"), F.col("__name").alias(key_name))
    names = names.join(wanted, "key", "left_semi").distinct()
    return deltas.join(names, "key").select("gen", key_name, "delta")


def page_deltas(pages: DataFrame) -> DataFrame:
    """``snapshot_delta`` of an article table with ``title``, ``hash``, ``gen`` and ``snapshot_ts``."""
    return snapshot_delta(pages, tidy_title(F.col("title")), hash_value(F.col("hash")))
