"""A search index that is kept: segments of postings in a folder, upkeep for changed pages, compaction.

A segment is a folder ``<number>-<whole or part>-<buckets>`` with ``postings`` (Parquet, partitioned by bucket, sorted by
key and word) and ``gone`` (the pages whose rows in earlier segments no longer count), which is written last: a segment
without it was broken off and is passed over. Nothing is ever overwritten, so a search that runs sees the index as it
was; opening an index reads names only.

An update writes the postings of the changed pages only. ``compact`` folds all segments into one, from their postings;
``sweep`` deletes what no search reads any more.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillar.operators.search import POSTINGS, Index, postings_of, unique_rows
from sillar.session import children, delete, exists

_NAME = re.compile(r"(\d{8})-(whole|part)-(\d+)")


def _segments(spark: SparkSession, folder: str) -> list[str]:
    """The complete segments from the last whole one on, oldest first."""
    names = sorted(n for n in children(spark, folder) if _NAME.fullmatch(n) and exists(spark, f"{folder}/{n}/gone/_SUCCESS"))
    first = max((i for i, n in enumerate(names) if "-whole-" in n), default=0)
    return names[first:]


def _write(postings: DataFrame, gone: DataFrame | None, folder: str, buckets: int, whole: bool) -> None:
    spark = postings.sparkSession
    used = [int(m[1]) for m in map(_NAME.fullmatch, children(spark, folder)) if m]
    place = f"{folder}/{1 + max(used, default=-1):08d}-{'whole' if whole else 'part'}-{buckets}"
    # rebalance: a bucket with a word that every row has is written by several tasks
    postings.hint("rebalance", "b").sortWithinPartitions("b", "key", "word", "chunk_id").write.partitionBy("b").parquet(f"{place}/postings")
    none = spark.createDataFrame([], "page_id long")
    (none if gone is None else gone.select(F.col("page_id").cast("long")).filter("page_id is not null").distinct()).write.parquet(f"{place}/gone")


def write_index(corpus: DataFrame, folder: str, buckets: int = 16) -> None:
    """A new whole segment of a corpus. ``buckets`` should grow with the corpus: about one for each GB of it."""
    _write(postings_of(unique_rows(corpus), buckets), None, folder, buckets, True)


def update_index(spark: SparkSession, folder: str, rows: DataFrame, gone: DataFrame) -> None:
    """Replaces the rows of pages: ``gone(page_id)`` lose what they have, ``rows`` (shaped as a corpus) come. A changed page
    is in both, a deleted one in ``gone`` only. The work is in proportion to ``rows``."""
    buckets = int(_segments(spark, folder)[-1].split("-")[-1])
    _write(postings_of(unique_rows(rows), buckets), gone, folder, buckets, False)


def read_index(corpus: DataFrame, folder: str) -> Index:
    """The index as it is now. Of earlier segments the rows of pages that later ones replaced are left out by one
    anti-join each; there are as many segments as updates since the last ``compact``."""
    spark = corpus.sparkSession
    names = _segments(spark, folder)
    if not names:
        raise FileNotFoundError(f"no index in {folder}")
    buckets = int(names[-1].split("-")[-1])
    parts = []
    for i, name in enumerate(names):
        part = spark.read.schema(POSTINGS).parquet(f"{folder}/{name}/postings").select(*(f.split(" ")[0] for f in POSTINGS.split(", ")))
        if i + 1 < len(names):
            gone = spark.read.schema("page_id long").parquet(*(f"{folder}/{n}/gone" for n in names[i + 1 :])).distinct()
            part = part.join(gone, "page_id", "left_anti").select(*part.columns)
        parts.append(part)
    return Index(reduce(DataFrame.unionByName, parts), unique_rows(corpus), buckets)


def compact(corpus: DataFrame, folder: str) -> None:
    index = read_index(corpus, folder)
    _write(index.postings, None, folder, index.buckets, True)


def sweep(spark: SparkSession, folder: str) -> None:
    """Deletes the segments before the last whole one and those that were broken off. No search may be running."""
    live = set(_segments(spark, folder))
    for name in children(spark, folder):
        if _NAME.fullmatch(name) and name not in live:
            delete(spark, f"{folder}/{name}")


def kept_index(corpus: DataFrame, root: str, bucket_bytes: int = 1 << 30) -> Index:
    """The index of a corpus read from files, made at the first call and read at later ones. It is known by the names,
    sizes and times of the files, so a changed corpus gets a new one. A bucket for each ``bucket_bytes`` of them."""
    spark = corpus.sparkSession
    files = sorted(corpus.inputFiles())
    jvm = spark._jvm.org.apache.hadoop.fs
    seen, total = hashlib.sha256(), 0
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        path = jvm.Path(folder)
        for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            seen.update(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}".encode())
            total += status.getLen()
    seen.update("\n".join(files).encode())
    place = f"{root}/search-index-{seen.hexdigest()[:32]}"
    if not _segments(spark, place):
        write_index(corpus, place, max(16, -(-total // bucket_bytes)))
    return read_index(corpus, place)
