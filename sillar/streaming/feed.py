"""The change feed as a stream.

Each micro-batch is reduced to the last event per title and merged into a table of the newest events, kept as
numbered versions in a folder. A batch that runs again writes the same version again, so a restart loses and repeats
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sillar.operators.feed import latest_events
from sillar.session import delete


def _version(folder: str, number: int) -> str:
    return f"{folder}/v={number:08d}"


def _read(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """Version ``number`` or the last one before it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(path)]
    done = sorted(n for n in done if n.startswith("v=") and n <= f"v={number:08d}" and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))
    return spark.read.parquet(f"{folder}/{done[-1]}") if done else None


def newest_events(spark: SparkSession, folder: str) -> DataFrame | None:
    return _read(spark, folder, 99_999_999)


def follow(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts following a streaming frame of events ``(ts, seq, title, kind, target)`` to its present end."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _read(spark, folder, number - 1) if number else None
        both = batch.select("ts", "seq", "title", "kind", "target")
        both = both if before is None else both.unionByName(before.select(*both.columns))
        latest_events(both).write.mode("overwrite").parquet(_version(folder, number))
        if number > 1:  # the version before stays, as a batch may be repeated
            delete(spark, _version(folder, number - 2))

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
