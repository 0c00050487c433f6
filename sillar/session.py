"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sillar")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a session on a single machine may leave it unset; it then gets a
    temporary folder of its own. On a cluster an unset folder is an error.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = os.path.join(tempfile.mkdtemp(prefix="sillar-"), "checkpoints")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that its rows stay
    the same however often they are used and whichever executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def default_parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, place = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


class Kept:
    """A few named texts in a folder, for cursors. A value is written beside the old one and then takes its place."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def _values(self) -> dict[str, str]:
        done = sorted(n for n in children(self._spark, self._folder) if n.startswith("v=") and exists(self._spark, f"{self._folder}/{n}/_SUCCESS"))
        if not done:
            return {}
        return {r["key"]: r["value"] for r in self._spark.read.schema("key string, value string").parquet(f"{self._folder}/{done[-1]}").collect()}

    def get(self, key: str, default: str | None = None) -> str | None:
        return self._values().get(key, default)

    def set(self, key: str, value: str) -> None:
        old = [n for n in children(self._spark, self._folder) if n.startswith("v=")]
        number = 1 + max((int(n[2:]) for n in old), default=0)
        rows = list((self._values() | {key: value}).items())
        self._spark.createDataFrame(rows, "key string, value string").coalesce(1).write.parquet(f"{self._folder}/v={number:012d}")
        for name in old:
            delete(self._spark, f"{self._folder}/{name}")

    def setdefault(self, key: str, value: str) -> None:
        if self.get(key) is None:
            self.set(key, value)

    def clear(self) -> None:
        delete(self._spark, self._folder)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores, if it comes straight from fewer pieces than there are cores; else as it is.

    For work in Python that costs far more than moving the rows. Large tables come in more pieces than cores and are
    not moved; a plan that shuffles already is left alone.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = default_parallelism(df.sparkSession)
    return df.repartition(cores) if plan.outputPartitioning().numPartitions() < cores else df
