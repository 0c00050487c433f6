"""Parquet tables in one folder, ``<folder>/<name>.parquet``, a file or a folder of files each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of its files."""
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
