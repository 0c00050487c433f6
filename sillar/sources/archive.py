"""Archives of entries: articles as HTML, and redirects.

``entries``: ``entry_id, path, title, mime, html, target``; ``target`` is the title a redirect leads to, else null. Any
source with these columns will do; :class:`JsonArchive` is a data source that splits a file of JSON lines into
ranges of entries.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sillar.functions import text as T
from sillar.operators.corpus import article_filter, redirect_rows
from sillar.session import exists
from sillar.sources.html import html_to_text

ENTRY_SCHEMA = "entry_id long, path string, title string, mime string, html string, target string"
RANGE_ENTRIES = 2000


def articles(entries: DataFrame) -> DataFrame:
    """``(title, text, hash, images)`` of the articles worth keeping: HTML, no redirect, 200 characters or more, no
    anchor in the title."""
    pages = entries.filter(F.col("target").isNull() & F.col("mime").startswith("text/html"))
    parsed = html_to_text(pages, "title", "html", "path")
    return article_filter(parsed).select("title", "text", T.content_hash(F.col("text")).alias("hash"), "images")


def redirects(entries: DataFrame) -> DataFrame:
    """``(title_key, target)``; only three columns are read."""
    return redirect_rows(entries.filter(F.col("target").isNotNull()).select("path", "title", "target"))


def archive_date(meta_date: str | None, files: DataFrame | None = None) -> float | None:
    """Seconds since the epoch: the archive's own date, else the newest modification time of its files."""
    import datetime as dt

    if meta_date:
        return dt.datetime.strptime(meta_date, "%Y-%m-%d").replace(tzinfo=dt.timezone.utc).timestamp()
    if files is None:
        return None
    row = files.select(F.max(F.col("_metadata.file_modification_time").cast("double")).alias("t")).first()
    return row["t"]


class _Range(InputPartition):
    def __init__(self, start: int, entries: int, offset: int):
        super().__init__((start, entries, offset))
        self.start, self.entries, self.offset = start, entries, offset


def _opened(path: str):
    """A file of any file system that pyarrow knows, by its address or as a local path."""
    import io

    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return io.BufferedReader(system.open_input_file(name), 1 << 20)


class _JsonReader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def partitions(self) -> list[InputPartition]:
        """Ranges of entries with the byte each begins at, so that a task reads its own part only."""
        ranges, count, at = [], 0, 0
        with _opened(self.path) as lines:
            for line in lines:
                if count % self.step == 0:
                    ranges.append((count, at))
                count, at = count + 1, at + len(line)
        return [_Range(start, self.step, offset) for start, offset in ranges] or [_Range(0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with _opened(self.path) as lines:
            lines.seek(partition.offset)
            for i, line in zip(range(partition.start, partition.start + partition.entries), lines):
                try:
                    e = json.loads(line)
                    yield (i, e.get("path"), e["title"], e.get("mime"), e.get("html"), e.get("target"))
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue  # a damaged entry does not stop an import


class JsonArchive(DataSource):
    """``spark.dataSource.register(JsonArchive)``, then ``spark.read.format("json_archive").load(path)``: one task per
    range of entries; damaged entries are passed over. The file must be reachable from every executor."""

    @classmethod
    def name(cls) -> str:
        return "json_archive"

    def schema(self) -> str:
        return ENTRY_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _JsonReader(self.options["path"], int(self.options.get("range", RANGE_ENTRIES)))


class _ZimReader(DataSourceReader):
    """Entries by their number; needs the ``libzim`` package on the executors, which nothing else here does."""

    def __init__(self, path: str, step: int, start: int, open_archive=None):
        self.path, self.step, self.start, self.open_archive = path, step, start, open_archive

    def _archive(self):
        if self.open_archive is not None:
            return self.open_archive(self.path)
        from libzim.reader import Archive

        return Archive(self.path)

    def partitions(self) -> list[InputPartition]:
        total = self._archive().all_entry_count
        return [_Range(at, min(self.step, total - at), 0) for at in range(self.start, total, self.step)] or [_Range(0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        archive = self._archive() if partition.entries else None
        for i in range(partition.start, partition.start + partition.entries):
            try:
                entry = archive._get_entry_by_id(i)
                if entry.is_redirect:
                    yield (i, entry.path, entry.title, None, None, entry.get_redirect_entry().title)
                    continue
                item = entry.get_item()
                html = bytes(item.content).decode("utf-8", "replace") if item.mimetype.startswith("text/html") else None
                yield (i, entry.path, entry.title, item.mimetype, html, None)
            except Exception:
                continue  # a damaged entry does not stop an import


class ZimArchive(DataSource):
    """``spark.read.format("zim_archive").option("start", id).load(path)``: one task per range of entries. The file must be
    reachable by the same path from every executor."""

    @classmethod
    def name(cls) -> str:
        return "zim_archive"

    def schema(self) -> str:
        return ENTRY_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ZimReader(self.options["path"], int(self.options.get("range", RANGE_ENTRIES)), int(self.options.get("start", 0)))


def import_in_steps(entries: Callable[[int, int], DataFrame], total: int, folder: str, spark: SparkSession, step: int = 100 * RANGE_ENTRIES, stop: Callable[[], bool] = lambda: False) -> tuple[DataFrame | None, bool]:
    """``(articles, complete)``: the articles of ``entries(start, end)`` step by step, each step written to ``folder``; steps that
    were written are not read again, so an import goes on at the entry where it ended. A folder belongs to one archive
    (``corpus.next_generation``)."""
    starts = list(range(0, total, step))
    for start in starts:
        place = f"{folder}/from={start:012d}"
        if exists(spark, f"{place}/_SUCCESS"):
            continue
        if stop():
            break
        articles(entries(start, min(start + step, total))).write.mode("overwrite").parquet(place)
    done = [f"{folder}/from={s:012d}" for s in starts if exists(spark, f"{folder}/from={s:012d}/_SUCCESS")]
    return (spark.read.parquet(*done) if done else None), len(done) == len(starts)
