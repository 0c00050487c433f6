"""Versioned corpus maintenance: snapshot merge, upserts and deletes, redirects, sizes, statistics.

Tables are immutable; every change returns the new version of a table (copy on write).

``pages``: ``page_id, title, revid, snapshot_ts, size, hash, gen, title_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillar.functions import text as T
from sillar.operators.chunking import chunk_documents
from sillar.operators.ordered import running_sum

# What a merge did with a title.
NEW, CHANGED, SAME, NEWER, DELETED = "nuevo", "cambiado", "igual", "local más reciente", "borrado"

LEAST_CHARS = 200


def article_filter(articles: DataFrame) -> DataFrame:
    """Articles worth keeping: 200 characters or more, no anchor in the title."""
    return articles.filter((F.length("text") >= LEAST_CHARS) & ~F.contains("title", F.lit("#")))


def merge_actions(current: DataFrame, incoming: DataFrame, snapshot: Column, gen: int) -> DataFrame:
    """What importing a snapshot does with every title: one full outer join.

    ``current(title, page_id, hash, snapshot_ts, gen)``, ``incoming(title, hash)``, both with unique
    titles. Gives ``(title, page_id, action, snapshot_ts, gen, hash)``: the new state and

    * ``nuevo``: not here yet;
    * ``local más reciente``: updated here after the snapshot: keeps its text and time;
    * ``igual``: same hash: keeps its text, takes the snapshot's time;
    * ``cambiado``: another text;
    * ``borrado``: not in the snapshot and not updated since.

    A title that is missing in the snapshot but newer, or of a later import, stays as it is
    and is not listed. Null times are the earliest; a null hash equals no other.
    """
    a, b = current.alias("a"), incoming.alias("b")
    late = F.coalesce(F.col("a.snapshot_ts"), F.timestamp_seconds(F.lit(0))) > snapshot
    here, there = F.col("a.title").isNotNull(), F.col("b.title").isNotNull()
    stays = ~there & (late | (F.col("a.gen") >= gen))
    action = F.when(~here, NEW).when(~there, DELETED).when(late, NEWER).when(F.col("a.hash") == F.col("b.hash"), SAME).otherwise(CHANGED)
    joined = a.join(b, F.col("a.title") == F.col("b.title"), "full_outer").filter(~F.coalesce(stays, F.lit(False)))
    rows = joined.select(F.coalesce("a.title", "b.title").alias("title"), F.col("a.page_id").alias("page_id"), action.alias("action"), F.col("a.snapshot_ts").alias("old_ts"), F.when(here & there & late, F.col("a.hash")).otherwise(F.coalesce("b.hash", "a.hash")).alias("hash"), F.col("a.gen").alias("old_gen"))
    return rows.select(
        "title",
        "page_id",
        "action",
        F.when(F.col("action").isin(NEWER, DELETED), F.col("old_ts")).otherwise(snapshot).alias("snapshot_ts"),
        F.when(F.col("action") == DELETED, F.col("old_gen")).otherwise(F.lit(gen)).cast("int").alias("gen"),
        "hash",
    )


def tally(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``current`` with the rows of ``incoming`` in the place of those with the same key. A null key
    replaces nothing. Missing columns become null."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def delete_keys(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def delete_cascade(gone: DataFrame, key: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the keys that go."""
    return {name: delete_keys(table, gone, key) for name, table in tables.items()}


def upsert_pages(pages: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Pages with ``incoming(title, revid, text, snapshot_ts, gen, page_id)`` replaced or added: size, hash
    and key are made from the text; a missing time is ``now``, a missing generation that of the old row."""
    old = pages.select("title", F.col("gen").alias("old_gen"))
    rows = incoming.join(old, "title", "left").select(
        "page_id",
        "title",
        "revid",
        F.coalesce("snapshot_ts", now).alias("snapshot_ts"),
        F.length("text").cast("int").alias("size"),
        T.content_hash(F.col("text")).alias("hash"),
        F.coalesce("gen", "old_gen").cast("int").alias("gen"),
        T.title_key(F.col("title")).alias("title_key"),
    )
    return upsert(pages.select(*rows.columns), rows, "title")


def upsert_articles(pages: DataFrame, chunks: DataFrame, images: DataFrame, incoming: DataFrame, now: Column) -> dict[str, DataFrame]:
    """``pages``, ``chunks`` and ``images`` after ``incoming(title, revid, text, snapshot_ts, gen, page_id, images)`` replaced what
    stood under its titles. The texts are cut into chunks anew. ``images array<struct<src, caption>>``: null keeps the old
    images, which go over to the new page; a list, even an empty one, replaces them.
    """
    ids = lambda table, column: table.agg(F.coalesce(F.max(column), F.lit(0)).alias("top")).first()["top"]
    old = pages.join(incoming.select("title", F.col("page_id").alias("new_id"), F.col("images").isNull().alias("keeps")), "title").select("page_id", "new_id", "keeps")
    gone = old.select("page_id").distinct()
    fresh = chunk_documents(incoming.select("page_id", "text"), "page_id", "text").join(incoming.select("page_id", "title"), "page_id")
    fresh = running_sum(fresh.withColumn("__all", F.lit(0)), "__all", ["page_id", "ord"], name="__n").withColumn("chunk_id", F.col("__n") + 1 + ids(chunks, "chunk_id"))
    moved = images.join(old.filter("keeps").select("page_id", "new_id"), "page_id").withColumn("page_id", F.col("new_id")).select(*images.columns)
    shown = incoming.select("page_id", F.posexplode("images").alias("ord", "i")).select("page_id", "ord", F.col("i.src").alias("src"), F.col("i.caption").alias("caption"))
    shown = running_sum(shown.withColumn("__all", F.lit(0)), "__all", ["page_id", "ord"], name="__n").withColumn("image_id", F.col("__n") + 1 + ids(images, "image_id")).select("image_id", "page_id", "src", "caption")
    return {
        "pages": upsert_pages(pages, incoming.drop("images"), now),
        "chunks": delete_keys(chunks, gone, "page_id").unionByName(fresh.select("chunk_id", "page_id", "ord", "title", "section", "text"), allowMissingColumns=True),
        "images": delete_keys(images, gone, "page_id").unionByName(moved).unionByName(shown, allowMissingColumns=True),
    }


def set_images(images: DataFrame, incoming: DataFrame, touched: DataFrame) -> DataFrame:
    """The images of ``touched(page_id)`` replaced by ``incoming``; a page without new images only loses
    those of the archive (``zim:`` sources)."""
    replaced = incoming.select("page_id").distinct()
    kept = images.join(replaced, "page_id", "left_anti")
    bare = touched.select("page_id").distinct().join(replaced, "page_id", "left_anti").withColumn("bare", F.lit(True))
    kept = kept.join(bare, "page_id", "left").filter(~(F.coalesce("bare", F.lit(False)) & F.col("src").startswith("zim:"))).drop("bare")
    return kept.unionByName(incoming, allowMissingColumns=True)


def set_meta(meta: DataFrame, key: str, value: str | None) -> DataFrame:
    """A key-value table with one key set, or removed for None."""
    rest = meta.filter(F.col("key") != key)
    if value is None:
        return rest
    return rest.unionByName(meta.sparkSession.createDataFrame([(key, str(value))], "key string, value string"))


def get_meta(meta: DataFrame, key: str) -> str | None:
    row = meta.filter(F.col("key") == key).select("value").first()
    return row["value"] if row else None


def migrate(table: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The table with the columns it lacks, null."""
    return table.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in schema.items() if name not in table.columns))


def fill_sizes(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """``pages`` with a null ``size`` replaced by the characters of the page's chunks, 0 without any."""
    sums = chunks.filter("page_id is not null").groupBy("page_id").agg(F.sum(F.length("text")).alias("chars"))
    return pages.join(sums, "page_id", "left").withColumn("size", F.coalesce("size", "chars", F.lit(0)).cast("int")).drop("chars")


def redirect_rows(entries: DataFrame) -> DataFrame:
    """``(title_key, target)`` of redirect entries ``(path, title, target)``: no main page, anchors, redirects to
    themselves or keys without words."""
    rows = entries.filter((F.coalesce("path", F.lit("")) != "mainPage") & ~F.contains("title", F.lit("#")) & ~F.contains("target", F.lit("#")) & (F.col("title") != F.col("target")))
    return rows.select(T.title_key(F.col("title")).alias("title_key"), "target").filter("title_key <> ''")


def refresh_redirects(current: DataFrame, incoming: DataFrame, gen: int) -> DataFrame:
    """Redirects after an import: the incoming ones under ``gen``; older and unnumbered ones go."""
    return current.filter(F.col("gen") >= gen).unionByName(incoming.withColumn("gen", F.lit(gen)), allowMissingColumns=True)


def next_generation(last_name: str | None, last_gen: int, name: str, complete: bool) -> tuple[int, str]:
    """``(gen, step)`` for importing the archive ``name``: a new name starts the next generation, the same one
    is resumed, or skipped if it was complete."""
    if name != last_name:
        return last_gen + 1, "start"
    return last_gen, "skip" if complete else "resume"


def hand_over_cursor(cursor: float | None, snapshot: float, pending: bool) -> tuple[float, bool]:
    """The change feed's cursor after an import and whether a catch-up is still pending: the later of both
    times; pending is dropped only if the cursor moved."""
    if cursor is None or snapshot > cursor:
        return snapshot, False
    return cursor, pending


def stats(pages: DataFrame, chunks: DataFrame, vectors: DataFrame, redirects: DataFrame, images: DataFrame, meta: DataFrame) -> DataFrame:
    """One row about the store. Chunks and images are given by their greatest id, as an estimate."""
    count = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
    top = lambda t, column, name: t.agg(F.coalesce(F.max(column), F.lit(0)).alias(name))
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    facts = meta.agg(value("last_sync").alias("last_sync"), value("zim_name").alias("zim_source"), value("zim_date").alias("zim_date"), value("check_after").isNotNull().alias("catchup_pending"))
    row = count(pages, "pages")
    for other in (top(chunks, "chunk_id", "chunks_approx"), count(vectors, "embedded_pages"), top(images, "image_id", "images"), count(redirects, "redirects"), facts):
        row = row.crossJoin(other)  # one row each
    return row
