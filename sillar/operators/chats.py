"""Conversation windows, follow-up queries and titles.

``messages``: ``message_id, chat_id, role, content, created_at``. Order is that of ``message_id``, the arrival.
Rows of one ``message_id`` count once.

A chat may hold a third of all messages. Windows that keep the last few rows of a chat are cut down before the
shuffle; what must see every row of a chat is an aggregate, or a rank by running sums over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillar.functions import text as T
from sillar.functions.roles import USER, said_by
from sillar.operators.ordered import running_sum

TITLE_CHARS, RENAME_CHARS = 60, 120
UNTITLED = "Sin título"
SHORT_QUESTION = 6
SOURCES, IMAGES = "array<struct<title:string,section:string>>", "array<struct<id:bigint,title:string,caption:string>>"


def unique_messages(messages: DataFrame) -> DataFrame:
    return messages.filter("chat_id is not null").select("message_id", "chat_id", "role", "content").distinct()


def context_window(messages: DataFrame, chats: DataFrame, recent: int) -> DataFrame:
    """``(chat_id, message_id, role, content)``: the last ``recent`` messages before the current (last) one."""
    back = Window.partitionBy("chat_id").orderBy(F.col("message_id").desc())
    rows = unique_messages(messages).withColumn("back", F.row_number().over(back))
    return rows.filter(F.col("back").between(2, recent + 1)).select("chat_id", "message_id", "role", "content")


def context_summaries(messages: DataFrame, chats: DataFrame, recent: int) -> DataFrame:
    """``(chat_id, summary)``: the summary that goes with the window: only if messages lie before it."""
    counts = unique_messages(messages).groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"))
    newest = chats.filter("chat_id is not null").groupBy("chat_id").agg(F.max("summary").alias("summary"))
    return newest.join(counts, "chat_id").select("chat_id", F.when(F.col("n") - 1 > recent, F.col("summary")).alias("summary"))


def needs_summary(messages: DataFrame, chats: DataFrame, recent: int, slack: int = 4) -> DataFrame:
    """``(chat_id, pending, needed)``: the messages outside the last ``recent`` that no summary covers, and
    whether they are at least ``slack``."""
    back = Window.partitionBy("chat_id").orderBy(F.col("message_id").desc())
    upto = chats.filter("chat_id is not null").groupBy("chat_id").agg(F.coalesce(F.max("summary_upto"), F.lit(0)).alias("upto"))
    rows = unique_messages(messages).select("chat_id", "message_id")
    inside = rows.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= recent)
    edge = inside.groupBy("chat_id").agg(F.min("message_id").alias("edge"))
    bounds = rows.select("chat_id").distinct().join(edge, "chat_id", "left").join(upto, "chat_id", "left")
    outside = (F.col("edge").isNull() | (F.col("message_id") < F.col("edge"))) & (F.col("message_id") > F.coalesce("upto", F.lit(0)))
    return rows.join(bounds, "chat_id").groupBy("chat_id").agg(F.count_if(outside).alias("pending")).withColumn("needed", F.col("pending") >= slack)


def followup_queries(messages: DataFrame) -> DataFrame:
    """``(chat_id, message_id, query)``: what to search for each user message: a question of less than six words is
    joined to the one before."""
    users = unique_messages(messages).filter(said_by(F.col("role"), USER)).select("chat_id", "message_id", F.coalesce("content", F.lit("")).alias("content"))
    ranked = running_sum(users, "chat_id", ["message_id", "content"], name="rank")
    before = ranked.select("chat_id", (F.col("rank") + 1).alias("rank"), F.col("content").alias("before"))
    joined = ranked.join(before, ["chat_id", "rank"], "left")
    short = (T.word_count(F.col("content")) < SHORT_QUESTION) & F.col("before").isNotNull()
    return joined.select("chat_id", "message_id", F.when(short, F.concat("before", F.lit(" "), "content")).otherwise(F.col("content")).alias("query"))


def derived_titles(messages: DataFrame) -> DataFrame:
    """``(chat_id, title)`` from each chat's first user message."""
    first = unique_messages(messages).filter(said_by(F.col("role"), USER) & F.col("content").isNotNull()).groupBy("chat_id").agg(F.min_by("content", "message_id").alias("content"))
    return first.select("chat_id", T.shorten(F.col("content"), TITLE_CHARS).alias("title"))


def renamed(title: Column) -> Column:
    """A title given by hand: white space single, 120 characters, never empty."""
    line = F.substring(T.collapse(F.coalesce(title, F.lit(""))), 1, RENAME_CHARS)
    return F.when(line == "", UNTITLED).otherwise(line)


def chats_by_recency(chats: DataFrame) -> DataFrame:
    """Each chat once, the last touched first; never touched ones last."""
    rows = chats.filter("chat_id is not null").groupBy("chat_id").agg(F.max(F.struct("updated_at", "title")).alias("c")).select("chat_id", F.col("c.title").alias("title"), F.col("c.updated_at").alias("updated_at"))
    return rows.orderBy(F.col("updated_at").desc_nulls_last(), "chat_id")


def create_chat(chats: DataFrame, chat_id: str, now: Column, title: str | None = None) -> DataFrame:
    """The table with a new chat; one that exists is left as it is."""
    new = chats.sparkSession.createDataFrame([(chat_id, title)], "chat_id string, title string").select("chat_id", "title", now.alias("created_at"), now.alias("updated_at"))
    return chats.unionByName(new.join(chats.select("chat_id"), "chat_id", "left_anti"), allowMissingColumns=True)


def get_chat(chats: DataFrame, messages: DataFrame, chat_id: str) -> tuple[DataFrame, DataFrame]:
    """The newest row of a chat, and its messages in order with sources and images read."""
    row = chats.filter(F.col("chat_id") == chat_id).orderBy(F.col("updated_at").desc_nulls_last()).limit(1)
    said = messages.filter(F.col("chat_id") == chat_id).distinct().orderBy("message_id")
    return row, said.withColumn("sources", F.from_json("sources", SOURCES)).withColumn("images", F.from_json("images", IMAGES))


def add_messages(chats: DataFrame, messages: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """``(chats, messages)`` with ``incoming(chat_id, ord, role, content, sources, images, search_query)`` said: numbered after the
    others by chat and ``ord``, sources and images as JSON. Chats are touched, unknown ones created, and one without a
    title takes it from its first user message."""
    top = messages.agg(F.coalesce(F.max("message_id"), F.lit(0)).alias("t")).first()["t"]
    rows = running_sum(incoming.filter("chat_id is not null").withColumn("__all", F.lit(0)), "__all", ["chat_id", "ord"], name="__n")
    said = rows.select((F.col("__n") + 1 + top).alias("message_id"), "chat_id", "role", "content", F.to_json("sources").alias("sources"), F.to_json("images").alias("images"), "search_query", now.alias("created_at"))
    touched = said.select("chat_id").distinct()
    names = derived_titles(messages.join(touched, "chat_id", "left_semi").select("message_id", "chat_id", "role", "content").unionByName(said.select("message_id", "chat_id", "role", "content")))
    same = chats.join(touched.withColumn("__touched", F.lit(True)), "chat_id", "left").join(names.withColumnRenamed("title", "__name"), "chat_id", "left")
    untitled = F.col("__touched") & F.coalesce(F.trim("title"), F.lit("")).isin("", UNTITLED)
    same = same.withColumn("title", F.when(untitled, F.coalesce("__name", "title")).otherwise(F.col("title"))).withColumn("updated_at", F.when(F.col("__touched"), now).otherwise(F.col("updated_at"))).select(*chats.columns)
    new = touched.join(chats.select("chat_id"), "chat_id", "left_anti").join(names, "chat_id", "left").select("chat_id", "title", now.alias("created_at"), now.alias("updated_at"))
    return same.unionByName(new, allowMissingColumns=True), messages.unionByName(said, allowMissingColumns=True)


def set_summaries(chats: DataFrame, made: DataFrame) -> DataFrame:
    """The table with ``made(chat_id, summary, upto)`` written to its chats."""
    rows = chats.join(made.select("chat_id", F.col("summary").alias("__s"), F.col("upto").alias("__u")), "chat_id", "left")
    return rows.withColumn("summary", F.coalesce("__s", "summary")).withColumn("summary_upto", F.coalesce("__u", "summary_upto")).select(*chats.columns)


def rename_chat(chats: DataFrame, chat_id: str, title: str) -> DataFrame:
    return chats.withColumn("title", F.when(F.col("chat_id") == chat_id, renamed(F.lit(title))).otherwise(F.col("title")))


def delete_chat(chats: DataFrame, messages: DataFrame, chat_id: str) -> tuple[DataFrame, DataFrame]:
    keep = ~F.col("chat_id").eqNullSafe(chat_id)
    return chats.filter(keep), messages.filter(keep)


def context_text(sources: Column) -> Column:
    """The texts given to a model, ``array<struct<title, section, text>>``, one paragraph each."""
    one = lambda s: F.concat(F.lit("Artículo: "), s["title"], F.when(s["section"] != "Introducción", F.concat(F.lit(" (sección «"), s["section"], F.lit("»)"))).otherwise(""), F.lit("\n"), s["text"])
    return F.coalesce(F.nullif(F.array_join(F.transform(sources, one), "\n\n"), F.lit("")), F.lit("(no se encontró ningún texto relacionado)"))
