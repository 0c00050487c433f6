"""From a conversation to an answer: the search query of its last question, the prompt, and the answer.

Models are callables. ``rewrite(history, question)`` gives a search query or None; ``chat(messages)`` gives the pieces of
an answer, one after another. Both get plain lists and run in the tasks, on one row per chat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillar.functions import text as T
from sillar.functions.roles import ASSISTANT, USER, said_by, speaker
from sillar.operators.chats import SHORT_QUESTION, context_summaries, context_text, unique_messages

RULES = "Responde en español a partir de los textos que siguen y nombra entre corchetes el artículo de cada dato. Si los textos no lo dicen, dilo."
NO_MODEL = "No hay ningún modelo disponible. Estos artículos tratan de la pregunta:"

QUESTION = "chat_id string, question string, before string, history array<struct<role:string,content:string>>, summary string"


def last_questions(messages: DataFrame, chats: DataFrame, recent: int = 6) -> DataFrame:
    """``(chat_id, question, before, history, summary)``: of each chat whose last message is a user's: the question, the
    user's message before it, up to ``recent`` messages before it in order, and the summary of what lies before those.

    Notes and unreadable roles are no part of it. The windows are cut before the shuffle.
    """
    rows = unique_messages(messages).withColumn("who", speaker(F.col("role"))).filter(F.col("who").isin(USER, ASSISTANT))
    back = Window.partitionBy("chat_id").orderBy(F.col("message_id").desc())
    near = rows.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= recent + 1)
    role = F.when(F.col("who") == USER, "user").otherwise("assistant")
    near = near.groupBy("chat_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), role.alias("role"), F.coalesce("content", F.lit("")).alias("content")))).alias("all"))
    asked = rows.filter(F.col("who") == USER).withColumn("back", F.row_number().over(back)).filter(F.col("back") <= 2)
    before = asked.filter("back = 2").select("chat_id", F.coalesce("content", F.lit("")).alias("before"))
    last = F.element_at("all", -1)
    found = near.filter(last["role"] == "user").select("chat_id", last["content"].alias("question"), F.transform(F.slice("all", 1, F.size("all") - 1), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"))
    found = found.join(before, "chat_id", "left").join(context_summaries(messages, chats, recent), "chat_id", "left")
    return found.select("chat_id", "question", "before", "history", "summary")


def _rewritten(rewrite: Callable[[list[dict], str], str | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for question, before, history, summary in zip(*(b.column(c).to_pylist() for c in ("question", "before", "history", "summary"))):
                made = None
                if before is not None:  # a first question is searched as it is
                    try:
                        made = rewrite(([{"role": "system", "content": summary}] if summary else []) + history, question)
                    except Exception:
                        made = None  # a model that fails leaves the rule
                out.append(" ".join(made.split()) or None if made else None)
            yield pa.RecordBatch.from_arrays([b.column("chat_id"), b.column("question"), b.column("before"), pa.array(out, pa.string())], names=["chat_id", "question", "before", "made"])

    return run


def search_queries(questions: DataFrame, rewrite: Callable[[list[dict], str], str | None] | None = None) -> DataFrame:
    """``(chat_id, query)``: a first question as it is; a later one as ``rewrite`` gives it or, without a result, joined to
    the one before if it has less than six words."""
    rows = questions.withColumn("made", F.lit(None).cast("string"))
    if rewrite is not None:
        rows = questions.mapInArrow(_rewritten(rewrite), "chat_id string, question string, before string, made string")
    short = F.col("before").isNotNull() & (T.word_count(F.col("question")) < SHORT_QUESTION)
    return rows.select("chat_id", F.coalesce("made", F.when(short, F.concat("before", F.lit(" "), "question")).otherwise(F.col("question"))).alias("query"))


_MESSAGE = "array<struct<role:string,content:string>>"


def prompts(questions: DataFrame, sources: DataFrame, rules: str = RULES) -> DataFrame:
    """``(chat_id, prompt array<struct<role, content>>, listing)`` for ``sources(chat_id, pos, title, section, text)``: the rules
    with the texts found, the summary, the history and the question."""
    found = sources.groupBy("chat_id").agg(F.sort_array(F.collect_list(F.struct("pos", "title", "section", "text"))).alias("s"))
    rows = questions.join(found, "chat_id", "left").withColumn("s", F.coalesce("s", F.expr("cast(array() as array<struct<pos:int,title:string,section:string,text:string>>)")))
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    summary = F.when(F.col("summary").isNotNull(), F.array(say("system", F.concat(F.lit("Lo hablado hasta ahora: "), F.col("summary"))))).otherwise(F.array().cast(_MESSAGE))
    prompt = F.concat(F.array(say("system", F.concat(F.lit(rules + "\n\n"), context_text(F.col("s"))))), summary, F.col("history"), F.array(say("user", F.col("question"))))
    return rows.select("chat_id", prompt.cast(_MESSAGE).alias("prompt"), listing(F.col("s")).alias("listing"))


def listing(sources: Column) -> Column:
    """What is answered without a model: the articles found, each section once."""
    lines = F.array_distinct(F.transform(sources, lambda s: F.concat(F.lit("- "), s["title"], F.when(s["section"].isNotNull() & (s["section"] != "Introducción"), F.concat(F.lit(" ("), s["section"], F.lit(")"))).otherwise(""))))
    return F.when(F.size(lines) > 0, F.concat(F.lit(NO_MODEL + "\n"), F.array_join(lines, "\n"))).otherwise("No se encontró ningún artículo sobre la pregunta.")


def summary_prompts(messages: DataFrame, chats: DataFrame, recent: int = 6, slack: int = 4) -> DataFrame:
    """``(chat_id, upto, prompt)`` of the chats that need a new summary: the old one and the messages it lacks, in order.
    The messages of a chat that no summary covers come together in one row, as a model has to read them."""
    from sillar.operators.chats import needs_summary

    wanted = needs_summary(messages, chats, recent, slack).filter("needed").select("chat_id")
    old = chats.filter("chat_id is not null").groupBy("chat_id").agg(F.max("summary").alias("summary"), F.coalesce(F.max("summary_upto"), F.lit(0)).alias("upto"))
    rows = unique_messages(messages).join(wanted, "chat_id", "left_semi")
    back = Window.partitionBy("chat_id").orderBy(F.col("message_id").desc())
    edge = rows.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= recent).groupBy("chat_id").agg(F.min("message_id").alias("edge"))
    rows = rows.join(edge, "chat_id").join(old, "chat_id", "left").filter((F.col("message_id") < F.col("edge")) & (F.col("message_id") > F.coalesce("upto", F.lit(0))))
    who = F.when(said_by(F.col("role"), USER), "Usuario: ").otherwise("Asistente: ")
    each = rows.groupBy("chat_id").agg(F.max("message_id").alias("upto"), F.first("summary").alias("summary"), F.sort_array(F.collect_list(F.struct("message_id", F.concat(who, F.coalesce("content", F.lit(""))).alias("line")))).alias("m"))
    text = F.concat(F.when(F.col("summary").isNotNull(), F.concat(F.lit("Resumen anterior: "), "summary", F.lit("\n"))).otherwise(""), F.array_join(F.transform("m", lambda x: x["line"]), "\n"))
    ask = F.array(F.struct(F.lit("system").alias("role"), F.lit("Resume la conversación en pocas frases.").alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content")))
    return each.select("chat_id", "upto", ask.cast(_MESSAGE).alias("prompt"))


def _answered(chat: Callable[[list[dict]], Iterable[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for prompt in b.column("prompt").to_pylist():
                try:
                    out.append("".join(chat(prompt)).strip() or None)
                except Exception:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column("chat_id"), pa.array(out, pa.string())], names=["chat_id", "answer"])

    return run


def answers(prompted: DataFrame, chat: Callable[[list[dict]], Iterable[str]] | None) -> DataFrame:
    """``(chat_id, answer, from_model)``; the listing where there is no model, or where it fails or says nothing."""
    kept = prompted.select("chat_id", "listing")
    if chat is None:
        return kept.select("chat_id", F.col("listing").alias("answer"), F.lit(False).alias("from_model"))
    said = prompted.select("chat_id", "prompt").mapInArrow(_answered(chat), "chat_id string, answer string")
    return kept.join(said, "chat_id", "left").select("chat_id", F.coalesce("answer", "listing").alias("answer"), F.col("answer").isNotNull().alias("from_model"))
