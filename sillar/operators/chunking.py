"""Section-aware chunks of an article's plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 1500
INTRODUCTION = "Introducción"
# Sections that hold only links or citations.
SKIPPED_SECTIONS = ["referencias", "notas", "enlaces externos", "bibliografía", "véase también", "fuentes", "notas y referencias", "referencias y notas", "bibliografía adicional", "lecturas adicionales", "enlaces", "obras citadas"]
# Fixed value: a heading line.
HEADING = r"^(={2,6})\s*(.+?)\s*\1\s*$"

_STATE = "struct<section:string,buf:string,out:array<struct<section:string,text:string>>>"


def chunks_of(text: Column, most: int = CHUNK_CHARS) -> Column:
    """``array<struct<section, text>>``: the paragraphs of each section, gathered into chunks
    of up to ``most`` characters; a longer paragraph is one chunk.

    Sections of links and citations are left out, their subsections are not. Null and
    blank texts give no chunks. One fold over the lines, bounded by the article.
    """
    kept = lambda s: ~F.lower(F.trim(s)).isin(SKIPPED_SECTIONS)
    start = F.struct(F.lit(INTRODUCTION).alias("section"), F.lit("").alias("buf"), F.array().cast("array<struct<section:string,text:string>>").alias("out")).cast(_STATE)

    def flushed(state: Column) -> Column:
        ready = (state["buf"] != "") & kept(state["section"])
        piece = F.array(F.struct(state["section"].alias("section"), state["buf"].alias("text")))
        return F.when(ready, F.concat(state["out"], piece)).otherwise(state["out"])

    def step(state: Column, line: Column) -> Column:
        para = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        heading = F.struct(F.regexp_extract(line, HEADING, 2).alias("section"), F.lit("").alias("buf"), flushed(state).alias("out"))
        full = (state["buf"] != "") & (F.length(state["buf"]) + F.length(para) > most)
        fresh = F.struct(state["section"].alias("section"), para.alias("buf"), flushed(state).alias("out"))
        longer = F.when(state["buf"] == "", para).otherwise(F.concat(state["buf"], F.lit("\n"), para))
        grown = F.struct(state["section"].alias("section"), longer.alias("buf"), state["out"].alias("out"))
        return F.when(line.rlike(HEADING), heading.cast(_STATE)).when(para == "", state).when(full, fresh.cast(_STATE)).otherwise(grown.cast(_STATE))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), start, step, flushed)


def chunk_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(<id>, ord, section, text)``."""
    return documents.select(documents[id_column], F.posexplode(chunks_of(documents[text_column])).alias("ord", "c")).select(id_column, "ord", F.col("c.section").alias("section"), F.col("c.text").alias("text"))
