"""Question sets, configuration, and images by their bytes."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults of a configuration.
DEFAULTS = {"seed_categories": [], "category_depth": 1, "seed_titles": [], "track_all_changes": False, "skip_bot_edits": True, "update_interval_hours": 12, "request_delay_seconds": 0.5, "top_k": 4, "embed_dims": 384, "embed_chars": 400, "history_messages": 6, "summarize_history": True, "rewrite_followups": False}
CACHE_BYTES = 2 * 1024 * 1024

_SET = "preguntas array<struct<pregunta:string,articulos:array<string>,datos:array<array<string>>,no_debe_decir:array<string>,sin_respuesta:boolean>>"


def question_set(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """``(qid, question, articles, facts, forbidden, unanswerable)`` of a JSON file, in its order from 1; ``most`` is the
    feature of looking at the first few."""
    rows = spark.read.schema(_SET).json(path, multiLine=True).select(F.posexplode("preguntas").alias("p", "q"))
    rows = rows.select((F.col("p") + 1).cast("long").alias("qid"), F.col("q.pregunta").alias("question"), F.col("q.articulos").alias("articles"), F.col("q.datos").alias("facts"), F.col("q.no_debe_decir").alias("forbidden"), F.coalesce("q.sin_respuesta", F.lit(False)).alias("unanswerable"))
    return rows if most is None else rows.filter(F.col("qid") <= most)


def load_config(path: str | None) -> dict:
    """The file's values over the defaults; the defaults alone without a file."""
    if path is None or not Path(path).exists():
        return dict(DEFAULTS)
    return DEFAULTS | json.loads(Path(path).read_text(encoding="utf-8"))


def image_bytes(cached: bytes | None, src: str | None, archive: Callable[[str], bytes | None], http: Callable[[str], bytes | None]) -> tuple[bytes | None, bool]:
    """``(bytes, keep)``: the cached bytes, else those of the archive entry or the address; ``keep`` tells to cache a
    download of up to 2 MiB. None on any failure."""
    if cached is not None:
        return cached, False
    try:
        if src and src.startswith("zim:"):
            return archive(src[4:]), False
        data = http(src) if src else None
        return data, data is not None and len(data) <= CACHE_BYTES
    except Exception:
        return None, False


def write_details(results: DataFrame, path: str) -> None:
    """The results of an evaluation as JSON lines."""
    results.write.mode("overwrite").json(path)
