"""Choosing images for an answer.

``images``: ``image_id, page_id, title, caption``; ``sources``: ``qid, page_rank, page_id``, ranks from 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillar.functions import text as T
from sillar.operators.vectors import embed

# A page's first image, each place of the page among the sources, each word of the question in the
# caption, and how far below the best an image may score.
FIRST_BONUS, RANK_STEP, WORD_BONUS, WITHIN = 0.08, 0.03, 0.05, 0.12
PER_PAGE, TOTAL = 2, 6


def placed(images: DataFrame, sources: DataFrame) -> DataFrame:
    """The images of the source pages with their position on the page, counted before anything is left out."""
    on_page = Window.partitionBy("page_id").orderBy("image_id")
    images = images.join(sources.select("page_id").distinct(), "page_id", "left_semi")  # other pages are not ranked
    return images.withColumn("position", F.row_number().over(on_page) - 1).join(sources, "page_id")


def without(rows: DataFrame, shown: DataFrame | None) -> DataFrame:
    return rows if shown is None else rows.join(shown.select("qid", "image_id").distinct(), ["qid", "image_id"], "left_anti")


def rank_images(images: DataFrame, sources: DataFrame, queries: DataFrame, similarities: DataFrame | None = None, shown: DataFrame | None = None, per_page: int = PER_PAGE, total: int = TOTAL) -> DataFrame:
    """``(qid, pos, image_id, title, caption, score)``: the images that fit a question best.

    A score is the similarity of caption and question (``similarities(qid, image_id, similarity)``, 0 without), plus a
    bonus for each of the question's words in the caption and for a page's first image, less a step per place of
    the page. Kept: at most ``per_page`` per title and ``total``, none more than ``WITHIN`` below the best. Ties go to
    the better page, then the smaller id.
    """
    rows = without(placed(images, sources), shown).join(queries, "qid")
    if similarities is None:
        rows = rows.withColumn("similarity", F.lit(0.0))
    else:
        rows = rows.join(similarities, ["qid", "image_id"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    common = F.size(F.array_intersect(T.keywords(F.col("query")), T.keywords(F.col("caption"))))
    score = F.col("similarity") + WORD_BONUS * common + F.when(F.col("position") == 0, FIRST_BONUS).otherwise(0.0) - RANK_STEP * F.col("page_rank")
    rows = rows.withColumn("score", F.round(score, 6))
    best = F.max("score").over(Window.partitionBy("qid"))
    order = [F.col("score").desc(), "page_rank", "image_id"]
    rows = rows.withColumn("best", best).filter(F.col("score") >= F.round(F.col("best") - WITHIN, 6))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "title").orderBy(*order))).filter(F.col("nth") <= per_page)
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("pos") <= total)
    return rows.select("qid", "pos", "image_id", "title", F.coalesce("caption", "title").alias("caption"), "score")


def images_for_pages(images: DataFrame, sources: DataFrame, shown: DataFrame | None = None, per_page: int = PER_PAGE, total: int = TOTAL) -> DataFrame:
    """``(qid, pos, image_id, title, caption)``: up to ``per_page`` images of each source page in order, ``total`` in all."""
    rows = without(placed(images, sources), shown)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "page_rank").orderBy("image_id"))).filter(F.col("nth") <= per_page)
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("page_rank", "image_id"))).filter(F.col("pos") <= total)
    return rows.select("qid", "pos", "image_id", "title", F.coalesce("caption", "title").alias("caption"))


def caption_input(images: DataFrame) -> DataFrame:
    """``(image_id, input)``: what is embedded of an image that has no vector yet."""
    return images.select("image_id", T.embedding_text(F.col("title"), F.col("caption"), None).alias("input"))


def caption_vectors(images: DataFrame, cached: DataFrame, embedder: Callable[[list[str]], np.ndarray], dims: int) -> DataFrame:
    """``(image_id, vec)`` to be added to ``cached(image_id, vec)``: the captions of images that have no vector yet."""
    missing = caption_input(images.join(cached.select("image_id").distinct(), "image_id", "left_anti").dropDuplicates(["image_id"]))
    return embed(missing.withColumnRenamed("image_id", "page_id"), embedder, dims).withColumnRenamed("page_id", "image_id")


def similarities(vectors: DataFrame, queries: DataFrame, images: DataFrame, sources: DataFrame) -> DataFrame:
    """``(qid, image_id, similarity)`` for ``vectors(image_id, vec)`` (quantized) and ``queries(qid, vec)`` (unit length): of each
    query with the images of its source pages only."""
    shown = sources.select("qid", "page_id").distinct().join(images.select("page_id", "image_id"), "page_id").select("qid", "image_id").distinct()
    rows = shown.join(vectors, "image_id").join(queries.select("qid", F.col("vec").alias("q")), "qid")
    dot = F.aggregate(F.zip_with("vec", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return rows.select("qid", "image_id", F.round(dot / 127.0, 6).alias("similarity"))
