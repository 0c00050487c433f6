"""Scoring answers by fixed rules, and summarizing the scores.

``items``: ``qid, question, articles array<string>, facts array<array<string>>, forbidden array<string>, unanswerable
boolean``; ``answers``: ``qid, answer, titles array<string>, seconds double``. Patterns are regular expressions over
folded text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillar.functions import text as T


def unsupported(answer: Column, titles: Column) -> Column:
    """The cited titles that share no full set of words with any source, in either direction."""
    known = F.filter(F.transform(F.coalesce(titles, F.array().cast("array<string>")), T.keywords), lambda k: F.size(k) > 0)
    bare = F.transform(T.citations(answer), lambda c: F.trim(F.regexp_replace(c, r"\s*\(secci[oó]n[^)]*\)\s*$", "")))

    def missing(title: Column) -> Column:
        words = T.keywords(title)
        covered = F.exists(known, lambda k: (F.size(F.array_except(words, k)) == 0) | (F.size(F.array_except(k, words)) == 0))
        return (F.size(words) > 0) & ~covered

    return F.filter(bare, missing)


def all_invented(answer: Column, titles: Column) -> Column:
    """There are citations and none is supported."""
    cited = T.citations(answer)
    return (F.size(cited) > 0) & (F.size(unsupported(answer, titles)) == F.size(cited))


# Fixed value: the words of the warning.
def citation_warning(answer: Column, titles: Column) -> Column:
    """The text of the warning, or null."""
    names = F.array_join(F.array_distinct(unsupported(answer, titles)), ", ")
    text = F.concat(F.lit("⚠️ Esta respuesta cita artículos que no estaban entre las fuentes consultadas ("), names, F.lit("): puede no venir de la wiki."))
    return F.when(all_invented(answer, titles), text)


def sources_line(titles: Column) -> Column:
    """The distinct source titles in order, or "ninguna"."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(F.coalesce(titles, F.array().cast("array<string>")))), ", "), F.lit("")), F.lit("ninguna"))


def answerable(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items that expect no article, or at least one that exists."""
    some = items.select("qid", F.explode("articles").alias("title")).join(pages.select("title").distinct(), "title", "left_semi").select("qid").distinct()
    bare = items.filter("articles is null or size(articles) = 0")
    return items.join(some, "qid", "left_semi").unionByName(bare)


def score(items: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per answered item; what does not apply is null."""
    rows = items.join(answers, "qid")
    folded = T.fold(F.coalesce("answer", F.lit("")))
    none = F.array().cast("array<string>")
    leaked = F.exists(F.coalesce("forbidden", none), lambda p: F.regexp_like(folded, p))
    groups = F.coalesce("facts", F.array().cast("array<array<string>>"))
    found = F.size(F.filter(groups, lambda g: F.exists(g, lambda p: F.regexp_like(folded, p))))
    blank = F.coalesce("unanswerable", F.lit(False))
    refused = T.refused(F.col("answer"))
    invents = leaked | ~refused
    right = F.when(blank, ~invents).otherwise((found == F.size(groups)) & ~leaked)
    expects = F.size(F.coalesce("articles", none)) > 0
    return rows.select(
        "qid",
        F.coalesce("answer", F.lit("")).rlike(r"\[[^\]]+\]").alias("cita"),
        refused.alias("se_niega"),
        T.talks_of_texts(F.col("answer")).alias("habla_de_fragmentos"),
        T.word_count(F.col("answer")).alias("palabras"),
        all_invented(F.col("answer"), F.col("titles")).alias("cita_inventada"),
        F.when(blank, invents).alias("inventa"),
        right.alias("acierto"),
        F.when(~blank, F.concat(found.cast("string"), F.lit("/"), F.size(groups).cast("string"))).alias("datos"),
        F.when(~blank & expects, F.arrays_overlap("articles", F.coalesce("titles", none))).alias("busqueda"),
        F.when(~blank, refused & ~right).alias("se_niega_de_mas"),
        "seconds",
    )


def summarize(scores: DataFrame) -> DataFrame:
    """One row: counts and percentages, rounded half to even; null where nothing applies."""
    open_ = F.col("datos").isNotNull()
    share = lambda column, when: F.bround(100.0 * F.sum(F.when(when, F.col(column).cast("int"))) / F.count(F.when(when, F.col(column))), 0).cast("int")
    every = F.lit(True)
    return scores.agg(
        F.count(F.lit(1)).alias("preguntas"),
        share("acierto", every).alias("aciertos_pct"),
        share("acierto", open_).alias("con_respuesta_pct"),
        share("acierto", F.col("inventa").isNotNull()).alias("sin_respuesta_pct"),
        share("busqueda", open_).alias("busqueda_pct"),
        F.coalesce(F.count_if(F.col("inventa")), F.lit(0)).alias("inventa"),
        F.coalesce(F.count_if(F.col("se_niega_de_mas")), F.lit(0)).alias("se_niega_de_mas"),
        share("cita", open_).alias("cita_pct"),
        share("habla_de_fragmentos", every).alias("habla_de_fragmentos_pct"),
        F.count_if(F.col("cita_inventada")).alias("citas_inventadas"),
        F.bround(F.avg(F.when(open_, F.col("palabras"))), 0).cast("int").alias("palabras_promedio"),
        F.bround(F.avg("seconds"), 1).alias("segundos_promedio"),
    )


# What each figure of a summary is called in a report, and its unit.
LABELS = {
    "preguntas": ("Preguntas evaluadas", ""),
    "aciertos_pct": ("Respuestas correctas", " %"),
    "con_respuesta_pct": ("Correctas entre las que tienen respuesta", " %"),
    "sin_respuesta_pct": ("Correctas entre las que no la tienen", " %"),
    "busqueda_pct": ("Búsquedas con el artículo esperado", " %"),
    "cita_pct": ("Respuestas con cita", " %"),
    "citas_inventadas": ("Citas de artículos no consultados", ""),
    "inventa": ("Invenciones", ""),
    "se_niega_de_mas": ("Negativas sin motivo", ""),
    "habla_de_fragmentos_pct": ("Mencionan los textos recibidos", " %"),
    "palabras_promedio": ("Palabras por respuesta", ""),
    "segundos_promedio": ("Segundos por pregunta", ""),
}


def format_summary(row: dict) -> str:
    """A summary as a table of two columns; a dash where a figure does not apply."""
    width = max(len(label) for label, _ in LABELS.values())
    shown = {name: "—" if row.get(name) is None else f"{row[name]}{unit}" for name, (_, unit) in LABELS.items()}
    return "\n".join(f"{label:<{width}}  {shown[name]:>8}" for name, (label, _) in LABELS.items())
