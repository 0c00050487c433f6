"""Mixing sources to target weights by weighted fair queueing.

Each use of a shuffled document gets a virtual finish time: the tokens of its source up
to and including it, divided by the source's weight. Ordered by that time the sources
advance in proportion to their weights; the order is cut off at the total budget. A
source that is used up (every document as often as allowed) drops out, and the others
share what it leaves in proportion to theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillar.operators.ordered import running_sum
from sillar.llm.tokens import FOLDER, NAME, token_sizes
from sillar.session import cut


def tidy_source(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case; null stays null, blank becomes null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(source, r"(?U)\s+", " "))), F.lit(""))


def finish_time(totals: dict[str, int], weights: dict[str, float], repeats: dict[str, int], budget: int) -> float:
    """The virtual time at which the sources together have given ``budget`` tokens, each
    ``weight * time`` but no more than its tokens times its repeats; infinite if they
    cannot give so much."""
    caps = {s: totals.get(s, 0) * repeats[s] for s in weights}
    ends = sorted((caps[s] / weights[s], s) for s in weights)
    used, slope = 0.0, sum(weights.values())
    now = 0.0
    for end, s in ends:
        step = (end - now) * slope
        if slope > 0 and used + step >= budget:
            return now + (budget - used) / slope
        used, now, slope = used + step, end, slope - weights[s]
    return float("inf")


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 17, folder: str = FOLDER, name: str = NAME) -> tuple[DataFrame, DataFrame]:
    """``(uses, report)``.

    ``uses`` is ``(position, doc_id, use, source, tokens)``: the documents of the mixture in
    its order; ``use`` counts from 1. ``report`` is ``(source, target_share, actual_share,
    tokens, uses, documents, most_used, available)`` for every source of the targets.

    The budget is the number of tokens of all documents that are not blank, whatever their
    source. Sources are compared in one spelling; documents of sources without a target
    are not used; a target without documents gets no share. Targets with a null or
    non-positive share or no repeats get none either; repeated targets are added up, the
    greatest number of repeats counting, null as one. Empty tables give an empty mixture.
    The targets and one row per source come to the driver.
    """
    spark = documents.sparkSession
    wanted = targets.select(tidy_source(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("repeats")).filter("source is not null")
    wanted = wanted.groupBy("source").agg(F.sum(F.when(F.col("share") > 0, F.col("share")).otherwise(0.0)).alias("share"), F.max("repeats").alias("repeats")).collect()
    whole = sum(r["share"] for r in wanted)
    weights = {r["source"]: r["share"] / whole for r in wanted if r["share"] > 0 and r["repeats"] > 0}
    repeats = {s: max(r["repeats"] for r in wanted if r["source"] == s) for s in weights}
    sized = token_sizes(documents.withColumn("source", tidy_source(F.col("source"))), "doc_id", "text", ["source"], folder, name).filter("tokens > 0")
    sized = cut(sized)
    summed = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).withColumn("known", F.col("source").isin(list(weights) or [""]))
    rows = summed.filter("known").collect()
    totals = {r["source"]: r["tokens"] for r in rows}
    budget = summed.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    end = finish_time(totals, weights, repeats, budget) if weights else 0.0
    # of each source, as many rounds over its documents as the mixture can need
    rounds = {s: min(repeats[s], int(min(end * weights[s] / t, 1e9)) + 1) for s, t in totals.items()}
    info = spark.createDataFrame([(s, weights[s], t, rounds[s]) for s, t in totals.items()], "source string, weight double, total long, rounds int")
    shuffled = sized.join(F.broadcast(info), "source").select("*", F.explode(F.sequence(F.lit(1), "rounds")).alias("use"))
    shuffled = shuffled.withColumn("h", F.xxhash64("doc_id", "use", F.lit(seed))).drop("rounds", "total")
    ahead = running_sum(shuffled, "source", ["use", "h", "doc_id"], "tokens", "before")
    ahead = ahead.withColumn("finish", (F.col("before") + F.col("tokens")) / F.col("weight")).withColumn("every", F.lit(0))
    fields = ["every", "finish", "source", "use", "h", "doc_id", "tokens"]
    first = ahead.select(*fields) if end == float("inf") else ahead.filter(F.col("before") / F.col("weight") <= end).select(*fields)
    queued = running_sum(first, "every", fields[1:6], "tokens", "position")
    uses = cut(queued.filter(F.col("position") + F.col("tokens") <= budget).select("position", "doc_id", F.col("use").cast("int").alias("use"), "source", "tokens", "finish"))
    # the document that no longer fitted leaves a gap in each source; the next ones of the
    # source that fit into it follow at the end
    got = {r["source"]: (r["t"], r["last"]) for r in uses.groupBy("source").agg(F.sum("tokens").alias("t"), F.max("finish").alias("last")).collect()}
    last = max((x for _, x in got.values()), default=0.0)
    gaps = [(s, int(min(weights[s] * end, totals[s] * repeats[s], 2**62)) - got.get(s, (0, 0.0))[0]) for s in totals]
    gap = spark.createDataFrame([g for g in gaps if g[1] > 0], "source string, gap long")
    spare = ahead.filter(F.col("finish") > last).join(F.broadcast(gap), "source").filter(F.col("tokens") <= F.col("gap")).select("source", "use", "h", "doc_id", "tokens", "gap")
    spare = running_sum(spare, "source", ["use", "h", "doc_id"], "tokens", "before").filter(F.col("before") + F.col("tokens") <= F.col("gap"))
    spare = running_sum(spare.select(F.lit(0).alias("every"), "source", "use", "h", "doc_id", "tokens"), "every", ["source", "use", "h", "doc_id"], "tokens", "after")
    total = sum(t for t, _ in got.values())
    spare = spare.filter(F.col("after") + F.col("tokens") + total <= budget)
    spare = spare.select((F.col("after") + total).alias("position"), "doc_id", F.col("use").cast("int").alias("use"), "source", "tokens")
    uses = uses.drop("finish").unionByName(spare)
    per = uses.groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("n").alias("uses"), F.count(F.lit(1)).alias("documents"), F.max("n").alias("most_used"))
    goal = spark.createDataFrame([(r["source"], float(r["share"] / whole) if whole else 0.0, int(totals.get(r["source"], 0))) for r in wanted], "source string, target_share double, available long")
    report = goal.join(per, "source", "left").na.fill(0, ["tokens", "uses", "documents", "most_used"])
    report = report.select("source", "target_share", F.round(F.col("tokens") / F.lit(max(1, budget)), 6).alias("actual_share"), "tokens", "uses", "documents", "most_used", "available")
    return uses, report
