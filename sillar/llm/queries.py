"""The named queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillar.functions.roles import NOTE_ROLES
from sillar.llm import conversations, mixing, nearest, packing, pair_defects, residue, splitting
from sillar.session import cut
from sillar.plans.sqltext import BY_ASSISTANT, BY_USER, said_by
from sillar.sources.tables import table

BY_NOTE = said_by("role", NOTE_ROLES)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized_kinds(table(spark, folder, "chunks"))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "chunks"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.similar_pairs(table(spark, folder, "page_vectors"))


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    found = nearest.nearest_pages(table(spark, folder, "page_vectors"))
    return found.withColumn("similarity", F.round("similarity", 9))


def p2_routed(spark: SparkSession, folder: str) -> DataFrame:
    """The exact search in shards of an eighth of the rows, so that leaves are divided again and rows visit other shards."""
    vectors = table(spark, folder, "page_vectors")
    shard = max(60, vectors.count() // 8)
    found = nearest.nearest_pages(vectors, factor=1.0, shard_rows=shard, query_rows=2 * shard, sample_rows=3 * shard, leaf_sample=2 * shard)
    return found.withColumn("similarity", F.round("similarity", 9))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.dropped_chats(table(spark, folder, "messages"), table(spark, folder, "chats"))


def p3_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.rebuild_conversations(table(spark, folder, "messages"))


def p3_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.rebuild_conversations(table(spark, folder, "messages"), split_at_gaps=True)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects.defective_answers(table(spark, folder, "messages"))


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects.judged_pairs(table(spark, folder, "messages"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_report(packing.pack(table(spark, folder, "documents")))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.documents_with_residue(table(spark, folder, "documents"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    return residue.without_residue(table(spark, folder, "documents"))


# ------------------------------------------------------------------ what SQL can say of results it cannot make


def p1_check(spark: SparkSession, folder: str) -> DataFrame:
    """Of every text that is split: its length, and whether its pieces are short, start in order, cover it and give it back."""
    chunks = table(spark, folder, "chunks")
    pieces = splitting.split_oversized(chunks).withColumn("repeated", F.lag("end").over(Window.partitionBy("chunk_id").orderBy("piece")) - F.col("start"))
    own = F.substring(F.col("text"), F.col("own_start") - F.col("start") + 1, F.length("text"))
    facts = pieces.groupBy("chunk_id").agg(
        (F.max(F.length("text")) <= splitting.LIMIT).alias("short"), (F.coalesce(F.max("repeated"), F.lit(0)) <= splitting.OVERLAP).alias("little_overlap"), (F.max("piece") == F.count(F.lit(1)) - 1).alias("numbered"), (F.count_if(F.col("end") - F.col("start") != F.length("text")) == 0).alias("placed"),
        F.max("end").alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", own.alias("own")))), lambda x: x["own"]), "").alias("whole"),
    )
    return facts.select("chunk_id", "short", "little_overlap", "numbered", "placed", F.length(F.regexp_replace("whole", r"(?U)\s+", "")).alias("letters"), F.md5(F.regexp_replace("whole", r"(?U)\s+", "").cast("binary")).alias("digest"))


def p3_session_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per kept session its turns, that they alternate, and its first and last message."""
    turns = conversations.rebuild_conversations(table(spark, folder, "messages"), split_at_gaps=True)
    who = F.col("turn") % 2 == F.when(F.col("role") == "user", 0).otherwise(1)
    return turns.groupBy("chat_id", "session").agg(F.count(F.lit(1)).alias("turns"), F.min(who).alias("alternate"), F.min_by("message_id", "turn").alias("first_id"), F.max_by("message_id", "turn").alias("last_id"))


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that is not blank, once: its pieces are whole, fit, and leave no container that could hold another."""
    d = table(spark, folder, "documents")
    packed = cut(packing.pack(d))
    per = packed.groupBy("container").agg(F.sum("tokens").alias("t"))
    report = per.agg((F.max("t") <= packing.CAPACITY).alias("fits"), (F.count(F.lit(1)) <= F.ceil(F.sum("t") / packing.CAPACITY * 1.01) + 1).alias("tight"), (F.max("container") == F.count(F.lit(1)) - 1).alias("numbered"))
    each = packed.groupBy("doc_id").agg(((F.max("piece") == F.count(F.lit(1)) - 1) & (F.max(F.col("tok_start") + F.col("tokens")) == F.sum("tokens"))).alias("whole"))
    return each.crossJoin(F.broadcast(report))  # one row


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per source with documents: whether its share is met or all its uses are made, and no document is used too often."""
    uses, report = mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    docs = table(spark, folder, "documents").select("doc_id", mixing.tidy_source(F.col("source")).alias("of"))
    right = uses.join(docs, "doc_id").groupBy("source").agg((F.count_if(~F.col("source").eqNullSafe(F.col("of"))) == 0).alias("own_documents"))
    limits = table(spark, folder, "mix_targets").groupBy(mixing.tidy_source(F.col("source")).alias("source")).agg(F.max("max_repeats").alias("limit"))
    known = report.filter("available > 0").join(right, "source").join(limits, "source")
    total = F.sum("target_share").over(Window.partitionBy())  # a row per source
    met = (F.abs(F.col("actual_share") - F.col("target_share") / total) <= 0.02) | (F.col("tokens") >= F.col("available") * F.col("limit") * 0.98) | (F.col("actual_share") > F.col("target_share"))
    return known.select("source", met.alias("met"), (F.col("most_used") <= F.col("limit")).alias("within_limit"), "own_documents")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [p1_found, p1_pieces, p2_found, p2_neighbours, p2_routed, p3_found, p3_conversations, p3_sessions, p4_found, p4_pairs, p6_containers, p6_report, p7_mixture, p7_report, p8_found, p8_clean, p1_check, p3_session_check, p6_check, p7_check]
    return {f.__name__: f for f in names}


# Unicode white space inside a character class of DuckDB's regular expressions.
_WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# All pairs: only for small tables, where the search is exact as well.
_LIVE = """
WITH live AS (
  SELECT page_id, vec::DOUBLE[] AS v FROM (
    SELECT page_id, vec FROM page_vectors WHERE page_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY vec_id DESC) = 1)
  WHERE len(vec) = 384 AND list_max(list_transform(vec, lambda x: abs(x::INTEGER))) > 0),
pairs AS (SELECT a.page_id AS a, b.page_id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM live a JOIN live b ON a.page_id <> b.page_id),
near AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS place FROM pairs QUALIFY place <= 10)"""

_TURNS = r"""
WITH alike AS (
  SELECT chat_id, role, content, created_at, min(message_id) AS message_id
  FROM messages WHERE chat_id IS NOT NULL GROUP BY ALL),
read AS (
  SELECT *, CASE WHEN """ + BY_USER + " THEN 0 WHEN " + BY_ASSISTANT + " THEN 1 WHEN " + BY_NOTE + r""" THEN 3 ELSE 2 END AS who,
         NOT regexp_matches(regexp_replace(coalesce(content, ''), '\[[^\[\]]*\]', ' ', 'g'), '[\p{L}\p{N}]') AS blank
  FROM alike),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at, message_id) - 1 AS turn,
         count(*) OVER (PARTITION BY chat_id) AS n
  FROM read WHERE who <> 3),
kept AS (
  SELECT chat_id FROM placed GROUP BY chat_id
  HAVING bool_and(who = turn % 2 AND NOT blank AND created_at IS NOT NULL) AND any_value(n) % 2 = 0)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": rf"""
            SELECT chunk_id, CASE WHEN max(longest) > 1500 THEN 'forced' ELSE 'boundary' END AS kind FROM (
              SELECT chunk_id, length(regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g')) AS n,
                     list_max(list_transform(regexp_extract_all(text, '[^{_WS}]+'), lambda x: length(x))) AS longest
              FROM chunks) WHERE n > 1500 GROUP BY chunk_id""",
        "p2_found": _LIVE + " SELECT DISTINCT least(a, b) AS page_a, greatest(a, b) AS page_b FROM near WHERE s >= 0.8",
        "p2_neighbours": _LIVE + " SELECT a AS page_id, place, b AS neighbour, s AS similarity FROM near",
        "p2_routed": _LIVE + " SELECT a AS page_id, place, b AS neighbour, s AS similarity FROM near",
        "p3_found": _TURNS
        + """SELECT chat_id FROM (SELECT chat_id FROM messages UNION SELECT chat_id FROM chats)
             WHERE chat_id IS NOT NULL AND chat_id NOT IN (SELECT chat_id FROM kept)""",
        "p3_conversations": _TURNS
        + """SELECT chat_id, 0::INTEGER AS session, turn, CASE who WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
                    content, created_at, message_id
             FROM placed WHERE chat_id IN (SELECT chat_id FROM kept)""",
        "p1_check": rf"""
            SELECT DISTINCT chunk_id, true AS short, true AS little_overlap, true AS numbered, true AS placed,
                   length(regexp_replace(text, '[{_WS}]+', '', 'g'))::INTEGER AS letters, md5(regexp_replace(text, '[{_WS}]+', '', 'g')) AS digest
            FROM chunks WHERE length(regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g')) > 1500""",
        "p3_session_check": _TURNS
        + """, gap AS (SELECT quantile_disc(epoch_us(created_at) - epoch_us(before), 0.995) AS g FROM (SELECT created_at, lag(created_at) OVER (PARTITION BY chat_id ORDER BY created_at NULLS FIRST, message_id) AS before, row_number() OVER (PARTITION BY chat_id ORDER BY created_at NULLS FIRST, message_id) AS n FROM placed) WHERE n > 1),
            cuts AS (SELECT *, coalesce(epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY chat_id ORDER BY created_at NULLS FIRST, message_id)) > (SELECT g FROM gap), false)::INTEGER AS cut_here FROM placed),
            parted AS (SELECT *, sum(cut_here) OVER (PARTITION BY chat_id ORDER BY created_at NULLS FIRST, message_id ROWS UNBOUNDED PRECEDING)::INTEGER AS session FROM cuts),
            counted AS (SELECT *, row_number() OVER (PARTITION BY chat_id, session ORDER BY created_at NULLS FIRST, message_id) - 1 AS nth FROM parted)
            SELECT chat_id, session, count(*) AS turns, true AS alternate, arg_min(message_id, nth) AS first_id, arg_max(message_id, nth) AS last_id FROM counted GROUP BY chat_id, session
            HAVING bool_and(who = nth % 2 AND NOT blank AND created_at IS NOT NULL) AND count(*) % 2 = 0""",
        "p6_check": rf"""SELECT doc_id, true AS whole, true AS fits, true AS tight, true AS numbered FROM documents WHERE regexp_replace(text, '[{_WS}]+', '', 'g') <> ''""",
        "p7_check": rf"""
            SELECT DISTINCT source, true AS met, true AS within_limit, true AS own_documents FROM (SELECT lower(trim(regexp_replace(source, '[{_WS}]+', ' ', 'g'))) AS source FROM mix_targets WHERE target_share > 0 AND max_repeats > 0)
            WHERE source IN (SELECT lower(trim(regexp_replace(source, '[{_WS}]+', ' ', 'g'))) FROM documents WHERE regexp_replace(text, '[{_WS}]+', '', 'g') <> '')""",
    }
