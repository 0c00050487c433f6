"""Keyword search with BM25, entity introductions, rank fusion and diversity, for batches of queries.

Shapes
------
``corpus``: ``chunk_id, page_id, title, section, text`` (one row per chunk id).
``queries``: ``qid, query``.

Scores follow SQLite's ``bm25`` with column weights: idf from the number of rows that match a
term in any column, k1 = 1.2, b = 0.75, the row's length over all columns, smaller is better.
They are rounded to six decimals before ordering, and ties go to the smaller id, so results
are the same on every run.

Plan
----
* A posting's *key* is the first five letters of its word, so the words that a term stands for, also by its
  beginning, share one key: terms find postings by an equi-join. Keys are hashed to buckets, a kept index
  (:mod:`sillar.operators.search_index`) is partitioned by them, and a search reads only the buckets of its terms.
* Words that no term can stand for (stopwords of up to four letters, single letters) have no postings. They count
  in the rows' lengths.
* What a term gives to a row is made once per distinct term, not once per query.
* The rows of a query's rare terms are scored for the query. What its common terms give to rows without a rare one is
  the same for all queries with these common terms: the best k are found once for each set of common terms. A thousand
  queries of one common word and a name each do not visit all rows of the common word a thousand times.
* Of the terms of such a set only some *lead*: if the k-th best row of one term alone scores ``s``, rows that have only
  terms whose greatest gains add up to less than ``s`` are not among the best k. Leading terms bring rows, the others
  are looked up for those rows.
* A batch of queries over a corpus without a kept index has the postings of its own terms made, in one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillar.functions import text as T
from sillar.session import cut

# Column weights, BM25 parameters, fusion constant.
TITLE_WEIGHT, SECTION_WEIGHT, TEXT_WEIGHT = 8.0, 3.0, 1.0
K1, B = 1.2, 0.75
RRF_K = 10
LOOSE_WEIGHT = 0.8
PREFIX_FROM = 5
PER_TITLE = 2

TOKEN = r"([\p{L}\p{N}\p{M}]+)"


def raw_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; an underscore divides them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits; an underscore divides them."""
    return F.transform(raw_tokens(text), T.fold_word)


BUCKETS = 64
#: Up to so many terms of a batch of queries (some 100 bytes each) are sent to all executors; more are joined by key.
FEW_TERMS = 100_000
#: The postings of up to so many keys are made for a batch of queries; more get those of all words.
FEW_KEYS = 10_000
#: A term with up to so many rows is rare: they are scored for each query that has it.
RARE_ROWS = 1_000
#: Up to so many rows of results (some 20 bytes each) are sent to all executors to find their titles.
FEW_RESULTS = 500_000
#: Scores are compared after rounding to six decimals.
ROUNDING = 1e-5

POSTINGS = "b int, key string, word string, chunk_id long, page_id long, dl long, f double"


@dataclass(frozen=True)
class Index:
    """``postings(b, key, word, chunk_id, page_id, dl, f)``: the weighted number of a word's occurrences in a row of
    length ``dl``; each row also has one posting of the word ``""``, in bucket 0. ``corpus``: the rows themselves."""

    postings: DataFrame
    corpus: DataFrame
    buckets: int = BUCKETS

    @property
    def sizes(self) -> DataFrame:
        """``(chunk_id, page_id, dl)``."""
        return self.postings.filter((F.col("b") == 0) & (F.col("key") == WHOLE)).select("chunk_id", "page_id", "dl")


#: Stands in the postings for a row as a whole.
WHOLE = ""


def key_of(word: Column) -> Column:
    return F.substring(word, 1, PREFIX_FROM)


def bucket(key: Column, buckets: int) -> Column:
    return F.when(key == WHOLE, 0).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def searchable(word: Column) -> Column:
    """Some term can stand for the word: terms are keywords, and short ones match whole words only."""
    return (F.length(word) >= PREFIX_FROM) | T.meaningful(word)


def _summed(each: DataFrame, buckets: int) -> DataFrame:
    """Postings of ``each(chunk_id, page_id, dl, word, w)``."""
    summed = each.groupBy("word", "chunk_id", "page_id", "dl").agg(F.sum("w").alias("f"))
    key = key_of(F.col("word"))
    return summed.select(bucket(key, buckets).alias("b"), key.alias("key"), "word", "chunk_id", "page_id", "dl", "f")


def postings_of(corpus: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The postings of rows, in one pass and one shuffle."""
    parts = corpus.select("chunk_id", "page_id", tokens(F.col("title")).alias("a"), tokens(F.col("section")).alias("s"), tokens(F.col("text")).alias("c"))
    weighted = lambda column, w: F.transform(F.filter(column, searchable), lambda x: F.struct(x.alias("word"), F.lit(w).alias("w")))
    every = F.concat(weighted("a", TITLE_WEIGHT), weighted("s", SECTION_WEIGHT), weighted("c", TEXT_WEIGHT), F.array(F.struct(F.lit(WHOLE).alias("word"), F.lit(0.0).alias("w"))))
    rows = parts.select("chunk_id", "page_id", (F.size("a") + F.size("s") + F.size("c")).cast("long").alias("dl"), F.explode(every).alias("t"))
    return _summed(rows.select("chunk_id", "page_id", "dl", F.col("t.word").alias("word"), F.col("t.w").alias("w")), buckets)


def postings_with(corpus: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Of the postings of a corpus' unique rows those with one of ``keys``, and those of the rows as a whole. All rows are
    read, their texts are not moved: rows alike in all columns are known by a digest, and their words by their places."""
    alike = F.concat(*(F.concat(F.coalesce(F.length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit(""))) for c in ("title", "section", "text")))
    parts = corpus.select("chunk_id", "page_id", F.unhex(T.content_hash(alike)).alias("digest"), *(raw_tokens(F.col(c)).alias(x) for c, x in (("title", "a"), ("section", "s"), ("text", "c"))))
    n = F.size("a") + F.size("s")
    sized = parts.select("chunk_id", "page_id", "digest", F.size("a").alias("na"), n.alias("ns"), (n + F.size("c")).cast("long").alias("dl"), F.concat("a", "s", "c", F.array(F.lit(WHOLE))).alias("words"))
    # words in rows, as expressions on rows are compiled and those on elements of arrays are not; there is always one, but
    # without "outer" a filter on the array's size is inferred, which makes it twice
    each = sized.select("chunk_id", "page_id", "digest", "na", "ns", "dl", F.posexplode_outer("words").alias("pos", "raw"))
    whole, word = F.col("pos") == F.col("dl"), T.fold_word(F.col("raw"))
    weight = F.when(whole, 0.0).when(F.col("pos") < F.col("na"), TITLE_WEIGHT).when(F.col("pos") < F.col("ns"), SECTION_WEIGHT).otherwise(TEXT_WEIGHT)
    found = each.filter(whole | key_of(word).isin(keys)).select("chunk_id", "page_id", "digest", "dl", "pos", word.alias("word"), weight.alias("w"))
    return _summed(found.repartition("chunk_id").distinct(), buckets)


def unique_rows(corpus: DataFrame) -> DataFrame:
    return corpus.select("chunk_id", "page_id", "title", "section", "text").distinct()


def build_index(corpus: DataFrame) -> Index:
    """The inverted index of a corpus for this session, written once to the shared folder, as it is read several times.
    Null titles, sections and texts are empty."""
    rows = unique_rows(corpus)
    return Index(cut(postings_of(rows)), rows)


def batch_index(corpus: DataFrame, queries: DataFrame) -> Index:
    """An index for these queries only: it has the postings of the words that share a key with one of their terms, and
    those of the rows as a whole."""
    keys = [r["key"] for r in terms_of(queries).select(key_of(F.col("term")).alias("key")).distinct().limit(FEW_KEYS + 1).collect()]
    if len(keys) > FEW_KEYS:
        return build_index(corpus)
    return Index(cut(postings_with(corpus, keys)), unique_rows(corpus))


def terms_of(queries: DataFrame) -> DataFrame:
    """``(qid, term, n_terms)``: the keywords of each query."""
    found = queries.select("qid", T.keywords(F.col("query")).alias("terms"))
    return found.select("qid", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


@dataclass(frozen=True)
class Matches:
    """``terms(qid, term, n_terms)`` and ``gains(term, chunk_id, page_id, gain)``: what each distinct term gives to the
    rows it matches, by statistics of the whole corpus. ``counts(term, df)``: the number of these rows. ``few``: the terms
    are so few that they may be sent to all executors."""

    terms: DataFrame
    gains: DataFrame
    counts: DataFrame
    few: bool = False

    def sent(self, rows: DataFrame) -> DataFrame:
        """Rows that are no more than the terms."""
        return F.broadcast(rows) if self.few else rows


def match(index: Index, terms: DataFrame) -> Matches:
    terms = cut(terms)  # named several times, and its source may be large
    wanted = terms.select("term").distinct().select("term", key_of(F.col("term")).alias("key"))
    facts = terms.agg(F.count(F.lit(1)).alias("n"), F.collect_set(bucket(key_of(F.col("term")), index.buckets)).alias("b")).first()  # no more than there are buckets
    few = F.broadcast if facts["n"] <= FEW_TERMS else (lambda x: x)
    found = index.postings.filter(F.col("b").isin(facts["b"]) & (F.col("word") != WHOLE)).join(few(wanted), "key").filter(F.startswith("word", "term") & ((F.length("term") >= PREFIX_FROM) | (F.col("word") == F.col("term"))))
    hits = cut(found.groupBy("term", "chunk_id", "page_id", "dl").agg(F.sum("f").alias("f")))
    whole = index.sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(whole))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = cut(df.select("term", "df", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"), "avgdl"))
    damp = F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    gains = hits.join(few(df), "term").select("term", "chunk_id", "page_id", (F.col("idf") * F.col("f") * (K1 + 1) / damp).alias("gain"))
    return Matches(terms, gains, df.select("term", "df"), facts["n"] <= FEW_TERMS)


def leading(matches: Matches, limit: int) -> DataFrame:
    """``(qid, term, n_terms, leads, least)``: which terms of a query may bring rows to its best ``limit``, and a score
    that the best ``limit`` rows reach at least."""
    by = Window.partitionBy("term").orderBy(F.col("gain").desc())
    tops = matches.gains.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= limit)
    tops = tops.groupBy("term").agg(F.max("gain").alias("top"), F.when(F.count(F.lit(1)) >= limit, F.min("gain")).otherwise(0.0).alias("kth"))
    each = matches.terms.join(matches.sent(tops), "term").groupBy("qid").agg(F.first("n_terms").alias("n_terms"), F.sort_array(F.collect_list(F.struct("top", "term", "kth"))).alias("ts"))
    each = each.withColumn("least", F.array_max(F.transform("ts", lambda x: x["kth"])) - ROUNDING)
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<term:string,leads:boolean>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        total = state["sum"] + x["top"]
        return F.struct(total.alias("sum"), F.concat(state["out"], F.array(F.struct(x["term"].alias("term"), (total >= F.col("least")).alias("leads")))).alias("out"))

    marked = each.select("qid", "n_terms", "least", F.explode(F.aggregate("ts", start, step, lambda s: s["out"])).alias("t"))
    return marked.select("qid", F.col("t.term").alias("term"), "n_terms", F.col("t.leads").alias("leads"), "least")


def _per_row(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("qid", "chunk_id").agg(F.first("page_id").alias("page_id"), (-F.sum("gain")).alias("score"), F.count(F.lit(1)).alias("matched"), F.first("n_terms").alias("n_terms"))
    return per.withColumn("score", F.round("score", 6))


def _led_rows(matches: Matches, limit: int) -> DataFrame:
    """Shaped as ``best_rows``: the rows that the leading terms of each query bring."""
    plan = cut(leading(matches, limit))
    found = matches.sent(plan.filter("leads")).join(matches.gains, "term").filter((F.col("n_terms") > 1) | (F.col("gain") >= F.col("least")))
    found = found.select("qid", "chunk_id", "page_id", "n_terms", "gain")
    rest = found.select("qid", "chunk_id").distinct().join(matches.sent(plan.filter("not leads").select("qid", "term", "n_terms")), "qid")
    return _per_row(found.unionByName(rest.join(matches.gains, ["term", "chunk_id"]).select("qid", "chunk_id", "page_id", "n_terms", "gain")))


def _best_by_common(matches: Matches, sets: DataFrame, limit: int) -> DataFrame:
    """``(common, chunk_id, page_id, score, matched)``: for each of ``sets(common)``, terms with a space between them, the
    best ``limit`` rows by score and the best ``limit`` of those that have all its terms."""
    terms = sets.select("common").distinct().select(F.col("common").alias("qid"), F.split("common", " ").alias("ts"))
    terms = terms.select("qid", F.size("ts").alias("n_terms"), F.explode("ts").alias("term"))
    held = matches.gains.join(matches.sent(terms.select("term").distinct()), "term", "left_semi")
    rows = _led_rows(Matches(terms, held, matches.counts, matches.few), limit)
    by = Window.partitionBy("qid").orderBy("score", "chunk_id")
    best = lambda df: df.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= limit).drop("r")
    both = best(rows).unionByName(best(rows.filter(F.col("matched") >= F.col("n_terms")))).groupBy("qid", "chunk_id")
    return both.agg(*(F.first(c).alias(c) for c in ("page_id", "score", "matched"))).withColumnRenamed("qid", "common")


def best_rows(matches: Matches, limit: int | None) -> DataFrame:
    """``(qid, chunk_id, page_id, score, matched, n_terms)``: rows that match any term of a query. With a ``limit`` those
    that are not among the best ``limit``, by score or by terms matched and then score, may be absent.

    A row without any of a query's rare terms scores what its common terms give. If it is not among the best ``limit``
    by these, the rows before it score at least as much in the whole query, so it is not among its best. Rows
    with all terms of a query have its rare ones, if there are any.
    """
    if limit is None:
        return _per_row(matches.sent(matches.terms).join(matches.gains, "term").select("qid", "chunk_id", "page_id", "n_terms", "gain"))
    terms = cut(matches.terms.join(matches.sent(matches.counts), "term").select("qid", "term", "n_terms", (F.col("df") <= RARE_ROWS).alias("rare")))
    rare, common = terms.filter("rare").drop("rare"), terms.filter("not rare").drop("rare")
    sets = common.groupBy("qid", "n_terms").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("common"))
    found = matches.sent(rare).join(matches.gains, "term").select("qid", "chunk_id", "page_id", "n_terms", "gain")
    rest = found.select("qid", "chunk_id").distinct().join(matches.sent(common), "qid").join(matches.gains, ["term", "chunk_id"])
    own = _per_row(found.unionByName(rest.select(*found.columns)))
    shared = matches.sent(sets).join(cut(_best_by_common(matches, sets, limit)), "common").select(*own.columns)
    # a row that has a rare term matches more terms than what the common ones alone tell of it
    whole = own.unionByName(shared).groupBy("qid", "chunk_id").agg(F.max(F.struct("matched", "page_id", "score", "n_terms")).alias("t"))
    whole = whole.select("qid", "chunk_id", *(F.col(f"t.{c}").alias(c) for c in ("page_id", "score", "matched", "n_terms")))
    of_query = Window.partitionBy("qid")  # a few thousand rows
    whole = whole.withColumn("by_score", F.row_number().over(of_query.orderBy("score", "chunk_id")))
    whole = whole.withColumn("by_tier", F.row_number().over(of_query.orderBy(F.col("matched") < F.col("n_terms"), "score", "chunk_id")))
    return cut(whole.filter((F.col("by_score") <= limit) | (F.col("by_tier") <= limit)).drop("by_score", "by_tier"))


def scored(index: Index, terms: DataFrame, limit: int | None = None) -> DataFrame:
    """``best_rows`` of the terms' matches."""
    return best_rows(match(index, terms), limit)


def keyword_search(hits: DataFrame, limit: int, strict_only: bool = False) -> DataFrame:
    """``(qid, pos, chunk_id, page_id, score, strict)``: rows with all terms first, then, if they are fewer
    than ``limit``, rows with some. ``strict`` tells that only the first kind was needed:
    the query has one term, or enough rows have them all."""
    tier = (F.col("matched") < F.col("n_terms")).cast("int")
    if strict_only:
        hits = hits.filter(tier == 0)
    by = Window.partitionBy("qid").orderBy("tier", "score", "chunk_id")
    top = hits.withColumn("tier", tier).withColumn("pos", F.row_number().over(by)).filter(F.col("pos") <= limit)
    fully = F.sum((F.col("tier") == 0).cast("int")).over(Window.partitionBy("qid"))
    return top.select("qid", "pos", "chunk_id", "page_id", "score", ((F.col("n_terms") == 1) | (fully >= limit)).alias("strict"))


def best_chunks(index: Index, matches: Matches, pages: DataFrame) -> DataFrame:
    """``(qid, page_id, chunk_id)`` for ``pages(qid, page_id)``: the page's best row for the query, by
    statistics of the whole corpus, else its first row. Only rows of these pages are scored."""
    pages = pages.select("qid", "page_id").distinct()
    hits = pages.join(matches.terms.select("qid", "term"), "qid").join(matches.gains, ["term", "page_id"]).groupBy("qid", "page_id", "chunk_id").agg(F.round(-F.sum("gain"), 6).alias("score"))
    best = hits.groupBy("qid", "page_id").agg(F.min(F.struct("score", "chunk_id")).alias("b"))
    out = pages.join(first_chunks(index, pages), "page_id").join(best, ["qid", "page_id"], "left")
    return out.select("qid", "page_id", F.coalesce("b.chunk_id", "first").alias("chunk_id"))


def first_chunks(index: Index, pages: DataFrame) -> DataFrame:
    """``(page_id, first)`` of these pages."""
    return index.sizes.join(pages.select("page_id").distinct(), "page_id", "left_semi").groupBy("page_id").agg(F.min("chunk_id").alias("first"))


def entity_candidates(pages: DataFrame, redirects: DataFrame, keys: DataFrame) -> DataFrame:
    """``(title_key, page_id)``: for each of ``keys(title_key)`` the page it stands for. An own title goes
    before a redirect, a title that is the key without its clarification before others, then
    the longest page, then the smallest id."""
    keys = keys.select("title_key").distinct()
    own = pages.join(keys, "title_key", "left_semi").select("title_key", F.lit(0).alias("kind"), "page_id", "title", "size")
    other = redirects.join(keys, "title_key", "left_semi").select("title_key", F.col("target").alias("title")).join(pages.select("page_id", "title", "size"), "title").select("title_key", F.lit(1).alias("kind"), "page_id", "title", "size")
    every = own.unionByName(other)
    rank = F.struct("kind", (T.title_base_key(F.col("title")) != F.col("title_key")).alias("differs"), (-F.coalesce("size", F.lit(0))).alias("less"), "page_id")
    return every.groupBy("title_key").agg(F.min(rank).alias("best")).select("title_key", F.col("best.page_id").alias("page_id"))


def entity_intros(index: Index, pages: DataFrame, redirects: DataFrame, queries: DataFrame, most: int = 2, longest: int = 4) -> DataFrame:
    """``(qid, pos, page_id, chunk_id)``: the first rows of the pages a query is about, ``pos`` from 1.

    Longer runs of words go first; a run that shares a word with one taken, or leads to a
    page taken, is passed over.
    """
    grams = T.query_grams(queries.select("qid", "query"), longest).select("qid", (-F.col("size")).alias("g"), F.col("gram").alias("title_key"), "start", "size")
    found = cut(entity_candidates(pages, redirects, grams.select("title_key")))
    first = first_chunks(index, found).withColumnRenamed("first", "chunk_id")
    options = grams.join(found, "title_key").join(first, "page_id").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("g", "start", "size", "page_id", "chunk_id"))).alias("o"))
    empty = F.expr("cast(array() as array<struct<g:int,start:int,size:int,page_id:bigint,chunk_id:bigint>>)")

    def step(taken: Column, o: Column) -> Column:
        clash = F.exists(taken, lambda t: (t["page_id"] == o["page_id"]) | ((t["start"] < o["start"] + o["size"]) & (o["start"] < t["start"] + t["size"])))
        return F.when((F.size(taken) >= most) | clash, taken).otherwise(F.concat(taken, F.array(o)))

    walked = options.select("qid", F.posexplode(F.aggregate("o", empty, step)).alias("p", "t"))
    return walked.select("qid", (F.col("p") + 1).alias("pos"), F.col("t.page_id").alias("page_id"), F.col("t.chunk_id").alias("chunk_id"))


def fuse(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """``(qid, chunk_id, score)``: weighted reciprocal ranks of ``keyword(qid, pos, chunk_id, strict)`` and
    ``semantic(qid, pos, chunk_id)``, positions from 1; keyword hits count less if not strict."""
    weight = F.when(F.col("strict"), 1.0).otherwise(LOOSE_WEIGHT)
    a = keyword.select("qid", "chunk_id", (weight / (RRF_K + F.col("pos") - 1)).alias("r"), F.col("pos").alias("seen"))
    b = semantic.select("qid", "chunk_id", (1.0 / (RRF_K + F.col("pos") - 1)).alias("r"), (F.col("pos") + 1_000_000).alias("seen"))
    return a.unionByName(b).groupBy("qid", "chunk_id").agg(F.round(F.sum("r"), 9).alias("score"), F.min("seen").alias("seen"))


def diverse(ranked: DataFrame, k: int, per_title: int = PER_TITLE) -> DataFrame:
    """Of ``ranked(qid, pos, title, ...)`` at most ``per_title`` rows per title and ``k`` in all, in order;
    ``pos`` is numbered anew from 1. A null title is one title."""
    by_title = Window.partitionBy("qid", "title").orderBy("pos")
    again = Window.partitionBy("qid").orderBy("old")
    kept = ranked.withColumn("nth", F.row_number().over(by_title)).filter(F.col("nth") <= per_title).withColumnRenamed("pos", "old")
    return kept.withColumn("pos", F.row_number().over(again)).filter(F.col("pos") <= k).drop("nth", "old")


def hybrid_search(index: Index, queries: DataFrame, k: int = 6, semantic: DataFrame | None = None, pages: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """``(qid, pos, chunk_id, page_id, title, section)``: introductions of the pages named in the query,
    then keyword hits fused with ``semantic(qid, pos, page_id)``, if given; at most two per title."""
    matches = match(index, terms_of(queries))
    keyword = keyword_search(best_rows(matches, 3 * k), 3 * k)
    if semantic is None:
        ranked = keyword.select("qid", "chunk_id", F.col("pos").cast("double").alias("order"))
    else:
        semantic = cut(semantic)  # what is named several times below is cut, else the plan holds its whole history each time
        best = best_chunks(index, matches, semantic)
        near = semantic.join(best, ["qid", "page_id"]).select("qid", "pos", "chunk_id")
        fused = fuse(keyword, near)
        by = Window.partitionBy("qid").orderBy(F.col("score").desc(), "seen")
        ranked = fused.select("qid", "chunk_id", F.row_number().over(by).cast("double").alias("order"))
    if pages is not None and redirects is not None:
        intros = cut(entity_intros(index, pages, redirects, queries).select("qid", "chunk_id", (F.col("pos") - 1000.0).alias("order")))
        ranked = intros.unionByName(ranked.join(intros, ["qid", "chunk_id"], "left_anti"))
    numbered = ranked.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("order"))).drop("order")
    numbered = cut(numbered)
    asked = numbered.select("chunk_id").distinct()
    few = F.broadcast if numbered.count() <= FEW_RESULTS else (lambda x: x)
    # the rows wanted are picked before repeated ones are found, so only their texts are moved
    rows = few(numbered).join(index.corpus.join(few(asked), "chunk_id", "left_semi").select("chunk_id", "page_id", "title", "section"), "chunk_id")
    return diverse(rows, k).select("qid", "pos", "chunk_id", "page_id", "title", "section")


def retrieve(index: Index, queries: DataFrame, top_k: int, vectors: DataFrame | None = None, embedder: Callable | None = None, dims: int = 384, pages: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """``hybrid_search`` from texts: the queries are embedded and the ``2 * top_k`` pages of ``vectors(page_id, vec)`` (quantized)
    nearest to each are fused in; by keywords alone without vectors or embedder, or where the embedder fails."""
    from sillar.operators.vectors import embed_queries, exact_top_k

    semantic = None
    if vectors is not None and embedder is not None:
        asked = embed_queries(queries, embedder, dims)
        near = exact_top_k(asked, vectors.filter(F.size("vec") == dims).select(F.col("page_id").alias("id"), "vec"), 2 * top_k)
        semantic = near.select("qid", "pos", F.col("id").alias("page_id"))
    return hybrid_search(index, queries, top_k, semantic, pages, redirects)
