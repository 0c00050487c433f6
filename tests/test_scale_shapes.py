"""Shapes of plans that matter at scale: what is pushed down, what is not shuffled, what is cut before it is."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sillar.operators import chats, corpus, feed, search, search_index, vectors
from sillar.operators.snapshot_delta import page_deltas


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def saved(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def test_snapshot_delta_reads_four_columns(spark, tmp_path):
    pages = saved(spark, tmp_path / "p", [(1, "A", dt.datetime(2025, 1, 1), "x", 1, "wide" * 50)], "page_id long, title string, snapshot_ts timestamp, hash string, gen int, text string")
    text = plan(page_deltas(pages))
    assert "text:string" not in text and "PushedFilters: [IsNotNull(gen)" in text


def test_windows_are_cut_before_the_shuffle(spark, tmp_path):
    m = saved(spark, tmp_path / "m", [(1, "c", "user", "x", None)], "message_id long, chat_id string, role string, content string, created_at timestamp")
    c = saved(spark, tmp_path / "c", [("c", None, 0)], "chat_id string, summary string, summary_upto long")
    assert "WindowGroupLimit" in plan(chats.context_window(m, c, 4))


def test_latest_events_fold_before_the_shuffle(spark, tmp_path):
    e = saved(spark, tmp_path / "e", [(None, 1, "edit", "A", None)], "ts timestamp, seq long, kind string, title string, target string")
    text = plan(feed.latest_events(e))
    assert "partial_max" in text and text.count("Exchange hashpartitioning") == 1


def test_merge_is_one_join(spark, tmp_path):
    current = saved(spark, tmp_path / "a", [("A", 1, "x", None, 1)], "title string, page_id long, hash string, snapshot_ts timestamp, gen int")
    incoming = saved(spark, tmp_path / "b", [("A", "x")], "title string, hash string")
    text = plan(corpus.merge_actions(current, incoming, F.lit(dt.datetime(2025, 1, 1)), 2))
    assert text.count("FullOuter") == 1 and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_search_has_no_nested_loop_over_rows(spark, tmp_path):
    chunks = saved(spark, tmp_path / "k", [(1, 1, "Lago", "s", "agua"), (2, 1, "Lago", "s", "sal")], "chunk_id long, page_id long, title string, section string, text string")
    index = search.build_index(chunks)
    wanted = spark.createDataFrame([(1, "lago")], "qid long, query string")
    text = plan(search.scored(index, search.terms_of(wanted)))
    assert "CartesianProduct" not in text
    # the only nested loops join a single row of statistics
    assert text.count("BroadcastNestedLoopJoin") <= 2


def test_search_reads_the_buckets_of_its_words(spark, tmp_path):
    chunks = saved(spark, tmp_path / "k", [(i, 1, f"Lago{i}", "s", "agua") for i in range(50)], "chunk_id long, page_id long, title string, section string, text string")
    search_index.write_index(chunks, str(tmp_path / "index"), 16)
    index = search_index.read_index(chunks, str(tmp_path / "index"))
    assert len(list((tmp_path / "index" / "00000000-whole-16" / "postings").glob("b=*"))) > 4
    seen = []
    original = search.cut
    search.cut = lambda df: seen.append(plan(df)) or original(df)
    try:
        search.match(index, search.terms_of(spark.createDataFrame([(1, "lago7")], "qid long, query string")))
    finally:
        search.cut = original
    assert "PartitionFilters: [isnotnull(b" in seen[1] and "BroadcastHashJoin" in seen[1]


def test_a_common_word_is_not_visited_for_each_query(spark, tmp_path):
    """Queries of one common word and a name each: the common word's rows come once, not once per query."""
    rows = [(i, i, f"Nombre{i:04d}" if i % 40 == 0 else "Otro", "Historia", "agua " * (i % 7)) for i in range(1200)]
    index = search.build_index(saved(spark, tmp_path / "k", rows, "chunk_id long, page_id long, title string, section string, text string"))
    wanted = spark.createDataFrame([(i, f"Historia de Nombre{i:04d}") for i in range(0, 1200, 40)], "qid long, query string")
    found = search.match(index, search.terms_of(wanted))
    by_score = lambda r: (r["score"], r["chunk_id"])
    some, every = search.best_rows(found, 4).collect(), search.best_rows(found, None).collect()
    assert len(every) == 30 * 1200 and len(some) <= 30 * (1 + 2 * 4)
    for qid in (0, 40, 1160):
        best = [sorted((r for r in rs if r["qid"] == qid), key=by_score)[:4] for rs in (some, every)]
        assert [r.asDict() for r in best[0]] == [r.asDict() for r in best[1]]


def test_best_rows_by_common_and_rare_terms(spark, tmp_path, monkeypatch):
    """The best rows by score, and by terms matched and then score, wherever the line between rare and common lies."""
    text = ["lago", "lago volcán", "volcán sierra", "lago sierra puerto", "puerto lago volcán sierra", "sierra", "nada", "lago lago volcán"]
    rows = [(i, i % 9, "Puerto" if i % 11 == 0 else None, "Lago" if i % 3 == 0 else "s", text[i % 8] + " relleno" * (i % 5)) for i in range(120)]
    index = search.build_index(saved(spark, tmp_path / "k", rows, "chunk_id long, page_id long, title string, section string, text string"))
    wanted = spark.createDataFrame([(1, "lago"), (2, "lago puerto"), (3, "lago volcán sierra puerto"), (4, "sierra nada"), (5, "volcán inexistente"), (6, "lago puerto")], "qid long, query string")
    found = search.match(index, search.terms_of(wanted))
    every = search.best_rows(found, None).collect()
    for most in (0, 20, 50, 1000):
        monkeypatch.setattr(search, "RARE_ROWS", most)
        some = search.best_rows(found, 5).collect()
        assert len({(r["qid"], r["chunk_id"]) for r in some}) == len(some)
        for key in (lambda r: (r["qid"], r["score"], r["chunk_id"]), lambda r: (r["qid"], r["matched"] < r["n_terms"], r["score"], r["chunk_id"])):
            for qid in range(1, 7):
                best = [sorted((tuple(r[c] for c in ("qid", "chunk_id", "page_id", "score", "matched", "n_terms")) for r in sorted((r for r in rs if r["qid"] == qid), key=key)[:5])) for rs in (some, every)]
                assert best[0] == best[1] and best[0], (most, qid)


def test_a_batch_without_an_index_has_the_postings_of_its_terms(spark, tmp_path):
    rows = [(1, 1, "Lago Ñandú", "Historia", "El lago, un LAGO y la lagartija; historiadores."), (2, 1, None, None, None), (3, 2, "Sal", "", "sal"), (4, 2, "", None, "ﬁno fino")]
    rows += [rows[0], (1, 1, "Lago Ñandú", "Historia", "Otro lago del mismo número."), (4, 2, None, "", "ﬁno fino")]
    chunks = saved(spark, tmp_path / "k", rows, "chunk_id long, page_id long, title string, section string, text string")
    wanted = spark.createDataFrame([(1, "Historia del lago ñandú"), (2, "fino")], "qid long, query string")
    whole, batch = search.build_index(chunks), search.batch_index(chunks, wanted)
    keys = {"lago", "nandu", "histo", "fino", search.WHOLE}
    rows_of = lambda i: sorted(tuple(r) for r in i.postings.select("b", "key", "word", "chunk_id", "page_id", "dl", "f").collect())
    assert rows_of(batch) == [r for r in rows_of(whole) if r[1] in keys] and len({r[1] for r in rows_of(batch)}) == 5
    assert search.hybrid_search(batch, wanted).collect() == search.hybrid_search(whole, wanted).collect()


def test_the_words_of_a_batch_are_made_once(spark, tmp_path):
    chunks = saved(spark, tmp_path / "k", [(1, 1, "Lago", "s", "agua")], "chunk_id long, page_id long, title string, section string, text string")
    text = plan(search.postings_with(chunks, ["lago"]))
    assert "size(concat(regexp_extract_all" not in text and text.count("Exchange") == 1


def test_the_length_of_a_vector_is_summed_up_once(spark, tmp_path):
    v = saved(spark, tmp_path / "v", [(1, [3, 4])], "vec_id long, vec array<int>")
    done = v.select(vectors.normalised(F.col("vec"), 2).alias("u"))
    assert done.first()["u"] == [0.6, 0.8] and plan(done).count("aggregate(") == 1


def test_nearest_rows_with_many_equal_ones(spark):
    rng = np.random.default_rng(5)
    units = rng.normal(size=(6, 12))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    ints = rng.integers(-3, 4, size=(300, 12)) * rng.integers(1, 40, size=(300, 1))
    ints[50:120] = ints[50]  # many alike, some longer than unit length
    ints = np.concatenate([np.tile(ints, (30, 1)), np.round(units * 127).astype(int)])
    ids = rng.permutation(len(ints))
    data = spark.createDataFrame([(int(i), [int(x) for x in v]) for i, v in zip(ids, ints)], "id long, vec array<tinyint>")
    asks = spark.createDataFrame([(i, [float(x) for x in u]) for i, u in enumerate(units)], "qid long, vec array<double>")
    got = sorted(tuple(r) for r in vectors.exact_top_k(asks, data, 40, rows=len(ids)).collect())
    sims = np.round(units @ ints.T / 127.0, 6)
    assert got == [(q, p + 1, int(ids[j]), float(sims[q, j])) for q in range(6) for p, j in enumerate(np.lexsort((ids, -sims[q]))[:40])]
