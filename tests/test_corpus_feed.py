import datetime as dt

import pytest
from pyspark.sql import functions as F

from sillar.operators import corpus as C
from sillar.operators import feed as X
from sillar.sources.questions import image_bytes, load_config
from sillar.sources.wiki import Unavailable, WikiApi, category_closure, page_texts, refresh

T = dt.datetime(2025, 1, 1)
DAY = dt.timedelta(days=1)
PAGES = "page_id long, title string, revid long, snapshot_ts timestamp, size int, hash string, gen int, title_key string"


def pages(spark, *rows):
    return spark.createDataFrame([(i, t, r, ts, None, h, g, t.lower()) for i, (t, r, ts, h, g) in enumerate(rows, 1)], PAGES)


def test_merge_tally_and_state(spark):
    current = pages(spark, ("Igual", None, T, "1", 1), ("Cambia", None, T, "2", 1), ("Nueva local", 5, T + 5 * DAY, "3", None), ("Borrada", None, T, "4", 1), ("Local sin archivo", 9, T + 5 * DAY, "6", None), ("Sin fecha", None, None, None, None))
    incoming = spark.createDataFrame([("Igual", "1"), ("Cambia", "x"), ("Nueva local", "y"), ("Otra", "5")], "title string, hash string")
    done = C.merge_actions(current, incoming, F.lit(T + DAY), 2)
    got = {r.title: (r.action, r.gen, r.hash) for r in done.collect()}
    assert got == {"Igual": ("igual", 2, "1"), "Cambia": ("cambiado", 2, "x"), "Nueva local": ("local más reciente", 2, "3"), "Otra": ("nuevo", 2, "5"), "Borrada": ("borrado", 1, "4"), "Sin fecha": ("borrado", None, None)}
    assert {r.action: r.n for r in C.tally(done).collect()}["borrado"] == 2
    assert {r.title: r.snapshot_ts for r in done.collect()}["Nueva local"] == T + 5 * DAY


def test_upsert_delete_sizes_redirects(spark):
    current = pages(spark, ("A", None, T, "1", 3), ("B", None, T, "2", 3))
    incoming = spark.createDataFrame([(9, "B", 7, "texto", None, None), (10, "C", 8, "x", T, 4)], "page_id long, title string, revid long, text string, snapshot_ts timestamp, gen int")
    got = {r.title: r for r in C.upsert_pages(current, incoming, F.lit(T + DAY)).collect()}
    assert set(got) == {"A", "B", "C"} and got["B"].gen == 3 and got["B"].size == 5 and got["B"].snapshot_ts == T + DAY and got["C"].gen == 4
    child = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "chunk_id long, page_id long")
    gone = spark.createDataFrame([(1,)], "page_id long")
    assert sorted(r.chunk_id for r in C.delete_cascade(gone, "page_id", c=child)["c"].collect()) == [2, 3]
    chunk = spark.createDataFrame([(1, "abc"), (1, "de"), (1, None)], "page_id long, text string")
    assert {r.title: r.size for r in C.fill_sizes(current, chunk).collect()} == {"A": 5, "B": 0}
    old = spark.createDataFrame([("a", "A", 1), ("b", "B", None), ("c", "C", 2)], "title_key string, target string, gen int")
    new = spark.createDataFrame([("d", "D")], "title_key string, target string")
    assert sorted(r.title_key for r in C.refresh_redirects(old, new, 2).collect()) == ["c", "d"]
    assert C.migrate(new, {"target": "string", "size": "int"}).columns == ["title_key", "target", "size"]


def test_images_and_meta(spark):
    schema = "image_id long, page_id long, src string, caption string"
    have = spark.createDataFrame([(1, 1, "zim:a", None), (2, 1, "http://b", None), (3, 2, "zim:c", None), (4, 3, "zim:d", None)], schema)
    new = spark.createDataFrame([(9, 2, "zim:z", "c")], schema)
    touched = spark.createDataFrame([(1,), (2,)], "page_id long")
    assert sorted(r.image_id for r in C.set_images(have, new, touched).collect()) == [2, 4, 9]
    meta = spark.createDataFrame([], "key string, value string")
    meta = C.set_meta(meta, "a", "1")
    assert C.get_meta(meta, "a") == "1" and C.get_meta(C.set_meta(meta, "a", None), "a") is None


def test_generations_and_cursors():
    assert C.next_generation(None, 0, "x", False) == (1, "start") and C.next_generation("x", 1, "x", False) == (1, "resume") and C.next_generation("x", 1, "x", True) == (1, "skip")
    assert C.hand_over_cursor(None, 5.0, True) == (5.0, False) and C.hand_over_cursor(9.0, 5.0, True) == (9.0, True)
    assert X.strategy(100, None, False, True, None) == "catch_up" and X.strategy(100, 50, True, True, 1) == "catch_up" and X.strategy(100, 50, False, True, None) == "feed"
    assert X.strategy(100, 50, False, False, None) == "catch_up" and X.strategy(30 * 86400, 0, False, True, None) == "catch_up"
    assert X.cursor_after_feed(1000) == 880 and X.cursor_after_check(5000) == 1400
    assert X.try_run(lambda: None) and not X.try_run(lambda: 1 / 0)


EVENTS = "ts timestamp, seq long, kind string, title string, target string"


def test_feed(spark):
    events = spark.createDataFrame([(T, 1, "edit", "A", None), (T, 2, "delete", "A", None), (T, 3, "move", "B", "B2"), (T, 4, "edit", "C", None), (T, 5, "edit", "X", None), (T, 6, "move", "Y", "Y2"), (T, 7, "delete", "B2", None), (T, 8, "move", "D", "E"), (T, 9, "edit", None, None)], EVENTS)
    known = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "title string")
    got = {r.title: r.action for r in X.plan_changes(events, known).collect()}
    assert got == {"A": "delete", "B": "delete", "B2": "delete", "C": "fetch", "Y": "delete", "D": "delete", "E": "fetch"}
    everything = {r.title: r.action for r in X.plan_changes(events, known, track_all=True).collect()}
    assert everything["X"] == "fetch" and everything["Y2"] == "fetch"
    mine = spark.createDataFrame([("A", 1), ("C", 1), ("Z", 1)], "title string, v int")
    after = X.apply_changes(mine, X.plan_changes(events, known), spark.createDataFrame([("C", 2), ("E", 2), ("Q", 2)], "title string, v int"))
    assert sorted(map(tuple, after.collect())) == [("C", 2), ("E", 2), ("Z", 1)]


def test_map_log_events(spark):
    schema = "ts timestamp, seq long, type string, log_type string, log_action string, ns int, title string, target string, target_ns int"
    raw = [(T, 1, "edit", None, None, 0, "A", None, None), (T, 2, "log", "delete", "delete", 0, "B", None, None), (T, 3, "log", "delete", "restore", 0, "C", None, None), (T, 4, "log", "move", "move", 0, "D", "U:D", 2), (T, 5, "log", "block", "block", 0, "E", None, None), (T, 6, "new", None, None, 1, "F", None, None)]
    got = [(r.title, r.kind, r.target) for r in X.map_log_events(spark.createDataFrame(raw, schema)).orderBy("seq").collect()]
    assert got == [("A", "edit", None), ("B", "delete", None), ("C", "edit", None), ("D", "move", None)]


def test_catch_up_and_keyset(spark):
    mine = pages(spark, ("A", 1, T, None, None), ("B", 1, T, None, None), ("C", None, T, None, None), ("D", None, T, None, None), ("E", 1, T, None, None), ("F", None, None, None, None))
    latest = spark.createDataFrame([("A", 1, T, False), ("B", 2, T, False), ("C", 9, T + DAY, False), ("D", 9, T, False), ("E", None, None, True), ("F", 1, T, False)], "title string, revid long, ts timestamp, gone boolean")
    assert {r.title: r.action for r in X.catch_up(mine, latest).collect()} == {"B": "fetch", "C": "fetch", "E": "delete", "F": "fetch"}
    assert [r.title for r in X.keyset_page(mine, "B", 2).collect()] == ["C", "D"]


def test_stream_equals_batch(spark, tmp_path):
    from sillar.streaming.feed import follow, newest_events

    rows = [(T + i * dt.timedelta(seconds=1), i, "edit" if i % 3 else "delete", f"t{i % 5}", None) for i in range(40)]
    source = tmp_path / "events"
    for part in range(3):
        spark.createDataFrame(rows[part::3], EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(EVENTS).parquet(str(source))
        follow(stream, str(tmp_path / "v"), str(tmp_path / "c")).awaitTermination()
    want = sorted((r.title, r.seq, r.kind) for r in X.latest_events(spark.createDataFrame(rows, EVENTS)).collect())
    assert sorted((r.title, r.seq, r.kind) for r in newest_events(spark, str(tmp_path / "v")).collect()) == want


def test_wiki_api():
    calls, waits = [], []

    def transport(params):
        calls.append(params)
        if len(calls) == 1:
            return 503, {"Retry-After": "7"}, {}
        if len(calls) == 2:
            return 200, {}, {"error": {"code": "maxlag"}}
        return 200, {}, {"query": {"normalized": [{"from": "a_b", "to": "a b"}], "pages": [{"title": "a b", "revisions": [{"revid": 3, "timestamp": "t"}]}, {"title": "c", "missing": True}]}}

    api = WikiApi(transport, waits.append)
    assert api.latest_revisions(["a_b", "c"]) == {"a_b": (3, "t"), "c": None} and waits == [7.0, 10.0]
    busy = WikiApi(lambda p: (429, {}, {}), waits.append)
    with pytest.raises(Unavailable):
        busy.get()
    parts = iter([{"n": 1, "continue": {"k": 1}}, {"n": 2}])
    assert [b["n"] for b in WikiApi(lambda p: (200, {}, next(parts))).pages()] == [1, 2]


def test_categories_lookups_and_config(spark, tmp_path):
    links = spark.createDataFrame([("R", "S1", True), ("S1", "S2", True), ("S2", "R", True), ("R", "a", False), ("S1", "b", False), ("S2", "c", False), ("S2", "a", False)], "category string, member string, is_category boolean")
    roots = spark.createDataFrame([("R",)], "category string")
    assert [sorted(r.title for r in category_closure(links, roots, d).collect()) for d in (0, 1, 5)] == [["a"], ["a", "b"], ["a", "b", "c"]]
    titles = spark.createDataFrame([("A",), ("old",), ("none",)], "title string")
    api = spark.createDataFrame([("A", 1, "x"), ("new", 2, "y")], "title string, revid long, text string")
    moved = spark.createDataFrame([("old", "new")], "title string, target string")
    fetched = page_texts(titles, api, moved)
    left, rows = refresh(spark.createDataFrame([("A",), ("old",), ("none",)], "title string"), fetched)
    assert [r.title for r in left.collect()] == ["A"] and sorted(r.title for r in rows.collect()) == ["A", "new"]
    path = tmp_path / "c.json"
    path.write_text('{"top_k": 9}')
    assert load_config(str(path))["top_k"] == 9 and load_config(None)["embed_dims"] == 384
    assert image_bytes(b"x", None, None, None) == (b"x", False) and image_bytes(None, "zim:a", lambda p: p.encode(), None) == (b"a", False)
    assert image_bytes(None, "http://x", None, lambda u: b"1") == (b"1", True) and image_bytes(None, "http://x", None, lambda u: 1 / 0) == (None, False)
