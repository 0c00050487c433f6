"""Work that goes on where it ended, models behind callables, and conversations as they grow."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sillar.operators import answers, chats, corpus, feed, images, search, vectors
from sillar.sources import archive, models
from sillar.streaming.schedule import AFTER_FAILURE, LONGEST_WAIT, Repeat

T = dt.datetime(2025, 1, 1)
MESSAGES = "message_id long, chat_id string, role string, content string, sources string, images string, search_query string, created_at timestamp"
CHATS = "chat_id string, title string, created_at timestamp, updated_at timestamp, summary string, summary_upto long"
PAGES = "page_id long, title string, revid long, snapshot_ts timestamp, size int, hash string, gen int, title_key string"


def said(i, chat, role, content):
    return (i, chat, role, content, None, None, None, T)


@pytest.fixture(scope="module")
def talk(spark):
    rows = [said(1, "a", "user", "¿Dónde nace el río Sur?"), said(2, "a", "Bot", "En la sierra."), said(3, "a", "system", "nota"), said(4, "a", " USUARIO", "¿Y su fauna?"), said(5, "b", "user", "hola"), said(6, "b", "assistant", "hola"), said(7, "c", "user", None), said(8, None, "user", "x")]
    return spark.createDataFrame(rows, MESSAGES), spark.createDataFrame([("a", "t", T, T, "Se habló de ríos.", 0), ("c", None, T, T, None, None)], CHATS)


def test_last_questions_and_their_queries(spark, talk):
    asked = answers.last_questions(*talk, recent=1)
    got = {r.chat_id: r for r in asked.collect()}
    assert got.keys() == {"a", "c"} and got["a"].before == "¿Dónde nace el río Sur?" and [tuple(h) for h in got["a"].history] == [("assistant", "En la sierra.")] and got["a"].summary == "Se habló de ríos."
    assert got["c"].question == "" and got["c"].before is None and got["c"].history == []
    plain = {r.chat_id: r.query for r in answers.search_queries(asked).collect()}
    assert plain == {"a": "¿Dónde nace el río Sur? ¿Y su fauna?", "c": ""}
    made = lambda f: {r.chat_id: r.query for r in answers.search_queries(asked, f).collect()}
    assert made(lambda history, q: f"fauna del río Sur {len(history)}") == {"a": "fauna del río Sur 2", "c": ""}
    assert made(lambda history, q: " ") == plain and made(lambda history, q: 1 / 0) == plain


def test_prompts_answers_and_fallback(spark, talk):
    asked = answers.last_questions(*talk)
    sources = spark.createDataFrame([("a", 1, "Río Sur", "Fauna", "Hay nutrias."), ("a", 2, "Río Sur", "Introducción", "Nace en la sierra.")], "chat_id string, pos int, title string, section string, text string")
    ready = answers.prompts(asked, sources)
    prompt = {r.chat_id: r.prompt for r in ready.collect()}["a"]
    assert [m.role for m in prompt] == ["system", "user", "assistant", "user"] and "Hay nutrias." in prompt[0].content and prompt[-1].content == "¿Y su fauna?"
    none = {r.chat_id: r.answer for r in answers.answers(ready, None).collect()}
    assert none["a"].endswith("- Río Sur (Fauna)\n- Río Sur") and "ningún artículo" in none["c"]
    good = {r.chat_id: (r.answer, r.from_model) for r in answers.answers(ready, lambda m: iter(["Hay ", "nutrias."])).collect()}
    assert good == {"a": ("Hay nutrias.", True), "c": ("Hay nutrias.", True)}
    assert not any(r.from_model for r in answers.answers(ready, lambda m: 1 / 0).collect())
    assert answers.answers(answers.prompts(asked.filter("false"), sources), None).count() == 0


def test_summary_prompts(spark):
    rows = [said(i, "a", "user" if i % 2 else "bot", f"m{i}") for i in range(1, 13)]
    chat = spark.createDataFrame([("a", None, T, T, "antes", 2)], CHATS)
    got = answers.summary_prompts(spark.createDataFrame(rows, MESSAGES), chat, recent=4).collect()
    assert len(got) == 1 and got[0].upto == 8 and got[0].prompt[1].content == "Resumen anterior: antes\nUsuario: m3\nAsistente: m4\nUsuario: m5\nAsistente: m6\nUsuario: m7\nAsistente: m8"
    done = chats.set_summaries(chat, spark.createDataFrame([("a", "nuevo", 8)], "chat_id string, summary string, upto long")).first()
    assert (done.summary, done.summary_upto) == ("nuevo", 8)


def test_model_protocols():
    calls = []

    def send(lines):
        return lambda address, body: calls.append((address, body)) or [x if isinstance(x, bytes) else json.dumps(x).encode() for x in lines]

    assert models.embedder("http://h/", "m", "ollama", send([{"embeddings": [[1, 0], [0, 1]]}]))(["a", "b"]).tolist() == [[1, 0], [0, 1]]
    swapped = send([{"data": [{"index": 1, "embedding": [0, 1]}, {"index": 0, "embedding": [1, 0]}]}])
    assert models.embedder("http://h", "m", "openai", swapped)(["a", "b"]).tolist() == [[1, 0], [0, 1]]
    with pytest.raises(ValueError):
        models.embedder("http://h", "m", "ollama", send([{"embeddings": []}]))(["a"])
    assert list(models.chat_model("http://h", "m", "ollama", send([{"message": {"content": "a"}}, b"", {"message": {"content": "b"}, "done": True}]))([])) == ["a", "b"]
    events = [b"data: " + json.dumps({"choices": [{"delta": {"content": "a"}}]}).encode(), b"", b": nada", b'data: {"choices": []}', b"data: [DONE]", b"data: x"]
    assert list(models.chat_model("http://h", "m", "openai", send(events))([])) == ["a"]
    with pytest.raises(RuntimeError):
        list(models.chat_model("http://h", "m", "ollama", send([{"error": "no"}]))([]))
    assert [a for a, _ in calls] == ["http://h/api/embed", "http://h/v1/embeddings", "http://h/api/embed", "http://h/api/chat", "http://h/v1/chat/completions", "http://h/api/chat"]


def test_embedding_goes_on_where_it_ended(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"P{i}", None if i == 3 else i * 10) for i in range(1, 8)], "page_id long, title string, size int")
    chunk = spark.createDataFrame([(i, i, f"texto {i}") for i in range(1, 8)], "chunk_id long, page_id long, text string")
    store, log = str(tmp_path / "vectors"), str(tmp_path / "log")
    assert [r.page_id for r in vectors.embedding_queue(pages, vectors.stored_vectors(spark, store), chunk, 3, after=(50, 5)).collect()] == [4, 2, 1]

    def embedder(texts):
        with open(log, "a") as f:
            f.writelines(t.split("|")[0] + "\n" for t in texts)
        return np.stack([np.bincount([ord(c) % 8 for c in t], minlength=8) for t in texts])

    asked = iter([False, False, True])
    assert vectors.embed_pending(pages, chunk, store, embedder, 8, round_rows=2, stop=lambda: next(asked)) == 4
    assert {r.page_id for r in vectors.stored_vectors(spark, store).collect()} == {7, 6, 5, 4}
    assert vectors.embed_pending(pages, chunk, store, embedder, 8, round_rows=2, most=1) == 1
    assert vectors.embed_pending(pages, chunk, store, embedder, 8) == 2 and vectors.embed_pending(pages, chunk, store, embedder, 8) == 0
    rows = vectors.stored_vectors(spark, store).collect()
    assert sorted(r.page_id for r in rows) == list(range(1, 8)) and len({r.vec_id for r in rows}) == 7 and len(open(log).readlines()) == 7
    last = max(r.vec_id for r in rows if r.page_id >= 4)
    assert {r.page_id for r in vectors.newer_than(vectors.stored_vectors(spark, store), last).collect()} == {1, 2, 3}


def test_retrieval_with_and_without_an_embedder(spark):
    rows = [(1, 1, "Río Sur", "Fauna", "nutrias"), (2, 2, "Monte Alto", "Introducción", "nieve"), (3, 3, "Lago", "Introducción", "agua")]
    index = search.build_index(spark.createDataFrame(rows, "chunk_id long, page_id long, title string, section string, text string"))
    asked = spark.createDataFrame([(1, "nutrias")], "qid long, query string")
    stored = spark.createDataFrame([(2, [127, 0]), (3, [0, 127]), (9, [1])], "page_id long, vec array<tinyint>")
    found = lambda **how: [r.page_id for r in search.retrieve(index, asked, 3, **how).orderBy("pos").collect()]
    assert found() == [1] and found(vectors=stored, embedder=lambda t: 1 / 0, dims=2) == [1]
    assert found(vectors=stored, embedder=lambda t: np.array([[2.0, 1.0]] * len(t)), dims=2) == [1, 2, 3]


def test_caption_vectors_are_made_once(spark):
    pics = spark.createDataFrame([(1, 10, "Río", "nutria"), (2, 10, "Río", None), (3, 20, "Lago", "agua")], "image_id long, page_id long, title string, caption string")
    have = spark.createDataFrame([(1, [127, 0])], "image_id long, vec array<tinyint>")
    new = images.caption_vectors(pics, have, lambda texts: np.array([[0.0, 1.0] if "agua" in t else [1.0, 1.0] for t in texts]), 2)
    assert {r.image_id: r.vec for r in new.collect()} == {2: [90, 90], 3: [0, 127]}
    asked = spark.createDataFrame([(5, [0.0, 1.0])], "qid long, vec array<double>")
    source = spark.createDataFrame([(5, 0, 10)], "qid long, page_rank int, page_id long")
    near = images.similarities(have.unionByName(new), asked, pics, source)
    assert {r.image_id: r.similarity for r in near.collect()} == {1: 0.0, 2: pytest.approx(0.708661)}
    words = spark.createDataFrame([(5, "nada")], "qid long, query string")
    assert images.rank_images(pics, source, words, near).orderBy("pos").first().image_id == 2


def test_articles_are_replaced_with_chunks_and_images(spark):
    pages = spark.createDataFrame([(1, "A", 1, T, 5, "x", 3, "a"), (2, "B", 1, T, 5, "y", 3, "b")], PAGES)
    chunk = spark.createDataFrame([(1, 1, 0, "A", "Introducción", "viejo"), (2, 2, 0, "B", "Introducción", "queda")], "chunk_id long, page_id long, ord int, title string, section string, text string")
    pics = spark.createDataFrame([(1, 1, "zim:a", "v"), (2, 2, "zim:b", "w")], "image_id long, page_id long, src string, caption string")
    new = [(11, "A", 2, "Intro.\n== Clima ==\nLlueve.", T, None, None), (12, "C", 1, "Otra.", T, 4, [("zim:c", "z")])]
    incoming = spark.createDataFrame(new, "page_id long, title string, revid long, text string, snapshot_ts timestamp, gen int, images array<struct<src:string,caption:string>>")
    got = corpus.upsert_articles(pages, chunk, pics, incoming, F.lit(T))
    assert {(r.title, r.page_id, r.gen) for r in got["pages"].collect()} == {("A", 11, 3), ("B", 2, 3), ("C", 12, 4)}
    assert sorted((r.chunk_id, r.page_id, r.title, r.section) for r in got["chunks"].collect()) == [(2, 2, "B", "Introducción"), (3, 11, "A", "Introducción"), (4, 11, "A", "Clima"), (5, 12, "C", "Introducción")]
    assert sorted((r.image_id, r.page_id, r.src) for r in got["images"].collect()) == [(1, 11, "zim:a"), (2, 2, "zim:b"), (3, 12, "zim:c")]
    bare = corpus.upsert_articles(pages, chunk, pics, incoming.withColumn("images", F.array().cast("array<struct<src:string,caption:string>>")), F.lit(T))
    assert [r.image_id for r in bare["images"].collect()] == [2]


def test_catch_up_goes_on_where_it_ended(spark, tmp_path):
    pages = spark.createDataFrame([(i, t, 1, T, 1, "h", 1, t.lower()) for i, t in enumerate("ABCDEFG")], PAGES)
    applied, asked = [], []
    answers_of = {"B": (2, "2025-02-01T00:00:00Z"), "D": None, "E": (1, "2025-01-01T00:00:00Z")}

    def lookup(titles):
        asked.append(titles)
        return {t: answers_of[t] for t in titles if t in answers_of}

    walk = lambda stop: feed.catch_up_in_steps(pages, lookup, lambda d: applied.extend((r.title, r.action) for r in d.collect()), str(tmp_path / "c"), 10_000.0, rows=2, stop=stop)
    stops = iter([False, False, True])
    assert walk(lambda: next(stops)) is None and asked == [["A", "B"], ["C", "D"]]
    assert feed.catch_up_in_steps(pages, lookup, lambda d: applied.extend((r.title, r.action) for r in d.collect()), str(tmp_path / "c"), 99_999.0, rows=2) == 10_000.0 - 3600
    assert asked == [["A", "B"], ["C", "D"], ["E", "F"], ["G"]] and applied == [("B", "fetch"), ("D", "delete")]


def test_events_in_batches(spark, tmp_path):
    events = spark.createDataFrame([(T, i, "edit", f"t{i}", None) for i in range(7)], "ts timestamp, seq long, kind string, title string, target string")
    seen = []

    def apply(part):
        seen.append(sorted(r.seq for r in part.collect()))
        if len(seen) == 2:
            raise OSError("lost")

    with pytest.raises(OSError):
        feed.apply_in_batches(events, apply, str(tmp_path / "s"), 1000.0, 3)
    assert feed.apply_in_batches(events, apply, str(tmp_path / "s"), 1000.0, 3) == 880.0 and seen == [[0, 1, 2], [3, 4, 5], [3, 4, 5], [6]]


def test_chats_grow(spark, talk):
    messages, chat = talk
    more = [("a", 0, "assistant", "Nutrias.", [("Río Sur", None)], None, None), ("c", 0, "user", "¿Qué es un fiordo?", None, None, None), ("n", 1, "assistant", "Sí.", None, None, None), ("n", 0, "user", "¿Hay   mar?", None, None, "mar")]
    incoming = spark.createDataFrame(more, "chat_id string, ord int, role string, content string, sources array<struct<title:string,section:string>>, images array<struct<id:long,title:string,caption:string>>, search_query string")
    now = F.lit(T + dt.timedelta(days=1))
    chat2, said2 = chats.add_messages(chat, messages, incoming, now)
    assert {r.chat_id: (r.title, r.updated_at.day) for r in chat2.collect()} == {"a": ("t", 2), "c": ("¿Qué es un fiordo?", 2), "n": ("¿Hay mar?", 2)}
    assert sorted((r.message_id, r.chat_id, r.content) for r in said2.filter("message_id > 8").collect()) == [(9, "a", "Nutrias."), (10, "c", "¿Qué es un fiordo?"), (11, "n", "¿Hay   mar?"), (12, "n", "Sí.")]
    row, mine = chats.get_chat(chat2, said2, "a")
    assert row.first().title == "t" and [r.sources for r in mine.collect()][-1][0].title == "Río Sur"
    assert chats.create_chat(chat2, "z", now).count() == 4 and chats.create_chat(chat2, "a", now).count() == 3
    assert {r.title for r in chats.rename_chat(chat2, "n", " a  b ").filter("chat_id = 'n'").collect()} == {"a b"}


class _Entry:
    def __init__(self, i):
        self.path, self.title, self.is_redirect, self.i = f"A/{i}", f"T{i}", i % 4 == 1, i

    def get_redirect_entry(self):
        return _Entry(0)

    def get_item(self):
        if self.i == 2:
            raise RuntimeError("damaged")
        return type("Item", (), {"mimetype": "text/html" if self.i % 4 == 0 else "text/css", "content": memoryview(b"<body><p>" + b"palabra " * 40 + b"</p></body>")})


class _Archive:
    all_entry_count = 9

    def _get_entry_by_id(self, i):
        return _Entry(i)


def test_entries_by_number_and_resumed_import(spark, tmp_path):
    reader = archive._ZimReader("x", 4, 0, lambda path: _Archive())
    parts = reader.partitions()
    rows = [r for p in parts for r in reader.read(p)]
    assert [p.start for p in parts] == [0, 4, 8] and [r[0] for r in rows] == [0, 1, 3, 4, 5, 6, 7, 8] and rows[1][5] == "T0" and rows[2][3] == "text/css"
    assert [p.start for p in archive._ZimReader("x", 4, 6, lambda path: _Archive()).partitions()] == [6]
    read = []

    def entries(start, end):
        read.append(start)
        return spark.createDataFrame([r for r in rows if start <= r[0] < end], archive.ENTRY_SCHEMA)

    stops = iter([False, True])
    found, complete = archive.import_in_steps(entries, 9, str(tmp_path / "i"), spark, 4, lambda: next(stops))
    assert not complete and [r.title for r in found.collect()] == ["T0"]
    found, complete = archive.import_in_steps(entries, 9, str(tmp_path / "i"), spark, 4)
    assert complete and sorted(r.title for r in found.collect()) == ["T0", "T4", "T8"] and read == [0, 4, 8]


def test_repeating_a_step():
    waits, results = [], iter([5.0, None, ZeroDivisionError, 1.0])

    def step():
        x = next(results)
        if x is ZeroDivisionError:
            raise x
        if x == 1.0:
            job.stop()
        return x

    job = Repeat(step)
    job.run(waits.append)
    assert waits == [5.0, LONGEST_WAIT, AFTER_FAILURE]
    counted = []
    live = Repeat(lambda: counted.append(1) or 1000.0).start()
    while not counted:
        pass
    live.wake()
    live.stop(5)
    assert counted
