import json
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sillar.operators import chats, evaluate, images, search, search_index, vectors
from sillar.sources.questions import question_set

CHUNKS = "chunk_id long, page_id long, title string, section string, text string"
PAGES = "page_id long, title string, title_key string, size int"
ROWS = [
    (1, 1, "Lago de Atitlán", "Introducción", "El lago de Atitlán está rodeado de volcanes."),
    (2, 1, "Lago de Atitlán", "Historia", "Los pueblos del lago comercian."),
    (3, 2, "Volcán de Fuego", "Introducción", "El volcán entra en erupción."),
    (4, 3, "Guatemala", "Introducción", "País de volcanes y lagos."),
    (5, 4, "Todos (Guatemala)", "Introducción", "Pueblo."),
    (6, 5, "La Gioconda", "Introducción", "Cuadro de Leonardo."),
    (6, 5, "La Gioconda", "Introducción", "Cuadro de Leonardo."),
    (7, 6, None, None, None),
    (8, 1, "Lago de Atitlán", "Clima", "lago lago lago"),
]


@pytest.fixture(scope="module")
def index(spark):
    return search.build_index(spark.createDataFrame(ROWS, CHUNKS))


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "qid long, query string")


def test_scores_match_sqlite(spark, index):
    sqlite3 = pytest.importorskip("sqlite3")
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(title, section, text, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search in this sqlite")
    for r in {r[0]: r for r in ROWS}.values():
        con.execute("INSERT INTO f(rowid, title, section, text) VALUES (?,?,?,?)", (r[0], r[2] or "", r[3] or "", r[4] or ""))
    for query in ("lago atitlan", "volcan", "guatemala volcanes pueblo", "nada"):
        hits = {r.chunk_id: r.score for r in search.scored(index, search.terms_of(ask(spark, query))).collect()}
        terms = query.split()
        match = " OR ".join(f'"{t}"*' if len(t) > 4 else f'"{t}"' for t in terms)
        want = dict(con.execute("SELECT rowid, bm25(f, 8.0, 3.0, 1.0) FROM f WHERE f MATCH ?", (match,)).fetchall())
        assert hits.keys() == want.keys() and all(abs(hits[k] - want[k]) < 2e-6 for k in want)


def test_tiers(spark, index):
    hits = search.scored(index, search.terms_of(ask(spark, "atitlan", "lago historia", "", "volcan lago")))
    rows = search.keyword_search(hits, 4).orderBy("qid", "pos").collect()
    assert [r.chunk_id for r in rows if r.qid == 0][0] in (1, 2, 8) and all(r.strict for r in rows if r.qid == 0)
    assert [r.chunk_id for r in rows if r.qid == 1][0] == 2 and not any(r.strict for r in rows if r.qid == 1)
    assert not [r for r in rows if r.qid == 2]
    assert {r.qid for r in search.keyword_search(hits, 4, strict_only=True).collect()} == {0, 1, 3}


def test_best_chunk_falls_back_to_first(spark, index):
    wanted = ask(spark, "historia", "nada")
    found = search.match(index, search.terms_of(wanted))
    pages = spark.createDataFrame([(0, 1), (1, 1), (0, 99)], "qid long, page_id long")
    assert {(r.qid, r.chunk_id) for r in search.best_chunks(index, found, pages).collect()} == {(0, 2), (1, 1)}


def test_intros(spark, index):
    pages = spark.createDataFrame([(1, "Lago de Atitlán", "lago atitlan", 90), (2, "Volcán de Fuego", "volcan fuego", 50), (3, "Guatemala", "guatemala", 10), (4, "Todos (Guatemala)", "guatemala", 999), (5, "La Gioconda", "gioconda", 5), (6, "Oro", "oro", None)], PAGES)
    redirects = spark.createDataFrame([("mona lisa", "La Gioconda"), ("oro", "Guatemala"), ("x", "Nada")], "title_key string, target string")
    wanted = ask(spark, "¿Quién pintó la Mona Lisa?", "¿Qué es el lago de Atitlán?", "volcanes de Guatemala", "el Volcán de Fuego en Guatemala y el Lago de Atitlán", "¿qué es guatemala?", "comer pan")
    got = {}
    for r in search.entity_intros(index, pages, redirects, wanted).orderBy("qid", "pos").collect():
        got.setdefault(r.qid, []).append(r.page_id)
    assert got == {0: [5], 1: [1], 2: [3], 3: [1, 2], 4: [3]} or got == {0: [5], 1: [1], 2: [3], 3: [2, 1], 4: [3]}


def test_fusion_and_diversity(spark):
    keyword = spark.createDataFrame([(1, 1, 10, False), (1, 2, 11, False)], "qid long, pos int, chunk_id long, strict boolean")
    semantic = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], "qid long, pos int, chunk_id long")
    got = {r.chunk_id: r.score for r in search.fuse(keyword, semantic).collect()}
    assert got == {10: pytest.approx(0.08), 11: pytest.approx(0.8 / 11 + 0.1), 12: pytest.approx(1 / 11)}
    ranked = spark.createDataFrame([(1, i, t) for i, t in enumerate("aaabbcn")], "qid long, pos int, title string")
    assert [r.title for r in search.diverse(ranked, 5).orderBy("pos").collect()] == ["a", "a", "b", "b", "c"]


def test_hybrid_without_vectors(spark, index):
    rows = search.hybrid_search(index, ask(spark, "lago"), 3).orderBy("pos").collect()
    assert [(r.chunk_id, r.title) for r in rows] == [(8, "Lago de Atitlán"), (2, "Lago de Atitlán")]  # of three hits in one title


def test_kept_index(spark, tmp_path):
    """Written, updated and compacted, an index is the one built anew."""
    folder = str(tmp_path / "index")
    corpus = spark.createDataFrame(ROWS, CHUNKS)
    terms = search.terms_of(ask(spark, "lago atitlan", "volcanes", "leonardo", "isla"))
    found = lambda index: sorted(map(tuple, search.scored(index, terms).collect()))
    with pytest.raises(FileNotFoundError):
        search_index.read_index(corpus, folder)
    search_index.write_index(corpus, folder, 4)
    assert found(search_index.read_index(corpus, folder)) == found(search.build_index(corpus))
    changed = [(20, 1, "Lago de Atitlán", "Introducción", "El lago tiene una isla."), (21, 9, "Isla", None, "Leonardo vivió en la isla.")]
    search_index.update_index(spark, folder, spark.createDataFrame(changed, CHUNKS), spark.createDataFrame([(1,), (5,), (9,), (None,)], "page_id long"))
    after = spark.createDataFrame([r for r in ROWS if r[1] not in (1, 5)] + changed, CHUNKS)
    want = found(search.build_index(after))
    assert found(search_index.read_index(after, folder)) == want and {r[1] for r in want} >= {20, 21} and not {r[1] for r in want} & {1, 2, 6, 8}
    (tmp_path / "index" / "00000007-whole-4" / "postings").mkdir(parents=True)  # broken off
    search_index.compact(after, folder)
    assert found(search_index.read_index(after, folder)) == want
    search_index.sweep(spark, folder)
    assert [p.name for p in (tmp_path / "index").iterdir()] == ["00000008-whole-4"] and found(search_index.read_index(after, folder)) == want
    empty = corpus.filter("false")
    search_index.write_index(empty, str(tmp_path / "none"))
    assert found(search_index.read_index(empty, str(tmp_path / "none"))) == []


def test_kept_index_follows_its_files(spark, tmp_path):
    place = str(tmp_path / "chunks.parquet")
    spark.createDataFrame(ROWS[:3], CHUNKS).write.parquet(place)
    size = lambda: search_index.kept_index(spark.read.parquet(place), str(tmp_path / "kept")).sizes.count()
    assert size() == 3 and size() == 3 and len(list((tmp_path / "kept").iterdir())) == 1
    spark.createDataFrame(ROWS[3:5], CHUNKS).write.mode("append").parquet(place)
    assert size() == 5


def test_leading_terms_lose_no_best_row(spark):
    rng = random.Random(4)
    words = ["comun", "frecuente", "otro", "raro", *(f"palabra{i}" for i in range(30))]
    weights = [60, 40, 20, 2, *[1] * 30]
    rows = [(i, i % 40, " ".join(rng.choices(words, weights, k=2)), None, " ".join(rng.choices(words, weights, k=rng.randint(1, 30)))) for i in range(500)]
    index = search.build_index(spark.createDataFrame(rows, CHUNKS))
    asked = ask(spark, *(" ".join(rng.choices(words, [10, 8, 5, 5, *[1] * 30], k=rng.randint(1, 4))) for _ in range(60)))
    found = search.match(index, search.terms_of(asked))
    every = search.best_rows(found, None)
    few = search.best_rows(found, 5)
    top = lambda rows: sorted(map(tuple, search.keyword_search(rows, 5).collect()))
    by = Window.partitionBy("qid").orderBy("score", "chunk_id")
    best = lambda rows: sorted(map(tuple, rows.withColumn("p", F.row_number().over(by)).filter("p <= 5").select("qid", "p", "chunk_id", "score").collect()))
    assert top(few) == top(every) and best(few) == best(every) and few.count() < 0.8 * every.count()


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(a) for a in v], "c") for i, v in enumerate(x)] + [(900, [0.0] * 8, "c"), (901, None, "c")], "id long, v array<double>, vec string")
    quantized = df.select("id", vectors.quantize(F.col("v"), 6).alias("vec"))
    u = x[:, :6] / np.linalg.norm(x[:, :6], axis=1, keepdims=True)
    got = {r.id: r.vec for r in quantized.collect()}
    assert got[900] is None and got[901] is None and all(got[i] == np.rint(u[i] * 127).astype(int).tolist() for i in range(300))
    asks = df.filter("id < 20").select(F.col("id").alias("qid"), vectors.normalised(F.col("v"), 6).alias("vec"))
    top = vectors.exact_top_k(asks, quantized, 5, data_rows=70).collect()
    sims = np.round(u[:20] @ np.rint(u * 127).T / 127, 6)
    for q in range(20):
        want = sorted(range(300), key=lambda i: (-sims[q, i], i))[:5]
        assert [r.id for r in sorted((r for r in top if r.qid == q), key=lambda r: r.pos)] == want
    assert vectors.exact_top_k(asks.filter("qid < 0"), quantized, 5).count() == 0


def test_index_refresh(spark):
    df = spark.createDataFrame([(3, [1, 2]), (1, None), (2, [1, 2]), (4, [1])], "vec_id long, vec array<tinyint>")
    assert vectors.stored_dims(df.filter("vec_id < 3")) == 2 and vectors.stored_dims(df.filter("vec_id = 1")) is None
    assert sorted(r.vec_id for r in vectors.of_dims(df, 2).collect()) == [2, 3]
    assert [r.vec_id for r in vectors.newer_than(df, 1).collect()] == [2, 3, 4]
    lines = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,)], "t array<string>").select(evaluate.sources_line(F.col("t")).alias("x"))
    assert [r.x for r in lines.collect()] == ["a, b", "ninguna", "ninguna"]


def test_embedding_queue(spark):
    pages = spark.createDataFrame([(1, "A", 10), (2, "B", 99), (3, "C", None), (4, "D", 50)], "page_id long, title string, size int")
    have = spark.createDataFrame([(4,)], "page_id long")
    chunk = spark.createDataFrame([(7, 1, "dos"), (5, 1, "uno")], "chunk_id long, page_id long, text string")
    queue = vectors.embedding_queue(pages, have, chunk, 10)
    assert [(r.page_id, r.input) for r in queue.collect()] == [(2, "title: B | text: B"), (1, "title: A | text: uno"), (3, "title: C | text: C")]
    made = {r.page_id: r.vec for r in vectors.embed(queue, vectors.hash_embedder(16), 8, batch=2).collect()}
    assert set(made) == {1, 2, 3} and all(len(v) == 8 for v in made.values())


MESSAGES = "message_id long, chat_id string, role string, content string, created_at timestamp"
CHATS = "chat_id string, title string, created_at timestamp, updated_at timestamp, summary string, summary_upto long"


def test_chats(spark):
    turns = [(i, "c", "user" if i % 2 else "assistant", f"m{i}", None) for i in range(1, 12)] + [(11, "c", "user", "m11", None), (50, "d", "user", "  Una   pregunta " + "larga " * 20, None), (51, "d", "user", "¿Y el clima?", None), (60, None, "user", "x", None)]
    m = spark.createDataFrame(turns, MESSAGES)
    c = spark.createDataFrame([("c", None, None, None, "resumen", 2), ("d", None, None, None, "otro", None)], CHATS)
    assert [r.message_id for r in chats.context_window(m, c, 4).filter("chat_id = 'c'").orderBy("message_id").collect()] == [7, 8, 9, 10]
    assert {r.chat_id: r.summary for r in chats.context_summaries(m, c, 4).collect()} == {"c": "resumen", "d": None}
    assert {r.chat_id: (r.pending, r.needed) for r in chats.needs_summary(m, c, 4).collect()} == {"c": (5, True), "d": (0, False)}
    follow = {r.message_id: r.query for r in chats.followup_queries(m).collect()}
    assert follow[1] == "m1" and follow[3] == "m1 m3" and follow[51].endswith("¿Y el clima?") and follow[51].startswith("  Una")
    spelled = spark.createDataFrame([(1, "e", " USUARIO ", "uno dos tres cuatro cinco seis", None), (2, "e", "Bot", "x", None), (3, "e", "human", "¿y?", None), (4, "e", "undefined", "z", None), (5, "e", None, "w", None)], MESSAGES)
    assert {r.message_id: r.query for r in chats.followup_queries(spelled).collect()} == {1: "uno dos tres cuatro cinco seis", 3: "uno dos tres cuatro cinco seis ¿y?"}
    titles = {r.chat_id: r.title for r in chats.derived_titles(m).collect()}
    assert titles["c"] == "m1" and len(titles["d"]) <= 60 and titles["d"].endswith("…")
    named = spark.createDataFrame([("  a \n b ",), ("",), (None,), ("x" * 200,)], "t string").select(chats.renamed(F.col("t")).alias("t"))
    assert [r.t for r in named.collect()] == ["a b", "Sin título", "Sin título", "x" * 120]
    assert chats.delete_chat(c, m, "c")[1].filter("chat_id = 'c'").count() == 0


def test_context_text(spark):
    df = spark.createDataFrame([([("A", "Introducción", "x"), ("B", "Clima", "y")],), ([],)], "s array<struct<title:string,section:string,text:string>>")
    assert [r.t for r in df.select(chats.context_text(F.col("s")).alias("t")).collect()] == ["Artículo: A\nx\n\nArtículo: B (sección «Clima»)\ny", "(no se encontró ningún texto relacionado)"]


ITEMS = "qid long, question string, articles array<string>, facts array<array<string>>, forbidden array<string>, unanswerable boolean"
ANSWERS = "qid long, answer string, titles array<string>, seconds double"


def test_evaluation(spark):
    items = [(1, "q", ["Oro"], [["setenta y nueve", "79"]], None, False), (2, "q", ["Plata"], [["ag"], ["47"]], ["oro"], False), (3, "q", None, None, ["ulan"], True), (4, "q", None, None, None, True), (5, "q", ["X"], [["z"]], None, None)]
    answers = [(1, "Es 79 [Oro]", ["Oro"], 1.0), (2, "No encontré esa información.", ["Otra"], 2.0), (3, "Es Ulán [Mongolia]", ["Oro"], 3.0), (4, "No se menciona en la wiki.", [], 4.0), (5, None, None, None)]
    scores = evaluate.score(spark.createDataFrame(items, ITEMS), spark.createDataFrame(answers, ANSWERS))
    got = {r.qid: r for r in scores.collect()}
    assert got[1].acierto and got[1].datos == "1/1" and got[1].busqueda and got[1].cita and not got[1].cita_inventada
    assert got[2].se_niega_de_mas and got[2].datos == "0/2" and got[2].busqueda is False
    assert got[3].inventa and got[3].cita_inventada and got[3].datos is None
    assert got[4].acierto and not got[4].inventa
    assert got[5].datos == "0/1" and got[5].palabras == 0
    s = evaluate.summarize(scores).first().asDict()
    assert (s["preguntas"], s["aciertos_pct"], s["con_respuesta_pct"], s["sin_respuesta_pct"], s["inventa"]) == (5, 40, 33, 50, 1)
    report = dict(line.rsplit("  ", 1) for line in evaluate.format_summary(s).split("\n"))
    assert {k.strip(): v.strip() for k, v in report.items()}["Respuestas correctas"] == "40 %"
    none = evaluate.format_summary(evaluate.summarize(scores.filter("qid < 0")).first().asDict())
    assert none.count("—") >= 6
    pages = spark.createDataFrame([("Oro",)], "title string")
    assert sorted(r.qid for r in evaluate.answerable(spark.createDataFrame(items, ITEMS), pages).collect()) == [1, 3, 4]


def test_citations(spark):
    cases = [("Vale [Mercurio].", ["Ciclo del mercurio"], False), ("[Tornasol (sección «Uso»)]", ["Tornasol (química)"], False), ("[Ulaanbaatar (Mongolia)]", ["Oro"], True), ("sin citas", ["Oro"], False), ("[Oro] y [Nada]", ["Oro"], False), (None, None, False)]
    df = spark.createDataFrame([(a, t) for a, t, _ in cases], "answer string, titles array<string>")
    rows = df.select(evaluate.citation_warning(F.col("answer"), F.col("titles")).alias("w")).collect()
    assert [r.w is not None for r in rows] == [w for *_, w in cases] and "Ulaanbaatar (Mongolia)" in rows[2].w


def test_images(spark):
    pics = spark.createDataFrame([(1, 10, "Volcán", "Un ave"), (2, 10, "Volcán", "La erupción del volcán"), (3, 10, "Volcán", "Cráter del volcán"), (4, 20, "Lago", None), (5, 20, "Lago", "x")], "image_id long, page_id long, title string, caption string")
    sources = spark.createDataFrame([(1, 0, 10), (1, 1, 20)], "qid long, page_rank int, page_id long")
    asked = spark.createDataFrame([(1, "erupción del volcán")], "qid long, query string")
    got = images.rank_images(pics, sources, asked).orderBy("pos").collect()
    assert [r.image_id for r in got] == [2, 1, 4] and got[2].caption == "Lago"
    near = spark.createDataFrame([(1, 3, 0.6)], "qid long, image_id long, similarity double")
    assert [r.image_id for r in images.rank_images(pics, sources, asked, near).collect()] == [3]
    shown = spark.createDataFrame([(1, 2)], "qid long, image_id long")
    assert [r.image_id for r in images.rank_images(pics, sources, asked, shown=shown).orderBy("pos").collect()][0] == 1
    assert [r.image_id for r in images.images_for_pages(pics, sources, total=3).orderBy("pos").collect()] == [1, 2, 4]


def test_question_set(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps({"preguntas": [{"pregunta": "a", "articulos": ["X"], "datos": [["1"]]}, {"pregunta": "b", "sin_respuesta": True}]}))
    rows = question_set(spark, str(path)).orderBy("qid").collect()
    assert [(r.qid, r.question, r.unanswerable) for r in rows] == [(1, "a", False), (2, "b", True)]
    assert question_set(spark, str(path), 1).count() == 1
