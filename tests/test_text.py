import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sillar.functions import text as T


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


def test_keywords_match_python(spark):
    texts = ["¿Qué es el Lago de Atitlán?", "Año 1999: niño_x", "ÁÉÍ ÓÚ Ü", "", None, "a b c", "El oro y la Plata, el ORO", "km² 5º ªb", "naïve Straße Łódź", "ﬁn de oﬃcina"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", T.keywords(F.col("x")).alias("k")).collect()
    assert {r.i: r.k for r in got} == {i: T.py_keywords(t or "") for i, t in enumerate(texts)}


def test_fold_table_covers_every_single_letter(spark):
    letters = [chr(c) for c in range(0xC0, 0x2000) if unicodedata.category(chr(c)).startswith("L") and len(T.py_fold(chr(c))) == 1 and len(chr(c).lower()) == 1]
    got = spark.createDataFrame([(x,) for x in letters], "x string").select("x", T.fold(F.col("x")).alias("y")).collect()
    wrong = [r.x for r in got if r.y != T.py_fold(r.x)]
    assert len(wrong) <= 2, wrong[:20]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aáÁñ eéü_1.(),;¿?", max_size=30))
def test_py_keywords_are_unique(text):
    words = T.py_keywords(text)
    assert len(words) == len(set(words))


def test_keys(spark):
    assert one(spark, T.title_key, "Todos (Guatemala)") == "guatemala"
    assert one(spark, T.title_base_key, "Todos (Guatemala)") == ""
    assert one(spark, T.title_key, None) == ""


def test_query_terms_and_grams(spark):
    terms = one(spark, T.query_terms, "¿Dónde está el Popol Vuh y la Mona Lisa, Popol?")
    assert [(t.term, t.capital) for t in terms] == [("popol", True), ("vuh", True), ("mona", True), ("lisa", True)]
    df = spark.createDataFrame([(1, "¿Qué es el oro?"), (2, "Historia de Tikal"), (3, ""), (4, None)], "q long, query string")
    grams = {(r.q, r.gram) for r in T.query_grams(df).collect()}
    assert grams == {(1, "oro"), (2, "historia tikal"), (2, "tikal")}


@pytest.mark.parametrize(("text", "want"), [("a  b\n c", "a b c"), ("x" * 70, "x" * 59 + "…"), ("", "")])
def test_shorten(spark, text, want):
    assert one(spark, lambda c: T.shorten(c, 60), text) == want


def test_refusals_citations_counts(spark):
    for answer, want in [("No encontré esa información en la wiki.", True), ("Los textos no lo dicen: no se menciona", True), ("DESCONOZCO eso", True), ("El oro es un metal", False), (None, False)]:
        assert one(spark, T.refused, answer) is want
    assert one(spark, T.citations, "Es así [Oro] y [x] [Plata (metal)]") == ["Oro", "Plata (metal)"]
    assert one(spark, T.word_count, " uno  dos\n") == 2 and one(spark, T.word_count, None) == 0


def test_iso_round_trip(spark):
    assert one(spark, lambda c: T.iso(T.parse_iso(c)), "2025-03-01T10:20:30Z") == "2025-03-01T10:20:30Z"


def test_embedding_text(spark):
    df = spark.createDataFrame([("T", "x" * 500), ("T", None), ("T", "")], "a string, b string").select(T.embedding_text(F.col("a"), F.col("b")).alias("y"))
    assert [r.y for r in df.collect()] == ["title: T | text: " + "x" * 400, "title: T | text: T", "title: T | text: T"]
