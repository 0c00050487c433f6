import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sillar.llm.splitting import Boundaries, cuts, oversized_kinds, split_oversized

SCHEMA = "chunk_id long, page_id long, ord int, title string, section string, text string, piece string, kind string"
piece_of_text = st.sampled_from(["a", "bc", " ", "\n", ". ", " ", "　", "\n== Uno ==\n", "=== Dos ===", "Fin. Otra", "x" * 40, "ñ🙂", "…» Y"])


def row(i, text, section="Historia", **more):
    return (i, 1, 0, "t", section, text, "clash", "clash")


@settings(max_examples=400, deadline=None)
@given(st.lists(piece_of_text, max_size=60).map("".join), st.integers(2, 30), st.integers(0, 29))
def test_pieces_give_back_the_text(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    made = cuts(Boundaries(text), len(text), limit, overlap)
    at, before = 0, None
    for start, own, end, how in made:
        assert start <= own < end and end - start <= limit
        assert not text[at:own].strip()
        if before is not None:
            assert start == own or (start <= before and before - start <= overlap)
        if how not in ("end", "hard"):
            assert end == len(text) or text[end].isspace()
        at = before = end
    assert not text[at:].strip()
    assert any(h == "hard" for *_, h in made) == bool(re.search(r"\S{%d,}" % (limit + 1), text))


def test_prefers_headings_then_paragraphs_then_sentences():
    text = "Uno dos tres. Cuatro cinco.\nSeis siete ocho.\n== Nueve ==\nDiez once doce trece. Catorce quince."
    made = cuts(Boundaries(text), len(text), 60, 10)
    assert [h for *_, h in made] == ["heading", "end"]
    assert text[made[1][1] :].startswith("== Nueve ==")
    assert text[: cuts(Boundaries(text), len(text), 40, 0)[0][2]].endswith("cinco.")


def test_operator(spark):
    long = "Palabra corta. " * 200
    rows = [row(1, long), row(1, long), row(2, "x" * 3000), row(3, "corto"), row(4, None), row(5, " " * 4000), row(6, "a" + " " * 3000 + "b" * 1500), row(7, "\n" * 10 + "y" * 1500 + " " * 90)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, oversized_kinds(df).collect())) == [(1, "boundary"), (2, "forced"), (6, "boundary")]
    pieces = split_oversized(df).orderBy("chunk_id", "piece").collect()
    assert {r.chunk_id for r in pieces} == {1, 2, 6}
    assert all(len(r.text) <= 1500 for r in pieces)
    assert [r.piece for r in pieces if r.chunk_id == 2] == [0, 1] and pieces[0].cut == "sentence"


def test_sections(spark):
    text = "Inicio. " * 200 + "\n=== Deporte ===\n" + "Sigue. " * 200
    for given_, want in ((None, "Introducción"), ("== HISTORIA ==", "Historia"), ("clima (cont.)", "Clima"), (" Flora y fauna ", "Flora y fauna")):
        rows = split_oversized(spark.createDataFrame([row(1, text, given_)], SCHEMA)).orderBy("piece").collect()
        assert rows[0].section == want and rows[-1].section == "Deporte"


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert split_oversized(df).count() == 0 and oversized_kinds(df).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, 10, 10)
