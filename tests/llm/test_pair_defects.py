import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sillar.llm.plaintext import blank, is_blank
from sillar.llm.pair_defects import declines, defect, defective_answers, judged_pairs, language, names_article, only_repeats, open_at_end, tiles, unfinished

S = '[{"title": "Tikal", "section": null}]'
Q = "¿Cuántos habitantes tiene el puerto de Tikal?"


@pytest.mark.parametrize(
    ("question", "answer", "sources", "want"),
    [
        (Q, None, S, "empty"),
        (Q, " ​… [1]", S, "empty"),
        (Q, Q, S, "copied"),
        (Q, "> " + Q.upper() + "\n", S, "copied"),
        (Q, f"Pregunta: {Q} {Q}", S, "copied"),
        (Q, Q + "\nEl censo registró 40 viviendas.", S, None),
        (Q, "Lo siento, no tengo datos sobre Tikal.", S, "refusal"),
        (Q, "Lo siento, no tengo datos sobre Tikal.", "[]", None),
        (Q, "Lo siento, no tengo datos sobre Tikal.", '[{"title": "Tikal", "sec', "refusal"),
        (Q, "Disculpa, pero prefiero no responder. ¿Puedo ayudarte con otra cosa?", S, "refusal"),
        (Q, "«Lo siento, no tengo datos» es el título de una comedia que se estrenó en 1856 [Tikal].", S, None),
        (Q, "El tratado de 1580 no menciona Tikal, y por eso quedó en manos de otro.", S, None),
        (Q, "No hay puentes sobre el cauce: se cruza en balsa desde Tikal.", S, None),
        (Q, "The town lies above the plain and trades mostly in wool and salt.", S, "language"),
        (Q, "El escudo muestra una torre. Una lápida dice «The bridge was rebuilt after the flood».", S, None),
        ("Who built the bridge, and when?", "The bridge was rebuilt after the flood.", S, None),
        ("Who built the bridge, and when?", "El puente fue construido por los vecinos de la comarca en 1700.", S, "language"),
        ("O que se cultiva perto de Tikal?", "En el siglo XVIII el dialecto local conserva dos vocablos que no existen en la comarca.", S, "language"),
        ("O que se cultiva perto de Tikal?", "A vila fica a 288 metros de altitude e vive sobretudo do comércio de lã.", S, None),
        (Q, "Город стоит на реке.", S, "language"),
        (Q, "El puerto recibió barcos cargados de lana y de", S, "truncated"),
        (Q, "La comarca se divide en 30 distritos, el mayor de los cuales es (véase", S, "truncated"),
        (Q, "Tiene tres barrios:\n- Norte\n- Sur\n-", S, "truncated"),
        (Q, "Tiene tres barrios:\n- Norte\n- Sur\n- Población:", S, "truncated"),
        (Q, "Tiene tres barrios:\n- Norte\n- Sur", S, None),
        (Q, "```\nprint(1)", S, "truncated"),
        (Q, "En 1649", S, None),
        (Q, "El censo registró 40 viviendas, de las que 3 estaban vacías [Tikal]", S, None),
        (Q, "El escudo muestra una torre sobre campo de oro; altitud: 406 m", S, None),
        (None, "Sí.", None, None),
    ],
)
def test_defects(question, answer, sources, want):
    assert defect(question, answer, sources) == want


def test_parts():
    assert is_blank(None) and is_blank("[[a] b]") and not is_blank("²")
    assert tiles(list("abcab"), list("abxab"), 2) == [(0, 0, 2), (0, 3, 2)]
    assert not only_repeats("¿Es cierto que Tikal es grande?", "Sí, Tikal")
    assert [o for o, _ in open_at_end("a) (b [c] «d» \"e\" {f")] == ["(", "{"]
    assert language("") is None and language("el puente une los barrios con la villa y con el puerto") == "es"
    assert names_article(S) and not names_article("null") and not names_article(None)
    assert declines("Uf, no puedo ayudarte con esa consulta…") and not declines("No hay mal que por bien no venga.")
    assert is_blank("[" * 200_000 + "]" * 200_000) and not is_blank("]a[") and only_repeats("x " * 100_000, "x " * 100_000)
    assert not only_repeats("x " * 100_000, "y " * 100_000) and len(open_at_end("(" * 100_000 + "]" * 100_000)) == 100_000
    assert unfinished("x " * 200_000 + "y,") and not unfinished("Fin. " * 50_000)


SCHEMA = "message_id long, chat_id string, role string, content string, sources string, images string, search_query string, created_at timestamp, edge string, defect string"
T = dt.datetime(2025, 1, 1)


def row(i, chat, role, content, second, sources=S):
    return (i, chat, role, content, sources, None, None, None if second is None else T + dt.timedelta(seconds=second), "clash", "clash")


def test_pairs_across_partitions(spark):
    rng = random.Random(1)
    rows = [row(i, "hot" if i < 200 else f"c{i % 9}", rng.choice(["user", "assistant", "system", "?"]), f"texto {i}.", i if rng.random() > 0.1 else None) for i in range(400)]
    want = set()
    by = {}
    for r in rows:
        if r[7] is not None and r[2] in ("user", "assistant"):
            by.setdefault(r[1], []).append(r)
    for mine in by.values():
        mine.sort(key=lambda r: (r[7], r[0]))
        want |= {(a[0], b[0], a[3], b[3]) for a, b in zip(mine, mine[1:]) if a[2] == "user" and b[2] == "assistant"}
    got = judged_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.question_id, r.message_id, r.question, r.answer) for r in got} == want and len(got) == len(want)


def test_copies_and_empty(spark):
    rows = [row(1, "c", "user", Q, 1), row(2, "c", "user", Q, 1), row(3, "c", "assistant", Q, 2), row(3, "c", "assistant", Q, 2), row(9, "c", "assistant", Q, 2), row(4, None, "assistant", "", 3)]
    assert list(map(tuple, defective_answers(spark.createDataFrame(rows, SCHEMA)).collect())) == [(3, "copied")]
    assert judged_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def _tiles_by_hand(pattern, text, least):
    """The definition: the longest free common run first, then the leftmost."""
    taken, out = [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for j in range(len(text)):
            for i in range(len(pattern)):
                k = 0
                while i + k < len(pattern) and j + k < len(text) and not taken[j + k] and pattern[i + k] == text[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return taken
        for j in range(best[2], best[2] + best[0]):
            taken[j] = True


def test_tiles_cover_what_the_definition_covers():
    rng = random.Random(3)
    for _ in range(150):
        words = "abcde"[: rng.randint(2, 5)]
        pattern, text = [[rng.choice(words) for _ in range(rng.randint(1, 14))] for _ in "xy"]
        covered = [False] * len(text)
        for i, j, k in tiles(pattern, text, 2):
            assert pattern[i : i + k] == text[j : j + k]
            covered[j : j + k] = [True] * k
        assert sum(covered) >= sum(_tiles_by_hand(pattern, text, 2)) - 1


@pytest.mark.parametrize("n", [12, 400, 496, 500, 504, 520, 4_000, 40_000])
def test_shuffled_blocks_are_copied_at_every_length(n):
    words = [f"palabra{i}" for i in range(n)]
    blocks = [words[i : i + 4] for i in range(0, n, 4)]
    random.Random(1).shuffle(blocks)
    assert only_repeats(" ".join(words), " ".join(w for b in blocks for w in b))
    assert not only_repeats(" ".join(words), " ".join(words[: n // 2]))


@pytest.mark.parametrize("n", [1, 5, 6, 7, 8, 60])
def test_refusals_of_any_number_of_sentences(n):
    assert declines("Lo siento, no puedo responder a eso. " * n)
    assert not declines("Lo siento, no puedo responder a eso. " * n + "El puerto se abrió en 1700.")


def test_blank_is_the_same_in_both_places(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("[]a .") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += [None, "", "[[[[[a]]]]]", "[[[[[a]]]]] b", "[[[[a]]] ²", "]a[", "[" * 5_000 + "a" + "]" * 5_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", blank(F.col("t")).alias("b")).collect()
    assert [r.b for r in sorted(got)] == [is_blank(t) for t in texts]
