import json

from sillar.operators.chunking import chunk_documents
from sillar.sources.archive import JsonArchive, archive_date, articles, redirects
from sillar.sources.html import html_to_text, parse_article

FAIR = """<!doctype html><html><head><title>no</title></head><body class="skin"><header>Portal</header>
<main><article class="wide mw-parser-output"><h1>Feria de la lana</h1>
<div class="hatnote">Para otros usos, véase Lana.</div>
<p>Se celebra   cada mayo<sup class="reference"><a>[4]</a></sup> en la
plaza&nbsp;mayor &amp; dura <b>tres</b> días.</p>
<h3>Puestos <span class="mw-editsection">[editar]</span></h3>
<ul><li>quesos<li>paños</ul>
<table><caption>Ventas</caption><tr><th>Año<th>Fardos</tr><tr><td>1910<td>75</tr><tr><td> <td></tr></table>
<p>El área es <math alttext="\\pi r^2"><mi>π</mi><mo>r</mo></math>.</p>
<figure><img class="mw-file-element" src="../media/plaza%20mayor.png?w=300" width="300" height="120" alt="plaza"><figcaption>La plaza en <i>1910</i></figcaption></figure>
<img class="mw-file-element" src="escudo.png" width="120" height="180" alt="Escudo">
<img class="mw-file-element" src="punto.png" width="99" height="500"><img src="suelta.png" width="200" height="200">
<img class="mw-file-element" src="https://otro.example/x.png" width="200" height="200">
<div class="noprint">Imprimir<p>no</p></div><ol class="references"><li>Acta de 1910</li></ol>
<style>p{}</style></article></main><footer>Fin</footer></body></html>"""


def chunks(spark, *texts):
    rows = chunk_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "ord").collect()
    return [[(r.section, r.text) for r in rows if r.doc_id == i] for i in range(len(texts))]


def test_sections(spark):
    guide = "Vive en cuevas.\n\n== Dieta ==\n Come musgo. \n=== Invierno ===\nAyuna.\n== Véase también ==\nOso\n==== Crías ====\nDos al año."
    got = chunks(spark, guide, None, "", "\n \n", "== Vacía ==")
    assert got == [[("Introducción", "Vive en cuevas."), ("Dieta", "Come musgo."), ("Invierno", "Ayuna."), ("Crías", "Dos al año.")], [], [], [], []]


def test_sizes(spark):
    a, b, long = "a" * 900, "b" * 601, "c" * 4000
    assert chunks(spark, f"{a}\n{b}\n{long}\nfin") == [[("Introducción", a), ("Introducción", b), ("Introducción", long), ("Introducción", "fin")]]
    assert chunks(spark, f"{a}\n{'b' * 600}") == [[("Introducción", f"{a}\n{'b' * 600}")]]


def test_article_layout():
    text, _ = parse_article(FAIR)
    assert text.split("\n") == ["Se celebra cada mayo en la", "plaza mayor & dura tres días.", "=== Puestos ===", "quesos", "paños", "Ventas", "| Año | Fardos", "| 1910 | 75", "El área es \\pi r^2 .", "La plaza en 1910", "Fin"]


def test_article_images():
    assert parse_article(FAIR, "A/b/Feria")[1] == [("A/media/plaza mayor.png", "La plaza en 1910"), ("A/b/escudo.png", "Escudo")]
    many = "<body>" + "".join(f'<img class="mw-file-element" src="{i % 9}.png" width="100" height="100">' for i in range(20))
    assert [p for p, _ in parse_article(many)[1]] == [f"{i}.png" for i in range(6)]
    assert parse_article('<body><img class="mw-file-element" src="a.png" width="x" height="9"><figcaption>suelta</figcaption>') == ("suelta", [])


def test_depth_has_no_limit():
    assert parse_article("<body>" + "<b>" * 50_000 + "hondo" + "</p>" * 50_000)[0] == "hondo"
    assert parse_article("<body>" + "<h2>" * 3_000 + "x")[0] == "== x =="


def test_tolerant_parsing():
    assert parse_article("<body><p>uno<b>dos</p></i>tres</body>")[0] == "unodos\ntres"
    assert parse_article("<p>sin cuerpo</p>")[0] == ""
    assert parse_article("<body><div class='toc'><p>x</div>y</body>")[0] == "y"
    assert parse_article("")[0] == ""


def test_html_operator_handles_nulls(spark):
    df = spark.createDataFrame([(1, "<body><p>a</p></body>", "t"), (2, None, "t")], "id long, html string, text string")
    assert {r.id: r.text for r in html_to_text(df, "id").collect()} == {1: "a", 2: ""}


def test_archive(spark, tmp_path):
    body = "<body><p>" + "palabra " * 40 + "</p></body>"
    lines = [
        {"path": "Tikal", "title": "Tikal", "mime": "text/html", "html": body},
        {"path": "Q", "title": "Quetzal", "mime": "text/html; charset=utf-8", "html": body},
        {"path": "c", "title": "Corto", "mime": "text/html", "html": "<body>x</body>"},
        {"path": "a", "title": "A#b", "mime": "text/html", "html": body},
        {"path": "s", "title": "s.css", "mime": "text/css", "html": body},
        {"path": "r", "title": "Mona Lisa", "target": "La Gioconda"},
        {"path": "mainPage", "title": "Portada", "target": "Tikal"},
        {"path": "r2", "title": "Tikal", "target": "Tikal"},
        {"path": "r3", "title": "de la", "target": "Tikal"},
    ]
    path = tmp_path / "archive.jsonl"
    path.write_text("\n".join([*map(json.dumps, lines), "{damaged"]), encoding="utf-8")
    spark.dataSource.register(JsonArchive)
    entries = spark.read.format("json_archive").option("range", "3").load(str(path))
    assert entries.rdd.getNumPartitions() == 4 and entries.count() == 9
    assert sorted(r.entry_id for r in entries.collect()) == list(range(9))
    empty = tmp_path / "empty.jsonl"
    empty.write_text("")
    assert spark.read.format("json_archive").load(str(empty)).count() == 0
    assert sorted(r.title for r in articles(entries).collect()) == ["Quetzal", "Tikal"]
    assert list(map(tuple, redirects(entries).collect())) == [("mona lisa", "La Gioconda")]
    assert archive_date("1970-01-02") == 86400.0 and archive_date(None) is None
