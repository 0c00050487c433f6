import pytest

from sillar.llm.residue import documents_with_residue, residue, residue_kinds, unfilled_field, without_residue

REAL = "El puente fue destruido por una crecida en 1780. La comarca se divide en 30 distritos y vive del comercio."


@pytest.mark.parametrize(
    "marker",
    ["{{nombre}}", "{{{autor|}}}", "{gentilicio}", "{0}", "${FECHA}", "$(capital)", "<%= ano %>", "@@nombre@@", "__TITULO__", "____", "#ALCALDE#", "%fecha%", "%s", "[insertar provincia]", "[completar: nombre_1]", "[su río aquí]", "[[título aquí]]", "«IMAGEN aquí»", "(altitud por definir)", "[fecha]", "<rio_es>", "&lt;fecha2&gt;", "XXX capital XXX", "XXXX", "NNNN", "9999-99-99", "TBD", "TODO", "¿¿??"],
)
def test_unfilled_fields(marker):
    assert residue(f"{REAL} Tiene una población de {marker} habitantes.") == "template"


@pytest.mark.parametrize(
    "text",
    [
        f"{REAL} El programa lee la variable {{nombre}} y escribe en su lugar el de la villa.",
        "Para citar la ficha se escribe {{Ficha de río}} al comienzo, según el manual de estilo.",
        f"{REAL} La marca #ANO# se sustituye al imprimir cada ejemplar.",
        'En ese lenguaje, la orden printf("%d", k) imprime un entero.',
        "Sea el conjunto {a, b, c} y la fracción \\frac{12}{25}; ambos son finitos, como x^{2}.",
        "La copia dice «fue villa [sic] [...] hasta 1618», y el original [1] añade la firma.",
        "El siglo XX trajo el tren, y el capítulo XXXIX de sus anales <en cursiva> lo celebra.",
        f"{REAL} Creció un 100% y un 5 % más.",
        "El error 404 es el código con que un servidor indica que no halla el recurso pedido; lo estudió en un ensayo.",
        "JavaScript es un lenguaje que se ejecuta en el navegador; se enseña desde hace 23 años junto a otros.",
        "El manual recomienda cambiar el aviso «Necesita habilitar los scripts en su navegador para continuar» por otro más claro.",
        "La expresión «lorem ipsum» se usa en las imprentas para probar tipos sin distraer al lector.",
        "La sección en construcción del ferrocarril unía dos villas y medía 199 metros.",
        REAL,
        "",
        " \n",
        None,
        "Fundación | 1928",
    ],
)
def test_real_content(text):
    assert residue(text) is None


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"),
        (f"{REAL}\n== Clima ==\nTexto de ejemplo. Bla bla bla bla.", "filler"),
        (f"{REAL}\nPróximamente, el resumen de la localidad.", "filler"),
        ("Inserte la cronología de esta sección antes de publicar.", "filler"),
        ("Tikal\n<p>HTTP 503: Service Unavailable</p>", "error"),
        ("== Introducción ==\nError 404", "error"),
        ("No se ha podido abrir la página: tiempo agotado.\nVuelva a intentarlo dentro de unos minutos.", "error"),
        ("Please enable JavaScript to view this article.", "error"),
        ("ES NECESARIO ACTIVAR LOS SCRIPTS EN LA CONFIGURACIÓN DEL NAVEGADOR.", "error"),
        ("Veuillez activer JavaScript pour afficher cette page.", "error"),
    ],
)
def test_residue(text, kind):
    assert residue(text) == kind


def test_long_texts():
    assert residue(REAL * 5000) is None
    assert residue(REAL * 5000 + " {{x}}") == "template"
    assert unfilled_field("{" * 20_000) is None and unfilled_field('"' * 9_999) is None


def test_operators(spark):
    rows = [(1, REAL, "a", "k"), (2, "{{x}}", "b", "k"), (2, "{{x}}", "b", "k"), (3, None, None, None), (None, "Error 404", None, None), (4, " ", "c", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, c0 string")
    assert sorted((r.doc_id or 0) for r in documents_with_residue(df).collect()) == [0, 2]
    assert residue_kinds(df).count() == 6
    clean = without_residue(df)
    assert clean.columns == df.columns and sorted((r.doc_id for r in clean.collect())) == [1, 3, 4]
    none = spark.createDataFrame([], df.schema)
    assert documents_with_residue(none).count() == 0 and without_residue(none).count() == 0


@pytest.mark.parametrize("n", [10, 100, 200, 250, 350, 450, 20_000])
def test_windows_have_no_length(n):
    words = "palabra " * n
    for quotation in (f"«{words}{{{{nombre}}}}»", f"“{words}Error 404”", f'"{words}TBD"', f"`{words}%s`"):
        assert residue(f"{REAL} La novela dice {quotation} y nada más.") is None
    assert residue(f"{REAL} La marca{' ' * n}{{{{nombre}}}} aparece en la guía.") is None
    assert residue(f"{REAL} El caso {{{{{'x' * n}}}}} llegó.") == "template"
    assert residue(f"{REAL} El caso @@{'x' * n}@@ llegó.") == "template"


def test_markers_of_other_kinds():
    for marker in ("|AÑO|", ":nombre", "[Nombre del cliente]", "{}", "[fecha de fundación]"):
        assert residue(f"{REAL} Se fundó en {marker}, según el acta.") == "template"
    for text in ("a las 12:30 y a las 13:45", "la razón 3:nombre", "f({})", "1820 | Pucitupán | 22", "[nota del editor]"):
        assert residue(f"{REAL} Consta {text}.") is None
