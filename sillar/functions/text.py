"""Text expressions that stay in the JVM: folding, keywords, keys, n-grams, citations, refusals."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that carry no meaning in a search, without accents.
STOPWORDS = """
a al algo algun alguna algunas alguno algunos ante antes aqui asi cada como con contra cual cuales
cuando cuanto de del desde donde dos el ella ellas ellos en entre era eran es esa esas ese eso esos
esta estaba estan estas este esto estos fue fueron ha habia han hay hasta la las le les lo los mas me
mi muy nada ni no nos o otra otro para pero poco por porque que quien quienes se sea segun ser si sin
sobre son su sus tambien tan te tiene tienen todo todos tu un una uno unos y ya yo dime cuentame
explica explicame sabes saber quiero puedes hablame acerca informacion the of and is what who
""".split()

WORD = r"([\p{L}\p{N}_\p{M}]+)"
# Compatibility letters that fold to more than one letter.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st", "ĳ": "ij", "ŉ": "ʼn"}


@cache
def fold_table() -> tuple[str, str]:
    """``(from, to)`` for ``translate``: every lower-case letter below U+3000 that loses an
    accent or a compatibility form to one letter; then the combining marks, which vanish."""
    source, target, gone = [], [], []
    for code in range(0x80, 0x3000):
        char = chr(code)
        if unicodedata.combining(char):
            gone.append(char)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain != char and len(plain) == 1 and char == char.lower():
            source.append(char)
            target.append(plain)
    return "".join(source + gone), "".join(target)


def fold(text: Column) -> Column:
    """Lower case, compatibility forms plain, accents dropped. Null stays null.

    Letters that decompose into several (Hangul, fractions) are kept as they are, but for
    the ligatures listed above.
    """
    out = F.translate(F.lower(text), *fold_table())
    return F.when(out.rlike("[" + "".join(LIGATURES) + "]"), _unligate(out)).otherwise(out)


def _unligate(out: Column) -> Column:
    for letter, plain in LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_word(word: Column) -> Column:
    """``fold`` of a lower-case word; most are plain ASCII and pass as they are."""
    return F.when(F.octet_length(word) == F.length(word), word).otherwise(fold(word))


def words(text: Column) -> Column:
    """Runs of letters, digits, underscores and combining marks."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(1))


def meaningful(word: Column) -> Column:
    return (F.length(word) > 1) & ~word.isin(STOPWORDS)


def keywords(text: Column) -> Column:
    """The folded words of more than one letter that are no stopwords, each once, in the
    order of their first occurrence. Null and empty texts give an empty array.

    A decomposed accent does not split its word.
    """
    return F.array_distinct(F.filter(F.transform(words(F.lower(F.coalesce(text, F.lit("")))), fold_word), meaningful))


def title_key(title: Column) -> Column:
    """The keywords of a title in one string; empty if it has none. Not unique."""
    return F.array_join(keywords(title), " ")


def title_base_key(title: Column) -> Column:
    """``title_key`` without the clarification in parentheses at the end."""
    return title_key(F.regexp_replace(title, r"\s*\([^)]*\)\s*$", ""))


def query_terms(query: Column) -> Column:
    """``array<struct<term, capital>>``: the keywords of a query; ``capital`` marks a word
    written with a capital that is not the query's first word."""
    raw = F.transform(words(F.coalesce(query, F.lit(""))), lambda w, i: F.struct(fold(w).alias("term"), ((i > 0) & w.rlike(r"^\p{Lu}")).alias("capital")))
    kept = F.filter(raw, lambda x: meaningful(x["term"]))
    return bind(kept, lambda k: F.filter(k, lambda x, i: F.array_position(F.transform(k, lambda t: t["term"]), x["term"]) == i + 1))


def query_grams(queries: DataFrame, longest: int = 4) -> DataFrame:
    """``(<columns but query>, gram, start, size)``: the runs of up to ``longest`` keywords of ``query`` that may be a
    title: those that begin with a capital, or that are the whole query."""
    kept = [c for c in queries.columns if c != "query"]
    terms = queries.select(*kept, query_terms(F.col("query")).alias("__t"))
    sized = terms.select(*kept, "__t", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("size")).filter(F.size("__t") >= F.col("size"))
    runs = sized.select(*kept, "__t", "size", F.explode(F.sequence(F.lit(0), F.size("__t") - F.col("size"))).alias("start"))
    runs = runs.filter((F.col("size") == F.size("__t")) | F.get("__t", F.col("start"))["capital"])
    gram = F.array_join(F.transform(F.slice("__t", F.col("start") + 1, F.col("size")), lambda t: t["term"]), " ")
    return runs.select(*kept, gram.alias("gram"), "start", "size")


def is_prefix_term(term: Column) -> Column:
    """Longer terms also match words that begin with them."""
    return F.length(term) > 4


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def collapse(text: Column) -> Column:
    """White space single, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def shorten(text: Column, most: int) -> Column:
    """``collapse``; if longer than ``most``, cut to that length with an ellipsis at the end."""
    line = collapse(text)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…")))


def embedding_text(title: Column, text: Column, most: int | None = 400) -> Column:
    """What is embedded of a page: its title and the first ``most`` characters of its text (None: all), or the title twice."""
    body = F.coalesce(F.nullif(text, F.lit("")), title)
    return F.concat(F.lit("title: "), title, F.lit(" | text: "), body if most is None else F.substring(body, 1, most))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    return F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# Fixed value: an article cited in an answer.
CITATION = r"\[([^\[\]]{2,120})\]"


def citations(answer: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1))


# Fixed value: an answer that says the information wasn't found, over folded text.
REFUSAL = (
    "no (lo )?(encontre|encuentro|tengo|hay|dispongo|puedo (responder|dar|proporcionar)|se (menciona|encuentra|especifica|indica|proporciona)"
    "|aparece|contiene|incluye|esta (disponible|en))"
    "|(fragmentos|wiki|informacion) (proporcionad[oa]s? )?no (contiene|incluye|menciona|tiene|dice|habla)"
    "|no cuento con|sin informacion|fuera del alcance|desconozco"
)
# Fixed value: an answer that talks of the texts it was given.
META_TALK = r"fragmento|\btextos? (de la wiki|proporcionad|del articulo)|segun (la wiki|los textos)|se deriva de los textos|que se me proporciona"


def refused(answer: Column) -> Column:
    return fold(collapse(F.coalesce(answer, F.lit("")))).rlike(REFUSAL)


def talks_of_texts(answer: Column) -> Column:
    return fold(F.coalesce(answer, F.lit(""))).rlike(META_TALK)


def word_count(text: Column) -> Column:
    """Words between white space."""
    line = collapse(F.coalesce(text, F.lit("")))
    return F.when(line == "", 0).otherwise(F.size(F.split(line, " ")))


def py_fold(text: str) -> str:
    """``fold`` in Python, for tests and for Python-side operators."""
    plain = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in plain if not unicodedata.combining(c))


def py_keywords(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in map(py_fold, re.findall(r"\w+", text)) if len(w) > 1 and w not in set(STOPWORDS)))
