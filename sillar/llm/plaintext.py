"""Lower case without accents, letter for letter, fast; and when a text is blank."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _single(code: int) -> str | None:
    char = chr(code)
    low = char.lower()
    if len(low) != 1:
        return None
    base = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return base if len(base) == 1 else low


#: Every character below U+3000 that has a plain lower-case form of one letter.
TABLE = {code: plain for code in range(0x3000) if (plain := _single(code)) is not None and plain != chr(code)}


def plain(text: str) -> str:
    """As long as the text, so offsets hold in both. Letters that fold to several stay lower case; combining marks
    stay where they are."""
    low = text.lower()
    if len(low) != len(text):
        return text.translate(TABLE)
    if not low.isascii():
        for char in set(low):  # few different letters, each replaced at once
            if char > "\x7f" and (other := TABLE.get(ord(char))) is not None:
                low = low.replace(char, other)
    return low


_SQUARE = re.compile(r"[\[\]]")


def outside_brackets(text: str) -> str:
    """The text with a space for each outermost pair of square brackets; unmatched ones stay."""
    opened: list[int] = []
    spans: list[tuple[int, int]] = []
    for m in _SQUARE.finditer(text):
        if m.group() == "[":
            opened.append(m.start())
        elif opened:
            start = opened.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, m.end()))
    out, at = [], 0
    for start, end in spans:
        out += [text[at:start], " "]
        at = end
    return "".join(out) + text[at:]


def is_blank(text: str | None) -> bool:
    """Null, or no letter or digit outside square brackets."""
    return not text or not any(c.isalnum() for c in (outside_brackets(text) if "]" in text else text))


def blank(text: Column) -> Column:
    """``is_blank`` as an expression, at any depth of brackets in linear time.

    Pairs without brackets inside are taken out at once; only if pairs are left, brackets
    and the runs between them are walked: a letter counts unless the depth later falls
    below its own, and of all letters that still count only the least deep need be known.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[^\[\]]*\]", " ")
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\[\]]|[^\[\]]+)"), F.lit(1))
    none = 2**31 - 1

    def step(state: Column, piece: Column) -> Column:
        depth, least = state["depth"], state["least"]
        down = F.greatest(depth - 1, F.lit(0))
        closed = F.struct(down.alias("depth"), F.when(least > down, none).otherwise(least).alias("least"))
        opened = F.struct((depth + 1).alias("depth"), least.alias("least"))
        seen = F.struct(depth.alias("depth"), F.when(piece.rlike(r"[\p{L}\p{N}]"), F.least(least, depth)).otherwise(least).alias("least"))
        return F.when(piece == "[", opened).when(piece == "]", closed).otherwise(seen)

    walked = F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit(none).alias("least")), step, lambda s: s["least"] == none)
    return F.when(bare.rlike(r"\[[^\[\]]*\]"), walked).otherwise(~bare.rlike(r"[\p{L}\p{N}]"))
