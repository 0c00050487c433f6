"""DuckDB counterparts of the text expressions."""

from __future__ import annotations

from sillar.functions.roles import ASSISTANT_ROLES, USER_ROLES
from sillar.functions.text import STOPWORDS


def fold(x: str) -> str:
    return f"strip_accents(translate(lower({x}), '²³¹ºª', '231oa'))"


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def raw_keywords(x: str) -> str:
    """Keywords with repeats, in order."""
    return f"list_filter(regexp_extract_all({fold(f'coalesce({x}, {chr(39)}{chr(39)})')}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))"


def once(x: str) -> str:
    """An array's elements, each at its first place."""
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


def keywords(x: str) -> str:
    return once(raw_keywords(x))


def title_key(x: str) -> str:
    return f"coalesce(array_to_string({keywords(x)}, ' '), '')"


def base_key(x: str) -> str:
    return title_key(f"regexp_replace({x}, '\\s*\\([^)]*\\)\\s*$', '')")


def said_by(role: str, spellings: list[str]) -> str:
    names = ", ".join(f"'{r}'" for r in spellings)
    return f"lower(trim(coalesce({role}, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203))) IN ({names})"


BY_USER, BY_ASSISTANT = said_by("role", USER_ROLES), said_by("role", ASSISTANT_ROLES)
