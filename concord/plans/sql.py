"""DuckDB fragments that state the text functions independently of Spark, for oracle queries.

The dialect's patterns have no lookaround: a looked-at character is captured and put back, and
patterns that may share one are applied twice.
"""

from __future__ import annotations

from concord.functions import fixed as X


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_DELETE = X.QUOTES
_FROM = "ё" + X.LATIN + "º" + X.DASHES + _DELETE
_TO = "е" + X.CYRILLIC + "°---"


def rr(e: str, pattern: str, to: str) -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(to)}, 'g')"


def normalize(e: str) -> str:
    x = f"translate(lower({e}), {q(_FROM)}, {q(_TO)})"
    x = rr(x, rf"(^|{X.WS})-{X.WS}+(\d)", r"\1\2")
    x = rr(rr(x, rf"{X.WS}+", " "), r" *([,.:;%/()-]) *", r"\1")
    return f"trim({x})"


def compact(e: str) -> str:
    x = normalize(e)
    for _ in range(2):
        x = rr(x, r"(\d)[,.](\d)", r"\1¤\2")
    return rr(rr(x, r"-(\d)", r"§\1"), r"[^\p{L}\p{N}¤§%°]", "")


def dehyphenate(e: str) -> str:
    return rr(e, r"(\p{L})-\s*(?:[<>|{}\[\]]+\s*)?(\p{L})", r"\1\2")


def tokens(e: str) -> str:
    found = f"regexp_extract_all({normalize(dehyphenate(e))}, {q(r'-?[0-9]+(?:[,.][0-9]+)?|' + chr(92) + 'p{L}+|[%°]')})"
    return f"list_transform({found}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+[.][0-9]+') THEN replace(t, '.', ',') ELSE t END)"


def words(e: str) -> str:
    return f"list_filter({tokens(e)}, lambda t: length(t) > 1 OR t IN ('%', '°', 'л', 'г'))"


def fold(e: str) -> str:
    return f"translate({e}, {q(X.LATIN + X.DIGITS)}, {q(X.CYRILLIC + X.DIGIT_LETTERS)})"


def fragments(e: str) -> str:
    """Pieces at newlines and sentence ends; one of fewer than three tokens joins the piece before; none unless there are two, of three tokens each."""
    cut = rr(e, r"([.!?;])\s+(\p{Lu})", "\\1\n\\2")
    pieces = f"list_filter(string_split_regex({cut}, '\n+'), lambda p: trim(p) <> '')"
    folded = f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({pieces}, lambda p: [p])), lambda acc, p: CASE WHEN len(acc) > 0 AND len({tokens('p[1]')}) < 3 THEN list_concat(acc[1:len(acc) - 1], [acc[len(acc)] || ' ' || p[1]]) ELSE list_concat(acc, p) END)"
    return f"list_transform([{folded}], lambda a: CASE WHEN len(a) > 1 AND len(list_filter(a, lambda x: len({tokens('x')}) < 3)) = 0 THEN a ELSE [] END)[1]"
