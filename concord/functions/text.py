"""Text functions as Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X

FOLD = (X.LATIN + X.DIGITS, X.CYRILLIC + X.DIGIT_LETTERS)
_NORMAL = ("ё" + X.LATIN + "º" + X.DASHES + X.QUOTES, "е" + X.CYRILLIC + "°" + "-" * len(X.DASHES))


def let(value: Column, body) -> Column:
    """Evaluates value once per row for all its uses in body; a projection may be folded into a lambda, this may not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def gram_list(tokens: Column, n: int) -> Column:
    """The n-grams of an array of tokens, joined by spaces; none if it is shorter."""

    def made(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, every).otherwise(F.array().cast("array<string>"))

    return let(tokens, made)


def _unlisted(s: Column) -> Column:
    """Lower case, one alphabet, one dash, no quotes; without dashes that begin an item before a number."""
    return F.regexp_replace(F.translate(F.lower(s), *_NORMAL), rf"(^|{X.WS})-{X.WS}+(?=\d)", "$1")


def normalize(s: Column) -> Column:
    """Lower case, one alphabet for look-alikes, one dash, one space, none around marks, no quotes."""
    x = F.regexp_replace(_unlisted(s), rf"{X.WS}+", " ")
    return F.trim(F.regexp_replace(x, r" *([,.:;%/()-]) *", "$1"))


def compact(s: Column) -> Column:
    """Letters, digits, % and ° alone; a decimal mark is ¤ and a minus §."""
    x = F.regexp_replace(normalize(s), r"(\d)[,.](?=\d)", "$1¤")
    return F.regexp_replace(F.regexp_replace(x, r"-(?=\d)", "§"), r"[^\p{L}\p{N}¤§%°]", "")


def dehyphenate(s: Column) -> Column:
    return F.regexp_replace(s, r"(\p{L})-\s*(?:[<>|{}\[\]]+\s*)?(\p{L})", "$1$2")


def _tokens(s: Column) -> Column:
    # of the white space that normalize takes away only that inside a number matters here: it is passed over, not replaced in the whole text
    found = F.regexp_extract_all(_unlisted(dehyphenate(s)), F.lit(rf"\p{{L}}+|(?:-{X.WS}*)?\d+(?:{X.WS}*[,.]{X.WS}*\d+)?|[%°]"), F.lit(0))

    def number(t: Column) -> Column:
        return let(F.regexp_replace(t, rf"{X.WS}+", ""), lambda n: F.when(n.startswith("-"), n).otherwise(F.translate(n, ".", ",")))

    # a number begins with a dash or a digit; of other tokens only % and letters lie outside
    return F.transform(found, lambda t: F.when((t >= "-") & (t < ":"), number(t)).otherwise(t))


def words(s: Column) -> Column:
    """Tokens longer than one character, and % ° л г."""
    return F.filter(_tokens(s), lambda t: (F.char_length(t) > 1) | t.isin("%", "°", "л", "г"))


def phrase_tokens(s: Column) -> Column:
    """All tokens; the letter of a temperature scale after ° is с, as every Latin c is."""
    return _tokens(s)


def number_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(r"\d"))


def fold(token: Column) -> Column:
    return F.translate(token, *FOLD)


def shared_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.char_length(a), F.char_length(b))
    return F.size(F.filter(F.sequence(F.lit(0), n), lambda i: (i > 0) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))))


def substitutions(a: Column, b: Column) -> Column:
    """Positions at which two texts of one length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda n, x: n + x)


def alike(a: Column, b: Column) -> Column:
    """The same word in another form or with one misread letter; numbers are alike only when equal."""
    x, y = fold(a), fold(b)
    nx, ny, p = F.char_length(x), F.char_length(y), shared_prefix(x, y)
    least = F.least(nx, ny)
    stem = (p >= 4) & (least >= 4) & (F.abs(nx - ny) <= 2) & (p >= least - 2)
    slip = (nx == ny) & (nx >= 6) & (substitutions(x, y) <= 1)
    return F.when((a == b) | (x == y), F.lit(True)).when(a.rlike(r"\d") | b.rlike(r"\d"), F.lit(False)).otherwise(stem | slip)


def compare(expected: Column, actual: Column) -> Column:
    """struct<status, coverage, missing>: found, all_words, partial, unreadable, or manual without expected text."""
    parts = F.struct(compact(dehyphenate(expected)).alias("e"), compact(dehyphenate(actual)).alias("a"), words(expected).alias("want"), words(actual).alias("read"))
    return let(parts, lambda p: compare_tokens(p["e"], p["a"], p["want"], p["read"]))


def compare_tokens(e: Column, a: Column, want: Column, read: Column) -> Column:
    """The same of prepared parts, so that a reading is taken apart once for many expected texts."""
    n = F.size(want)
    hits = F.size(F.filter(want, lambda t: F.array_contains(read, t)))
    share = F.when(n > 0, F.floor(hits * 100 / n + 0.5)).otherwise(F.lit(0)).cast("int")
    found = a.contains(e)
    none = F.array().cast("array<string>")
    status = F.when(e == "", "manual").when(found, "found").when(share == 100, "all_words").when(share > 0, "partial").otherwise("unreadable")
    coverage = F.when(e == "", 0).when(found, 100).otherwise(share)
    missing = F.when((e == "") | found, none).otherwise(F.array_except(F.array_distinct(want), read))
    return F.struct(status.alias("status"), coverage.alias("coverage"), missing.alias("missing"))


_MARKED = r"(-?\d+(?:[,.]\d+)?|\p{L}+)([.,;:!?-]?)"


def marked_tokens(s: Column) -> Column:
    """array<struct<token, mark>>: each word or number with the mark right after it."""
    x = normalize(dehyphenate(s))
    t = F.transform(F.regexp_extract_all(x, F.lit(_MARKED), F.lit(1)), lambda v: F.regexp_replace(v, r"^(\d+)\.(?=\d)", "$1,"))
    return F.zip_with(t, F.regexp_extract_all(x, F.lit(_MARKED), F.lit(2)), lambda a, b: F.struct(a.alias("token"), b.alias("mark")))


def punctuation(expected: Column, actual: Column) -> Column:
    """struct<checked, differences>: marks that differ, over tokens matched in order; null when nothing was checked."""
    return let(F.struct(marked_tokens(expected).alias("l"), marked_tokens(actual).alias("r")), lambda p: _marks_compared(p["l"], p["r"]))


def _marks_compared(left: Column, right: Column) -> Column:
    of = lambda a: F.transform(a, lambda x: x["token"])
    same = of(left) == of(right)
    shape = "struct<cursor:int,checked:int,differences:array<struct<word:string,expected:string,actual:string>>>"
    dash = lambda m: F.when(m == "", "—").otherwise(m)

    def step(s: Column, item: Column) -> Column:
        rest = F.array_position(of(F.slice(right, s["cursor"] + 1, F.greatest(F.size(right), F.lit(1)))), item["token"]).cast("int")
        read = F.get(right, s["cursor"] + rest - 1)
        differs = ((item["mark"] != "") | same) & (item["mark"] != read["mark"])
        found = F.array(F.struct(item["token"].alias("word"), dash(item["mark"]).alias("expected"), dash(read["mark"]).alias("actual")))
        new = F.struct((s["cursor"] + rest).alias("cursor"), (s["checked"] + F.when(item["mark"] != "", 1).otherwise(0)).alias("checked"), F.when(differs, F.concat(s["differences"], found)).otherwise(s["differences"]).alias("differences"))
        return F.when(rest > 0, new).otherwise(s)

    start = F.struct(F.lit(0).alias("cursor"), F.lit(0).alias("checked"), F.array().cast("array<struct<word:string,expected:string,actual:string>>").alias("differences")).cast(shape)
    out = F.aggregate(left, start, lambda s, x: step(s, x).cast(shape))
    some = (F.size(left) > 0) & (F.size(right) > 0) & ((out["checked"] > 0) | (F.size(out["differences"]) > 0))
    return F.when(some, F.struct(out["checked"].alias("checked"), out["differences"].alias("differences")))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def truncated(a: Column, b: Column) -> Column:
    """b's digits are a proper beginning or end of those of a."""
    x, y = digits(a), digits(b)
    return (x != "") & (y != "") & (F.char_length(y) < F.char_length(x)) & (x.startswith(y) | x.endswith(y))


def lookalike(a: Column, b: Column) -> Column:
    """Of one length, each character equal or of one group of confusable characters."""
    close = lambda p, q: (p == q) | F.exists(F.array(*map(F.lit, X.CONFUSION)), lambda g: g.contains(p) & g.contains(q))
    return (a != b) & (F.char_length(a) == F.char_length(b)) & F.forall(F.zip_with(F.split(a, ""), F.split(b, ""), close), lambda v: v)


def fragments(s: Column) -> Column:
    """Pieces at newlines and at sentence ends before a capital; short pieces join the one before; empty unless all hold three tokens or more and there are two."""
    parts = F.filter(F.split(s, r"\n+|(?<=[.!?;])\s+(?=\p{Lu})"), lambda p: F.trim(p) != "")

    def add(acc: Column, p: Column) -> Column:
        short = F.size(phrase_tokens(p)) < 3
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(acc, -1), p)))
        return F.when(short & (F.size(acc) > 0), joined).otherwise(F.concat(acc, F.array(p)))

    out = F.aggregate(parts, F.array().cast("array<string>"), add)
    good = (F.size(out) > 1) & F.forall(out, lambda p: F.size(phrase_tokens(p)) >= 3)
    return F.when(good, out).otherwise(F.array().cast("array<string>"))


def raised(s: Column) -> Column:
    """A raised run as the sign it stands for."""
    return F.translate(s, "0oOоО23", "°°°°°²³")


def strict(s: Column) -> Column:
    """For exact error counts: composed characters as given, one dash, one degree sign, one quote, one space."""
    return F.trim(F.regexp_replace(F.translate(s, X.DASHES + "º" + "«»“”’‘'", "---°" + '"' * 7), rf"{X.WS}+", " "))


def letters(s: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(strict(s)), "ё" + X.LATIN + "0", "е" + X.CYRILLIC + "о"), r"[^\p{L}\p{N}]", "")


def bare(s: Column) -> Column:
    return fold(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}%]", ""))


def calibrated(c: Column) -> Column:
    """A second engine's confidence on the first one's scale: straight lines between corner points."""
    out = F.lit(X.CALIBRATION[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(X.CALIBRATION, X.CALIBRATION[1:]))):
        out = F.when(c <= x1, y0 + (c - x0) * (y1 - y0) / (x1 - x0)).otherwise(out)
    return F.when(c <= 0, F.lit(0.0)).otherwise(out)


def escape_html(s: Column) -> Column:
    out = F.coalesce(s, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: one row of the table at a time."""
    zero = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), lambda cur, j: F.concat(cur, F.array(F.when(F.get(b, j - 1) == x, F.get(prev, j - 1) + 1).otherwise(F.greatest(F.get(prev, j), F.element_at(cur, -1))))))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.element_at(F.aggregate(a, zero, row), -1))


def inside_distance(needle: Column, hay: Column) -> Column:
    """Edits of needle against the best place of hay: ends are free in hay. Both are arrays of units."""
    start = F.transform(F.concat(F.array(F.lit("")), hay), lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        first = F.array(F.get(prev, F.lit(0)) + 1)
        return F.aggregate(F.sequence(F.lit(1), F.size(hay)), first, lambda cur, j: F.concat(cur, F.array(F.least(F.get(prev, j - 1) + F.when(F.get(hay, j - 1) == x, 0).otherwise(1), F.get(prev, j) + 1, F.element_at(cur, -1) + 1))))

    return F.when(F.size(needle) == 0, F.lit(0)).when(F.size(hay) == 0, F.size(needle)).otherwise(F.array_min(F.aggregate(needle, start, row)))


def inside_similarity(needle: Column, hay: Column) -> Column:
    return F.when(F.size(needle) == 0, F.lit(0.0)).otherwise(1 - inside_distance(needle, hay) / F.size(needle))
