"""Verdicts per rule, their tallies against truth, and mutations that try to fool them.

The engine is three-valued and conservative: uncertain is not different, and automatic evidence
alone never passes a rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import quantity as Q
from concord.functions import text as T


def sure_difference(kind: Column, confidence: Column, anchored: Column) -> Column:
    return F.coalesce(F.when(kind == "missing", anchored).otherwise((kind != "uncertain") & (kind != "same") & (confidence >= 75)), F.lit(False))


def numeric_difference(kind: Column, expected: Column, actual: Column, confidence: Column) -> Column:
    groups = lambda c: F.regexp_extract_all(c, F.lit(r"\d+(?:[,.]\d+)*"), F.lit(0))
    return F.coalesce((kind == "replace") & (confidence >= 80) & expected.rlike(r"\d") & actual.rlike(r"\d") & (groups(expected) != groups(actual)), F.lit(False))


def is_text_height(unit: Column, target: Column, label: Column) -> Column:
    """Letter heights inform and do not decide, unless heights_affect_status is set."""
    named = target.isin("partitioned_letters", "quantity_label", "quantity", "date_label", "date_digits") | ((target == "letters") & label.rlike("(?iu)высот[аы]\\s+букв"))
    return (unit == "мм") & ~label.rlike("(?iu)еас") & named


def row_status(
    comparison: Column, *, rejected: Column, failed: Column, exempt: Column, confirmed: Column, sizes_pass: Column, conditions: Column,
    quantity_issue: Column, notation: Column, size_issue: Column, has_text: Column,
) -> Column:
    """error > na > pass > issue > detected > words > issue > pending."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(no(rejected) | no(failed), "error").when((comparison == "na") | no(exempt), "na")
        .when(no(confirmed) & no(sizes_pass) & no(conditions), "pass").when(no(quantity_issue) | no(notation) | no(size_issue), "issue")
        .when(comparison == "found", "detected").when(comparison == "all_words", "words")
        .when(no(has_text) & comparison.isin("partial", "unreadable", "uncertain"), "issue").otherwise("pending")
    )


def status_label(quantity: Column, notation: Column, number: Column, sizes: Column, text: Column, callout: Column, border: Column, unsure: Column) -> Column:
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(no(quantity), "Проверить количество").when(no(notation), "Другая запись единицы").when(no(number), "Проверить число").when(no(sizes), "Проверить размеры")
        .when(no(text), "Отличие текста").when(no(callout), "Выноска ≠ замер").when(no(border), "Проверить размер").when(no(unsure), "Спорно")
    )


def text_verdict(status: Column, sure: Column) -> Column:
    """match, difference, unsure, not-found or skip."""
    return (
        F.when(status.isin("na", "manual"), "skip").when(status == "found", "match").when(F.coalesce(sure, F.lit(False)), "difference")
        .when(status.isin("partial", "uncertain", "all_words"), "unsure").otherwise("not-found")
    )


def outcome(truth: Column, verdict: Column) -> Column:
    """Equal sections are confirmed, open or falsely different; different ones caught, flagged, open or falsely matched."""
    return (
        F.when(truth == "same", F.when(verdict == "match", "confirmed").when(verdict == "difference", "falseDiff").otherwise("open"))
        .when(truth == "different", F.when(verdict == "difference", "caught").when(verdict == "match", "falseMatch").when(verdict == "unsure", "flagged").otherwise("open"))
    )


OUTCOMES = ("confirmed", "caught", "flagged", "open", "falseMatch", "falseDiff")


def tally(rows: DataFrame, keys: Sequence[str], by: str = "outcome") -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(by) == o).alias(o) for o in OUTCOMES), F.count(by).alias("total"))


def rolled(rows: DataFrame, keys: Sequence[str], by: str = "outcome") -> DataFrame:
    """Tallies of each level of keys and of all rows, with `level` the number of keys left."""
    return rows.rollup(*keys).agg(*(F.count_if(F.col(by) == o).alias(o) for o in OUTCOMES), (len(keys) - F.bit_count(F.grouping_id())).cast("int").alias("level"))


def complete_methods(runs: DataFrame, method: str, sheet: str) -> DataFrame:
    """Methods that were run on every sheet (relational division)."""
    n = runs.select(F.count_distinct(sheet).alias("n"))
    return runs.groupBy(method).agg(F.count_distinct(sheet).alias("sheets")).join(F.broadcast(n), F.col("sheets") == F.col("n")).select(method, "sheets")


def best_region(scores: DataFrame, region: str, score: str, by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """The region of largest total score; the first one wins a tie."""
    total = scores.groupBy(*by, region, *([order] if order and order != region else [])).agg(F.sum(score).alias("score"))
    best = total.groupBy(*by).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(order or region).alias("o"), F.col(region).alias("r"), "score")).alias("b"))
    return best.select(*by, F.col("b.r").alias(region), "b.score")


#: Most changes of each kind that one text gets, spread evenly over its places.
CHANGES = {"number": 12, "inside": 8, "edge": 4, "added": 8, "letter": 8}
ADDED = "дополнительно "


def mutable(title: Column, text: Column) -> Column:
    """Rules that mutations are made of: a text to compare, no amount, code, sign or graphic."""
    return (F.coalesce(text, F.lit("")) != "") & (text != "-") & ~Q.is_quantity_title(title) & ~title.rlike("(?iu)штриховой код|знаки|мебиус|рюмка")


def spread_of(items: Column, limit: int) -> Column:
    """Items floor(i * n / limit) of an array of n, all of it up to `limit`."""
    n = F.size(items)
    return F.when(n <= limit, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.get(items, F.floor(i * n / limit).cast("int"))))


def mutations(rules: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, place, mutated: texts with one number, word or letter changed, places spread evenly over the text.

    number: the last digit goes up by one; inside and edge: a word of four letters or more goes, with or without tokens on
    both sides of it in its sentence; added: a word comes before one inside; letter: the middle letter of a word of six or more
    becomes another. place counts characters before the change. Words are those of any alphabet.
    """

    def parts(pattern: str) -> Column:
        """array<struct<part, at>>: the text taken apart into runs of the pattern and runs between, and where each begins."""
        runs = F.regexp_extract_all(F.col(text), F.lit(rf"{pattern}+|[^{pattern[1:-1]}]+"), F.lit(0))
        begin = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<part:string,at:int>>").alias("a"))
        step = lambda s, p: F.struct((s["n"] + F.char_length(p)).alias("n"), F.concat(s["a"], F.array(F.struct(p.alias("part"), s["n"].alias("at")))).alias("a"))
        return F.aggregate(runs, begin, step, lambda s: s["a"])

    pieces = T.let(T.fragments(F.col(text)), lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.col(text))))
    find = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<lo:int,hi:int>>").alias("a"))

    def found(s: Column, p: Column) -> Column:
        lo = F.position(p, F.col(text), s["n"] + 1) - 1
        hi = lo + F.char_length(p)
        return F.struct(hi.alias("n"), F.concat(s["a"], F.array(F.struct(lo.alias("lo"), hi.alias("hi")))).alias("a"))

    rows = rules.select(F.col(key), F.col(text), F.filter(parts("[0-9]"), lambda p: p["part"].rlike("^[0-9]")).alias("_n"), F.filter(parts(r"[\p{L}]"), lambda p: p["part"].rlike(r"^\p{L}{4}")).alias("_w"), F.aggregate(pieces, find, found, lambda s: s["a"]).alias("_s"))
    some = lambda lo, n: F.substring(F.col(text), lo + 1, n).rlike(r"[0-9\p{L}%°º]")

    def inner(w: Column) -> Column:
        """Whether its sentence has tokens on both sides of the word; one whose pieces were joined across a line break is not found in the text."""
        end = w["at"] + F.char_length(w["part"])
        around = F.transform(F.filter("_s", lambda s: (s["lo"] <= w["at"]) & (w["at"] < s["hi"])), lambda s: (s["lo"] >= 0) & some(s["lo"], w["at"] - s["lo"]) & some(end, s["hi"] - end))
        return F.coalesce(F.get(around, F.lit(0)), F.lit(False))

    rows = rows.withColumn("_in", F.filter("_w", inner)).withColumn("_out", F.filter("_w", lambda w: ~inner(w))).withColumn("_long", F.filter("_w", lambda w: F.char_length(w["part"]) >= 6))
    head = lambda w: F.substring(F.col(text), F.lit(1), w["at"])
    tail = lambda w: F.substring(F.col(text), w["at"] + F.char_length(w["part"]) + 1, F.char_length(text))
    make = lambda kind, w, new: F.struct(F.lit(kind).alias("kind"), w["at"].alias("place"), new.alias("mutated"))
    bumped = lambda d: F.concat(F.left(d, F.char_length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    gone = lambda w: F.regexp_replace(F.concat(head(w), tail(w)), " {2,}", " ")

    def turned(w: Column) -> Column:
        at = F.floor(F.char_length(w) / 2).cast("int") + 1
        old = F.substring(w, at, F.lit(1))
        new = F.when(F.lower(old) == "ж", "ш").otherwise("ж")
        return F.concat(F.substring(w, F.lit(1), at - 1), F.when(old == F.lower(old), new).otherwise(F.upper(new)), F.substring(w, at + 1, F.char_length(w)))

    kinds = {
        "number": ("_n", lambda w: F.concat(head(w), bumped(w["part"]), tail(w))), "inside": ("_in", gone), "edge": ("_out", gone),
        "added": ("_in", lambda w: F.concat(head(w), F.lit(ADDED), w["part"], tail(w))), "letter": ("_long", lambda w: F.concat(head(w), turned(w["part"]), tail(w))),
    }

    def changed(kind: str, places: str, change) -> Column:
        return F.transform(spread_of(F.col(places), CHANGES[kind]), lambda w: make(kind, w, change(w)))

    every = F.concat(*(changed(k, c, f) for k, (c, f) in kinds.items()))
    return rows.select(key, F.explode(every).alias("m")).select(key, "m.kind", "m.place", "m.mutated")


FILTERS = {"all": None, "issues": ("error", "issue"), "pending": ("pending",), "passed": ("pass", "detected", "words")}


def shown(status: Column, wanted: str) -> Column:
    """Whether a row is shown under a filter of the report."""
    kept = FILTERS[wanted]
    return F.lit(True) if kept is None else status.isin(*kept)
