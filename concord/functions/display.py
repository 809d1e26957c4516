"""Numbers, stated sizes, scales and phrases as a person reads them: decimal commas, three digits to a group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARATORS = {"=": "", "≥": "≥ ", ">": "> ", "<": "< "}


def number(value: Column, places: int = 2) -> Column:
    """At most `places` decimals without trailing zeros, a comma, no-break spaces between thousands; a dash for null."""
    text = F.regexp_replace(F.format_number(value, places), r"\.?0+$", "") if places else F.format_number(value, 0)
    return F.coalesce(F.translate(text, ",.", " ,"), F.lit("—"))


def claim(kind: Column, value: Column, width: Column, height: Column, comparator: Column) -> Column:
    """A stated dimension: height, box or share; an unreadable one says so."""
    mark = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in COMPARATORS.items() for x in pair)), comparator), F.lit(""))
    return (
        F.when(kind == "height", F.concat(number(value), F.lit(" мм"))).when(kind == "box", F.concat(number(width), F.lit(" × "), number(height), F.lit(" мм")))
        .when(kind == "percent", F.concat(mark, number(value), F.lit(" %"))).when(kind == "unreadable", "не прочитано")
    )


def scale(level: Column, mm_per_pixel: Column) -> Column:
    """What is known of a sheet's scale."""
    return F.when(level == "none", "масштаб не определён").otherwise(F.concat(number(mm_per_pixel, 4), F.lit(" мм на точку · "), F.when(level == "high", "точно").otherwise("по сторонам")))


def phrase(kind: Column, expected: Column, actual: Column) -> Column:
    """One difference of a phrase, in brackets where the reading is not sure."""
    return (
        F.when(kind == "same", expected).when(kind == "missing", F.concat(F.lit("−"), expected)).when(kind == "extra", F.concat(F.lit("+"), actual))
        .when(kind == "replace", F.concat(expected, F.lit(" → "), actual)).otherwise(F.concat(F.lit("("), F.coalesce(expected, F.lit("")), F.lit(" ? "), F.coalesce(actual, F.lit("")), F.lit(")")))
    )
