"""Sinks: HTML report, callout counts, scored tables, upserts of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.text import escape_html


def html_rows(results: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key and html: one escaped table row each; rendering stays in the executors."""
    cells = F.concat(*(F.concat(F.lit("<td>"), escape_html(F.col(c).cast("string")), F.lit("</td>")) for c in columns))
    return results.select(key, F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("html"))


def html_report(results: DataFrame, sheet: str, order: str, title: str, columns: Sequence[str]) -> DataFrame:
    """sheet and html: a report per sheet, its rows in order."""
    rows = results.select(sheet, order, F.concat(*(F.concat(F.lit("<td>"), escape_html(F.col(c).cast("string")), F.lit("</td>")) for c in columns)).alias("h"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "h"))), lambda x: F.concat(F.lit("<tr>"), x["h"], F.lit("</tr>"))), "\n")
    head = "".join(f"<th>{c}</th>" for c in columns)
    return rows.groupBy(sheet).agg(body.alias("b")).select(sheet, F.concat(F.lit("<!doctype html><meta charset=utf-8><h1>"), escape_html(F.lit(title)), F.lit(" "), escape_html(F.col(sheet).cast("string")), F.lit(f"</h1><table><tr>{head}</tr>\n"), "b", F.lit("\n</table>")).alias("html"))


def callout_counts(callouts: DataFrame, sheet: str) -> DataFrame:
    """read, unread, checked (linked and confirmed by measuring), plain (linked alone) and loose callouts of each sheet."""
    read, linked, agrees = F.col("kind") != "unreadable", F.col("n_links") > 0, F.coalesce(F.col("agrees"), F.lit(False))
    return callouts.groupBy(sheet).agg(F.count_if(read).alias("read"), F.count_if(~read).alias("unread"), F.count_if(read & linked & agrees).alias("checked"), F.count_if(read & linked & ~agrees).alias("plain"), F.count_if(read & ~linked).alias("loose"))


def markdown(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in columns)), F.lit(" |")).alias("line"))


def pivoted(rows: DataFrame, keys: Sequence[str], method: str, methods: Sequence[str], value: str) -> DataFrame:
    """A column for each method, in the order given."""
    return rows.groupBy(*keys).pivot(method, list(methods)).agg(F.first(value))


def fixture(found: DataFrame, expected: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Writes the links found as compressed JSON lines, those a person expected carried over as `expected`; returns what differs from before, on either side."""
    from concord.operators import tokens

    carried = expected.select(*keys).distinct().withColumn("expected", F.lit(True))
    found.join(carried, list(keys), "left").withColumn("expected", F.coalesce("expected", F.lit(False))).write.mode("overwrite").option("compression", "gzip").json(path)
    return tokens.difference(expected.select(*keys), found.select(*keys))
