"""Other engines in the place of the first: what they give, brought to the one shape the rest of the plan reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import geometry as G

#: Most a word may be trusted that stands at an edge where its line was cut.
CUT_EDGE = 50.0
MODES = {"line": ("7", "8", "13"), "page": ("1", "3", "4", "6", "11", "12")}


def reading_mode(page_mode: Column) -> Column:
    """line where a page mode asks for one line or word, search for modes that look for lines, null for unknown ones."""
    return F.when(page_mode.isin(*MODES["line"]), "line").when(page_mode.isin(*MODES["page"]), "search")


def allowed(words: DataFrame, characters: str) -> DataFrame:
    """Words with the characters of a whitelist alone; those left without any go. An empty whitelist allows all."""
    if not characters:
        return words
    others = "[^" + "".join("\\" + c if c in "\\]^-[" else c for c in characters) + "]"
    return words.withColumn("text", F.regexp_replace("text", others, "")).filter("text <> ''")


def cut_edges(words: DataFrame) -> DataFrame:
    """Words (text, confidence, x0, x1, width, height, cut_left, cut_right of their line's image) trusted by 50 at most where the line was cut within .8 of its height."""
    edge = F.col("height") * 0.8
    partial = (F.coalesce("cut_left", F.lit(False)) & (F.col("x0") < edge)) | (F.coalesce("cut_right", F.lit(False)) & (F.col("x1") > F.col("width") - edge))
    return words.withColumn("confidence", F.when(partial, F.least(F.lit(CUT_EDGE), F.col("confidence"))).otherwise(F.col("confidence")))


def tree(words: DataFrame, key: str) -> DataFrame:
    """key, blocks: words (line, word_ix, text, confidence, x0, y0, x1, y1) as the nested tree the first engine gives, one block and paragraph, a line for each line."""
    box = F.struct(*(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    word = F.struct(F.col("text"), F.col("confidence").cast("double").alias("confidence"), box.alias("bbox"))
    lines = words.groupBy(key, "line").agg(F.transform(F.sort_array(F.collect_list(F.struct("word_ix", word.alias("w")))), lambda x: x["w"]).alias("words"))
    return lines.groupBy(key).agg(F.array(F.struct(F.array(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("line", "words"))), lambda x: F.struct(x["words"].alias("words"))).alias("lines"))).alias("paragraphs"))).alias("blocks"))


def from_line_sheets(found: DataFrame, slots: DataFrame) -> DataFrame:
    """line_ix, text, confidence, x0, x1 of words read on packed sheets: each belongs to the slot its middle lies in (4 pixels more on either side), its columns cut at the slot's.

    found: sheet, text, score, x0, y0, x1, y1. slots: sheet, line_ix, slot_x, slot_y, width, height, scale, cut_left, cut_right.
    """
    middle = (F.col("y0") + F.col("y1")) / 2
    s = slots.select(F.col("sheet").alias("_sheet"), "line_ix", "slot_x", "slot_y", "width", "height", "scale", "cut_left", "cut_right")
    rows = found.filter(F.trim("text") != "").join(s, (F.col("sheet") == F.col("_sheet")) & (middle >= F.col("slot_y") - 4) & (middle < F.col("slot_y") + F.col("height") + 4))
    at = lambda x: F.greatest(F.lit(0.0), F.least(F.col("width") / F.col("scale"), (F.col(x) - F.col("slot_x")) / F.col("scale")))
    rows = rows.select("line_ix", F.trim("text").alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score") * 100)).alias("confidence"), at("x0").alias("x0"), at("x1").alias("x1"), (F.col("width") / F.col("scale")).alias("width"), (F.col("height") / F.col("scale")).alias("height"), "cut_left", "cut_right").filter("x1 > x0")
    return cut_edges(rows).select("line_ix", "text", "confidence", "x0", "x1")


def page_box(words: DataFrame, region: str) -> DataFrame:
    """words of a line image (x0, x1 of width, the line's whole height) as boxes of the page: the line's region (a box) cut to the word's columns."""
    r = F.col(region)
    return words.withColumn("box", G.box(r["x"] + F.col("x0") / F.col("width") * r["w"], r["y"], (F.col("x1") - F.col("x0")) / F.col("width") * r["w"], r["h"]))
