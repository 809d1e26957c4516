"""Several readings of one place: consensus, conflicts, near copies of boxes, blanks, fusion of two engines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import fixed as X
from concord.functions import geometry as G
from concord.functions import text as T


def consensus(readings: DataFrame, place: Sequence[str], value: str, passes: str, confidence: str) -> DataFrame:
    """place, value, support, confidence, conflict: the best reading of each place.

    An option needs confidence or two passes; the best has most confidence plus 4 for each of up to three
    passes, ties by value. More than one surely read number at a place is a conflict. Missing confidence counts as 100.
    """
    c = F.coalesce(F.col(confidence), F.lit(100.0))
    options = readings.filter(c >= X.FLOOR_CONSENSUS).groupBy(*place, value).agg(F.count_distinct(passes).alias("support"), F.max(c).alias("confidence"))
    options = options.filter((F.col("confidence") >= X.FLOOR_USABLE) | (F.col("support") >= 2))
    score = F.col("confidence") + 4 * F.least(F.lit(3), F.col("support"))
    sure = F.when((F.col("confidence") >= X.FLOOR_NUMBER) & F.col(value).cast("string").rlike(r"\d"), F.col(value))
    best = options.groupBy(*place).agg(F.min(F.struct((-score).alias("s"), value, "support", "confidence")).alias("b"), (F.count_distinct(sure) > 1).alias("conflict"))
    return best.select(*place, f"b.{value}", "b.support", "b.confidence", "conflict")


def conflicts(readings: DataFrame, place: Sequence[str], value: str, confidence: Column | None = None) -> DataFrame:
    """Places with several credible different numbers: they stay ambiguous."""
    rows = readings if confidence is None else readings.filter(confidence >= X.FLOOR_NUMBER)
    return rows.groupBy(*place).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("least"), F.max(value).alias("most")).filter("n_values > 1")


def distinct_boxes(boxes: DataFrame, keys: Sequence[str], order: str, tolerance: float) -> DataFrame:
    """Boxes without those near an earlier one (each side within tolerance): cells of twice the tolerance are the join key, so only near ones meet."""
    cell = lambda c: F.floor(c / (2 * tolerance))
    base = boxes.withColumn("_gx", cell(F.col("x"))).withColumn("_gy", cell(F.col("y")))
    # what is near lies in the cell of x - tolerance or in that of x + tolerance, so too for y: four cells at most
    ends = lambda c: F.array_distinct(F.array(cell(F.col(c) - tolerance), cell(F.col(c) + tolerance)))
    both = F.flatten(F.transform(ends("x"), lambda x: F.transform(ends("y"), lambda y: F.struct(x.alias("_gx"), y.alias("_gy")))))
    spots = boxes.withColumn("_c", F.explode(both))
    early = spots.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(order).alias("_o"), "_c._gx", "_c._gy", *(F.col(v).alias(f"_{v}") for v in "xywh"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.abs(F.col(v) - F.col(f"_{v}")) < tolerance for v in "xywh"]
    on = (base._gx == early._gx) & (base._gy == early._gy) & (early._o < base[order])
    for c in same:
        on = on & c
    return base.join(early, on, "left_anti").drop("_gx", "_gy")


def within(words: DataFrame, label: Column, has_contour: bool = True) -> DataFrame:
    """Words of the label alone when it has a contour."""
    return words.filter(G.inside(F.col("box"), label)) if has_contour else words


def blanks(words: DataFrame, keys: Sequence[str], order: str, text: str, confidence: str) -> DataFrame:
    """Neighbours with nothing readable between them: for each readable word the next readable one and whether only unreadable marks lie between."""
    c = F.coalesce(F.col(confidence), F.lit(100.0))
    readable = (c >= X.FLOOR_BLANK) & F.col(text).rlike(r"[\p{L}\p{N}]")
    w = W.partitionBy(*keys).orderBy(order)
    rows = words.withColumn("_r", readable).withColumn("next_ix", F.first(F.when(F.col("_r"), F.col(order)), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))
    return rows.filter("_r AND next_ix IS NOT NULL").select(*keys, order, "next_ix", (F.col("next_ix") - F.col(order) - 1).alias("blank_between"))


def supersede(readings: DataFrame, place: Sequence[str], confidence: str, size: str, order: str) -> DataFrame:
    """At each place the surer reading stays, then the larger, then the first."""
    rest = [c for c in readings.columns if c not in place]
    best = readings.groupBy(*place).agg(F.min(F.struct((-F.col(confidence)).alias("_c"), (-F.col(size)).alias("_s"), F.col(order).alias("_o"), *(F.col(c).alias(c) for c in rest))).alias("b"))
    return best.select(*place, *(f"b.{c}" for c in rest))


def fuse(first: DataFrame, second: DataFrame, keys: Sequence[str], token_ix: str = "token_ix") -> DataFrame:
    """A second engine's outcome for each unsure token of the first, joined on key and place in the phrase.

    both: keys, token_ix, expected, kind, actual, confidence. resolved: the second reads the expected token with
    confidence 80; disputed: the first is sure of another token (75, or 50 for two numbers) yet the second has the
    expected one; contradicted: the second surely reads something else; open otherwise.
    """
    ours = first.select(*keys, token_ix, "expected", "kind", "actual", F.col("confidence").alias("c1"))
    theirs = second.select(*keys, token_ix, F.col("kind").alias("k2"), F.col("actual").alias("a2"), F.col("confidence").alias("c2"))
    rows = ours.join(theirs, [*keys, token_ix], "left")
    numbers = F.col("expected").rlike(r"\d") & F.coalesce(F.col("actual"), F.lit("")).rlike(r"\d")
    strong = (F.col("kind") == "replace") & ((F.col("c1") >= X.FLOOR_USABLE) | ((F.col("c1") >= 50) & numbers))
    seen = (F.col("k2") == "same") & (F.col("c2") >= X.FLOOR_SURE)
    outcome = F.when(F.col("kind") == "same", "same").when(seen & strong, "disputed").when(seen, "resolved").when((F.col("k2") == "replace") & (F.col("c2") >= X.FLOOR_SURE), "contradicted").otherwise("open")
    return rows.select(*keys, token_ix, outcome.alias("outcome"))


def whole_confirms(coverage: Column, sure_changes: Column, iou: Column) -> Column:
    """A second engine's exact phrase confirms the first's when that had nearly all, nothing surely different, at the same place."""
    return (coverage >= 90) & (sure_changes == 0) & (iou >= 0.5)
