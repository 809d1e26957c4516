"""The simple local method: one overview reading of each candidate region, the best of them judged; no lines cut, no sizes measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators import places
from concord.sources.shared import kept

from . import assess


def run_local(rules: DataFrame, words: DataFrame, volume: str = "0,7", **more) -> DataFrame:
    """assess() of each sheet on the words of its best region and turn: the sum of coverage over its rules decides, upright first.

    words: sheet_id, region_ix, turn (how the region was turned to be read), word_ix, pass, text, confidence, box and the like. Text of a layer or a bar
    code stands beside: words without region belong to all.
    """
    own = words.filter("region_ix IS NOT NULL")
    each = own.select(F.concat_ws("|", "sheet_id", "region_ix", "turn").alias("id"), "sheet_id", "region_ix", "turn").distinct()
    read = own.withColumn("sheet_id", F.concat_ws("|", "sheet_id", "region_ix", "turn"))
    asked = rules.join(each, "sheet_id").withColumn("sheet_id", F.col("id")).drop("id", "region_ix", "turn")
    asked = assess.expected_texts(asked, volume)
    placed = kept(assess.placed(read), "overview")
    found = assess.located(asked, kept(assess.pass_readings(placed), "overview-readings"), placed)
    scores = each.join(found.groupBy(F.col("sheet_id").alias("id")).agg(F.sum("coverage").alias("score")), "id", "left")
    best = places.best_orientation(scores.select("sheet_id", "region_ix", F.col("turn").alias("rotation"), F.coalesce("score", F.lit(0)).alias("score")))
    b = best.select("sheet_id", F.col("region_ix").alias("_r"), F.col("rotation").alias("_t"), "has_contour")
    rows = words.join(b, "sheet_id").filter(F.col("region_ix").isNull() | ~F.col("has_contour") | ((F.col("region_ix") == F.col("_r")) & (F.col("turn") == F.col("_t"))))
    return assess.assess(rules, rows.drop("_r", "_t", "has_contour", "region_ix", "turn"), volume=volume, **more)
