"""Heights, declared sizes, area shares and evidence of quantities: grouped aggregates over readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import fixed as X
from concord.functions import geometry as G


def typical_height(heights: DataFrame, keys: Sequence[str], word: str, height: str, confidence: Column | None = None, least: int = 2) -> DataFrame:
    """keys, n_words, typical: per word the upper median of its letters (at least `least`), then the smallest of these,
    past up to max(1, 5 %) leading values that are broken: below .6 of the next one, with five words or more."""
    sure = heights if confidence is None else heights.filter(F.coalesce(confidence, F.lit(0)) >= X.FLOOR_SURE)
    words = sure.groupBy(*keys, word).agg(F.collect_list(height).alias("h")).filter(F.size("h") >= least).select(*keys, G.upper_median(F.col("h")).alias("m"))
    sets = words.groupBy(*keys).agg(F.sort_array(F.collect_list("m")).alias("m"))
    n = F.size("m")
    allowed = F.when(n >= 5, F.greatest(F.lit(1), F.floor(n * 0.05).cast("int"))).otherwise(0)
    skip = F.aggregate(F.sequence(F.lit(0), F.greatest(allowed - 1, F.lit(0))), F.lit(0), lambda s, i: F.when((s == i) & (i < allowed) & (F.get("m", i) < 0.6 * F.get("m", i + 1)), s + 1).otherwise(s))
    return sets.select(*keys, n.cast("long").alias("n_words"), F.get("m", skip).alias("typical"))


def least_glyph(heights: DataFrame, keys: Sequence[str], text: str, height: str, confidence: str) -> DataFrame:
    """Smallest surely read digit and smallest letter of each group."""
    sure = (F.coalesce(F.col(confidence), F.lit(0)) >= X.FLOOR_SURE) & (F.col(height) > 0)
    return heights.groupBy(*keys).agg(F.min(F.when(sure & F.col(text).rlike(r"\d"), F.col(height))).alias("digit_height"), F.min(F.when(sure & F.col(text).rlike(r"\p{L}"), F.col(height))).alias("letter_height"))


def declared_least(declared: DataFrame, keys: Sequence[str], value: str, level: str, scope: str, order: str) -> DataFrame:
    """keys, declared, level, n: the smallest usable statement decides; usable is not low and about a section; the level is high only if all usable are."""
    usable = (F.col(level) != "low") & (F.col(scope) == "section")
    return declared.groupBy(*keys).agg(
        F.min(F.when(usable, F.struct(value, order)))[value].alias("declared"),
        F.when(F.count_if(usable) == 0, F.lit(None)).when(F.bool_and(F.when(usable, F.col(level) == "high")), "high").otherwise("medium").alias("level"),
        F.count("*").alias("n"),
    )


def filled(measured: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Measured values stay; only missing ones are taken from statements."""
    rows = measured.join(declared, list(keys), "left")
    return rows.select(*keys, F.coalesce("measured", "declared").alias("value"), F.when(F.col("measured").isNotNull(), "measured").when(F.col("declared").isNotNull(), "declared").alias("origin"))


def area_share(words: DataFrame, keys: Sequence[str], x: str, y: str, w: str, h: str, label_area: Column) -> DataFrame:
    """Per cent of the label that the bounding box of a group's words takes."""
    box = words.groupBy(*keys).agg(((F.max(F.col(x) + F.col(w)) - F.min(x)) * (F.max(F.col(y) + F.col(h)) - F.min(y))).alias("a"), F.max(label_area).alias("l"))
    return box.select(*keys, F.when(F.col("l") > 0, F.col("a") / F.col("l") * 100).alias("share"))


def stated_share(inscription: Column, threshold: Column, percent: Column, measured: Column, label: Column) -> Column:
    """Shares from a stated formula: base = threshold / (percent / 100); stated and mixed share, what is left out of the base, and whether stated and measured area agree within 10 %."""
    base = threshold / (percent / 100)
    near = F.abs(inscription - measured) <= 0.1 * F.greatest(inscription, measured)
    return F.struct(base.alias("base"), (inscription / base * 100).alias("stated"), (measured / base * 100).alias("mixed"), (measured / label * 100).alias("measured"), (label - base).alias("excluded"), near.alias("agrees"))


def quantity_evidence(found: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """keys, kind, base_value, unit, conflict of the best amount: anchored ones if there are any, then by trust, then by order.
    Several credible different amounts are a conflict: nothing expected ever decides between them."""
    w = W.partitionBy(*keys)
    pool = found.withColumn("_any", F.max(F.col("anchored").cast("int")).over(w)).filter((F.col("_any") == 0) | F.col("anchored"))
    credible = F.when(F.col("score") >= X.FLOOR_NUMBER, F.struct("kind", "base_value", "unit"))
    return pool.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), order, "kind", "base_value", "unit")).alias("b"), (F.size(F.collect_set(credible)) > 1).alias("conflict")).select(*keys, "b.kind", "b.base_value", "b.unit", "conflict")


def trust(confidence: Column, support: Column) -> Column:
    """A weak reading repeated alike by three passes is taken as read."""
    return F.greatest(F.coalesce(confidence, F.lit(0)), F.when(support >= 3, 76).otherwise(0))


def raster_step(page: Column, coarser: Column, scale: Column, detail: Column) -> Column:
    """Size of a source pixel in mm: never finer than the source, however far it was enlarged."""
    return F.when(coarser.isNotNull(), page * F.greatest(F.lit(1.0), coarser)).otherwise(page / F.least(scale, detail))


def borderline(value: Column, least: Column, step: Column) -> Column:
    return F.coalesce((step > 0) & (F.abs(value - least) <= 2 * step), F.lit(False))


def symbols_measured(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pixel_step, symbols: the coarsest raster step of surely read words with measured letters, and how many letters these have.

    words: confidence, source_step, step, heights (array).
    """
    sure = words.filter((F.coalesce("confidence", F.lit(0.0)) >= X.FLOOR_SURE) & F.exists("heights", lambda h: h.isNotNull()))
    step = F.greatest(F.coalesce("source_step", F.lit(0.0)), F.coalesce("step", F.lit(0.0)))
    return sure.groupBy(*keys).agg(F.max(F.when(step > 0, step)).alias("pixel_step"), F.sum(F.size(F.filter("heights", lambda h: h.isNotNull()))).alias("symbols"))


def peaks(samples: DataFrame, keys: Sequence[str], kind: str, value: str) -> DataFrame:
    """keys, peak_total and peak of each kind of process: the largest sum at one moment, and the largest value of each kind. samples: keys, at, kind, value."""
    moments = samples.groupBy(*keys, "at").agg(F.sum(value).alias("_t")).groupBy(*keys).agg(F.max("_t").alias("peak_total"))
    by = samples.groupBy(*keys, "at", kind).agg(F.sum(value).alias("_v")).groupBy(*keys, kind).agg(F.max("_v").alias("peak"))
    return by.join(moments, list(keys))


def grid(rows: DataFrame, settings: Sequence[str], counts: Sequence[tuple[str, str, str]], ms: str) -> DataFrame:
    """settings, a rate in per cent for each (name, errors, total), and the mean time of a sheet in whole milliseconds."""
    sums = [(n, F.sum(e), F.sum(t)) for n, e, t in counts]
    return rows.groupBy(*settings).agg(*(F.when(t > 0, F.floor(e / t * 1000 + 0.5) / 10).alias(n) for n, e, t in sums), F.floor(F.avg(ms) + 0.5).cast("long").alias("mean_ms"))


def detector_scales(width: Column, height: Column) -> Column:
    """Scales at which an image is searched for lines: its own size beyond 2,400 pixels, else 1,000 and 2,000 pixels, between .5 and 3."""
    long = F.greatest(width, height)
    one = lambda target: F.floor(F.greatest(F.lit(0.5), F.least(F.lit(3.0), target / long)) * 100 + 0.5) / 100
    return F.when(long > 2400, F.array(F.lit(1.0))).otherwise(F.array_distinct(F.array(one(1000.0), one(2000.0))))
