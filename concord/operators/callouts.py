"""Callouts: statements of size on a sheet, linked to the rules they speak for and checked against what was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import fixed as X
from concord.functions import quantity as Q
from concord.functions import text as T

STOP = "для при это или его она также только всех согласно менее более шрифта высота минимальная указания должна надпись".split()
TIE = 0.08


def telling(text: Column) -> Column:
    """Tokens that tell an inscription: those with digits, and words of three letters or more that are no stop words."""
    return F.filter(T.words(text), lambda t: t.rlike(r"\d") | ((F.char_length(t) > 2) & ~t.isin(*STOP)))


def needed(length: Column) -> Column:
    return F.when(length <= 5, 1.0).when(length <= 10, 0.8).otherwise(0.7)


def number_sure(confidence: Column, marks_agree: Column, reads: Column) -> Column:
    return F.when(marks_agree.eqNullSafe(False), F.lit(False)).otherwise((confidence >= F.when(F.coalesce(marks_agree, F.lit(False)), 70).otherwise(80)) | (F.coalesce(marks_agree, F.lit(False)) & (reads >= 2) & (confidence >= 30)))


def level(sure: Column, semantic: Column, via: Column, textual: Column) -> Column:
    """How far the link of a number to a rule can be trusted: high, medium or low."""
    pointer = via.isin("gauge", "leader")
    return F.when(~sure, "low").when(semantic, "medium").when(pointer & (textual >= 0.75), "high").when(pointer & (textual >= 0.5), "medium").when(~pointer & via.isNotNull() & (textual >= 0.6), "medium").otherwise("low")


def link(callouts: DataFrame, rules: DataFrame) -> DataFrame:
    """sheet_id, callout_ix, rule_id, share, whole, via_text: rules that a callout's inscription belongs to.

    callouts: sheet_id, callout_ix, kind, texts (readings of the inscription). rules: sheet_id, rule_id, expected,
    has_percent. They meet by sheet only. A piece of a rule's text, or half of the line's weight in two or more telling
    words, links; two rules within TIE of each other link neither; a rule's whole short text inside a longer
    line links beside them; a share of the area goes to the sheet's only such rule.
    """
    r = rules.select("sheet_id", "rule_id", "has_percent", telling(F.col("expected")).alias("words"), T.bare(F.translate(F.lower("expected"), "ё", "е")).alias("key"))
    df = r.select("sheet_id", F.explode(F.array_distinct(F.transform("words", T.fold))).alias("t")).groupBy("sheet_id", "t").agg(F.count("*").alias("df"))
    weight = df.groupBy("sheet_id").agg(F.map_from_entries(F.collect_list(F.struct("t", 1 / F.col("df")))).alias("weights"))
    c = callouts.filter(F.col("kind").isNotNull() & ~F.col("kind").isin("unreadable", "percent")).select("sheet_id", "callout_ix", F.explode("texts").alias("text"))
    c = c.select("sheet_id", "callout_ix", "text", telling(F.col("text")).alias("line"), T.bare(F.translate(F.lower("text"), "ё", "е")).alias("line_key")).filter((F.char_length("line_key") >= 3) & ~F.col("line_key").rlike(r"^\d{1,4}$"))
    p = c.join(r, "sheet_id").join(weight, "sheet_id").filter("key <> ''")
    chars = lambda k: F.split(k, "")
    letters = lambda k: F.regexp_replace(k, r"\d", "")
    similar = lambda a, b: T.inside_similarity(chars(a), chars(b))
    part = F.greatest(similar(F.col("line_key"), F.col("key")), F.when(F.char_length(letters(F.col("line_key"))) >= 5, similar(letters(F.col("line_key")), letters(F.col("key"))) * 0.95).otherwise(0.0))
    of = lambda t: F.coalesce(F.try_element_at("weights", T.fold(t)), F.lit(1.0))
    total = lambda ts: F.aggregate(F.transform(ts, of), F.lit(0.0), lambda s, x: s + x)
    hit = F.filter("line", lambda t: F.exists("words", lambda w: T.alike(t, w)))
    p = p.withColumn("part", part).withColumn("hits", F.size(hit)).withColumn("worded_share", F.when(F.size("line") > 0, total(hit) / total(F.col("line"))).otherwise(0.0))
    worded = (F.col("worded_share") >= 0.5) & (F.col("hits") >= 2)
    inside = (F.col("part") >= needed(F.char_length("line_key"))) | worded
    whole = F.when(~inside & (F.char_length("key") >= 4) & (F.char_length("key") < F.char_length("line_key")), similar(F.col("key"), F.col("line_key"))).otherwise(0.0)
    p = p.withColumn("inside", inside).withColumn("share", F.when(inside, F.greatest("part", F.when(worded, F.col("worded_share") * 0.9).otherwise(0.0))).otherwise(0.0)).withColumn("whole", whole)
    w = W.partitionBy("sheet_id", "callout_ix", "text").orderBy(F.desc("share"), "rule_id")
    p = p.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead(F.when(F.col("inside"), F.col("share"))).over(w))
    best = (F.col("rank") == 1) & F.col("inside") & (F.col("second").isNull() | (F.col("share") - F.col("second") >= TIE - 1e-12))
    within = F.col("whole") >= needed(F.char_length("key")) + 0.05
    found = p.filter(best | within).groupBy("sheet_id", "callout_ix", "rule_id").agg(F.max("share").alias("share"), F.max("whole").alias("whole"), F.max_by("text", F.char_length("line_key")).alias("via_text"))
    area = r.filter("has_percent").groupBy("sheet_id").agg(F.count("*").alias("n"), F.min("rule_id").alias("rule_id")).filter("n = 1").select("sheet_id", "rule_id")
    shares = callouts.filter("kind = 'percent'").select("sheet_id", "callout_ix").join(area, "sheet_id").select("sheet_id", "callout_ix", "rule_id", F.lit(0.0).alias("share"), F.lit(0.0).alias("whole"), F.lit(None).cast("string").alias("via_text"))
    return found.unionByName(shares)


def confirmed(links: DataFrame, matches: DataFrame) -> DataFrame:
    """links with the measured value of their rule and whether it agrees with the stated one: within .25, a fifth, or three raster steps."""
    rows = links.join(matches.select("sheet_id", "rule_id", "measured", "step", "ratio"), ["sheet_id", "rule_id"], "left")
    slack = F.greatest(F.lit(0.25), F.lit(0.2) * F.col("value"), 3 * F.coalesce("step", F.lit(0.0)))
    return rows.withColumn("agrees", F.when(F.col("measured").isNotNull(), F.abs(F.col("measured") - F.col("value")) <= slack)).withColumn("scope", F.when(F.col("ratio").between(0.7, 1.4), "section").otherwise("line"))


def best_reading(attempts: DataFrame) -> DataFrame:
    """Of several readings of one callout the best, with how many agree: a plausible claim whose marks agree with the ink ranks
    before one without, both before an unreadable one; then confidence, then order. attempts: sheet_id, callout_ix, attempt, raw, confidence, separators."""
    rows = attempts.withColumn("claim", Q.parse_claim(F.col("raw")))
    kind = F.col("claim.kind")
    agrees = F.when(F.col("separators").isNotNull() & kind.isin("box", "height"), Q.claim_marks(F.col("claim")) == F.col("separators"))
    rows = rows.withColumn("marks_agree", agrees)
    rank = F.when(kind.isNull(), 0).when(kind == "unreadable", 1).when(F.coalesce("marks_agree", F.lit(False)), 3).otherwise(2)
    value = F.concat_ws("|", kind, F.col("claim.value").cast("string"), F.array_join(F.transform("claim.values", lambda v: v.cast("string")), "x"))
    best = rows.withColumn("said", value).groupBy("sheet_id", "callout_ix").agg(
        F.min(F.struct((-(rank * 1000 + F.col("confidence"))).alias("s"), "attempt", "raw", "confidence", "marks_agree", "said")).alias("b"), F.collect_list("said").alias("all")
    )
    return best.select("sheet_id", "callout_ix", F.col("b.raw").alias("raw"), F.col("b.confidence").alias("confidence"), F.col("b.marks_agree").alias("marks_agree"), F.size(F.filter("all", lambda s: s == F.col("b.said"))).alias("reads"))


def separators(glyphs: Column, size: Column) -> Column:
    """Specks of ink no larger than .42 of the callout's letters on both axes: the decimal marks."""
    return F.size(F.filter(glyphs, lambda g: (g["w"] <= size * 0.42) & (g["h"] <= size * 0.42)))


def declared_size(lines: DataFrame) -> DataFrame:
    """sheet_id and sides of the label from its sheet: the pair of sizes nearest to the right of, or below, a caption. lines: sheet_id, line_ix, text, box."""
    pair = F.array(*(Q.number(F.nullif(F.regexp_extract("text", X.SIDES, i), F.lit(""))) for i in (1, 2)))
    v = lines.withColumn("pair", pair).filter(F.forall("pair", lambda n: n.between(8, 600)))
    c = lines.filter(F.col("text").rlike("(?iu)размер") & F.col("text").rlike("(?iu)этикетк|продукци|издели"))
    j = c.select("sheet_id", F.col("line_ix").alias("ci"), F.col("box").alias("c")).join(v.select("sheet_id", F.col("line_ix").alias("vi"), F.col("box").alias("v"), "pair"), "sheet_id")
    same = F.col("ci") == F.col("vi")
    right = (F.col("v.x") >= F.col("c.x") + F.col("c.w") - 0.01) & (F.abs(F.col("v.y") + F.col("v.h") / 2 - F.col("c.y") - F.col("c.h") / 2) < F.greatest("c.h", "v.h") * 1.2)
    low = F.col("v.y") - F.col("c.y") - F.col("c.h")
    below = (low >= -0.004) & (low < 0.06) & (F.col("v.x") < F.col("c.x") + F.col("c.w")) & (F.col("v.x") + F.col("v.w") > F.col("c.x") - 0.02)
    d = F.when(same, 0.0).when(right, F.col("v.x") - F.col("c.x") - F.col("c.w")).when(below, 0.2 + low)
    return j.withColumn("d", d).filter("d < 0.35").groupBy("sheet_id").agg(F.min(F.struct("d", "ci", "vi", "pair"))["pair"].alias("sides"))
