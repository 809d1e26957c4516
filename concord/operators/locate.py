"""Where required texts stand in readings: exact, by fragments, by sections, by alignment, by words.

Readings are scanned, never crossed with texts and never shuffled whole (see search). Stages run cheapest first, and what is
located leaves before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import text as T
from concord.sources.shared import kept

from . import align, search
from .tokens import top


def prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, raw, tokens: each text taken apart once."""
    return df.select(F.col(key).alias("id"), F.col(text).alias("raw"), T.phrase_tokens(F.col(text)).alias("tokens"))


def chosen(readings: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, raw, tokens of the readings that pairs name. The rows are chosen before they are taken apart: behind it all readings would be taken apart again."""
    named = pairs.select(F.col("reading_id").alias("id")).distinct()
    return prepared(readings.select("id", "raw").join(named, "id", "left_semi"), "id", "raw")


def candidates(rules: DataFrame, readings: DataFrame, k: int = 10) -> DataFrame:
    """rule_id, reading_id, overlap, rank: the k readings that hold most of a rule's distinct tokens, two (or all) at least."""
    return search.ranked(rules, readings, k)


def contiguous(rules: DataFrame, readings: DataFrame) -> DataFrame:
    """rule_id, reading_id of each reading that holds the rule's tokens in one run."""
    return search.runs(rules, readings)


def parts_of(rules: DataFrame) -> DataFrame:
    """id (rule_id, part) and tokens of each fragment of the rules that have fragments."""
    parts = rules.select(F.col("id").alias("rule_id"), F.posexplode(T.fragments(F.col("raw"))).alias("part", "raw"))
    return parts.select(F.struct("rule_id", "part").alias("id"), T.phrase_tokens(F.col("raw")).alias("tokens"))


def all_parts(parts: DataFrame, found: DataFrame) -> DataFrame:
    """rule_id, reading_id, n_fragments where every part of a rule was found; found: rule_id (rule_id, part), reading_id."""
    count = parts.groupBy(F.col("id.rule_id").alias("rule_id")).agg(F.count("*").alias("n_fragments"))
    hits = found.select(F.col("rule_id.rule_id").alias("rule_id"), "reading_id").groupBy("rule_id", "reading_id").agg(F.count("*").alias("n"))
    return hits.join(count, "rule_id").filter("n = n_fragments").select("rule_id", "reading_id", "n_fragments")


def by_fragments(rules: DataFrame, readings: DataFrame) -> DataFrame:
    """rule_id, reading_id, n_fragments where every fragment of a rule stands in the reading."""
    parts = parts_of(rules)
    return all_parts(parts, contiguous(parts, readings))


def compared(rules: DataFrame, readings: DataFrame, pairs: DataFrame) -> DataFrame:
    """rule_id, reading_id, status, coverage, missing of each pair; either side is taken apart once, before the join."""
    parts = lambda c: (T.compact(T.dehyphenate(c)), T.words(c))
    e, want = parts(F.col("raw"))
    left = rules.select(F.col("id").alias("rule_id"), e.alias("e"), want.alias("want"))
    a, read = parts(F.col("raw"))
    right = chosen(readings, pairs).select(F.col("id").alias("reading_id"), a.alias("a"), read.alias("read"))
    # few rows of much work: dealt over all cores, whichever small side the joins broadcast
    rows = pairs.join(left, "rule_id").join(right, "reading_id").repartition(pairs.sparkSession.sparkContext.defaultParallelism, "rule_id", "reading_id")
    return rows.select("rule_id", "reading_id", T.compare_tokens(F.col("e"), F.col("a"), F.col("want"), F.col("read")).alias("c")).select("rule_id", "reading_id", "c.status", "c.coverage", "c.missing")


def _aligned(rules: DataFrame, readings: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """rule_id, reading_id, coverage, n_same, quality of pairs whose best alignment has quality `least`. No more can be read than what
    the reading holds, with or without its spaces: pairs that hold too little are not aligned."""
    want = rules.select(F.col("id").alias("rule_id"), F.col("tokens").alias("want"))
    rows = pairs.select("rule_id", "reading_id").join(want, "rule_id").join(chosen(readings, pairs).select(F.col("id").alias("reading_id"), F.col("tokens").alias("read")), "reading_id")
    held = T.let(F.array_join("read", ""), lambda x: F.size(F.filter("want", lambda t: F.contains(x, t))))
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "rule_id", "reading_id")
    # each token not read is a step that is not same
    rows = rows.filter(F.size("want") - held <= (1 - least) * F.size("want") + 1e-9)
    return align.aligned(rows, ["rule_id", "reading_id"], "want", "read").filter(F.col("quality") >= least).select("rule_id", "reading_id", "coverage", "n_same", "quality")


def by_sections(rules: DataFrame, readings: DataFrame, k: int = 10, least: int = 55, near: DataFrame | None = None) -> DataFrame:
    """rule_id, reading_id, coverage where every fragment of a rule is aligned in the reading (quality .5) with a coverage of `least`; coverage
    weighed by the fragments' tokens. near: the fragments' candidates, if they are known."""
    parts = parts_of(rules)
    found = _aligned(parts, readings, candidates(parts, readings, k) if near is None else near, 0.5).filter(F.col("coverage") >= least)
    sizes = parts.select(F.col("id").alias("rule_id"), F.size("tokens").alias("n"))
    count = parts.groupBy(F.col("id.rule_id").alias("rule_id")).agg(F.count("*").alias("parts"))
    sums = found.join(sizes, "rule_id").groupBy(F.col("rule_id.rule_id").alias("rule_id"), "reading_id").agg(F.count("*").alias("found"), F.floor(F.sum(F.col("coverage") * F.col("n")) / F.sum("n") + 0.5).cast("int").alias("coverage"))
    return sums.join(count, "rule_id").filter("found = parts").select("rule_id", "reading_id", "coverage")


def staged(rules: DataFrame, readings: DataFrame, k: int = 10) -> DataFrame:
    """rule_id, method, reading_id, coverage: the best place of each rule by the first method that finds one, with null for none.

    exact, then fragments, then sections (each fragment aligned by itself), then layout (the best alignment of quality .5: most
    tokens read, then quality, then the candidates' order), then words (most coverage, 50 at least).
    """
    # one scan for all runs, of rules and of their fragments; one more for the candidates of what is left
    whole = lambda rows: rows.select(F.struct(F.col("id").alias("rule_id"), F.lit(-1).alias("part")).alias("id"), "tokens")
    runs = kept(contiguous(whole(rules).unionByName(parts_of(rules)), readings), "runs")
    of = lambda method, rows: rows.select("rule_id", F.lit(method).alias("method"), "reading_id", "coverage")
    sure = lambda rows: rows.groupBy("rule_id").agg(F.min("reading_id").alias("reading_id")).withColumn("coverage", F.lit(100))
    without = lambda rows, done: rows.join(done, rows.id == done.rule_id, "left_anti")
    exact = kept(of("exact", sure(runs.filter("rule_id.part = -1").select("rule_id.rule_id", "reading_id"))), "exact")
    left = without(rules, exact)
    parts = kept(of("fragments", sure(all_parts(parts_of(left), runs.filter("rule_id.part >= 0")))), "fragments")
    left = without(left, parts)
    every = kept(candidates(whole(left).unionByName(parts_of(left)), readings, k), "candidates")
    sections = kept(of("sections", top(by_sections(left, readings, k, near=every.filter("rule_id.part >= 0")), ["rule_id"], [F.desc("coverage"), F.asc("reading_id")], 1)), "sections")
    left = without(left, sections)
    near = every.filter("rule_id.part = -1").select(F.col("rule_id.rule_id").alias("rule_id"), "reading_id", "overlap", "rank").join(left, F.col("rule_id") == left.id, "left_semi")
    fit = _aligned(left, readings, near, 0.5).join(near.select("rule_id", "reading_id", F.col("rank").alias("_k")), ["rule_id", "reading_id"])
    layout = kept(of("layout", top(fit, ["rule_id"], [F.desc("n_same"), F.desc("quality"), F.asc("_k")], 1)), "layout")
    near = near.join(layout.select("rule_id"), "rule_id", "left_anti")
    scored = compared(left, readings, near).filter("coverage >= 50")
    words = of("words", top(scored, ["rule_id"], [F.desc("coverage"), F.asc("reading_id")], 1))
    placed = exact.unionByName(parts).unionByName(sections).unionByName(layout).unionByName(words)
    return rules.select(F.col("id").alias("rule_id")).join(placed, "rule_id", "left")


def weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """token, df, weight (1/df) over the distinct folded tokens of each text."""
    rows = df.select(F.explode(F.array_distinct(F.transform(T.words(F.col(text)), T.fold))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("df")).withColumn("weight", 1 / F.col("df"))
