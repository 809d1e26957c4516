"""Callouts and the rules their inscriptions belong to, by an inverted index before any edit distance.

What may link shares something whole: two letters of an inscription that the allowed slips cannot all have touched, or the stem of a word. Each
inscription is entered under its rarest such pieces alone, as many as slips could break and one more; so few pairs of a sheet are compared and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from concord.functions import text as T
from concord.sources.shared import kept

from . import align
from .callouts import TIE, level, needed, number_sure, telling

#: Fixed values of the method: weight of the letters alone, of shared words; words and their share that make a link; more for a whole text in a line; readings
#: that count as equally good; how square a sign is, and what its three letters look like.
LETTERS, WORDED, HITS, SHARE, MORE, ALIKE, SQUARE, SIGN = 0.95, 0.9, 2, 0.5, 0.05, 0.02, (0.7, 1.45), "еас"
_ON = ["sheet_id", "callout_ix", "v"]


def _key(text: Column) -> Column:
    return T.bare(F.translate(F.lower(text), "ё", "е"))


def _letters(key: Column) -> Column:
    return F.regexp_replace(key, r"\d", "")


def _pairs_of(key: Column) -> Column:
    """The two-letter pieces of a key, each once."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(key) - 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(2)))
    return F.when(F.char_length(key) >= 2, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _slips(length: Column) -> Column:
    """No link allows more."""
    return F.floor(0.3 * length + 1e-9).cast("int")


def _rarest(rows: DataFrame, on: list[str], key: Column, common: DataFrame) -> DataFrame:
    """on and piece: of each key the rarest pieces, two for each slip it may have and one more."""
    p = rows.select("sheet_id", *[c for c in on if c != "sheet_id"], (2 * _slips(F.char_length(key)) + 1).alias("_n"), F.explode(_pairs_of(key)).alias("piece"))
    p = p.join(common, ["sheet_id", "piece"], "left").withColumn("_k", F.row_number().over(W.partitionBy(*on).orderBy(F.coalesce("df", F.lit(0)), "piece")))
    return p.filter(F.col("_k") <= F.col("_n")).select(*on, "piece")


def variants(callouts: DataFrame) -> DataFrame:
    """sheet_id, callout_ix, v, text, key, letters, line of each reading of an inscription, surest first."""
    rows = callouts.filter(F.col("kind").isNotNull() & (F.col("kind") != "unreadable")).select("sheet_id", "callout_ix", F.posexplode("texts").alias("i", "t"))
    rows = rows.select("sheet_id", "callout_ix", "i", "t.text", "t.confidence", _key(F.col("t.text")).alias("key")).filter(F.char_length("key") >= 2)
    rows = rows.withColumn("v", F.row_number().over(W.partitionBy("sheet_id", "callout_ix").orderBy(F.desc("confidence"), "i")))
    return rows.select(*_ON, "text", "key", _letters(F.col("key")).alias("letters"), telling(F.col("text")).alias("line"))


def candidates(read: DataFrame, rules: DataFrame) -> DataFrame:
    """sheet_id, callout_ix, v, rule_id of the pairs that share a piece or a stem. rules: sheet_id, rule_id, key, letters, words."""
    rid = ["sheet_id", "rule_id"]
    piece = lambda rows, on, c: rows.select(*on, F.explode(_pairs_of(F.col(c))).alias("piece"))
    of_rules = {c: piece(rules, rid, c) for c in ("key", "letters")}
    df = {c: x.groupBy("sheet_id", "piece").agg(F.count("*").alias("df")) for c, x in of_rules.items()}
    parts = [_rarest(read, _ON, F.col(c), df[c]).join(of_rules[c], ["sheet_id", "piece"]) for c in ("key", "letters")]
    lines = piece(read, _ON, "key")
    parts.append(_rarest(rules, rid, F.col("key"), lines.groupBy("sheet_id", "piece").agg(F.count("*").alias("df"))).join(lines, ["sheet_id", "piece"]))
    # words of one form have equal first or last three letters, folded
    stem = lambda t: F.array(F.concat(F.lit("<"), F.substring(T.fold(t), 1, 3)), F.concat(F.lit(">"), F.right(T.fold(t), F.lit(3))))
    stems = lambda rows, on, c: rows.select(*on, F.explode(F.array_distinct(F.flatten(F.transform(c, stem)))).alias("stem"))
    parts.append(stems(read, _ON, "line").join(stems(rules, rid, "words"), ["sheet_id", "stem"]))
    out = parts[0].select(*_ON, "rule_id")
    for p in parts[1:]:
        out = out.unionByName(p.select(*_ON, "rule_id"))
    return out.distinct()


def _compared(pairs: DataFrame) -> DataFrame:
    """pairs with how much of line_key stands in key, of line_letters in letters, and of key in line_key."""
    names = pairs.columns
    of = [(names.index(a), names.index(b)) for a, b in (("line_key", "key"), ("line_letters", "letters"), ("key", "line_key"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for i, j in of:
                texts = zip(b.column(i).to_pylist(), b.column(j).to_pylist())
                made.append(pa.array([1 - align.distance_inside(list(x), list(y)) / len(x) if x and y else 0.0 for x, y in texts], pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*names, "_keys", "_letters", "_whole"])

    schema = pairs.schema
    for c in ("_keys", "_letters", "_whole"):
        schema = StructType([*schema.fields, StructField(c, DoubleType())])
    return pairs.mapInArrow(run, schema)


def scored(read: DataFrame, rules: DataFrame) -> DataFrame:
    """sheet_id, callout_ix, v, rule_id, share, whole of every link of a reading: a piece of a rule's text, or half of the line's weight in two telling words or more; or a
    rule's whole short text inside a longer line. A word weighs the less the more rules of the sheet hold it."""
    r = rules.select("sheet_id", "rule_id", telling(F.col("expected")).alias("words"), _key(F.col("expected")).alias("key")).filter("key <> ''").withColumn("letters", _letters(F.col("key")))
    r = kept(r, "rules")
    # two or three bare figures occur in any long text
    c = read.filter((F.char_length("key") >= 3) & ~F.col("key").rlike(r"^\d{1,4}$"))
    df = r.select("sheet_id", "rule_id", F.explode(F.array_distinct(F.transform("words", T.fold))).alias("t")).groupBy("sheet_id", "t").agg(F.count("*").alias("df"))
    tokens = c.select(*_ON, F.posexplode("line").alias("k", "token")).withColumn("t", T.fold(F.col("token"))).join(df, ["sheet_id", "t"], "left")
    weighed = tokens.groupBy(*_ON).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "token", (1 / F.coalesce("df", F.lit(1))).alias("w")))), lambda x: F.struct(x["token"], x["w"])).alias("weighed"))
    p = candidates(c, r).join(c.select(*_ON, F.col("key").alias("line_key"), F.col("letters").alias("line_letters")), _ON).join(r, ["sheet_id", "rule_id"]).join(weighed, _ON, "left")
    p = _compared(p)
    weighed_ = F.coalesce("weighed", F.array().cast("array<struct<token:string,w:double>>"))
    hit = F.filter(weighed_, lambda x: F.exists("words", lambda w: T.alike(x["token"], w)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["w"])
    p = p.withColumns({
        "part": F.greatest("_keys", F.when(F.char_length("line_letters") >= 5, F.col("_letters") * LETTERS).otherwise(0.0)),
        "hits": F.size(hit), "worded": F.when(F.size(weighed_) > 0, total(hit) / total(weighed_)).otherwise(0.0),
    })
    by_words = (F.col("worded") >= SHARE) & (F.col("hits") >= HITS)
    inside = (F.col("part") >= needed(F.char_length("line_key"))) | by_words
    short = (F.char_length("key") >= 4) & (F.char_length("key") < F.char_length("line_key"))
    p = p.withColumn("inside", inside).withColumn("whole", F.when(~F.col("inside") & short, F.col("_whole")).otherwise(0.0))
    p = p.withColumn("share", F.when(F.col("inside"), F.greatest("part", F.when(by_words, F.col("worded") * WORDED).otherwise(0.0))).otherwise(0.0))
    w = W.partitionBy(*_ON).orderBy(F.desc("inside"), F.desc("share"), "rule_id")
    p = p.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead(F.when(F.col("inside"), F.col("share"))).over(w))
    # a line belongs to one rule; a near tie is left to a person
    first = F.col("inside") & (F.col("rank") == 1) & (F.col("next").isNull() | (F.col("share") - F.col("next") >= TIE))
    return p.filter(first | (~F.col("inside") & (F.col("whole") >= needed(F.char_length("key")) + MORE))).select(*_ON, "rule_id", "share", F.when(F.col("inside"), 0.0).otherwise(F.col("whole")).alias("whole"))


def linked(callouts: DataFrame, rules: DataFrame) -> DataFrame:
    """sheet_id, callout_ix, rule_id, how (text, percent, format or sign), share, whole, shown, level of each link.

    callouts: sheet_id, callout_ix, kind, values, texts (struct<text, confidence> of each reading of the inscription), aspect and via of what the
    callout points at (null without), confidence, marks_agree, reads. rules: sheet_id, rule_id, expected, percent and sign (it has such sizes), formats (pairs of sides it allows).

    The readings are tried surest first: one that links better takes over, of equally good ones the longer. Without a text a share of the area goes to the sheet's only
    rule about shares, a width and height to the only rule that allows them, a size at a square mark, or one read as the sign, to the only rule with a sign.
    """
    # read by several joins each
    read = kept(variants(callouts), "variants")
    found = kept(scored(read.join(callouts.filter("kind <> 'percent'").select("sheet_id", "callout_ix"), ["sheet_id", "callout_ix"], "left_semi"), rules), "links")
    one = F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("s"), "rule_id", "whole")))
    of = found.groupBy(*_ON).agg(F.count("*").cast("int").alias("n"), one.alias("l")).select(*_ON, "n", F.get("l", F.lit(0))["rule_id"].alias("first"), (F.get("l", F.lit(0))["whole"] - F.get("l", F.lit(0))["s"]).alias("score"))
    tried = read.select(*_ON, "text", F.char_length("key").alias("long")).join(of, _ON, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    item = F.struct("v", "n", "first", "score", "long", "text")
    sets = tried.groupBy("sheet_id", "callout_ix").agg(F.sort_array(F.collect_list(item)).alias("tried"))

    def step(best: Column, x: Column) -> Column:
        near = F.abs(x["score"] - best["score"]) <= ALIKE
        better = (x["n"] > 0) & ((best["n"] == 0) | (x["score"] > best["score"] + ALIKE))
        fuller = (x["n"] > 0) & (best["n"] > 0) & x["first"].eqNullSafe(best["first"]) & near & (x["n"] >= best["n"]) & (x["long"] > best["long"])
        return F.when(F.coalesce(better | fuller, F.lit(False)), x).otherwise(best)

    sets = sets.withColumn("best", F.aggregate("tried", F.get("tried", F.lit(0)), step))
    same = F.filter("tried", lambda x: x["first"].eqNullSafe(F.col("best")["first"]) & (x["n"] > 0))
    longest = F.array_max(F.transform(same, lambda x: F.struct(x["long"].alias("long"), (-x["v"]).alias("v"), x["text"].alias("text"))))
    sets = sets.withColumn("shown", F.coalesce(F.when(F.col("best.n") > 0, longest["text"]), F.get("tried", F.lit(0))["text"]))
    by_text = sets.filter("best.n > 0").select("sheet_id", "callout_ix", F.col("best.v").alias("v"), "shown").join(found, _ON).select("sheet_id", "callout_ix", "rule_id", F.lit("text").alias("how"), "share", "whole", "shown")

    c = callouts.join(sets.select("sheet_id", "callout_ix", "shown", F.transform("tried", lambda x: _key(x["text"])).alias("keys"), (F.col("best.n") > 0).alias("texted")), ["sheet_id", "callout_ix"], "left")
    c = c.filter(F.col("kind").isNotNull() & (F.col("kind") != "unreadable") & ~F.coalesce("texted", F.lit(False))).withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    only = lambda rows, on: rows.groupBy(*on).agg(F.count("*").alias("_n"), F.min("rule_id").alias("rule_id")).filter("_n = 1").drop("_n")
    at = ["sheet_id", "callout_ix"]
    give = lambda rows, how, share: rows.select(*at, "rule_id", F.lit(how).alias("how"), share.alias("share"), F.lit(0.0).alias("whole"), F.coalesce("shown", F.lit("")).alias("shown"))
    zero = F.lit(0.0)
    shares = give(c.filter("kind = 'percent'").join(only(rules.filter("percent"), ["sheet_id"]), "sheet_id"), "percent", zero)
    near = lambda a, b: F.abs(a - b) < 0.051
    sides = lambda f, i, j: near(f[0], F.get("values", F.lit(i))) & near(f[1], F.get("values", F.lit(j)))
    boxes = c.filter("kind = 'box'").select(*at, "values", "shown").join(rules.select("sheet_id", "rule_id", "formats"), "sheet_id").filter(F.exists("formats", lambda f: sides(f, 0, 1) | sides(f, 1, 0)))
    formats = give(only(boxes, at).join(c.select(*at, "shown"), at), "format", zero)
    letters = lambda k: F.size(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: F.substring(k, i, F.lit(1)) == F.substring(F.lit(SIGN), i, F.lit(1))))
    named = F.exists("keys", lambda k: (F.char_length(k) == 3) & (letters(k) >= 2))
    square = F.col("aspect").between(*SQUARE) & (2 * F.size(F.filter("keys", lambda k: F.char_length(k) <= 4)) >= F.size("keys"))
    marks = c.filter(F.col("kind").isin("height", "box") & F.col("aspect").isNotNull()).join(formats.select(*at), at, "left_anti").withColumn("named", named).filter(F.col("named") | square)
    signs = give(marks.join(only(rules.filter("sign"), ["sheet_id"]), "sheet_id"), "sign", F.when(F.col("named"), 0.67).otherwise(0.5))
    every = by_text.unionByName(shares).unionByName(formats).unionByName(signs)
    # how far the links can be trusted, apart from how sure the number is
    textual = F.max(F.when(F.col("how").isin("percent", "format"), 0.5).otherwise(F.greatest("share", "whole"))).over(W.partitionBy(*at))
    semantic = F.max(F.col("how") != "text").over(W.partitionBy(*at))
    rows = every.withColumns({"_t": textual, "_s": semantic}).join(callouts.select(*at, "via", "confidence", "marks_agree", "reads"), at)
    return rows.select(*at, "rule_id", "how", "share", "whole", "shown", level(number_sure(F.col("confidence"), F.col("marks_agree"), F.col("reads")), F.col("_s"), F.col("via"), F.col("_t")).alias("level"))
