"""Winnowed document fingerprints, in DataFrame functions only.

A unit is up to eight characters of a word with the white space after it, so that a text without
spaces still has many; a gram is k consecutive units. Of each window of w consecutive grams the one
of least hash is kept, the rightmost on ties; two texts that share w+k-1 whole units therefore share a
kept gram. Positions stay with the hashes. A text of fewer than k units is one gram, an empty one none.

While a window's minimum is sought a gram is one long: 32 hash bits above 31 bits that count down with the
position (an array has fewer elements than 2**31), so that the plain minimum is also the rightmost of equals.
A kept gram has its place and its whole 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import settle

GRAM, WINDOW = 4, 9
UNIT = r"\s*\S{1,8}\s*|\s+"
#: Rows that one bucket of neighbouring ids should hold, and the number of quantiles taken of the ids.
BUCKET_ROWS, QUANTILES = 256, 256
#: Bucket ends are broadcast up to this many; beyond it they are joined by a shuffle.
MAX_ENDS = 100_000
_POS = (1 << 31) - 1
#: Buckets of one doc_id that holds more than a quantile, by its texts' hashes; all other rows of a bucket come after these.
_TIES = 1024


def _let(value: Column, body) -> Column:
    """Evaluates value once per row for all uses in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def winnow(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """array<struct<at int, hash long>> of kept grams in order of position, which counts units from 1."""

    def ranked(u: Column, i: Column) -> Column:
        h = F.shiftrightunsigned(F.xxhash64(F.slice(u, i, k)), 32)
        return F.shiftleft(h, 31) + (F.lit(_POS).cast("long") - i.cast("long"))

    def grams(u: Column) -> Column:
        n = F.size(u)
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(k)) - (k - 1)), lambda i: ranked(u, i)))

    def least(h: Column) -> Column:
        n = F.size(h)
        return F.when(n <= w, F.when(n == 0, h).otherwise(F.array(F.array_min(h)))).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(w)) - (w - 1)), lambda i: F.array_min(F.slice(h, i, F.lit(w)))))
        )

    def whole(u: Column, x: Column) -> Column:
        at = (F.lit(_POS).cast("long") - x.bitwiseAND(F.lit(_POS).cast("long"))).cast("int")
        return F.struct(at.alias("at"), F.xxhash64(F.slice(u, at, k)).alias("hash"))

    return _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0)), lambda u: F.transform(_let(grams(u), least), lambda x: whole(u, x)))


def hashes(kept: Column) -> Column:
    return F.array_distinct(kept.getField("hash"))


def positions(kept: Column) -> Column:
    """Unit at which each kept gram begins, from 1."""
    return kept.getField("at")


def written(kept: Column) -> Column:
    """The fingerprint as text: hexadecimal position, colon, hexadecimal hash, by position."""
    return F.array_join(F.transform(kept, lambda x: F.concat(F.hex(x["at"].cast("long")), F.lit(":"), F.hex(x["hash"]))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two hash sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def _bucketed(docs: DataFrame) -> DataFrame:
    """docs with `_bucket`, numbers of neighbouring, ordered ranges of (doc_id, text hash) of about BUCKET_ROWS rows, and `_q`, the quantile they lie in."""
    n, cuts = docs.agg(F.count("*"), F.percentile_approx(F.coalesce("doc_id", F.lit(-(1 << 63))), [i / QUANTILES for i in range(QUANTILES + 1)], 4096)).first()
    cuts = cuts or [0]
    heavy = sorted({c for c, d in zip(cuts, cuts[1:]) if c == d})
    cuts = sorted(set(cuts))
    parts = max(1, -(-n // (BUCKET_ROWS * max(1, len(cuts) - 1))))
    at = F.array(*(F.lit(c).cast("long") for c in cuts))
    # a null id sorts below all
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    q = F.greatest(F.lit(1), F.size(F.filter(at, lambda c: c <= key)))
    lo, hi = F.element_at(at, q), F.element_at(at, F.least(q + 1, F.size(at)))
    wide = hi.cast("double") - lo.cast("double")
    part = F.when(wide > 0, F.floor((key.cast("double") - lo.cast("double")) * parts / wide)).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), part))
    # a quantile ends at such an id, so the id comes first in its bucket; split by its texts
    own = F.when(key.isin(heavy), F.shiftright("_tie", 54) + _TIES // 2).otherwise(F.lit(_TIES)) if heavy else F.lit(_TIES)
    return docs.withColumn("_q", q.cast("long")).withColumn("_bucket", ((q.cast("long") - 1) * parts + part) * (_TIES + 1) + own.cast("long"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, _bucket, _ghost and next_text: the text of the next row by descending doc_id; after the last, the first.

    Rows of equal doc_id follow each other by their text's hash; null ids come last. One shuffle of
    the texts: each bucket gets, as a ghost row, the first row of the bucket below it.
    """
    docs = _bucketed(docs.withColumn("_tie", F.xxhash64("text")))
    order = F.struct(F.col("doc_id").isNotNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.col("_tie").alias("c"))
    ends = settle(docs.groupBy("_q", "_bucket").agg(F.max(order).alias("_top")), "buckets")
    count, last = ends.agg(F.count("*"), F.min("_bucket")).first()
    # the first row of a bucket goes to the nearest bucket above; of the topmost, round to the lowest.
    # The quantile's own buckets are ordered in its task, the quantiles (QUANTILES at most) in one
    above = ends.groupBy("_q").agg(F.min("_bucket").alias("_low")).select("_q", F.lead("_low").over(W.orderBy("_q")).alias("_above"))
    to = ends.withColumn("_next", F.lead("_bucket").over(W.partitionBy("_q").orderBy("_bucket"))).join(F.broadcast(above), "_q")
    to = to.select(F.coalesce("_next", "_above", F.lit(last).cast("long")).alias("_to"), *(F.col(f"_top.{x}").alias(f"_{x}") for x in "abc"))
    small = F.broadcast(to) if count <= MAX_ENDS else to
    same = (F.col("doc_id").isNotNull() == F.col("_a")) & (F.coalesce("doc_id", F.lit(0)) == F.col("_b")) & (F.col("_tie") == F.col("_c"))
    # the topmost row follows the lowest: there it stands below all others
    ghosts = docs.join(small, same).select("doc_id", "text", F.col("_to").alias("_bucket"), "_tie", F.lit(True).alias("_ghost"), F.when(F.col("_bucket") > F.col("_to"), F.lit(0)).when(F.col("_bucket") == F.col("_to"), F.lit(0)).otherwise(F.lit(1)).alias("_rank"))
    every = docs.select("doc_id", "text", "_bucket", "_tie", F.lit(False).alias("_ghost"), F.lit(2).alias("_rank")).unionByName(ghosts)
    return every.withColumn("next_text", F.lead("text").over(_down()))


def _down():
    return W.partitionBy("_bucket").orderBy(F.desc("_rank"), F.desc_nulls_last("doc_id"), F.desc("_tie"))


def compare_with_next(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The last third of the text's code points gives way to as many first ones of the next document
    by descending doc_id. Null text counts as empty; repeated rows are compared one with the other;
    other columns are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = with_next(docs).withColumn("next_text", F.coalesce("next_text", "text"))
    rows = rows.select("doc_id", "_bucket", "_rank", "_tie", "_ghost", n.cast("long").alias("n_chars"), "text", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)).alias("edited"))
    rows = rows.select("doc_id", "_bucket", "_rank", "_tie", "_ghost", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), winnow(F.col("text"), k, w).alias("f"), F.when(F.col("_ghost"), F.array().cast("array<struct<at:int,hash:bigint>>")).otherwise(winnow(F.col("edited"), k, w)).alias("e"))
    rows = rows.withColumn("_next", F.lead("f").over(_down())).filter(~F.col("_ghost"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("f")).alias("fingerprint"), written(F.col("e")).alias("edited_fingerprint"),
        likeness(hashes(F.col("f")), hashes(F.col("e"))).alias("near_edited"), likeness(hashes(F.col("f")), hashes(F.coalesce("_next", "f"))).alias("near_next"),
    )
