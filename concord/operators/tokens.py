"""Words in order: layout, frames, grams, islands and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from concord.functions import text as T


def word_rows(df: DataFrame, key: str, text: str, per_line: int = 12) -> DataFrame:
    """key, word_ix, word, line, col: words laid out in lines of per_line. One pass, no shuffle."""
    words = F.filter(F.split(F.col(text), r"[\t-\r ]+"), lambda w: w != "")
    rows = df.select(key, F.posexplode(words).alias("word_ix", "word"))
    return rows.withColumn("line", F.floor(F.col("word_ix") / per_line).cast("int")).withColumn("col", (F.col("word_ix") % per_line).cast("int"))


def line_texts(words: DataFrame, key: str) -> DataFrame:
    """key, line, n_words, line_text in order of column."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "word"))), lambda x: x["word"]), " ")
    return words.groupBy(key, "line").agg(F.count("*").alias("n_words"), joined.alias("line_text"))


def text_lines(df: DataFrame, key: str, text: str, per_line: int = 12) -> DataFrame:
    """line_texts of word_rows, with lines cut in the row: a line is shuffled whole, once, and only to meet other texts of its key."""
    words = F.filter(F.split(F.col(text), r"[\t-\r ]+"), lambda w: w != "")
    cut = lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / per_line).cast("int")), lambda k: F.array_join(F.slice(w, k * per_line + 1, F.lit(per_line)), " ")))
    rows = df.select(key, F.posexplode(T.let(words, cut)).alias("line", "_w")).groupBy(key, "line").agg(F.collect_list("_w").alias("_l"))
    # no word holds a space
    several = F.transform(F.sort_array(F.flatten(F.transform("_l", lambda s: F.transform(F.split(s, " "), lambda x, i: F.struct(i.alias("col"), x.alias("word")))))), lambda x: x["word"])
    text_ = F.when(F.size("_l") == 1, F.get("_l", F.lit(0))).otherwise(F.array_join(several, " "))
    return rows.select(key, "line", text_.alias("line_text")).select(key, "line", F.size(F.split("line_text", " ")).cast("long").alias("n_words"), "line_text")


def islands(words: DataFrame, keys: Sequence[str], order: str, starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a row where `starts` holds begins one (gaps and islands)."""
    w = W.partitionBy(*keys).orderBy(order)
    return words.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def neighbours(words: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order)
    return words.withColumn("before", F.lag(column).over(w)).withColumn("after", F.lead(column).over(w))


def known_neighbours(rows: DataFrame, keys: Sequence[str], order: str, value: Column) -> DataFrame:
    """The nearest non-null value before and after each row."""
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumn("last_known", F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("next_known", F.first(value, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))


def context(df: DataFrame, key: str, text: str, wanted: str, before: int = 3, after: int = 3) -> DataFrame:
    """key, word_ix, word and the words around each word that fits `wanted`: frames cut from the array, so nothing is sorted."""
    words = F.filter(F.split(F.col(text), r"[\t-\r ]+"), lambda w: w != "")
    rows = df.select(key, words.alias("w")).select(key, "w", F.posexplode("w").alias("word_ix", "word")).filter(F.col("word").rlike(wanted))
    start = F.greatest(F.lit(1), F.col("word_ix") + 1 - before)
    return rows.select(key, "word_ix", "word", F.array_join(F.slice("w", start, F.col("word_ix") + 2 + after - start), " ").alias("context"))


def grams(df: DataFrame, text: str, sizes: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """n, gram, count over all texts; counted before the shuffle."""
    made = lambda t: F.flatten(F.array(*(F.transform(T.gram_list(t, n), _sized(n)) for n in sizes)))
    return df.select(F.explode(T.let(T.phrase_tokens(F.col(text)), made)).alias("g")).groupBy("g.n", "g.gram").agg(F.count("*").alias("count"))


def _sized(n: int):
    return lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"))



def numbered(df: DataFrame, order: Sequence[str], buckets: int = 64) -> tuple[DataFrame, int]:
    """df with `ix`, each row's place from 0 in the given order, and the number of rows.

    Rows are dealt to ranges of the first column of order (where it is a number; else all are one range) and numbered in each,
    after the rows of the ranges below: no task sorts all rows. A null comes first.
    """
    first = F.col(order[0])
    n, cuts = df.count(), None
    if n and isinstance(df.schema[order[0]].dataType, NumericType):
        cuts = df.select(F.percentile_approx(first, [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < first)) if cuts else F.lit(0)
    rows = df.withColumn("_range", F.when(first.isNull(), -1).otherwise(at))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # `buckets` rows
    rows = rows.join(F.broadcast(before), "_range")
    return rows.withColumn("ix", F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1).drop("_range", "_before"), n


def spread(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """An evenly spread choice of `limit` rows in the given order: rows floor(i * n / limit) for i < limit, never a random sample."""
    rows, n = numbered(df, order)
    if n <= limit:
        return rows
    i = F.floor(((F.col("ix") + 1) * limit - 1) / n)  # the last i whose row is not beyond ix
    return rows.filter(F.floor(i * n / limit) == F.col("ix"))


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k best of each group with their rank; ties fall by the last, unique order column. Spark cuts groups to k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def first_seen(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Of equal rows the one of least order; a partial minimum, no window."""
    rest = [c for c in df.columns if c not in by and c != order]
    return df.groupBy(*by).agg(F.min(F.struct(order, *rest)).alias("_r")).select(*by, f"_r.{order}", *(f"_r.{c}" for c in rest))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side alone, with how often, as `missing` (left) and `new` (right)."""
    cols = left.columns
    both = left.withColumn("_d", F.lit(1)).unionByName(right.select(*cols).withColumn("_d", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("_d").alias("n")).filter("n <> 0").select(*cols, F.when(F.col("n") > 0, "missing").otherwise("new").alias("side"), F.abs("n").alias("times"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new takes the place of old rows with its keys; all others stay."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)
