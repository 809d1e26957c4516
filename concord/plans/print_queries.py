"""Queries over print: lines and columns from boxes, marks of differences, one-to-one pairs by place."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import geometry as G
from concord.operators import diff, linking, pairing, sweep, tokens

from .registry import query, table

_WORDS = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\t-\\r ]+'), lambda x: x <> '') AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w)"
#: Twelve words a line on an uneven baseline, of uneven height; every third line has a gap before its seventh word.
_PRINT = f"""{_WORDS}, p AS (SELECT doc_id, i, word, (i % 12) * 8e-2 + (i * 7 % 5) * 2e-3 + CASE WHEN (i // 12) % 3 = 0 AND i % 12 >= 6 THEN 15e-2 ELSE 0e0 END AS x,
    (i // 12) * 6e-2 + (i * 13 % 7) * 1e-3 AS y, least(7e-2, length(word) * 6e-3) AS w, 25e-3 + (i * 11 % 5) * 1e-3 AS h FROM u)"""


def _print(spark, sf_dir, dealt: bool = False):
    """dealt: texts go to partitions by page before they are taken apart, so that no word is shuffled."""
    i = F.col("word_ix").cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if dealt:
        docs = docs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), "doc_id")
    rows = tokens.word_rows(docs, "doc_id", "text")
    x = (i % 12) * 0.08 + (i * 7 % 5) * 0.002 + F.when((F.floor(i / 12) % 3 == 0) & (i % 12 >= 6), 0.15).otherwise(0.0)
    return rows.select("doc_id", "word_ix", "word", G.box(x, F.floor(i / 12) * 0.06 + (i * 13 % 7) * 0.001, F.least(F.lit(0.07), F.char_length("word") * 0.006), 0.025 + (i * 11 % 5) * 0.001).alias("box"))


@query(
    f"""WITH {_PRINT},
b AS (SELECT *, max(y + h) OVER (PARTITION BY doc_id ORDER BY y, x, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM p),
l AS (SELECT *, sum(CASE WHEN low >= y THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY y, x, i) - 1 AS line_no FROM b),
m AS (SELECT doc_id, line_no, (list_sort(list(h)))[len(list(h)) // 2 + 1] AS height FROM l GROUP BY ALL),
g AS (SELECT l.*, height, x - lag(x + w) OVER (PARTITION BY doc_id, line_no ORDER BY x, y, i) > 35e-1 * height AS far FROM l JOIN m USING (doc_id, line_no)),
f AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY x, y, i) AS fragment FROM g)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(fragment AS BIGINT) AS fragment, count(*) AS n_words, min(height) AS height, string_agg(word, ' ' ORDER BY x, y, i) AS text FROM f GROUP BY doc_id, line_no, fragment"""
)
def reading_lines(spark, sf_dir):
    """Lines of uneven print by common height, cut where the gap is wide. The SQL says it by intervals: on this print each height overlaps its own line alone."""
    return sweep.printed(_print(spark, sf_dir, True), ["doc_id"], dealt=True).select("doc_id", "line_no", "fragment", "n_words", "height", "text")


@query()
def reading_columns(spark, sf_dir):
    """The columns that pieces of print chain to; against a plain version in the tests."""
    return sweep.candidates(_print(spark, sf_dir, True), ["doc_id"], dealt=True).select("doc_id", "column_no", "line_count", "n_words", "text")


_TRACED = """
p AS (SELECT o_custkey AS k, list(o_orderkey % 13 ORDER BY o_orderkey) AS a, list(CAST(floor(o_totalprice) AS BIGINT) % 13 ORDER BY o_orderkey) AS b FROM orders GROUP BY o_custkey),
t(k, i, r) AS (SELECT k, len(a), list_transform(range(0, len(b) + 1), lambda x: CAST(0 AS BIGINT)) FROM p
  UNION ALL SELECT p.k, t.i - 1, list_reverse(list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, len(b) + 1), lambda j: [CAST(len(b) + 1 - j AS BIGINT)])),
    lambda c, j: list_append(c, CASE WHEN b[j[1]] = a[t.i] THEN r[j[1] + 1] + 1 ELSE greatest(r[j[1]], c[len(c)]) END))) FROM t JOIN p USING (k) WHERE t.i > 0),
s AS (SELECT k, list(r ORDER BY i) AS s FROM t GROUP BY k),
w(k, i, j, l, r) AS (SELECT k, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', '' FROM p
  UNION ALL SELECT p.k, CASE WHEN a[i + 1] = b[j + 1] OR s[i + 2][j + 1] >= s[i + 1][j + 2] THEN i + 1 ELSE i END, CASE WHEN a[i + 1] = b[j + 1] OR s[i + 2][j + 1] < s[i + 1][j + 2] THEN j + 1 ELSE j END,
    l || CASE WHEN a[i + 1] = b[j + 1] THEN '=' WHEN s[i + 2][j + 1] >= s[i + 1][j + 2] THEN '-' ELSE '' END, r || CASE WHEN a[i + 1] = b[j + 1] THEN '=' WHEN s[i + 2][j + 1] >= s[i + 1][j + 2] THEN '' ELSE '-' END
  FROM w JOIN p USING (k) JOIN s USING (k) WHERE i < len(a) AND j < len(b))
"""


@query(f"WITH RECURSIVE {_TRACED} SELECT k AS o_custkey, l || repeat('-', len(a) - i) AS left_marks, r || repeat('-', len(b) - j) AS right_marks FROM w JOIN p USING (k) WHERE i = len(a) OR j = len(b)")
def token_marks(spark, sf_dir):
    """Of two sequences the members that the other lacks, marked by the trace from the front."""
    seq = lambda v: F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", (v % 13).cast("string").alias("v")))), lambda x: x["v"])
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(seq(F.col("o_orderkey")).alias("a"), seq(F.floor("o_totalprice")).alias("b"))
    text = lambda c: F.array_join(F.transform(c, lambda same: F.when(same, "=").otherwise("-")), "")
    return diff.marks(rows, "a", "b").select("o_custkey", text("left_same").alias("left_marks"), text("right_same").alias("right_marks"))


_NEAR = f"""{_PRINT}, q AS (SELECT *, i // 12 AS row, regexp_matches(word, '[0-9]') AS d FROM p),
o AS (SELECT a.doc_id, a.i AS a, b.i AS b, greatest(0, b.x - a.x - a.w, a.x - b.x - b.w) + greatest(0, b.y - a.y - a.h, a.y - b.y - b.h) AS gap
      FROM q a JOIN q b ON a.doc_id = b.doc_id AND b.row BETWEEN a.row - 1 AND a.row + 1 WHERE a.d AND NOT b.d),
g AS (SELECT doc_id, list_transform(list({{a: a, b: b}} ORDER BY gap, a, b), lambda x: {{a: [x.a], b: [x.b]}}) AS o FROM o GROUP BY doc_id),
r AS (SELECT doc_id, list_reduce(o, lambda s, x: CASE WHEN list_contains(s.a, x.a[1]) OR list_contains(s.b, x.b[1]) THEN s ELSE {{a: list_append(s.a, x.a[1]), b: list_append(s.b, x.b[1])}} END) AS s FROM g)
"""


@query(f"WITH {_NEAR} SELECT doc_id, CAST(unnest(s.a) AS INTEGER) AS number_ix, CAST(unnest(s.b) AS INTEGER) AS word_ix FROM r")
def nearest_pairs(spark, sf_dir):
    """Each number on a page and the word it stands beside, each word once, nearest first; candidates stand on its row or the next ones."""
    rows = _print(spark, sf_dir).withColumn("row", F.floor(F.col("word_ix") / 12)).withColumn("d", F.col("word").rlike("[0-9]"))
    a = rows.filter("d").select("doc_id", F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)).alias("row"), F.col("word_ix").alias("number_ix"), F.col("box").alias("p"))
    b = rows.filter("NOT d").select("doc_id", "row", "word_ix", F.col("box").alias("q"))
    apart = lambda s, e: F.greatest(F.lit(0.0), F.col(f"q.{s}") - F.col(f"p.{s}") - F.col(f"p.{e}"), F.col(f"p.{s}") - F.col(f"q.{s}") - F.col(f"q.{e}"))
    options = a.join(b, ["doc_id", "row"]).select("doc_id", "number_ix", "word_ix", (apart("x", "w") + apart("y", "h")).alias("gap"))
    return pairing.one_to_one(options, ["doc_id", "number_ix"], ["doc_id", "word_ix"], ["gap", "doc_id", "number_ix", "word_ix"]).select("doc_id", "number_ix", "word_ix")


@query()
def callout_links(spark, sf_dir):
    """Callouts of made-up sheets of required texts, each read three ways, and the texts their inscriptions belong to; against a plain version in the tests."""
    i, t = F.col("item_id"), F.col("text")
    rows = table(spark, sf_dir, "benchmark").select((i % 8).alias("sheet_id"), "item_id", "text")
    flag = lambda m, k: F.coalesce(i % m == k, F.lit(False))
    sides = F.array((20.0 + i % 50).cast("double"), (40.0 + i % 30).cast("double"))
    rules = rows.select("sheet_id", i.alias("rule_id"), t.alias("expected"), flag(16, 3).alias("percent"), flag(12, 5).alias("sign"), F.when(i % 3 == 0, F.array(sides)).otherwise(F.array().cast("array<array<double>>")).alias("formats"))
    words = F.filter(F.split(t, r"[\t-\r ]+"), lambda w: w != "")
    cut = lambda n, k: F.array_join(F.slice(words, 2 + i.cast("int") % 5, n), " ") if k is None else F.regexp_replace(F.array_join(F.slice(words, 2 + i.cast("int") % 5, n), " "), k, "о")
    kind = F.when(i % 9 == 0, "percent").when(i % 9 == 1, "box").when(i % 9 == 2, "unreadable").otherwise("height")
    texts = [(F.when(i % 4 == 1, "").otherwise(cut(4, None)), 90.0), (cut(6, "[aeu]"), 80.0), (F.when(i % 5 == 0, "еас").otherwise(cut(2, None)), 70.0)]
    reads = F.array(*(F.struct(x.alias("text"), F.lit(c).alias("confidence")) for x, c in texts))
    callouts = rows.select(
        "sheet_id", i.alias("callout_ix"), kind.alias("kind"), sides.alias("values"), reads.alias("texts"), F.when(i % 7 > 0, 0.4 + i % 7 * 0.3).alias("aspect"), F.when(i % 7 > 2, "gauge").when(i % 7 > 0, "beside").alias("via"),
        (60.0 + i % 40).alias("confidence"), F.when(i % 3 == 0, True).when(i % 3 == 1, False).alias("marks_agree"), (i % 4).alias("reads"),
    )
    return linking.linked(callouts, rules).select("sheet_id", F.col("callout_ix").alias("item_id"), F.col("rule_id").alias("linked_item"), "how", F.round("share", 6).alias("share"), F.round("whole", 6).alias("whole"), "shown", "level")
