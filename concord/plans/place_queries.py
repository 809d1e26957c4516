"""Registered queries over readings and areas by place, each with SQL from its definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import geometry as G
from concord.functions import text as T
from concord.operators import layout, lines, marks, places, tokens
from concord.sources import engines
from concord.sources import readings as sources

from . import sql as S
from .registry import query, table

# ---- words of the benchmark laid out in three passes -------------------------------------------------

_LAID = f"""
w AS (SELECT item_id AS s, list_filter(regexp_split_to_array(text, '[\\t-\\r ]+'), lambda x: x <> '') AS ws FROM benchmark),
u AS (SELECT s, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS ix FROM w),
one AS (SELECT s, ix, {S.tokens('word')}[1] AS v FROM u WHERE regexp_matches(word, '^(\\p{{L}}+|[0-9]+)$')),
r AS (SELECT s, ix, p, CASE WHEN p = 2 AND ix % 3 = 0 THEN v || 'x' WHEN p = 1 AND ix % 5 = 0 AND regexp_matches(v, '^[0-9]') THEN v || '7' ELSE v END AS v, 50.0 + (ix * 7 + p * 13) % 50 AS c FROM one, range(3) t(p))
"""


def _laid(spark, sf_dir):
    """Each single-token word read in three passes, some otherwise, a little apart."""
    w = tokens.word_rows(table(spark, sf_dir, "benchmark"), "item_id", "text").filter(F.col("word").rlike(r"^(\p{L}+|[0-9]+)$"))
    w = w.select(F.col("item_id").alias("sheet_id"), F.col("word_ix").alias("ix"), F.get(T.phrase_tokens(F.col("word")), F.lit(0)).alias("v"), "line", "col", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("p"))
    v, p, i = F.col("v"), F.col("p"), F.col("ix")
    value = F.when((p == 2) & (i % 3 == 0), F.concat(v, F.lit("x"))).when((p == 1) & (i % 5 == 0) & v.rlike("^[0-9]"), F.concat(v, F.lit("7"))).otherwise(v)
    box = G.box(F.col("col") * 0.08 + p * 0.001, F.col("line") * 0.03 + p * 0.0005, F.lit(0.05), F.lit(0.02))
    return w.select("sheet_id", (i * 3 + p).alias("word_ix"), F.lit(0).alias("rotation"), value.alias("value"), F.concat(F.lit("p"), p.cast("string")).alias("pass"), (50.0 + (i * 7 + p * 13) % 50).alias("confidence"), box.alias("box"))


_AGREED = f"""{_LAID},
o AS (SELECT s, ix, v, count(DISTINCT p) AS support, max(c) AS c FROM r GROUP BY ALL HAVING max(c) >= 75 OR count(DISTINCT p) >= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY s, ix ORDER BY c + 4 * least(3, support) DESC, v) AS k, count(DISTINCT CASE WHEN c >= 85 AND regexp_matches(v, '[0-9]') THEN v END) OVER (PARTITION BY s, ix) > 1 AS conflict FROM o)"""


@query(f"WITH {_AGREED} SELECT s AS item_id, CAST(ix AS INTEGER) AS place, v AS value, support, c AS confidence, conflict FROM b WHERE k = 1")
def placed_consensus(spark, sf_dir):
    """The best reading of each place, found by overlapping boxes alone."""
    rows = places.consensus(_laid(spark, sf_dir))
    place = F.round(F.col("box.y") / 0.03).cast("int") * 12 + F.floor((F.col("box.x") + 0.0005) / 0.08).cast("int")
    return rows.select(F.col("sheet_id").alias("item_id"), place.alias("place"), "value", "support", "confidence", "conflict")


@query(f"WITH {_AGREED} SELECT s AS item_id, count(*) FILTER (conflict AND regexp_matches(r.v, '^[0-9]')) AS uncertain, count(*) AS n FROM r JOIN (SELECT DISTINCT s, ix, conflict FROM b WHERE k = 1) USING (s, ix) GROUP BY s")
def conflict_places(spark, sf_dir):
    """Numbers read where several surely read numbers contradict each other."""
    words = _laid(spark, sf_dir)
    bad = places.consensus(words).filter("conflict").select("sheet_id", "box")
    kept = words.join(places.consensus(words).select("sheet_id", "box").withColumnRenamed("sheet_id", "_s").withColumnRenamed("box", "_b"), (F.col("sheet_id") == F.col("_s")) & G.same_place(F.col("box"), F.col("_b")), "left_semi")
    rows = places.unsettled(kept.withColumnRenamed("word_ix", "token_ix"), bad)
    return rows.groupBy(F.col("sheet_id").alias("item_id")).agg(F.count_if("uncertain").alias("uncertain"), F.count("*").alias("n"))


@query(
    f"""WITH w AS (SELECT item_id, {S.tokens('text')} AS t FROM benchmark), p AS (SELECT item_id, t, p FROM w, range(3) x(p)),
q AS (SELECT item_id, p, list_transform(range(1, len(t) + 1), lambda i: CASE WHEN p = 1 AND i % 6 = 0 THEN t[i] || 'x' ELSE t[i] END) AS t, list_transform(range(1, len(t) + 1), lambda i: 60.0 + (i * 7 + p * 11) % 40) AS c FROM p),
r AS (SELECT item_id, unnest(range(0, 12, 4)) AS k, t FROM w), g AS (SELECT item_id, k, t[k + 1:k + 3] AS g FROM r WHERE len(t) >= k + 3),
h AS (SELECT g.item_id, k, q.p, unnest(range(1, len(q.t) - 1)) AS i, g.g, q.t, q.c FROM g JOIN q USING (item_id)),
s AS (SELECT item_id, k, p, i, (c[i] + c[i + 1] + c[i + 2]) / 3 + CASE WHEN i + 1 < 12 THEN 200 ELSE 0 END + CASE WHEN p = 2 THEN 0 ELSE 0.1 END AS score FROM h WHERE t[i] = g[1] AND t[i + 1] = g[2] AND t[i + 2] = g[3]),
z AS (SELECT *, row_number() OVER (PARTITION BY item_id, k ORDER BY round(score, 6) DESC, CASE p WHEN 2 THEN 'consensus' ELSE 'p' || p END, i) AS n FROM s)
SELECT item_id, CAST(k AS INTEGER) AS rule, CASE p WHEN 2 THEN 'consensus' ELSE 'p' || p END AS pass, CAST(i - 1 AS INTEGER) AS from_ix, round(score, 6) AS score FROM z WHERE n = 1"""
)
def exact_places(spark, sf_dir):
    """Three-word phrases found by place: surest, inside the label, plain reading before consensus."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sheet_id"), T.phrase_tokens(F.col("text")).alias("t"))
    e = b.select("sheet_id", F.posexplode("t").alias("ix", "v")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("p"))
    i, p = F.col("ix") + 1, F.col("p")
    name = F.when(p == 2, "consensus").otherwise(F.concat(F.lit("p"), p.cast("string")))
    box = G.box(F.col("ix") * 0.08, 0.1, 0.07, 0.02)
    reads = e.select("sheet_id", name.alias("pass"), "ix", F.when((p == 1) & (i % 6 == 0), F.concat("v", F.lit("x"))).otherwise(F.col("v")).alias("value"), (60.0 + (i * 7 + p * 11) % 40).alias("confidence"), box.alias("box"))
    rules = b.select("sheet_id", "t", F.explode(F.array(F.lit(0), F.lit(4), F.lit(8))).alias("rule_id")).filter(F.size("t") >= F.col("rule_id") + 3).select("sheet_id", "rule_id", F.slice("t", F.col("rule_id") + 1, F.lit(3)).alias("tokens"))
    # the label ends after twelve words
    out = places.exact_places(rules, reads, G.box(0.0, 0.0, 0.96, 0.5))
    return out.select(F.col("sheet_id").alias("item_id"), F.col("rule_id").alias("rule"), "pass", "from_ix", F.round("score", 6).alias("score"))


# ---- boxes of lineitem -------------------------------------------------------------------------------

_ONE = "o AS (SELECT l_orderkey AS s, l_linenumber AS i, min(l_partkey) AS p, min(l_suppkey) AS q, CAST(min(l_discount) AS DOUBLE) AS d, CAST(min(l_tax) AS DOUBLE) AS t, CAST(min(l_quantity) AS DOUBLE) AS n FROM lineitem GROUP BY ALL)"


def _one(spark, sf_dir):
    d = lambda c: F.min(c).cast("double")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("i")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("q"), d("l_discount").alias("d"), d("l_tax").alias("t"), d("l_quantity").alias("n"))


def _share(a: str, b: str) -> str:
    lap = lambda k, n: f"greatest(0, least({a}.{k} + {a}.{n}, {b}.{k} + {b}.{n}) - greatest({a}.{k}, {b}.{k}))"
    return f"({lap('x', 'w')} * {lap('y', 'h')})"


@query(
    f"""WITH {_ONE}, b AS (SELECT s, i, p % 3 * 90 AS r, p % 101 AS c, d * 4 AS x, t * 4 AS y, n / 200 AS w, 0.1 AS h FROM o)
SELECT s AS l_orderkey, i AS l_linenumber FROM b WHERE NOT EXISTS (SELECT 1 FROM b a WHERE a.s = b.s AND a.r <> b.r AND {_share('a', 'b')} > 0.5 * least(a.w * a.h, b.w * b.h) AND (a.c > b.c OR (a.c = b.c AND (a.w * a.h > b.w * b.h OR (a.w * a.h = b.w * b.h AND a.i < b.i)))))"""
)
def one_direction(spark, sf_dir):
    """Words without those under a surer one that reads in another direction."""
    o = _one(spark, sf_dir)
    rows = o.select(F.col("s").alias("sheet_id"), F.col("i").alias("word_ix"), (F.col("p") % 3 * 90).alias("rotation"), (F.col("p") % 101).alias("confidence"), G.box(F.col("d") * 4, F.col("t") * 4, F.col("n") / 200, 0.1).alias("box"))
    return places.one_direction(rows).select(F.col("sheet_id").alias("l_orderkey"), F.col("word_ix").alias("l_linenumber"))


@query(
    f"""WITH {_ONE}, b AS (SELECT s, i, p % 2 AS pass, p % 3 * 90 AS r, 40 + p % 60 AS c, CASE q % 3 WHEN 0 THEN 'Слово' WHEN 1 THEN 'слово!' ELSE 'иное' END AS t, d * 4 AS x, t * 4 AS y, n / 200 AS w, 0.1 AS h FROM o),
m AS (SELECT *, CASE WHEN t = 'иное' THEN t ELSE 'слово' END AS said FROM b),
k AS (SELECT * FROM m b WHERE c >= 80 AND EXISTS (SELECT 1 FROM m a WHERE a.s = b.s AND a.said = b.said AND a.r = b.r AND a.pass <> b.pass AND a.c >= 50 AND least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) > 0.5 * least(a.w, b.w) AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > 0.5 * least(a.h, b.h)))
SELECT a.s AS l_orderkey, a.i AS area_ix, k.i AS word_ix, k.t AS text FROM m a JOIN k ON a.s = k.s AND a.r <> k.r AND {_share('a', 'k')} > 0"""
)
def across_words(spark, sf_dir):
    """Words of another direction over each area, read alike by two passes."""
    o = _one(spark, sf_dir)
    q = F.col("q") % 3
    rows = o.select(F.col("s").alias("sheet_id"), F.col("i").alias("word_ix"), (F.col("p") % 2).alias("pass"), (F.col("p") % 3 * 90).alias("rotation"), (40 + F.col("p") % 60).alias("confidence"), F.when(q == 0, "Слово").when(q == 1, "слово!").otherwise("иное").alias("text"), G.box(F.col("d") * 4, F.col("t") * 4, F.col("n") / 200, 0.1).alias("box"))
    found = places.across(rows.withColumnRenamed("word_ix", "area_ix"), rows)
    return found.select(F.col("sheet_id").alias("l_orderkey"), "area_ix", "word_ix", "text")


@query(
    f"""WITH {_ONE}, f AS (SELECT s, i, n * 2 AS w, n + d * 100 AS h, CASE WHEN s % 4 > 0 THEN max(n * 2) OVER (PARTITION BY s) END AS long, CASE WHEN s % 4 > 0 THEN arg_max(n + d * 100, [n, -i]) OVER (PARTITION BY s) END AS short FROM o),
g AS (SELECT *, coalesce(abs(greatest(w, h) - long) <= long * 0.03 AND abs(least(w, h) - short) <= short * 0.03, false) AS fits FROM f)
SELECT s AS l_orderkey, i AS frame_ix FROM g QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY s)"""
)
def fitting_frames(spark, sf_dir):
    """Frames of the size a sheet states, or all where none is."""
    from pyspark.sql import Window as W

    o, w = _one(spark, sf_dir), W.partitionBy("s")
    stated = F.col("s") % 4 > 0
    n, h = F.col("n") * 2, F.col("n") + F.col("d") * 100
    frames = o.select(F.col("s").alias("sheet_id"), F.col("i").alias("frame_ix"), n.alias("width"), h.alias("height"), F.when(stated, F.max(n).over(w)).alias("long"), F.when(stated, F.max_by(h, F.struct("n", -F.col("i"))).over(w)).alias("short"))
    return places.fitting_frames(frames).select(F.col("sheet_id").alias("l_orderkey"), "frame_ix")


@query(
    f"""WITH {_ONE}, c AS (SELECT s, (i - 1) // 2 AS g, CASE (i - 1) % 2 WHEN 0 THEN 0 ELSE 90 * (1 + p % 3) END AS r, CASE WHEN i % 2 = 1 AND s % 3 > 0 THEN 0 WHEN s % 7 = 0 THEN 0 ELSE CAST(n AS BIGINT) % 20 END AS v FROM o),
u AS (SELECT s, g, r, v FROM c WHERE r = 0 QUALIFY row_number() OVER (PARTITION BY s ORDER BY v DESC, g) = 1), f AS (SELECT s, g, r, v FROM c WHERE r <> 0 AND v > 0 QUALIFY row_number() OVER (PARTITION BY s, g ORDER BY r) = 1),
t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY s ORDER BY v DESC, g) = 1), k AS (SELECT DISTINCT s FROM c)
SELECT k.s AS l_orderkey, CASE WHEN u.v > 0 THEN u.g ELSE t.g END AS region_ix, CAST(CASE WHEN u.v > 0 THEN 0 ELSE coalesce(t.r, 0) END AS INTEGER) AS rotation, CASE WHEN u.v > 0 THEN u.v ELSE coalesce(t.v, 0) END AS score, coalesce(u.v > 0, false) OR t.s IS NOT NULL AS has_contour FROM k LEFT JOIN u ON k.s = u.s LEFT JOIN t ON k.s = t.s"""
)
def best_orientation(spark, sf_dir):
    """The region of a sheet that reads best, upright or turned."""
    o = _one(spark, sf_dir)
    i, s = F.col("i"), F.col("s")
    score = F.when((i % 2 == 1) & (s % 3 > 0), 0).when(s % 7 == 0, 0).otherwise(F.col("n").cast("long") % 20)
    rows = o.select(s.alias("sheet_id"), F.floor((i - 1) / 2).alias("region_ix"), F.when((i - 1) % 2 == 0, 0).otherwise(90 * (1 + F.col("p") % 3)).cast("int").alias("rotation"), score.alias("score"))
    return places.best_orientation(rows).withColumnRenamed("sheet_id", "l_orderkey")


_CAPTIONS = f"""{_ONE}, c AS (SELECT s, i, CASE p % 4 WHEN 0 THEN 'Объём' WHEN 1 THEN 'масса нетто' WHEN 2 THEN 'г' ELSE 'текст' END AS t, 60 + q % 40 AS c, d * 5 AS x, t * 5 AS y, 0.1 AS w, 0.02 AS h FROM o),
a AS (SELECT s, 2 * i + k AS ix, CASE k WHEN 0 THEN x - 0.004 ELSE x + 0.1 END AS x, CASE k WHEN 0 THEN y + 0.02 ELSE y - 0.01 END AS y, CASE k WHEN 0 THEN 0.108 ELSE 0.15 END AS w, CASE k WHEN 0 THEN 0.047 ELSE 0.042 END AS h FROM c, range(2) z(k) WHERE c >= 80 AND t IN ('Объём', 'масса нетто')),
e AS (SELECT s, ix, greatest(0, x) AS x, greatest(0, y) AS y, least(1, x + w) - greatest(0, x) AS w, least(1, y + h) - greatest(0, y) AS h FROM a),
f AS (SELECT * FROM e b WHERE w > 0 AND h > 0 AND NOT EXISTS (SELECT 1 FROM e a WHERE a.s = b.s AND a.ix < b.ix AND a.w > 0 AND a.h > 0 AND abs(a.x - b.x) < 0.003 AND abs(a.y - b.y) < 0.003)), g AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ix) AS k FROM f)"""


def _captions(spark, sf_dir):
    p = F.col("p") % 4
    text = F.when(p == 0, "Объём").when(p == 1, "масса нетто").when(p == 2, "г").otherwise("текст")
    return _one(spark, sf_dir).select(F.col("s").alias("sheet_id"), F.col("i").alias("word_ix"), text.alias("text"), (60 + F.col("q") % 40).alias("confidence"), F.lit(0).alias("rotation"), F.lit(1.0).alias("aspect"), G.box(F.col("d") * 5, F.col("t") * 5, 0.1, 0.02).alias("box"))


@query(f"WITH {_CAPTIONS} SELECT s AS l_orderkey, CAST(k AS INTEGER) AS area_ix, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM g WHERE k <= 6")
def quantity_areas(spark, sf_dir):
    """Where an amount may stand, below and right of its caption."""
    rows = places.quantity_areas(_captions(spark, sf_dir))
    return rows.select(F.col("sheet_id").alias("l_orderkey"), "area_ix", *(F.round(f"box.{k}", 6).alias(k) for k in "xywh"))


@query(
    f"""WITH {_CAPTIONS}, j AS (SELECT g.s, g.k, c.i, g.x, c.x - g.x AS w, row_number() OVER (PARTITION BY g.s, g.k ORDER BY c.c DESC, c.i) AS n FROM g JOIN c ON g.s = c.s WHERE g.k <= 6 AND c.t = 'г' AND c.c >= 75 AND c.x > g.x AND c.x < g.x + g.w AND c.y >= g.y AND c.y + c.h <= g.y + g.h + 0.001)
SELECT s AS l_orderkey, CAST(k AS INTEGER) AS area_ix, i AS word_ix, round(w, 6) AS w FROM j WHERE n = 1"""
)
def number_areas(spark, sf_dir):
    """The number's area left of the surest unit word."""
    words = _captions(spark, sf_dir)
    rows = places.number_areas(places.quantity_areas(words), words)
    return rows.select(F.col("sheet_id").alias("l_orderkey"), "area_ix", "word_ix", F.round("box.w", 6).alias("w"))


_SCENE = "['Нетто', '500', 'г', 'пиво', '7', 'л', '/кг', 'на', '100', 'г', 'вода', 'Объём', '0,7л', '2']"


@query(
    f"""WITH a AS (SELECT p_partkey AS s, unnest(range(14)) AS ix FROM part WHERE p_partkey % 20 = 0),
w AS (SELECT s, ix, {_SCENE}[ix + 1] AS t, CASE WHEN (s // 20 + ix) % 9 = 0 THEN 70 ELSE 75 + (s // 20 * 3 + ix * 5) % 25 END AS c, ix % 7 * 0.05 AS x, ix // 7 * 0.1 + CASE WHEN (s // 20) % 3 = 0 AND ix % 7 = 5 THEN 0.05 ELSE 0 END AS y FROM a),
g AS (SELECT w.s, w.ix, z.n, string_agg(v.t, ' ' ORDER BY v.ix) AS t, min(v.c) AS score, max(abs(v.y - w.y)) AS dy, max(CASE WHEN v.ix > w.ix THEN v.x - u.x - 0.04 END) AS gap, min(CASE WHEN v.ix > w.ix THEN v.x - u.x END) AS ahead, min(w.x) AS x, min(w.y) AS y
  FROM w JOIN range(1, 4) z(n) ON w.ix + z.n <= 14 JOIN w v ON v.s = w.s AND v.ix BETWEEN w.ix AND w.ix + z.n - 1 LEFT JOIN w u ON u.s = v.s AND u.ix = v.ix - 1 GROUP BY ALL),
k AS (SELECT * FROM g WHERE score >= 75 AND dy <= 0.02 * 0.6 AND coalesce(gap, 0) <= 0.03 AND coalesce(ahead, 0) >= 0 AND regexp_matches(t, '^[0-9]+[.,]?[0-9]* ?(г|кг|л)$') AND NOT EXISTS (SELECT 1 FROM w f WHERE f.s = g.s AND f.ix = g.ix + n AND starts_with(f.t, '/'))),
m AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM w b JOIN w v ON v.s = b.s WHERE b.s = k.s AND b.ix BETWEEN k.ix - 3 AND k.ix + n + 2 AND b.t IN ('на', 'белки') AND v.ix BETWEEN k.ix AND k.ix + n - 1 AND abs(b.y - v.y) < 0.016 AND abs(b.x - v.x) < 0.2))
SELECT s AS p_partkey, CAST(ix AS INTEGER) AS ix, CAST(n AS INTEGER) AS size, CAST(replace(regexp_extract(t, '^[0-9]+[.,]?[0-9]*', 0), ',', '.') AS DOUBLE) AS value, regexp_extract(t, '(кг|г|л)$', 1) AS unit, score, EXISTS (SELECT 1 FROM w c WHERE c.s = m.s AND c.ix BETWEEN m.ix - 4 AND m.ix - 1 AND c.t IN ('Нетто', 'Объём') AND abs(c.y - m.y) < 0.018 AND m.x >= c.x + 0.04 - 0.01 AND m.x - c.x - 0.04 < 0.2) AS anchored FROM m"""
)
def quantity_context(spark, sf_dir):
    """Amounts of neighbouring words with their caption, without those of a nutrition table, concentrations and weak readings."""
    p, i = F.floor(F.col("s") / 20), F.col("ix")
    scene = F.array(*map(F.lit, ("Нетто", "500", "г", "пиво", "7", "л", "/кг", "на", "100", "г", "вода", "Объём", "0,7л", "2")))
    rows = table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("s"), F.posexplode(scene).alias("ix", "text"))
    trust = F.when((p + i) % 9 == 0, 70).otherwise(75 + (p * 3 + i * 5) % 25)
    y = F.floor(i / 7) * 0.1 + F.when((p % 3 == 0) & (i % 7 == 5), 0.05).otherwise(0.0)
    words = rows.select(F.col("s").alias("sheet_id"), F.lit("a").alias("pass"), "ix", "text", trust.alias("trust"), G.box(i % 7 * 0.05, y, F.lit(0.04), F.lit(0.02)).alias("box"))
    return places.amounts(words).select(F.col("sheet_id").alias("p_partkey"), "ix", "size", "value", "unit", "score", "anchored")


_OPS = f"""{_ONE}, f AS (SELECT s, i, CASE WHEN p % 7 = 0 THEN 'extra' WHEN p % 7 < 4 THEN 'same' WHEN p % 7 = 4 THEN 'missing' ELSE 'replace' END AS kind, p % 100 AS c, q % 2 = 0 AS anchored, p % 3 = 0 AS num, q % 5 < 3 AND q % 100 >= 20 AS sure, i * 0.05 AS x, CASE WHEN q % 4 = 0 THEN 0.5 ELSE 0.1 END AS y2 FROM o),
t AS (SELECT *, CASE WHEN kind <> 'extra' THEN count(*) FILTER (kind <> 'extra') OVER (PARTITION BY s ORDER BY i) - 1 END AS tok FROM f)"""


@query(
    f"""WITH {_OPS}, n AS (SELECT *, max(CASE WHEN kind = 'same' THEN x END) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bx, min(CASE WHEN kind = 'same' THEN x END) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ax,
  coalesce(tok, max(tok) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS k FROM t),
r AS (SELECT s, least(coalesce(bx, 9), coalesce(ax, 9), CASE WHEN kind <> 'missing' THEN x ELSE 9 END) - 0.03 AS x0, greatest(coalesce(bx, -9), coalesce(ax, -9), CASE WHEN kind <> 'missing' THEN x ELSE -9 END) + 0.04 + 0.03 AS x1, i, kind, c, anchored, num, k FROM n),
j AS (SELECT r.*, coalesce(u.sure AND u.y2 = 0.1 AND least(r.x1, u.x + 0.04) > greatest(r.x0, u.x), false) AS there, coalesce(v.sure, false) AS next FROM r LEFT JOIN t u ON u.s = r.s AND u.tok = r.k LEFT JOIN t v ON v.s = r.s AND v.tok = r.k + 1)
SELECT s AS l_orderkey, i AS l_linenumber, CASE WHEN kind = 'same' THEN 'same' WHEN kind = 'extra' THEN CASE WHEN c < 75 AND there AND next THEN 'resolved' ELSE 'open' END WHEN NOT there THEN 'open' WHEN anchored AND kind = 'missing' THEN 'contradicted' WHEN kind = 'replace' AND (c >= 75 OR (c >= 50 AND num)) THEN 'disputed' ELSE 'resolved' END AS outcome FROM j"""
)
def fused_places(spark, sf_dir):
    """What a second engine's reading at the same place does to each step of the first one's alignment."""
    from pyspark.sql import Window as W

    o = _one(spark, sf_dir)
    p, q, i = F.col("p"), F.col("q"), F.col("i")
    kind = F.when(p % 7 == 0, "extra").when(p % 7 < 4, "same").when(p % 7 == 4, "missing").otherwise("replace")
    rows = o.withColumn("kind", kind).withColumn("token_ix", F.when(F.col("kind") != "extra", F.sum(F.when(F.col("kind") != "extra", 1).otherwise(0)).over(W.partitionBy("s").orderBy("i")) - 1))
    token = F.when(p % 3 == 0, "40").otherwise("слово")
    box = G.box(i * 0.05, 0.1, 0.04, 0.02)
    first = rows.select(F.col("s").alias("sheet_id"), F.lit(0).alias("rule_id"), i.alias("ix"), "token_ix", "kind", token.alias("expected"), token.alias("actual"), (p % 100).alias("confidence"), ((q % 2 == 0) & (F.col("kind") == "missing")).alias("anchored"), F.when(F.col("kind") != "missing", box).alias("box"))
    second = rows.filter("token_ix IS NOT NULL").select(F.col("s").alias("sheet_id"), F.lit(0).alias("rule_id"), "token_ix", F.when(q % 5 < 3, "same").otherwise("replace").alias("kind"), F.when(q % 100 >= 20, 90.0).otherwise(60.0).alias("confidence"), G.box(i * 0.05, F.when(q % 4 == 0, 0.5).otherwise(0.1), F.lit(0.04), F.lit(0.02)).alias("box"))
    return places.fused(first, second).select(F.col("sheet_id").alias("l_orderkey"), F.col("ix").alias("l_linenumber"), "outcome")


@query(
    """WITH k AS (SELECT p_partkey, p_partkey % 8 AS k, CASE p_size % 3 WHEN 0 THEN 'percent' WHEN 1 THEN 'box' ELSE 'height' END AS kind, p_size % 2 = 0 AS wide, p_partkey % 5 > 0 AS sign, p_partkey // 8 % 5 AS t FROM part),
r(k, ix, label, unit, target, named) AS (VALUES (0, 0, 'Площадь', '%', 'letters', false), (0, 1, 'Высота букв', 'мм', 'letters', false), (1, 0, 'Высота ЕАС', 'мм', 'letters', false), (1, 1, 'Ширина ЕАС', 'мм', 'letters', false), (2, 0, 'Высота ЕАС', 'мм', 'letters', false),
  (2, 1, 'Ширина ЕАС', 'мм', 'letters', false), (3, 0, 'Высота букв', 'мм', 'letters', false), (3, 1, 'Площадь', '%', 'letters', false), (4, 0, 'Буквы', 'мм', 'quantity_label', false), (4, 1, 'Количество', 'мм', 'quantity', false), (5, 0, 'Буквы подписи', 'мм', 'date_label', false),
  (5, 1, 'Цифры', 'мм', 'date_digits', false), (6, 0, 'Остальной', 'мм', 'partitioned_letters', false), (6, 1, 'Срок', 'мм', 'partitioned_letters', true), (7, 0, 'Высота ЕАС', 'мм', 'letters', false), (7, 1, 'Ширина ЕАС', 'мм', 'letters', false)),
t(t, caption, amount, letters, life) AS (VALUES (0, false, true, false, false), (1, false, false, true, false), (2, false, false, true, true), (3, true, false, true, false), (4, false, false, false, false)),
s AS (SELECT *, count(*) FILTER (unit = 'мм') OVER w AS sized, bool_or(contains(label, 'ЕАС')) OVER w AS eac, bool_or(target = 'quantity') OVER w AS amounts, bool_or(target = 'date_label') OVER w AS dates FROM k JOIN r USING (k) JOIN t USING (t) WINDOW w AS (PARTITION BY p_partkey))
SELECT p_partkey, CAST(ix AS INTEGER) AS check_ix FROM s WHERE CASE WHEN kind = 'percent' THEN unit = '%' WHEN unit <> 'мм' THEN false WHEN eac THEN sign AND (kind = 'box' OR contains(label, CASE WHEN wide THEN 'Ширина' ELSE 'Высота' END)) WHEN kind <> 'height' THEN false
  WHEN sized = 1 THEN true WHEN amounts THEN CASE WHEN target = 'quantity_label' THEN caption ELSE amount END WHEN dates THEN target = CASE WHEN letters THEN 'date_label' ELSE 'date_digits' END ELSE named = life END"""
)
def claim_targets(spark, sf_dir):
    """Which size conditions a stated dimension speaks for: eight kinds of rules, three of statements, five inscriptions."""
    p, n = F.col("p_partkey"), F.col("p_size")
    k = p % 8
    # label, unit, target, scope of two conditions of each kind of rule
    kinds = {
        0: (("Площадь", "%", "letters", None), ("Высота букв", "мм", "letters", None)), 1: (("Высота ЕАС", "мм", "letters", None), ("Ширина ЕАС", "мм", "letters", None)),
        2: (("Высота ЕАС", "мм", "letters", None), ("Ширина ЕАС", "мм", "letters", None)), 3: (("Высота букв", "мм", "letters", None), ("Площадь", "%", "letters", None)),
        4: (("Буквы", "мм", "quantity_label", None), ("Количество", "мм", "quantity", None)), 5: (("Буквы подписи", "мм", "date_label", None), ("Цифры", "мм", "date_digits", None)),
        6: (("Остальной", "мм", "partitioned_letters", "остальной текст"), ("Срок", "мм", "partitioned_letters", "срок годности")), 7: (("Высота ЕАС", "мм", "letters", None), ("Ширина ЕАС", "мм", "letters", None)),
    }
    texts = F.array(*map(F.lit, ("500 г", "Дата розлива", "Срок годности 5 лет", "масса нетто", "12")))
    parts = table(spark, sf_dir, "part")
    pick = lambda of, kind: F.element_at(F.create_map(*(F.lit(x).cast(kind) if j % 2 else F.lit(x) for n in range(8) for j, x in enumerate((n, of(n))))), k.cast("int"))
    check = lambda j: F.struct(F.lit(j).alias("check_ix"), *(pick(lambda n, j=j, c=c: kinds[n][j][c], "string").alias(name) for c, name in enumerate(("label", "unit", "target", "scope"))))
    checks = parts.select(p.alias("rule_id"), F.explode(F.array(check(0), check(1))).alias("c")).select("rule_id", "c.*")
    claims = parts.select(p.alias("claim_ix"), p.alias("rule_id"), F.lit("Масса").alias("title"), F.when(n % 3 == 0, "percent").when(n % 3 == 1, "box").otherwise("height").alias("kind"), F.when(n % 2 == 0, "width").alias("gauge"), (p % 5 > 0).alias("sign"), F.array(F.get(texts, (F.floor(p / 8) % 5).cast("int"))).alias("texts"))
    return places.check_for(claims, checks).select(F.col("claim_ix").alias("p_partkey"), "check_ix")


# ---- places around phrases ---------------------------------------------------------------------------


@query(
    f"""WITH {_ONE}, b AS (SELECT s, i, p % 100 AS c, p % 4 AS g, q % 3 AS v, d * 2 AS x, t * 2 AS y, 0.1 AS w, 0.03 AS h FROM o), r AS (SELECT * FROM b WHERE g >= 2 AND c >= 80),
l AS (SELECT b.s, b.i, r.g, row_number() OVER (PARTITION BY b.s, b.i ORDER BY r.i) AS k FROM b JOIN r ON r.s = b.s AND r.v = b.v WHERE b.g < 2 AND {_share('b', 'r')} / (0.1 * 0.03) > 0.6)
SELECT b.s AS l_orderkey, b.i AS l_linenumber, CAST(coalesce(l.g, b.g) AS INTEGER) AS n_glyphs FROM b LEFT JOIN l ON l.s = b.s AND l.i = b.i AND l.k = 1"""
)
def lent_glyphs(spark, sf_dir):
    """Letters lent by another sure reading of the same word at the same place."""
    o = _one(spark, sf_dir)
    n = (F.col("p") % 4).cast("int")
    glyph = F.struct(F.lit("а").alias("text"), F.lit(1.0).alias("height"))
    words = o.select(F.col("s").alias("sheet_id"), F.col("i").alias("word_ix"), F.concat(F.lit("Слово"), (F.col("q") % 3).cast("string")).alias("text"), G.box(F.col("d") * 2, F.col("t") * 2, 0.1, 0.03).alias("box"), (F.col("p") % 100).alias("confidence"), F.array_repeat(glyph, n).alias("glyphs"))
    return layout.substitutes(words, words).select(F.col("sheet_id").alias("l_orderkey"), F.col("word_ix").alias("l_linenumber"), F.size("glyphs").alias("n_glyphs"))


@query(
    """SELECT p_partkey // 10 AS sheet_id, p_partkey AS rule_id, check_ix, string_agg(t, '|' ORDER BY t) AS sentences FROM (SELECT p_partkey, unnest(['Срок годности ' || p_size, 'Хранить ' || p_name]) AS t, unnest([0, 1]) AS check_ix, unnest([p_size * 2, 85]) AS c FROM part) WHERE c >= 80 GROUP BY ALL"""
)
def assigned_sentences(spark, sf_dir):
    """Located sentences under the size condition whose subject they name."""
    p = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(F.floor(p / 10).alias("sheet_id"), p.alias("rule_id"), F.explode(F.array(F.struct(F.concat(F.lit("Срок годности "), F.col("p_size")).alias("text"), (F.col("p_size") * 2).alias("coverage")), F.struct(F.concat(F.lit("Хранить "), F.col("p_name")).alias("text"), F.lit(85).alias("coverage")))).alias("x")).select("sheet_id", "rule_id", "x.*")
    c = table(spark, sf_dir, "part").select(F.floor(p / 10).alias("sheet_id"), p.alias("rule_id"), F.explode(F.array(F.struct(F.lit(0).alias("check_ix"), F.lit("срока годности").alias("scope")), F.struct(F.lit(1).alias("check_ix"), F.lit("остальной текст").alias("scope")))).alias("x")).select("sheet_id", "rule_id", "x.*")
    return layout.assigned(s, c).select("sheet_id", "rule_id", "check_ix", F.array_join("sentences", "|").alias("sentences"))


@query(
    """SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 5 > 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'match' ELSE 'difference' END END IS DISTINCT FROM CASE WHEN p_partkey % 7 > 0 THEN CASE p_partkey % 2 WHEN 0 THEN 'match' ELSE 'difference' END END AS verdicts_differ,
CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size AS VARCHAR) ELSE '' END <> CASE WHEN p_partkey % 7 > 0 THEN CAST(p_size + p_partkey % 4 // 3 AS VARCHAR) ELSE '' END AS numbers_differ FROM part"""
)
def compared_sections(spark, sf_dir):
    """Verdicts and numbers of two methods side by side."""
    p, parts = F.col("p_partkey"), table(spark, sf_dir, "part")
    side = lambda keep, same, n: parts.filter(keep).select(p.alias("rule_id"), F.when(same, "match").otherwise("difference").alias("verdict"), F.concat(F.lit("длина "), n.cast("string"), F.lit(" мм")).alias("reading"))
    one, two = side(p % 5 > 0, p % 3 == 0, F.col("p_size")), side(p % 7 > 0, p % 2 == 0, F.col("p_size") + F.floor(p % 4 / 3))
    return layout.compared_sections(parts.select(p.alias("rule_id")), one, two).select("rule_id", "verdicts_differ", "numbers_differ")


@query(
    f"""WITH {_ONE}, a AS (SELECT s, i, least(0.9, d * 4) AS x, least(0.9, t * 4) AS y, p % 3 AS e FROM o WHERE i % 2 = 0),
pr AS (SELECT s, i, d * 4 + 0.01 AS x, t * 4 AS y, 0.08 AS w, 0.02 AS h, p % 3 = 0 AS blank, CASE WHEN p % 3 = 1 THEN 'прочие слова' WHEN p % 3 = 2 THEN 'годности' ELSE '' END AS t, 70 + q % 30 AS c FROM o WHERE i % 2 = 1),
j AS (SELECT a.s, a.i, pr.blank, pr.t, pr.c, row_number() OVER (PARTITION BY a.s, a.i ORDER BY pr.i) AS k FROM a LEFT JOIN pr ON pr.s = a.s AND greatest(0, least(a.x + 0.08, pr.x + pr.w) - greatest(a.x, pr.x)) * greatest(0, least(a.y + 0.02, pr.y + pr.h) - greatest(a.y, pr.y)) >= 0.6 * (0.08 * 0.02)),
e AS (SELECT DISTINCT s FROM o WHERE p % 11 = 0)
SELECT s AS l_orderkey, i AS place_ix, coalesce(blank, false) OR coalesce(t = 'прочие слова' AND c >= 80, false) AND true AS told, (coalesce(blank, false) OR coalesce(t = 'прочие слова' AND c >= 80, false)) AND s NOT IN (SELECT s FROM e) AS anchored, coalesce(blank, false) AS blank FROM j WHERE k = 1"""
)
def settled_edges(spark, sf_dir):
    """Words missing at a phrase's edge: absent only where the place is blank or surely holds others, and they stand nowhere else."""
    o = _one(spark, sf_dir)
    i, s = F.col("i"), F.col("s").alias("sheet_id")
    area = F.array(G.box(F.least(F.lit(0.9), F.col("d") * 4), F.least(F.lit(0.9), F.col("t") * 4), 0.08, 0.02))
    at = o.filter(i % 2 == 0).select(s, i.alias("place_ix"), F.lit(0).alias("rotation"), F.array(F.lit("годности")).alias("expected"), area.alias("areas"))
    p = F.col("p") % 3
    probes = o.filter(i % 2 == 1).select(s, i.alias("probe_ix"), G.box(F.col("d") * 4 + 0.01, F.col("t") * 4, 0.08, 0.02).alias("box"), F.lit(0).alias("rotation"), (p == 0).alias("blank"), F.when(p == 1, "прочие слова").when(p == 2, "годности").otherwise("").alias("text"), (70 + F.col("q") % 30).alias("confidence"))
    words = o.filter(F.col("p") % 11 == 0).select(s, F.lit("годности").alias("text"), F.lit(90).alias("confidence"))
    rows = layout.settled_edges(at, probes, words)
    told = F.col("blank") | (F.size("seen") > 0)
    return rows.select(F.col("sheet_id").alias("l_orderkey"), "place_ix", told.alias("told"), "anchored", "blank")


@query(
    f"""WITH {_ONE}, e AS (SELECT s, i, i % 2 = 0 AS lead, d * 4 AS x, t * 4 AS y, 0.1 AS w, 0.02 AS h, 3 + p % 5 AS chars, 2 + q % 8 AS m FROM o),
f AS (SELECT *, x * 1000 AS a0, (x + w) * 1000 AS a1, (y + h / 2) * 1000 - 10 AS c0, (y + h / 2) * 1000 + 10 AS c1, greatest(80, m * 100 / greatest(1, chars) * 1.6) AS l FROM e),
g AS (SELECT *, CASE WHEN lead THEN a0 - 4 - l ELSE a1 + 4 END AS p0, CASE WHEN lead THEN a0 - 4 ELSE a1 + 4 + l END AS p1 FROM f)
SELECT s AS l_orderkey, i AS place_ix, round(greatest(0, p0) / 1000, 6) AS x, round((least(1000, p1) - greatest(0, p0)) / 1000, 6) AS w, round(greatest(0, c0 - 3) / 1000, 6) AS y FROM g WHERE least(1000, p1) - greatest(0, p0) > 0 AND least(1000, c1 + 3) - greatest(0, c0 - 3) > 0"""
)
def edge_places(spark, sf_dir):
    """Where words missing at a phrase's edge would stand on its line."""
    o = _one(spark, sf_dir)
    rows = o.select(F.col("s").alias("l_orderkey"), F.col("i").alias("place_ix"), F.when(F.col("i") % 2 == 0, "leading").otherwise("trailing").alias("side"), G.box(F.col("d") * 4, F.col("t") * 4, 0.1, 0.02).alias("anchor"), (3 + F.col("p") % 5).alias("chars"), (2 + F.col("q") % 8).alias("missing_chars"), F.lit(0).alias("rotation"), F.lit(20.0).alias("letter"), F.lit(100.0).alias("from"), F.lit(600.0).alias("to"), F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"))
    areas = layout.edge_places(rows).select("l_orderkey", "place_ix", F.explode("areas").alias("a"), F.col("anchor.y").alias("ay"))
    # the area on the phrase's own line
    own = areas.filter((F.col("a.y") <= F.col("ay") + 0.01) & (F.col("a.y") + F.col("a.h") >= F.col("ay") + 0.01))
    return own.select("l_orderkey", "place_ix", F.round("a.x", 6).alias("x"), F.round("a.w", 6).alias("w"), F.round("a.y", 6).alias("y"))


@query(
    f"""WITH {_ONE}, m AS (SELECT s, i, p % 3 = 0 AS exact, p % 100 AS cov, CASE WHEN q % 4 = 0 THEN 90 ELSE 0 END AS r, q % 5 = 0 AS words, d * 4 AS x, t * 4 AS y, 1 + q % 2 AS n FROM o), k AS (SELECT *, greatest(0, x - 0.03) AS ax, greatest(0, y - 0.014) AS ay, least(1, x + 0.26 + 0.03) AS qx, least(1, y + 0.02 + 0.014) AS qy FROM m WHERE NOT exact AND cov >= 45),
a AS (SELECT s, i, r, ax AS x, ay AS y, qx - ax AS w, qy - ay AS h, CASE WHEN words THEN 2 WHEN r = 90 THEN 1 ELSE 0 END AS priority FROM k WHERE n = 2),
u AS (SELECT * FROM a b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.s = b.s AND a.i < b.i AND a.r = b.r AND least(a.w * a.h, b.w * b.h) > 0 AND {_share('a', 'b')} / least(a.w * a.h, b.w * b.h) > 0.65 AND least(a.w * a.h, b.w * b.h) > 0.65 * greatest(a.w * a.h, b.w * b.h)))
SELECT s AS l_orderkey, i AS rule_id, priority, round(x, 6) AS x, round(w, 6) AS w FROM u QUALIFY row_number() OVER (PARTITION BY s ORDER BY priority DESC, i) <= 3"""
)
def refinement_areas(spark, sf_dir):
    """Places to read again, scattered and turned text first."""
    o = _one(spark, sf_dir)
    x, y = F.col("d") * 4, F.col("t") * 4
    one, two = G.box(x, y, 0.1, 0.02), G.box(x + 0.16, y, 0.1, 0.02)
    m = o.select(F.col("s").alias("sheet_id"), F.col("i").alias("rule_id"), (F.col("p") % 3 == 0).alias("exact"), (F.col("p") % 100).alias("coverage"), F.when(F.col("q") % 4 == 0, 90).otherwise(0).alias("rotation"), F.when(F.col("q") % 2 == 1, F.array(one, two)).otherwise(F.array(one)).alias("boxes"), F.array(F.lit(10), F.lit(10)).alias("chars"), F.when(F.col("q") % 5 == 0, "words").otherwise("layout").alias("method"))
    m = m.withColumn("chars", F.slice("chars", F.lit(1), F.size("boxes")))
    rows = layout.refinement_areas(m, 3)
    return rows.select(F.col("sheet_id").alias("l_orderkey"), "rule_id", "priority", F.round("area.x", 6).alias("x"), F.round("area.w", 6).alias("w"))


@query(
    f"""WITH {_ONE}, b AS (SELECT s, i, d * 10 AS x, t * 5 AS y, n / 500 AS w, 0.02 AS h, p % 100 AS c, q % 3 * 90 AS r FROM o), g AS (SELECT a.s, a.i, a.x + a.w AS e, a.y, b.x AS n FROM b a JOIN b ON b.s = a.s AND b.i = a.i + 1 WHERE a.r = 0)
SELECT s AS l_orderkey, i AS gap_ix FROM g WHERE EXISTS (SELECT 1 FROM b m, b f, b l WHERE m.s = g.s AND f.s = g.s AND f.i = g.i AND l.s = g.s AND l.i = g.i + 1 AND m.r = 0 AND m.c >= 30
 AND NOT (least(m.x + m.w, f.x + f.w) - greatest(m.x, f.x) > 0.5 * m.w AND abs(2 * m.y - 2 * f.y) / 2 < 0.6 * ((f.y + 0.02) - f.y)) AND NOT (least(m.x + m.w, l.x + l.w) - greatest(m.x, l.x) > 0.5 * m.w AND abs(2 * m.y - 2 * l.y) / 2 < 0.6 * ((f.y + 0.02) - f.y))
 AND CASE WHEN abs(2 * f.y - 2 * l.y) / 2 < 0.6 * ((f.y + 0.02) - f.y) THEN (abs(2 * m.y - 2 * f.y) / 2 < 0.6 * ((f.y + 0.02) - f.y) AND m.x >= f.x + f.w - 0.3 * ((f.y + 0.02) - f.y)) AND (abs(2 * m.y - 2 * l.y) / 2 < 0.6 * ((f.y + 0.02) - f.y) AND m.x + m.w <= l.x + 0.3 * ((f.y + 0.02) - f.y))
   ELSE (abs(2 * m.y - 2 * f.y) / 2 < 0.6 * ((f.y + 0.02) - f.y) AND m.x >= f.x + f.w - 0.3 * ((f.y + 0.02) - f.y)) OR (abs(2 * m.y - 2 * l.y) / 2 < 0.6 * ((f.y + 0.02) - f.y) AND m.x + m.w <= l.x + 0.3 * ((f.y + 0.02) - f.y)) END)"""
)
def unread_gaps(spark, sf_dir):
    """Neighbouring words with other readable print between them."""
    o = _one(spark, sf_dir)
    box = G.box(F.col("d") * 10, F.col("t") * 5, F.col("n") / 500, 0.02)
    words = o.select(F.col("s").alias("sheet_id"), F.col("i").alias("ix"), box.alias("box"), (F.col("q") % 3 * 90).alias("rotation"), (F.col("p") % 100).alias("confidence"), F.lit("слово").alias("text"))
    after = words.select("sheet_id", (F.col("ix") - 1).alias("ix"), F.col("box").alias("after"))
    gaps = words.filter("rotation = 0").join(after, ["sheet_id", "ix"]).select("sheet_id", F.col("ix").alias("gap_ix"), F.col("box").alias("before"), "after", "rotation")
    return layout.unread_gaps(gaps, words).select(F.col("sheet_id").alias("l_orderkey"), "gap_ix")


@query(
    f"""WITH {_ONE}, b AS (SELECT s, i, d * 2 AS x, t * 2 AS y, 0.05 + p % 3 * 0.02 AS w, 0.02 AS h, 70 + q % 30 AS c, CASE WHEN p % 4 = 0 THEN '4600000000001' WHEN p % 4 = 1 THEN 'слово' ELSE '0' || i || '.2024' END AS t FROM o), k AS (SELECT * FROM b WHERE i = 1), w AS (SELECT * FROM b WHERE i > 1 AND c >= 80 AND t LIKE '%.2024')
SELECT k.s AS l_orderkey, string_agg(w.t, ' ' ORDER BY w.i) AS text, count(*) AS n FROM k JOIN w ON w.s = k.s WHERE w.x >= k.x - ((k.y + k.h) - k.y) AND w.x < k.x + k.w + 8 * ((k.y + k.h) - k.y) AND ((w.x >= k.x + k.w - 0.3 * ((k.y + k.h) - k.y) AND abs(w.y - k.y) < 1.5 * ((k.y + k.h) - k.y)) OR (w.y >= k.y + k.h - 0.1 * ((k.y + k.h) - k.y) AND w.y < k.y + k.h + 3 * ((k.y + k.h) - k.y))) GROUP BY k.s"""
)
def date_digits(spark, sf_dir):
    """Digits of a date right of or below its caption."""
    o = _one(spark, sf_dir)
    p, i = F.col("p"), F.col("i")
    text = F.when(p % 4 == 0, "4600000000001").when(p % 4 == 1, "слово").otherwise(F.concat(F.lit("0"), i.cast("string"), F.lit(".2024")))
    rows = o.select(F.col("s").alias("sheet_id"), i.alias("word_ix"), text.alias("text"), (70 + F.col("q") % 30).alias("confidence"), F.lit(0).alias("rotation"), G.box(F.col("d") * 2, F.col("t") * 2, 0.05 + p % 3 * 0.02, F.lit(0.02)).alias("box"))
    captions = rows.filter("word_ix = 1").withColumn("rule_id", F.lit(0))
    return layout.dates(captions, rows.filter("word_ix > 1")).select(F.col("sheet_id").alias("l_orderkey"), "text", "n")


@query(
    f"""WITH {_ONE}, t AS (SELECT s, i, CASE WHEN p % 4 = 0 THEN '' ELSE 'слово' || p % 4 END AS t, CAST(q % 100 AS DOUBLE) AS c, q % 5 > 0 AS inked FROM o), f AS (SELECT s, t, min(i) AS i FROM t WHERE t <> '' GROUP BY s, t), a AS (SELECT s, string_agg(t, ' ' ORDER BY i) AS text FROM f GROUP BY s)
SELECT t.s AS l_orderkey, bool_and(NOT inked) AS blank, coalesce(min(a.text), '') AS text, avg(CASE WHEN t <> '' THEN c END) AS confidence FROM t LEFT JOIN a ON a.s = t.s GROUP BY t.s"""
)
def probe_summaries(spark, sf_dir):
    """What the attempts at a place gave: blank, different texts in order, mean confidence."""
    o = _one(spark, sf_dir)
    text = F.when(F.col("p") % 4 == 0, "").otherwise(F.concat(F.lit("слово"), (F.col("p") % 4).cast("string")))
    rows = o.select(F.col("s").alias("sheet_id"), F.lit(0).alias("probe_ix"), F.col("i").alias("attempt"), text.alias("text"), (F.col("q") % 100).cast("double").alias("confidence"), (F.col("q") % 5 > 0).alias("inked"))
    return layout.probe_summary(rows).select(F.col("sheet_id").alias("l_orderkey"), "blank", "text", "confidence")


@query(
    f"""WITH {_ONE}, b AS (SELECT s, i, d AS x, t AS y, n / 50 AS w, (1 + p % 50) / 50.0 AS h FROM o),
c AS (SELECT f.s, f.i AS k, e.i, e.x, e.y, e.w, e.h FROM b f JOIN b e ON e.s = f.s AND e.i <> f.i WHERE e.x >= f.x - 0.006 AND e.y >= f.y - 0.006 AND e.x + e.w <= f.x + f.w + 0.006 AND e.y + e.h <= f.y + f.h + 0.006 AND e.w * e.h > 0.2 * (f.w * f.h) AND e.w * e.h < 0.8 * (f.w * f.h))
SELECT s AS l_orderkey, i AS frame_ix FROM b WHERE NOT EXISTS (SELECT 1 FROM c JOIN c c2 ON c2.s = c.s AND c2.k = c.k AND c.i < c2.i WHERE c.s = b.s AND c.k = b.i AND (greatest(c.x, c2.x) - least(c.x + c.w, c2.x + c2.w) > 0.006 OR greatest(c.y, c2.y) - least(c.y + c.h, c2.y + c2.h) > 0.006))"""
)
def single_frames(spark, sf_dir):
    """Frames without outlines around two others that a gutter divides."""
    o = _one(spark, sf_dir)
    rows = o.select(F.col("s").alias("sheet_id"), F.col("i").alias("frame_ix"), G.box(F.col("d"), F.col("t"), F.col("n") / 50, (1 + F.col("p") % 50) / 50).alias("box"))
    return marks.single_frames(rows).select(F.col("sheet_id").alias("l_orderkey"), "frame_ix")


@query(f"SELECT item_id, array_to_string({S.tokens('text')}, ' ') AS respaced FROM benchmark")
def respaced_tokens(spark, sf_dir):
    """Texts with spaces lost and added between words of four letters and more, put right by what they should say."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.phrase_tokens(F.col("text")).alias("t"))

    def run(batches):
        for b in batches:
            out = []
            for t in b["t"]:
                t, read, j = list(t), [], 0
                while j < len(t):
                    if j % 5 == 0 and j + 1 < len(t) and all(x.isalpha() and len(x) > 3 for x in t[j : j + 2]) and t[j] + t[j + 1] not in t:
                        read.append(t[j] + t[j + 1])
                        j += 2
                        continue
                    half = len(t[j]) // 2
                    parted = j % 7 == 3 and t[j].isalpha() and half > 2 and t[j][:half] not in t and t[j][half:] not in t
                    read += [t[j][:half], t[j][half:]] if parted else [t[j]]
                    j += 1
                out.append(" ".join(layout.respaced(t, read)))
            yield b[["item_id"]].assign(respaced=out)

    return rows.mapInPandas(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, respaced string")


# ---- engines, sheets, measuring ------------------------------------------------------------------------


@query(
    f"""WITH {_ONE}, w AS (SELECT s, i, CASE p % 3 WHEN 0 THEN 'a1,b2' WHEN 1 THEN '12.5' ELSE 'xyz' END AS t, CAST(q % 101 AS DOUBLE) AS c, n * 4 AS x0, n * 4 + 60 AS x1, p % 5 = 0 AS l, p % 7 = 0 AS r FROM o),
a AS (SELECT *, regexp_replace(t, '[^0-9.,]', '', 'g') AS u FROM w)
SELECT s AS l_orderkey, i AS l_linenumber, u AS text, CASE WHEN (l AND x0 < 40 * 0.8) OR (r AND x1 > 260 - 40 * 0.8) THEN least(50, c) ELSE c END AS confidence FROM a WHERE u <> ''"""
)
def engine_words(spark, sf_dir):
    """A digit whitelist, and words at cut edges trusted by half."""
    p = F.col("p")
    text = F.when(p % 3 == 0, "a1,b2").when(p % 3 == 1, "12.5").otherwise("xyz")
    rows = _one(spark, sf_dir).select("s", "i", text.alias("text"), (F.col("q") % 101).cast("double").alias("confidence"), (F.col("n") * 4).alias("x0"), (F.col("n") * 4 + 60).alias("x1"), F.lit(260.0).alias("width"), F.lit(40.0).alias("height"), (p % 5 == 0).alias("cut_left"), (p % 7 == 0).alias("cut_right"))
    out = engines.cut_edges(engines.allowed(rows, "0123456789.,"))
    return out.select(F.col("s").alias("l_orderkey"), F.col("i").alias("l_linenumber"), "text", "confidence")


@query(
    f"""WITH {_ONE}, l AS (SELECT s, i, CAST(i AS INTEGER) * 78 AS y, n * 10 + 100 AS w, 1 + p % 3 AS k, p % 4 = 0 AS cl FROM o), f AS (SELECT s, i, CAST(i AS INTEGER) * 78 + CASE WHEN p % 6 = 0 THEN 60 ELSE 20 END AS y0, n * 8 AS x0, n * 8 + 50 AS x1, 0.2 + q % 90 / 100.0 AS score FROM o),
j AS (SELECT f.s, l.i, f.i AS word_ix, least(100, f.score * 100) AS c, greatest(0, least(l.w / l.k, (f.x0 - 24) / l.k)) AS a, greatest(0, least(l.w / l.k, (f.x1 - 24) / l.k)) AS b, l.cl, l.k FROM f JOIN l ON l.s = f.s AND (2 * f.y0 + 10) / 2 >= l.y - 4 AND (2 * f.y0 + 10) / 2 < l.y + 52)
SELECT s AS l_orderkey, i AS line_ix, word_ix AS text, CASE WHEN cl AND a < 48.0 / k * 0.8 THEN least(50, c) ELSE c END AS confidence, round(a, 6) AS x0, round(b, 6) AS x1 FROM j WHERE b > a"""
)
def line_sheet_words(spark, sf_dir):
    """Words read on packed sheets of line images, back at their lines."""
    o = _one(spark, sf_dir)
    p, i = F.col("p"), F.col("i").cast("int")
    y = i * 78 + F.when(p % 6 == 0, 60).otherwise(20)
    found = o.select(F.col("s").alias("sheet"), F.col("i").cast("string").alias("text"), (0.2 + F.col("q") % 90 / 100).alias("score"), (F.col("n") * 8).alias("x0"), y.alias("y0"), (F.col("n") * 8 + 50).alias("x1"), (y + 10).alias("y1"))
    slots = o.select(F.col("s").alias("sheet"), F.struct(F.col("s").alias("s"), F.col("i").alias("i")).alias("line_ix"), F.lit(24.0).alias("slot_x"), (i * 78).alias("slot_y"), (F.col("n") * 10 + 100).alias("width"), F.lit(48.0).alias("height"), (1 + p % 3).alias("scale"), (p % 4 == 0).alias("cut_left"), F.lit(False).alias("cut_right"))
    out = engines.from_line_sheets(found, slots)
    return out.select(F.col("line_ix.s").alias("l_orderkey"), F.col("line_ix.i").alias("line_ix"), F.col("text").cast("int").alias("text"), "confidence", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query(
    """WITH t AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 0.9 WHEN 2 THEN 1.0 ELSE 2.1 END AS h, (p_partkey * 37 % 1000) / 1000.0 AS p FROM part), e AS (SELECT CAST(h AS DOUBLE) AS h, CAST(p AS DOUBLE) AS p, CAST(p AS DOUBLE) + CAST(h AS DOUBLE) / 0.085 AS q FROM t),
m AS (SELECT h, len(list_filter(range(0, CAST(ceil(q) AS INTEGER) + 1), lambda i: greatest(0, least(q, i + 1) - greatest(p, i)) >= 0.5)) * 0.085 - h AS whole, len(list_filter(range(0, CAST(ceil(q / 0.25) AS INTEGER) + 1), lambda i: greatest(0, least(q, (i + 1) * 0.25) - greatest(p, i * 0.25)) / 0.25 >= 0.5)) * 0.25 * 0.085 - h AS fine,
 list_sum(list_transform(range(0, CAST(ceil(q) AS INTEGER) + 1), lambda i: floor(greatest(0, least(q, i + 1) - greatest(p, i)) * 255 + 0.5) / 255)) * 0.085 - h AS gray FROM e)
SELECT h AS height, round(avg(whole), 9) AS whole_bias, round(sqrt(avg(whole * whole)), 9) AS whole_rms, round(avg(fine), 9) AS fine_bias, round(sqrt(avg(fine * fine)), 9) AS fine_rms, round(avg(gray), 9) AS gray_bias, round(sqrt(avg(gray * gray)), 9) AS gray_rms FROM m GROUP BY h"""
)
def height_errors(spark, sf_dir):
    """Bias and error of three ways to measure a letter's height on a raster of 300 dots per inch."""
    p = F.col("p_partkey")
    h = F.when(p % 4 == 0, 0.8).when(p % 4 == 1, 0.9).when(p % 4 == 2, 1.0).otherwise(2.1)
    out = lines.height_errors(table(spark, sf_dir, "part").select(h.alias("height"), (p * 37 % 1000 / 1000).alias("phase")), 0.085)
    return out.select("height", *(F.round(c, 9).alias(c) for c in out.columns if c != "height"))


@query(
    f"""WITH {_ONE} SELECT s AS l_orderkey, row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS ix, 'слово' || i AS text, CAST(q % 101 AS DOUBLE) AS confidence, round(0.1 + (d * 1000) / 400 * 0.5, 6) AS x, round(0.2 + (t * 1000) / 300 * 0.4, 6) AS y, round(n / 400 * 0.5, 6) AS w FROM o"""
)
def tree_words(spark, sf_dir):
    """Words as an engine's nested tree, and flat again as boxes of the page."""
    o = _one(spark, sf_dir)
    words = o.select(F.col("s").alias("sheet"), F.lit(0).alias("line"), F.col("i").alias("word_ix"), F.concat(F.lit("слово"), F.col("i").cast("string")).alias("text"), (F.col("q") % 101).alias("confidence"), (F.col("d") * 1000).alias("x0"), (F.col("t") * 1000).alias("y0"), (F.col("d") * 1000 + F.col("n")).alias("x1"), (F.col("t") * 1000 + 10).alias("y1"))
    blocks = engines.tree(words, "sheet").select("sheet", F.from_json(F.to_json(F.struct("blocks")), f"blocks {sources.TREE}")["blocks"].alias("blocks"))
    flat = sources.words_from_tree(blocks, "sheet", "blocks", G.box(0.1, 0.2, 0.5, 0.4), F.lit(400.0), F.lit(300.0), F.lit(0), F.lit(0.1), F.lit("ocr-1"))
    return flat.select(F.col("sheet").alias("l_orderkey"), F.col("wi").cast("long").alias("ix"), "text", "confidence", *(F.round(f"box.{k}", 6).alias(k) for k in "xyw"))
