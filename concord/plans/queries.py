"""Registered queries of the conformance engine over the driver's tables, each with DuckDB SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.functions import geometry as G
from concord.functions import quantity as Q
from concord.functions import text as T
from concord.operators import align, callouts, layout, locate, measure, nearest, raster, readings, requirements, tokens, verdict
from concord.sources import documents, reports
from concord.sources.shared import kept

from . import assess
from . import sql as S
from .registry import ORACLES, QUERIES, query, table  # noqa: F401

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# ---- text functions -----------------------------------------------------------------------------


@query(f"SELECT doc_id, {S.normalize('text')} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, {S.compact('text')} AS compacted FROM documents")
def compact_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.compact(F.col("text")).alias("compacted"))


@query(f"SELECT doc_id, {S.dehyphenate('text')} AS joined FROM documents")
def dehyphenate_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.dehyphenate(F.col("text")).alias("joined"))


@query(f"SELECT doc_id, len(t) AS n_words, array_to_string(t, ' ') AS words FROM (SELECT doc_id, {S.words('text')} AS t FROM documents)")
def word_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_words"), F.array_join("t", " ").alias("words"))


@query(f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def phrase_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.phrase_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string(list_filter({S.tokens('text')}, lambda t: regexp_matches(t, '[0-9]')), ' ') AS numbers FROM documents")
def number_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.number_tokens(T.phrase_tokens(F.col("text"))), " ").alias("numbers"))


@query(f"SELECT item_id, array_to_string(list_transform({S.words('text')}, lambda t: {S.fold('t')}), ' ') AS folded FROM benchmark")
def fold_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(T.words(F.col("text")), T.fold), " ").alias("folded"))


@query(
    """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages"""
)
def escape_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query(
    "SELECT event_id, CASE WHEN c <= 0 THEN 0 WHEN c <= 62 THEN c * 40 / 62 WHEN c <= 85 THEN 40 + (c - 62) * 22 / 23 WHEN c <= 92.5 THEN 62 + (c - 85) * 10 / 7.5 WHEN c <= 97 THEN 72 + (c - 92.5) * 13 / 4.5 WHEN c <= 99.5 THEN 85 + (c - 97) * 12 / 2.5 WHEN c <= 100 THEN 97 + (c - 99.5) * 2 / 0.5 ELSE 99 END AS calibrated FROM (SELECT event_id, (event_id % 1010) / 10.0 AS c FROM events)"
)
def calibrate_confidence(spark, sf_dir):
    c = (F.col("event_id") % 1010) / 10.0
    return table(spark, sf_dir, "events").select("event_id", T.calibrated(c).alias("calibrated"))


_ALIKE = f"""
WITH w AS (SELECT DISTINCT unnest({S.words('text')}) AS t FROM benchmark),
f AS (SELECT t, {S.fold('t')} AS x, regexp_matches(t, '[0-9]') AS d FROM w ),
p AS (SELECT a.t AS a, b.t AS b, a.x AS x, b.x AS y, a.d OR b.d AS d FROM f a JOIN f b ON a.t < b.t),
s AS (SELECT *, least(length(x), length(y)) AS m, len(list_filter(range(1, 40), lambda i: i <= least(length(x), length(y)) AND left(x, i) = left(y, i))) AS k,
  CASE WHEN length(x) = length(y) THEN len(list_filter(range(1, 40), lambda i: x[i] <> y[i])) END AS h FROM p)
SELECT a, b FROM s WHERE x = y OR (NOT d AND ((k >= 4 AND m >= 4 AND k >= m - 2 AND abs(length(x) - length(y)) <= 2) OR (h <= 1 AND m >= 6)))
"""


@query(_ALIKE)
def alike_pairs(spark, sf_dir):
    """Word pairs of one form, found by equal first or last three letters of the folded words (the whole of shorter ones): an
    equi-join on blocks. A pair that differs in one letter shares its first or its last three when it has six letters or more."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("t")).distinct()
    x = T.fold(F.col("t"))
    blocks = w.select("t", F.explode(F.array(F.concat(F.lit("<"), F.substring(x, 1, 3)), F.concat(F.lit(">"), F.right(x, F.lit(3))))).alias("block"))
    pairs = blocks.alias("l").join(blocks.alias("r"), (F.col("l.block") == F.col("r.block")) & (F.col("l.t") < F.col("r.t"))).select(F.col("l.t").alias("a"), F.col("r.t").alias("b")).distinct()
    return pairs.filter(T.alike(F.col("a"), F.col("b")))


# ---- location -----------------------------------------------------------------------------------


def _sides(spark, sf_dir):
    """Required texts and readings. Readings are taken apart in the scan that looks through them; no copy of them is written."""
    return locate.prepared(table(spark, sf_dir, "benchmark"), "item_id", "text"), locate.prepared(table(spark, sf_dir, "documents"), "doc_id", "text")


def _pairs(rules, reads, k: int = 10):
    """The k best readings of each rule, kept: several joins read these few rows."""
    return kept(locate.candidates(rules, reads, k), "candidates")


_HITS = f"""
b AS (SELECT item_id, {S.tokens('text')} AS t, text FROM benchmark), d AS (SELECT doc_id, {S.tokens('text')} AS t, text FROM documents),
w AS (SELECT item_id, least(len(list_distinct(t)), 2) AS need, unnest(list_distinct(t)) AS token FROM b),
h AS (SELECT doc_id, unnest(list_distinct(t)) AS token FROM d),
o AS (SELECT item_id, doc_id, count(*) AS overlap, min(need) AS need FROM w JOIN h USING (token) GROUP BY ALL HAVING count(*) >= min(need)),
r AS (SELECT item_id, doc_id, overlap, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM o QUALIFY rank <= 10)
"""


@query(f"WITH {_HITS} SELECT * FROM r")
def candidate_top10(spark, sf_dir):
    rules, readings = _sides(spark, sf_dir)
    return locate.candidates(rules, readings).select(F.col("rule_id").alias("item_id"), F.col("reading_id").alias("doc_id"), "overlap", F.col("rank").cast("long").alias("rank"))


_COMPARED = f"""
p AS (SELECT item_id, doc_id, {S.compact(S.dehyphenate('b.text'))} AS e, {S.compact(S.dehyphenate('d.text'))} AS a, {S.words('b.text')} AS want, {S.words('d.text')} AS read
      FROM r JOIN b USING (item_id) JOIN d USING (doc_id)),
n AS (SELECT *, CASE WHEN len(want) > 0 THEN CAST(floor(len(list_filter(want, lambda t: list_contains(read, t))) * 100 / len(want) + 0.5) AS INTEGER) ELSE 0 END AS share FROM p),
c AS (SELECT item_id, doc_id, CASE WHEN e = '' THEN 'manual' WHEN contains(a, e) THEN 'found' WHEN share = 100 THEN 'all_words' WHEN share > 0 THEN 'partial' ELSE 'unreadable' END AS status,
      CASE WHEN e = '' THEN 0 WHEN contains(a, e) THEN 100 ELSE share END AS coverage,
      CASE WHEN e = '' OR contains(a, e) THEN [] ELSE list_sort(list_filter(list_distinct(want), lambda t: NOT list_contains(read, t))) END AS missing FROM n)
"""


@query(f"WITH {_HITS}, {_COMPARED} SELECT item_id, doc_id, status, coverage FROM c")
def compare_text(spark, sf_dir):
    rules, readings = _sides(spark, sf_dir)
    return locate.compared(rules, readings, _pairs(rules, readings)).select(F.col("rule_id").alias("item_id"), F.col("reading_id").alias("doc_id"), "status", "coverage")


@query(f"WITH {_HITS}, {_COMPARED} SELECT item_id, doc_id, len(missing) AS n_missing, array_to_string(missing, ' ') AS missing FROM c WHERE status IN ('partial', 'unreadable')")
def missing_tokens(spark, sf_dir):
    rules, readings = _sides(spark, sf_dir)
    rows = locate.compared(rules, readings, _pairs(rules, readings)).filter(F.col("status").isin("partial", "unreadable"))
    return rows.select(F.col("rule_id").alias("item_id"), F.col("reading_id").alias("doc_id"), F.size("missing").cast("long").alias("n_missing"), F.array_join(F.sort_array("missing"), " ").alias("missing"))


_EXACT = f"""
b AS (SELECT item_id, text, ' ' || array_to_string({S.tokens('text')}, ' ') || ' ' AS w FROM benchmark), d AS (SELECT doc_id, text, ' ' || array_to_string({S.tokens('text')}, ' ') || ' ' AS l FROM documents),
x AS (SELECT item_id, doc_id FROM b JOIN d ON contains(l, w) WHERE w <> '  ')
"""


@query(f"WITH {_EXACT} SELECT item_id, doc_id FROM x")
def locate_exact(spark, sf_dir):
    rules, readings = _sides(spark, sf_dir)
    return locate.contiguous(rules, readings).select(F.col("rule_id").alias("item_id"), F.col("reading_id").alias("doc_id"))


@query(
    f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({S.tokens('text')}, ' ') || ' ' AS l FROM documents), b AS (SELECT item_id, {S.fragments('text')} AS f FROM benchmark),
p AS (SELECT item_id, len(f) AS n_fragments, list_transform(f, lambda x: ' ' || array_to_string({S.tokens('x')}, ' ') || ' ') AS f FROM b WHERE len(f) > 0)
SELECT item_id, doc_id, n_fragments FROM p JOIN d ON len(list_filter(f, lambda x: NOT contains(l, x))) = 0"""
)
def locate_fragments(spark, sf_dir):
    rules, readings = _sides(spark, sf_dir)
    return locate.by_fragments(rules, readings).select(F.col("rule_id").alias("item_id"), F.col("reading_id").alias("doc_id"), "n_fragments")


@query()
def locate_phrases(spark, sf_dir):
    """Each required text and the best place it stands at."""
    rules, readings = _sides(spark, sf_dir)
    return locate.staged(rules, readings).select(F.col("rule_id").alias("item_id"), "method", F.col("reading_id").alias("doc_id"), "coverage")


@query(f"SELECT token, count(*) AS df, 1 / count(*) AS weight FROM (SELECT item_id, unnest(list_distinct(list_transform({S.words('text')}, lambda t: {S.fold('t')}))) AS token FROM benchmark) GROUP BY token")
def df_weights(spark, sf_dir):
    return locate.weights(table(spark, sf_dir, "benchmark"), "item_id", "text")


# ---- words in order -----------------------------------------------------------------------------

_WORDS = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\t-\\r ]+'), lambda x: x <> '') AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS word_ix FROM w)"


@query(f"WITH {_WORDS} SELECT doc_id, CAST(word_ix // 12 AS INTEGER) AS line, count(*) AS n_words, string_agg(word, ' ' ORDER BY word_ix) AS line_text FROM u GROUP BY ALL")
def word_layout(spark, sf_dir):
    return tokens.text_lines(_docs(spark, sf_dir), "doc_id", "text")


@query(
    f"WITH {_WORDS}, g AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY word_ix) AS b FROM u), i AS (SELECT doc_id, sum(CASE WHEN b IS NULL OR right(b, 1) IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY word_ix) AS k FROM g) "
    "SELECT doc_id, CAST(k AS BIGINT) AS sentence, count(*) AS n_words FROM i GROUP BY ALL"
)
def line_fragments(spark, sf_dir):
    """Runs of words up to a closing mark, as gaps and islands."""
    words = tokens.neighbours(tokens.word_rows(_docs(spark, sf_dir), "doc_id", "text"), ["doc_id"], "word_ix", "word")
    rows = tokens.islands(words, ["doc_id"], "word_ix", F.col("before").isNull() | F.col("before").rlike("[.!?]$"), "sentence")
    return rows.groupBy("doc_id", "sentence").agg(F.count("*").alias("n_words"))


@query(f"WITH {_WORDS} SELECT doc_id, CAST(word_ix AS INTEGER) AS word_ix, word, array_to_string(ws[greatest(word_ix - 2, 1):word_ix + 4], ' ') AS context FROM u JOIN w USING (doc_id) WHERE regexp_matches(word, '[0-9]')")
def context_frame(spark, sf_dir):
    return tokens.context(_docs(spark, sf_dir), "doc_id", "text", "[0-9]")


@query(
    f"WITH t AS (SELECT {S.tokens('text')} AS t FROM benchmark), g AS (SELECT 1 AS n, unnest(t) AS gram FROM t UNION ALL SELECT 2, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM t UNION ALL SELECT 3, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM t) SELECT n, gram, count(*) AS count FROM g GROUP BY ALL"
)
def ngrams(spark, sf_dir):
    return tokens.grams(table(spark, sf_dir, "benchmark"), "text")


@query(
    "SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_known, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_known FROM events"
)
def known_neighbours(spark, sf_dir):
    rows = tokens.known_neighbours(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.when(F.col("event_type") == "purchase", F.col("value")))
    return rows.select("event_id", "event_type", "last_known", "next_known")


@query("WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT c_custkey FROM o WHERE n <= 71 OR list_contains(list_transform(range(71), lambda k: k * n // 71), i)")
def spread_sample(spark, sf_dir):
    return tokens.spread(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 71).select("c_custkey")


# ---- quantities, sizes, codes, scale ------------------------------------------------------------

_UNIT_OF = "CASE p_partkey % 6 WHEN 0 THEN ' л' WHEN 1 THEN ' мл' WHEN 2 THEN ' г' WHEN 3 THEN ' кг/л' WHEN 4 THEN ' дм³' ELSE 'мм' END"
_AMOUNT = f"'Объём ' || replace(CAST(p_size AS VARCHAR) || '.5', '.', CASE WHEN p_partkey % 2 = 0 THEN ',' ELSE '.' END) || {_UNIT_OF} || CASE WHEN p_partkey % 7 = 0 THEN '; 2 л' ELSE '' END"


def _amounts(spark, sf_dir):
    p = F.col("p_partkey")
    unit = F.when(p % 6 == 0, " л").when(p % 6 == 1, " мл").when(p % 6 == 2, " г").when(p % 6 == 3, " кг/л").when(p % 6 == 4, " дм³").otherwise("мм")
    mark = F.when(p % 2 == 0, ",").otherwise(".")
    text = F.concat(F.lit("Объём "), F.col("p_size").cast("string"), mark, F.lit("5"), unit, F.when(p % 7 == 0, "; 2 л").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


_PARSED = f"""
s AS (SELECT p_partkey, lower(replace({_AMOUNT}, '³', '3')) AS t FROM part),
m AS (SELECT p_partkey, list_filter(regexp_extract_all(t, '(?:^|[^\\p{{L}}\\p{{N}}.,+-])([0-9]+(?:[.,][0-9]+)?\\s*(?:дм3|мл|кг|л|г)(?:[^\\p{{L}}\\p{{N}}/]|$))', 1), lambda x: true) AS v FROM s),
u AS (SELECT p_partkey, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM m),
z AS (SELECT p_partkey, k, CAST(replace(regexp_extract(x, '^[0-9]+(?:[.,][0-9]+)?', 0), ',', '.') AS DOUBLE) AS value, regexp_extract(x, '(дм3|мл|кг|л|г)', 1) AS un FROM u),
qq AS (SELECT p_partkey, k, value, CASE un WHEN 'дм3' THEN 'дм³' ELSE un END AS unit, CASE WHEN un IN ('г', 'кг') THEN 'mass' ELSE 'volume' END AS kind, value * CASE un WHEN 'мл' THEN 0.001 WHEN 'кг' THEN 1000 ELSE 1 END AS base_value FROM z)
"""


@query(f"WITH {_PARSED} SELECT p_partkey, CAST(k AS INTEGER) AS k, value, unit, kind, base_value FROM qq")
def quantities_parse(spark, sf_dir):
    rows = _amounts(spark, sf_dir).select("p_partkey", F.posexplode(Q.quantities(F.col("text"))).alias("k", "q"))
    return rows.select("p_partkey", (F.col("k") + 1).alias("k"), "q.value", "q.unit", "q.kind", "q.base_value")


@query(
    f"""WITH {_PARSED}, o AS (SELECT p_partkey, count(*) AS n, min(value) AS value, min(unit) AS unit, min(kind) AS kind, min(base_value) AS base_value FROM qq GROUP BY p_partkey),
e AS (SELECT p.p_partkey, CASE WHEN n = 1 THEN kind END AS kind, CASE WHEN n = 1 THEN unit END AS unit, CASE WHEN n = 1 THEN base_value END AS b FROM part p LEFT JOIN o USING (p_partkey)),
j AS (SELECT a.p_partkey, a.kind AS ek, a.unit AS eu, a.b AS eb, b.kind AS ak, b.unit AS au, b.b AS ab FROM e a JOIN e b ON b.p_partkey = a.p_partkey + 6)
SELECT p_partkey, CASE WHEN eb IS NULL THEN 'ambiguous' WHEN ab IS NULL THEN 'unreadable' WHEN ek <> ak THEN 'wrong_unit' WHEN abs(eb - ab) > greatest(1e-9, abs(eb) * 1e-9) THEN CASE WHEN eu = au THEN 'wrong_value' ELSE 'wrong_quantity' END WHEN eu = au THEN 'match' ELSE 'equivalent' END AS status FROM j"""
)
def quantity_compare(spark, sf_dir):
    e = _amounts(spark, sf_dir).select("p_partkey", Q.expected_quantity(F.col("text")).alias("e"))
    a = e.select((F.col("p_partkey") - 6).alias("p_partkey"), F.col("e").alias("a"))
    return e.join(a, "p_partkey").select("p_partkey", Q.quantity_comparison(F.col("e"), F.col("a")).alias("status"))


@query(
    f"""WITH s AS (SELECT p_partkey, {_AMOUNT} AS t FROM part),
v AS (SELECT p_partkey, t, unnest([regexp_replace(t, '([0-9/]\\s*)дм\\s*[3³]', '\\1л', 'g'), regexp_replace(regexp_replace(t, '([0-9/]\\s*)л([^\\p{{L}}\\p{{N}}]|$)', '\\1дм3\\2', 'g'), '([0-9/]\\s*)л$', '\\1дм3'), regexp_replace(t, '([0-9/]\\s*)мл([^\\p{{L}}\\p{{N}}]|$)', '\\1см3\\2', 'g')]) AS text FROM s)
SELECT p_partkey, text FROM v WHERE text <> t"""
)
def notation_variants(spark, sf_dir):
    rows = _amounts(spark, sf_dir).select("p_partkey", F.explode(Q.notations(F.col("text"))).alias("n"))
    return rows.select("p_partkey", "n.text")


_SIZED = """
k AS (SELECT p_partkey, p_partkey % 6 AS k, p_size / 10.0 AS a, (p_size + p_partkey % 7) / 10.0 AS b, CAST(p_size AS DOUBLE) AS n FROM part),
c AS (SELECT p_partkey, 0 AS ix, 'Высота букв' AS label, a AS m, 'мм' AS unit, 'letters' AS target, NULL AS scope FROM k WHERE k = 0
UNION ALL SELECT p_partkey, 0, 'Площадь предупреждения', n, '%', 'letters', NULL FROM k WHERE k = 1
UNION ALL SELECT p_partkey, unnest([0, 1]), unnest(['Буквы «Масса»', 'Количество товара']), unnest([a, n * 10]), 'мм', unnest(['quantity_label', 'quantity']), NULL FROM k WHERE k = 2
UNION ALL SELECT p_partkey, unnest([0, 1]), unnest(['Буквы подписи даты', 'Цифры даты / партии']), unnest([a, b]), 'мм', unnest(['date_label', 'date_digits']), NULL FROM k WHERE k = 3
UNION ALL SELECT p_partkey, unnest([0, 1]), unnest(['Высота ЕАС', 'Ширина ЕАС']), b, 'мм', 'letters', NULL FROM k WHERE k = 4
UNION ALL SELECT p_partkey, unnest([0, 1]), unnest(['Срок годности', 'Остальной текст']), unnest([b, a]), 'мм', 'partitioned_letters', unnest(['срока годности', 'остального текста']) FROM k WHERE k = 5)
"""


@query(f"WITH {_SIZED} SELECT p_partkey, ix AS check_ix, label, CAST(CASE WHEN unit = 'мм' AND NOT contains(label, 'ЕАС') THEN floor((m + 0.2) * 100 + 0.5) / 100 ELSE m END AS DOUBLE) AS min, unit, target, scope FROM c")
def size_rules(spark, sf_dir):
    """The size conditions of six kinds of rules: one height, a share, an amount, a date's window, the sign of conformity, several parts of a text; what is a greatest size is none."""
    k, n = F.col("p_partkey") % 6, F.col("p_size")
    tenth = lambda v: F.format_string("%d,%d", F.floor(v / 10).cast("int"), (v % 10).cast("int"))
    a, b, whole = tenth(n), tenth(n + F.col("p_partkey") % 7), n.cast("string")
    t = F.lit
    rule = (
        F.when(k == 0, F.concat(t("шрифт не менее "), a, t(" мм, не более 90 мм"))).when(k == 1, F.concat(t("площадь не менее "), whole, t(" %")))
        .when(k == 2, F.concat(t("высота букв термина "), a, t(" мм; количество "), whole, t(" см"))).when(k == 3, F.concat(t("высота букв подписи "), a, t(" мм; высота цифр "), b, t(" мм")))
        .when(k == 4, F.concat(t("не менее "), b, t(" мм, не более 50 мм"))).otherwise(F.concat(t("для срока годности не менее "), b, t(" мм; для остального текста не менее "), a, t(" мм")))
    )
    title = F.when(k == 2, "Масса").when(k == 3, "Окно для даты").when(k == 4, "Знак ЕАС").otherwise("Состав")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(Q.dimension_checks(title, rule, 0.2)).alias("check_ix", "c"))
    return rows.select("p_partkey", "check_ix", "c.label", "c.min", "c.unit", "c.target", "c.scope")


_PHRASES = "СРОК ГОДНОСТИ", "Хранить в тепле", "условие", "Сроки и годы", "остальное", "годен, хранение"
_SCOPES = f"""
t AS (SELECT p_partkey, array_to_string([(['{"', '".join(_PHRASES)}'])[p_partkey % 6 + 1], p_name, (['{"', '".join(_PHRASES)}'])[p_size % 6 + 1], CAST(p_size AS VARCHAR) || ' ' || p_type], ' ') AS text,
  [CASE WHEN p_size % 2 = 0 THEN 'срока годности' END, CASE p_partkey % 4 WHEN 0 THEN 'условий хранения' WHEN 1 THEN 'хранения по сроку' WHEN 2 THEN p_name END, CASE WHEN p_size % 5 < 3 THEN 'остальной текст' END] AS s FROM part),
f AS (SELECT p_partkey, {S.fold(S.compact('text'))} AS flat, s FROM t),
u AS (SELECT p_partkey, flat, unnest(s) AS sc, generate_subscripts(s, 1) - 1 AS i FROM f),
r AS (SELECT p_partkey, i, list_filter(list_transform(list_filter({S.words('sc')}, lambda w: length(w) > 3), lambda w: instr(flat, substr({S.fold('w')}, 1, 4)) - 1), lambda x: x >= 0) AS spots FROM u WHERE sc IS NOT NULL AND NOT contains(sc, 'остальн')),
k AS (SELECT p_partkey, i, list_min(spots) AS first, row_number() OVER (PARTITION BY p_partkey ORDER BY list_min(spots), len(spots) DESC, i) AS rn FROM r WHERE len(spots) > 0),
z AS (SELECT p_partkey, max(i) AS rest FROM u WHERE contains(sc, 'остальн') GROUP BY p_partkey)
"""


@query(f"WITH {_SCOPES} SELECT t.p_partkey, CAST(CASE WHEN a.i IS NOT NULL AND (b.i IS NULL OR a.first < b.first) THEN a.i ELSE coalesce(rest, -1) END AS INTEGER) AS scope_ix FROM t LEFT JOIN k a ON a.p_partkey = t.p_partkey AND a.rn = 1 LEFT JOIN k b ON b.p_partkey = t.p_partkey AND b.rn = 2 LEFT JOIN z ON z.p_partkey = t.p_partkey")
def scope_index(spark, sf_dir):
    """Which of up to three conditions a text falls under: the one whose subject it names first, else the one for the rest."""
    p, n = F.col("p_partkey"), F.col("p_size")
    phrase = lambda k: F.get(F.array(*map(F.lit, _PHRASES)), k.cast("int"))
    text = F.concat_ws(" ", phrase(p % 6), "p_name", phrase(n % 6), n.cast("string"), "p_type")
    scopes = F.array(F.when(n % 2 == 0, "срока годности"), F.when(p % 4 == 0, "условий хранения").when(p % 4 == 1, "хранения по сроку").when(p % 4 == 2, F.col("p_name")), F.when(n % 5 < 3, "остальной текст"))
    return table(spark, sf_dir, "part").select(p, Q.scope_index(scopes, text).cast("int").alias("scope_ix"))


@query(
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'height' WHEN 1 THEN 'box' WHEN 2 THEN 'percent' WHEN 3 THEN 'unreadable' END AS kind, "
    "CAST(CASE p_partkey % 5 WHEN 0 THEN p_size + 0.5 WHEN 2 THEN p_size END AS DOUBLE) AS value, CASE p_partkey % 5 WHEN 1 THEN CAST(p_size AS DOUBLE) END AS width, CAST(CASE p_partkey % 5 WHEN 1 THEN p_size + 0.25 END AS DOUBLE) AS height, "
    "CASE p_partkey % 5 WHEN 2 THEN '>' END AS comparator, CAST(CASE p_partkey % 5 WHEN 2 THEN p_size * 10 + 0.5 END AS DOUBLE) AS threshold, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS marks FROM part"
)
def claims_parse(spark, sf_dir):
    p, n = F.col("p_partkey"), F.col("p_size").cast("string")
    text = (
        F.when(p % 5 == 0, F.concat(F.lit("↕ "), n, F.lit(" , 5 мм"))).when(p % 5 == 1, F.concat(n, F.lit(" x "), n, F.lit(",25 mm")))
        .when(p % 5 == 2, F.concat(F.lit("площадь надписи > "), n, F.lit(" % ("), n, F.lit("0,5 мм²)"))).when(p % 5 == 3, F.concat(F.lit("0"), n, F.lit(" мм"))).otherwise(F.concat(F.lit("часть номер "), n))
    )
    rows = table(spark, sf_dir, "part").select(p, Q.parse_claim(text).alias("c"))
    marks = F.when(F.col("c").isNull(), 0).otherwise(Q.claim_marks(F.col("c"))).alias("marks")
    return rows.select("p_partkey", "c.kind", "c.value", F.get("c.values", F.lit(0)).alias("width"), F.get("c.values", F.lit(1)).alias("height"), "c.comparator", "c.threshold", marks)


_TWELVE = "lpad(CAST(o_orderkey * 7919 AS VARCHAR), 12, '0')"


@query(
    f"SELECT o_orderkey, CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({_TWELVE}, CAST(i AS INTEGER), 1) AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 AS INTEGER) AS check_digit FROM orders"
)
def ean13_check(spark, sf_dir):
    code = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 12, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", Q.ean13_check_digit(code).cast("int").alias("check_digit"))


@query(
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 300.0 WHEN p_partkey % 3 = 1 THEN 72.0 END AS d, p_size * 20.0 AS w, p_size * 15.0 AS h,
  CASE WHEN p_partkey % 4 = 0 THEN p_size * 20 * 25.4 / 300 ELSE p_size * 2.0 END AS a, CASE WHEN p_partkey % 4 = 0 THEN p_size * 15 * 25.4 / 300 WHEN p_partkey % 4 = 1 THEN p_size * 1.5 ELSE p_size * 1.2 END AS b FROM part),
f AS (SELECT *, greatest(a, b) / greatest(w, h) AS l, least(a, b) / least(w, h) AS s, 25.4 / d AS f FROM p),
g AS (SELECT *, d IS NOT NULL AND abs(f - l) <= greatest(f, l) * 0.02 AND abs(f - s) <= greatest(f, s) * 0.03 AS high, abs(l - s) <= greatest(l, s) * 0.03 AS medium FROM f)
SELECT p_partkey, CASE WHEN high THEN 'high' WHEN medium THEN 'medium' ELSE 'none' END AS level, CASE WHEN high THEN f WHEN medium THEN (l + s) / 2 END AS mm_per_pixel FROM g"""
)
def scale_resolve(spark, sf_dir):
    p, n = F.col("p_partkey"), F.col("p_size")
    d = F.when(p % 3 == 0, 300.0).when(p % 3 == 1, 72.0)
    a = F.when(p % 4 == 0, n * 20 * 25.4 / 300).otherwise(n * 2.0)
    b = F.when(p % 4 == 0, n * 15 * 25.4 / 300).when(p % 4 == 1, n * 1.5).otherwise(n * 1.2)
    s = Q.resolve_scale(d, d, n * 20.0, n * 15.0, a, b)
    return table(spark, sf_dir, "part").select(p, s.alias("s")).select("p_partkey", "s.level", "s.mm_per_pixel")


# ---- measuring ----------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT l_orderkey, l_suppkey % 40 AS s, list_sort(list(l_quantity)) AS h FROM lineitem GROUP BY ALL HAVING count(*) >= 1),
m AS (SELECT l_orderkey % 500 AS sheet, l_orderkey * 40 + s AS word, h[CAST(floor(len(h) / 2) AS INTEGER) + 1] AS m FROM w), a AS (SELECT sheet, list_sort(list(m)) AS m FROM m GROUP BY sheet),
k AS (SELECT *, len(m) AS n, CASE WHEN len(m) >= 5 THEN greatest(1, CAST(floor(len(m) * 0.05) AS INTEGER)) ELSE 0 END AS allowed FROM a),
b AS (SELECT *, coalesce(list_min(list_filter(range(1, n + 1), lambda i: i > allowed OR i = n OR NOT (m[i] < 0.6 * m[i + 1]))), 1) AS f FROM k)
SELECT sheet, n AS n_words, m[f] AS typical FROM b"""
)
def typical_height(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("sheet"), (F.col("l_orderkey") * 40 + F.col("l_suppkey") % 40).alias("word"), F.col("l_quantity").alias("h"))
    return measure.typical_height(rows, ["sheet"], "word", "h", least=1)


@query(
    "SELECT l_orderkey, min(CASE WHEN c >= 80 AND l_quantity > 0 AND l_returnflag = 'N' THEN l_quantity END) AS digit_height, min(CASE WHEN c >= 80 AND l_quantity > 0 AND l_returnflag <> 'N' THEN l_quantity END) AS letter_height FROM (SELECT *, l_partkey % 101 AS c FROM lineitem) GROUP BY l_orderkey"
)
def glyph_min(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "N", "7").otherwise(F.col("l_returnflag")).alias("t"), "l_quantity", (F.col("l_partkey") % 101).alias("c"))
    return measure.least_glyph(rows, ["l_orderkey"], "t", "l_quantity", "c")


_DECLARED = """SELECT l_orderkey, min(CASE WHEN u THEN l_quantity END) AS declared, CASE WHEN count(*) FILTER (u) = 0 THEN NULL WHEN bool_and(l_linenumber % 3 = 1) FILTER (u) THEN 'high' ELSE 'medium' END AS level, count(*) AS n
FROM (SELECT *, l_linenumber % 3 <> 0 AND l_returnflag <> 'R' AS u FROM lineitem) GROUP BY l_orderkey"""


def _declared(spark, sf_dir):
    level = F.element_at(F.array(F.lit("low"), F.lit("high"), F.lit("medium")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", level.alias("level"), F.when(F.col("l_returnflag") == "R", "line").otherwise("section").alias("scope"))
    return measure.declared_least(rows, ["l_orderkey"], "l_quantity", "level", "scope", "l_linenumber")


@query(_DECLARED)
def declared_min(spark, sf_dir):
    return _declared(spark, sf_dir)


@query(
    f"SELECT o_orderkey AS l_orderkey, coalesce(m, declared) AS value, CASE WHEN m IS NOT NULL THEN 'measured' WHEN declared IS NOT NULL THEN 'declared' END AS origin FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 1000 END AS m FROM orders) LEFT JOIN ({_DECLARED}) d ON o_orderkey = l_orderkey"
)
def coalesce_measured(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") / 1000).alias("measured"))
    return measure.filled(m, _declared(spark, sf_dir), ["l_orderkey"])


@query(
    "SELECT l_orderkey, (max(x + w) - min(x)) * (max(y + 0.5) - min(y)) / (50.0 * 20) * 100 AS share FROM (SELECT l_orderkey, l_discount * 100 AS x, l_tax * 100 AS y, l_quantity AS w FROM lineitem) GROUP BY l_orderkey"
)
def area_share(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 100).alias("x"), (F.col("l_tax") * 100).alias("y"), F.col("l_quantity").alias("w"), F.lit(0.5).alias("h"))
    return measure.area_share(rows, ["l_orderkey"], "x", "y", "w", "h", F.lit(1000.0))


@query(
    "SELECT p_partkey, p_retailprice / 2 / (p_size / 100.0) AS base, p_retailprice / (p_retailprice / 2 / (p_size / 100.0)) * 100 AS stated, abs(p_retailprice - m) <= 0.1 * greatest(p_retailprice, m) AS agrees FROM (SELECT *, p_retailprice * (0.8 + (p_partkey % 5) / 10.0) AS m FROM part)"
)
def stated_area_share(spark, sf_dir):
    price = F.col("p_retailprice")
    s = measure.stated_share(price, price / 2, F.col("p_size").cast("double"), price * (0.8 + (F.col("p_partkey") % 5) / 10.0), F.lit(1e5))
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.base", "s.stated", "s.agrees")


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey % 101 AS score, l_returnflag AS kind, floor(l_quantity / 10) AS base_value, l_linestatus AS unit, l_suppkey % 4 = 0 AS anchored FROM lineitem),
p AS (SELECT * FROM f QUALIFY NOT bool_or(anchored) OVER (PARTITION BY l_orderkey) OR anchored),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, kind, base_value, unit) AS k FROM p), c AS (SELECT l_orderkey, count(DISTINCT (kind, base_value, unit)) FILTER (score >= 85) > 1 AS conflict FROM p GROUP BY l_orderkey)
SELECT l_orderkey, kind, base_value, unit, conflict FROM b JOIN c USING (l_orderkey) WHERE k = 1"""
)
def quantity_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 101).alias("score"), F.col("l_returnflag").alias("kind"), F.floor(F.col("l_quantity") / 10).cast("double").alias("base_value"), F.col("l_linestatus").alias("unit"), (F.col("l_suppkey") % 4 == 0).alias("anchored"))
    return measure.quantity_evidence(rows, ["l_orderkey"], "l_linenumber")


# ---- several readings ---------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT user_id, event_id % 7 AS place, event_type AS v, event_id % 3 AS pass, 60 + value % 40 AS c FROM events),
o AS (SELECT user_id, place, v, count(DISTINCT pass) AS support, max(c) AS confidence FROM r WHERE c >= 20 GROUP BY ALL HAVING max(c) >= 75 OR count(DISTINCT pass) >= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, place ORDER BY confidence + 4 * least(3, support) DESC, v) AS k FROM o) SELECT user_id, place, v, support, confidence, false AS conflict FROM b WHERE k = 1"""
)
def consensus_readings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 7).alias("place"), F.col("event_type").alias("v"), (F.col("event_id") % 3).alias("pass"), (60 + F.col("value") % 40).alias("c"))
    return readings.consensus(rows, ["user_id", "place"], "v", "pass", "c")


@query("SELECT l_partkey, l_suppkey, count(DISTINCT l_quantity) AS n_values, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL HAVING count(DISTINCT l_quantity) > 1")
def numeric_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("c", F.when(F.col("l_discount") >= 0.05, 90).otherwise(60))
    return readings.conflicts(rows, ["l_partkey", "l_suppkey"], "l_quantity", F.col("c"))


_BOXES = "SELECT l_orderkey, l_linenumber, l_discount AS x, l_tax AS y, floor(l_quantity) / 100 AS w, 0.02 AS h FROM lineitem"


def _boxes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), (F.floor("l_quantity") / 100).alias("w"), F.lit(0.02).alias("h"))


@query(f"WITH b AS ({_BOXES}) SELECT l_orderkey, l_linenumber FROM b WHERE NOT EXISTS (SELECT 1 FROM b a WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND abs(a.x - b.x) < 0.015 AND abs(a.y - b.y) < 0.015 AND abs(a.w - b.w) < 0.015)")
def near_duplicates(spark, sf_dir):
    return readings.distinct_boxes(_boxes(spark, sf_dir), ["l_orderkey"], "l_linenumber", 0.015).select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber FROM ({_BOXES}) WHERE x >= 0.02 - 0.002 AND y >= 0.01 - 0.002 AND x + w <= 0.42 + 0.002 AND y + h <= 0.08 + 0.002")
def inside_label(spark, sf_dir):
    rows = _boxes(spark, sf_dir).withColumn("box", F.struct("x", "y", "w", "h"))
    return readings.within(rows, G.box(0.02, 0.01, 0.4, 0.07)).select("l_orderkey", "l_linenumber")


@query(
    f"WITH b AS ({_BOXES}), p AS (SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS s, a.w * a.h AS p, b.w * b.h AS q FROM b a JOIN b USING (l_orderkey) WHERE a.l_linenumber < b.l_linenumber) SELECT l_orderkey, i, j, round(s / (p + q - s), 6) AS iou FROM p WHERE s / least(p, q) > 0.65"
)
def same_places(spark, sf_dir):
    rows = _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.struct("x", "y", "w", "h").alias("box"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber"))).filter(G.same_place(F.col("a.box"), F.col("b.box")))
    return pairs.select("a.l_orderkey", F.col("a.l_linenumber").alias("i"), F.col("b.l_linenumber").alias("j"), F.round(G.iou(F.col("a.box"), F.col("b.box")), 6).alias("iou"))


@query(
    f"WITH b AS ({_BOXES}), t AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS r, x, y, w, h, 1.4 AS a FROM b) SELECT l_orderkey, l_linenumber, CASE r WHEN 1 THEN 1 - y - h WHEN 2 THEN (1 - x - w) * a WHEN 3 THEN y ELSE x * a END AS rx, CASE r WHEN 1 THEN x * a WHEN 2 THEN 1 - y - h WHEN 3 THEN (1 - x - w) * a ELSE y END AS ry, CASE WHEN r IN (1, 3) THEN h ELSE w * a END AS rw FROM t"
)
def reading_boxes(spark, sf_dir):
    rows = _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.struct("x", "y", "w", "h").alias("box"))
    r = G.turned(F.col("box"), F.col("l_linenumber") % 4 * 90, F.lit(1.4))
    return rows.select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", F.col("r.x").alias("rx"), F.col("r.y").alias("ry"), F.col("r.w").alias("rw"))


@query(
    "WITH r AS (SELECT l_orderkey, l_linenumber AS k FROM lineitem WHERE l_partkey % 101 >= 30), n AS (SELECT l_orderkey, k, lead(k) OVER (PARTITION BY l_orderkey ORDER BY k) AS j FROM r) SELECT l_orderkey, k AS l_linenumber, j AS next_ix, j - k - 1 AS blank_between FROM n WHERE j IS NOT NULL"
)
def blank_between(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("x").alias("t"), (F.col("l_partkey") % 101).alias("c"))
    return readings.blanks(rows, ["l_orderkey"], "l_linenumber", "t", "c")


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber AS token_ix, l_partkey % 10 AS k, l_suppkey % 100 AS c1, CAST(l_quantity AS INTEGER) AS e, l_partkey % 3 = 0 AS number, l_suppkey % 5 AS k2, l_partkey % 100 AS c2 FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL))
SELECT l_orderkey, token_ix, CASE WHEN k < 5 THEN 'same' WHEN k2 < 3 AND c2 >= 80 AND k < 8 AND (c1 >= 75 OR (c1 >= 50 AND number)) THEN 'disputed' WHEN k2 < 3 AND c2 >= 80 THEN 'resolved' WHEN k2 = 3 AND c2 >= 80 THEN 'contradicted' ELSE 'open' END AS outcome FROM t"""
)
def fuse_engines(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    token = F.when(p % 3 == 0, F.col("l_quantity").cast("int").cast("string")).otherwise("слово")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")))
    first = items.select("l_orderkey", F.col("l_linenumber").alias("token_ix"), token.alias("expected"), F.when(p % 10 < 5, "same").when(p % 10 < 8, "replace").otherwise("missing").alias("kind"), token.alias("actual"), (s % 100).alias("confidence"))
    second = items.filter(s % 5 < 4).select("l_orderkey", F.col("l_linenumber").alias("token_ix"), F.when(s % 5 < 3, "same").otherwise("replace").alias("kind"), token.alias("actual"), (p % 100).alias("confidence"))
    return readings.fuse(first, second, ["l_orderkey"])


# ---- verdicts -----------------------------------------------------------------------------------

_JUDGED = "j AS (SELECT doc_id, lang, source, CASE quality WHEN 1 THEN 'same' ELSE 'different' END AS truth, CASE WHEN contains(text, ' | ') OR contains(text, '###') THEN 'difference' WHEN length(text) > 4000 THEN 'unsure' WHEN length(text) < 80 THEN 'not-found' ELSE 'match' END AS verdict FROM documents JOIN labels USING (doc_id)), o AS (SELECT *, CASE truth WHEN 'same' THEN CASE verdict WHEN 'match' THEN 'confirmed' WHEN 'difference' THEN 'falseDiff' ELSE 'open' END ELSE CASE verdict WHEN 'difference' THEN 'caught' WHEN 'match' THEN 'falseMatch' WHEN 'unsure' THEN 'flagged' ELSE 'open' END END AS outcome FROM j)"
_COUNTS = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {q}" for o, q in ((x, f'"{x}"') for x in ("confirmed", "caught", "flagged", "open", "falseMatch", "falseDiff")))


def _judged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    text = F.col("text")
    v = F.when(text.contains(" | ") | text.contains("###"), "difference").when(F.char_length(text) > 4000, "unsure").when(F.char_length(text) < 80, "not-found").otherwise("match")
    return docs.select("doc_id", "lang", "source", F.when(F.col("quality") == 1, "same").otherwise("different").alias("truth"), v.alias("verdict")).withColumn("outcome", verdict.outcome(F.col("truth"), F.col("verdict")))


@query(f"WITH {_JUDGED} SELECT lang, {_COUNTS}, count(outcome) AS total FROM o GROUP BY lang")
def outcome_tally(spark, sf_dir):
    return verdict.tally(_judged(spark, sf_dir), ["lang"])


@query(f"WITH {_JUDGED} SELECT lang, source, {_COUNTS}, CAST(CASE WHEN grouping(lang) = 1 THEN 0 WHEN grouping(source) = 1 THEN 1 ELSE 2 END AS INTEGER) AS level FROM o GROUP BY ROLLUP (lang, source)")
def tally_rollup(spark, sf_dir):
    return verdict.rolled(_judged(spark, sf_dir), ["lang", "source"])


@query("SELECT event_type, count(DISTINCT user_id % 50) AS sheets FROM events GROUP BY event_type HAVING count(DISTINCT user_id % 50) = (SELECT count(DISTINCT user_id % 50) FROM events)")
def complete_methods(spark, sf_dir):
    return verdict.complete_methods(table(spark, sf_dir, "events").withColumn("sheet", F.col("user_id") % 50), "event_type", "sheet")


@query(
    f"WITH {_HITS}, {_COMPARED}, v AS (SELECT item_id, doc_id, status, CASE WHEN item_id % 9 = 0 THEN 'error' WHEN item_id % 11 = 0 AND status = 'found' THEN 'pass' WHEN status = 'found' THEN 'detected' WHEN status = 'all_words' THEN 'words' WHEN status IN ('partial', 'unreadable') THEN 'issue' ELSE 'pending' END AS row_status FROM c) SELECT item_id, doc_id, row_status, CASE status WHEN 'manual' THEN 'skip' WHEN 'found' THEN 'match' WHEN 'partial' THEN 'unsure' WHEN 'all_words' THEN 'unsure' ELSE 'not-found' END AS verdict FROM v"
)
def verdict_rows(spark, sf_dir):
    rules, reads = _sides(spark, sf_dir)
    rows = locate.compared(rules, reads, _pairs(rules, reads))
    no = F.lit(False)
    i, status = F.col("rule_id"), F.col("status")
    s = verdict.row_status(status, rejected=i % 9 == 0, failed=no, exempt=no, confirmed=(i % 11 == 0) & (status == "found"), sizes_pass=F.lit(True), conditions=F.lit(True), quantity_issue=no, notation=no, size_issue=no, has_text=F.lit(True))
    return rows.select(i.alias("item_id"), F.col("reading_id").alias("doc_id"), s.alias("row_status"), verdict.text_verdict(status, no).alias("verdict"))


@query(f"WITH {_HITS}, {_COMPARED} SELECT status, count(*) AS n, CAST(min(coverage) AS INTEGER) AS least, CAST(max(coverage) AS INTEGER) AS most FROM c GROUP BY status")
def status_counts(spark, sf_dir):
    rules, reads = _sides(spark, sf_dir)
    return locate.compared(rules, reads, _pairs(rules, reads)).groupBy("status").agg(F.count("*").alias("n"), F.min("coverage").alias("least"), F.max("coverage").alias("most"))


_CHANGES = ", ".join(f"('{k}', {n})" for k, n in verdict.CHANGES.items())
_MUTATIONS = f"""
b AS (SELECT item_id, text, {S.fragments('text')} AS f FROM benchmark),
p AS (SELECT item_id, text, list_transform(CASE WHEN len(f) > 0 THEN f ELSE [text] END, lambda x: [x]) AS f FROM b),
s AS (SELECT item_id, text, list_reduce(list_prepend(CAST([] AS VARCHAR[]), f), lambda acc, x: list_concat(acc,
  [CAST(instr(substr(text, coalesce(CAST(acc[len(acc)] AS INTEGER), 0) + 1), x[1]) - 1 + CASE WHEN contains(substr(text, coalesce(CAST(acc[len(acc)] AS INTEGER), 0) + 1), x[1]) THEN coalesce(CAST(acc[len(acc)] AS INTEGER), 0) ELSE 0 END AS VARCHAR),
   CAST(instr(substr(text, coalesce(CAST(acc[len(acc)] AS INTEGER), 0) + 1), x[1]) - 1 + CASE WHEN contains(substr(text, coalesce(CAST(acc[len(acc)] AS INTEGER), 0) + 1), x[1]) THEN coalesce(CAST(acc[len(acc)] AS INTEGER), 0) ELSE 0 END + length(x[1]) AS VARCHAR)])) AS sent FROM p),
r AS (SELECT item_id, text, sent, regexp_extract_all(text, '[0-9]+|[^0-9]+') AS ns, regexp_extract_all(text, '\\p{{L}}+|[^\\p{{L}}]+') AS ws FROM s),
n AS (SELECT item_id, text, unnest(ns) AS part, list_transform(range(1, len(ns) + 1), lambda i: coalesce(list_sum(list_transform(ns[1:i - 1], lambda x: length(x))), 0)) AS ats, generate_subscripts(ns, 1) AS i FROM r),
w AS (SELECT item_id, text, sent, unnest(ws) AS part, list_transform(range(1, len(ws) + 1), lambda i: coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x))), 0)) AS ats, generate_subscripts(ws, 1) AS i FROM r),
v AS (SELECT item_id, text, part, CAST(ats[i] AS INTEGER) AS place, list_transform(list_filter(range(1, len(sent) // 2 + 1), lambda k: CAST(sent[2 * k - 1] AS INTEGER) <= ats[i] AND ats[i] < CAST(sent[2 * k] AS INTEGER)),
  lambda k: CAST(sent[2 * k - 1] AS INTEGER) >= 0 AND regexp_matches(substr(text, CAST(sent[2 * k - 1] AS INTEGER) + 1, CAST(ats[i] AS INTEGER) - CAST(sent[2 * k - 1] AS INTEGER)), '[0-9\\p{{L}}%°º]') AND regexp_matches(substr(text, CAST(ats[i] AS INTEGER) + length(part) + 1, CAST(sent[2 * k] AS INTEGER) - CAST(ats[i] AS INTEGER) - length(part)), '[0-9\\p{{L}}%°º]'))[1] AS inner_
  FROM w WHERE regexp_matches(part, '^\\p{{L}}{{4}}')),
c AS (SELECT item_id, text, part, CAST(ats[i] AS INTEGER) AS place, 'number' AS kind FROM n WHERE regexp_matches(part, '^[0-9]')
  UNION ALL SELECT item_id, text, part, place, 'inside' FROM v WHERE coalesce(inner_, false) UNION ALL SELECT item_id, text, part, place, 'edge' FROM v WHERE NOT coalesce(inner_, false)
  UNION ALL SELECT item_id, text, part, place, 'added' FROM v WHERE coalesce(inner_, false) UNION ALL SELECT item_id, text, part, place, 'letter' FROM v WHERE length(part) >= 6),
o AS (SELECT c.*, most, row_number() OVER (PARTITION BY item_id, kind ORDER BY place) - 1 AS ix, count(*) OVER (PARTITION BY item_id, kind) AS total FROM c JOIN (VALUES {_CHANGES}) m(kind, most) USING (kind)),
g AS (SELECT *, substr(text, 1, place) AS head, substr(text, place + length(part) + 1) AS tail, length(part) // 2 + 1 AS mid FROM o WHERE total <= most OR list_contains(list_transform(range(most), lambda k: k * total // most), ix)),
mutated AS (SELECT item_id, kind, place, CASE kind WHEN 'number' THEN head || left(part, length(part) - 1) || CAST((CAST(right(part, 1) AS INTEGER) + 1) % 10 AS VARCHAR) || tail
  WHEN 'added' THEN head || 'дополнительно ' || part || tail WHEN 'letter' THEN head || left(part, mid - 1) || CASE WHEN part[mid] = lower(part[mid]) THEN CASE WHEN part[mid] = 'ж' THEN 'ш' ELSE 'ж' END ELSE CASE WHEN lower(part[mid]) = 'ж' THEN 'Ш' ELSE 'Ж' END END || substr(part, mid + 1) || tail
  ELSE regexp_replace(head || tail, ' {{2,}}', ' ', 'g') END AS mutated FROM g)
"""


@query(f"WITH {_MUTATIONS} SELECT item_id, kind, place, mutated FROM mutated")
def mutations(spark, sf_dir):
    return verdict.mutations(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query()
def stress_tally(spark, sf_dir):
    """Every mutated text judged on the print of the text as it was, a sheet for each: a match is a false match. Texts as they are come too: a
    difference is a false one. Numbers are changed in the sentences of the documents that have some. Words stand in lines of some 90 characters, with
    the boxes such print has, so what stands beside a phrase is seen."""
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("item_id"), "text")
    said = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.fragments(F.col("text"))).alias("k", "text")).filter(F.col("text").rlike(r"\d"))
    numbers = kept(said.select(F.concat_ws(".", F.lit("d"), "doc_id", "k").alias("item_id"), "text"), "sentences")
    changed = verdict.mutations(b, "item_id", "text").unionByName(verdict.mutations(numbers, "item_id", "text").filter("kind = 'number'"))
    changed = kept(changed.unionByName(b.select("item_id", F.lit("unchanged").alias("kind"), F.lit(0).alias("place"), F.col("text").alias("mutated")), allowMissingColumns=True), "changed")
    b = b.unionByName(numbers)
    sheet = F.concat_ws(":", "item_id", "kind", F.col("place").cast("string")).alias("sheet_id")
    rules = changed.select(sheet, F.concat_ws(":", "kind", F.col("place").cast("string")).alias("rule_id"), F.lit("Текст").alias("title"), F.lit("").alias("constraint"), F.col("mutated").alias("original"), F.col("mutated").alias("text"))
    w = tokens.word_rows(b, "item_id", "text")
    size = F.char_length("word")
    at = F.sum(size + 1).over(Window.partitionBy("item_id").orderBy("word_ix")) - size - 1
    w = w.select("item_id", "word_ix", "word", G.box((at % 90) / 100, F.floor(at / 90) * 0.03, size / 100, F.lit(0.02)).alias("box"))
    words = changed.select("item_id", sheet).join(w, "item_id").select("sheet_id", "word_ix", F.lit("a").alias("pass"), F.col("word").alias("text"), F.lit(95.0).alias("confidence"), "box")
    rows = assess.assess(rules, words).withColumn("kind", F.substring_index("rule_id", ":", 1))
    n = lambda c: F.count_if(c)
    v = F.col("verdict")
    return rows.groupBy("kind").agg(F.count("*").alias("total"), n((v == "match") & (F.col("kind") != "unchanged")).alias("false_match"), n((v == "difference") & (F.col("kind") == "unchanged")).alias("false_difference"), n((v == "difference") & (F.col("kind") != "unchanged")).alias("caught"), n(~v.isin("match", "difference")).alias("flagged"))


@query(
    "SELECT n_regionkey, n_name, score FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY score DESC, n_nationkey) AS k FROM (SELECT n_regionkey, n_nationkey, n_name, sum(floor(c_acctbal)) AS score FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL)) WHERE k = 1"
)
def region_argmax(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("v", F.floor("c_acctbal").cast("double"))
    return verdict.best_region(rows, "n_name", "v", ["n_regionkey"], "n_nationkey")


@query(
    "WITH o AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL), w AS (SELECT user_id, event_type, -count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY ALL) SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = o.user_id AND w.event_type = o.event_type) UNION ALL SELECT * FROM w"
)
def upsert_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    count = lambda odd, sign: e.filter(F.col("event_id") % 2 == odd).groupBy("user_id", "event_type").agg((F.count("*") * sign).alias("n"))
    return tokens.upsert(count(0, 1), count(1, -1), ["user_id", "event_type"])


@query(
    "WITH a AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL), d AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, coalesce(a.n, 0) - coalesce(b.n, 0) AS n FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus) SELECT o_custkey, o_orderstatus, CASE WHEN n > 0 THEN 'missing' ELSE 'new' END AS side, abs(n) AS times FROM d WHERE n <> 0"
)
def link_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return tokens.difference(o.filter(F.col("o_orderkey") % 2 == 0).select("o_custkey", "o_orderstatus"), o.filter(F.col("o_orderkey") % 2 == 1).select("o_custkey", "o_orderstatus"))


@query(
    "WITH h AS (SELECT CAST(greatest(0, least(255, floor((embedding[1] + 1) * 127.5))) AS INTEGER) AS v, count(*) AS n FROM embeddings GROUP BY ALL), c AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS w0, sum(n * v) OVER (ORDER BY v) AS s0, sum(n) OVER () AS w, sum(n * v) OVER () AS s FROM h), b AS (SELECT v, w0 * (w - w0) * power(s0 / w0 - (s - s0) / (w - w0), 2) AS between_var FROM c WHERE w0 < w) SELECT v AS threshold FROM b ORDER BY between_var DESC, v LIMIT 1"
)
def otsu_threshold(spark, sf_dir):
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.get("embedding", F.lit(0)) + 1) * 127.5))).cast("int")
    return raster.otsu(table(spark, sf_dir, "embeddings").groupBy(v.alias("v")).agg(F.count("*").alias("n"))).select("threshold")


# ---- alignment ----------------------------------------------------------------------------------


def _top_pairs(spark, sf_dir, k: int):
    rules, reads = _sides(spark, sf_dir)
    pairs = _pairs(rules, reads, k).select("rule_id", "reading_id")
    left = rules.select(F.col("id").alias("rule_id"), F.col("raw").alias("rule_raw"), F.col("tokens").alias("rule_tokens"))
    right = locate.chosen(reads, pairs).select(F.col("id").alias("reading_id"), F.col("raw").alias("reading_raw"), F.col("tokens").alias("reading_tokens"))
    # few rows of much work: dealt over all cores
    return pairs.join(left, "rule_id").join(right, "reading_id").repartition(spark.sparkContext.defaultParallelism, "rule_id", "reading_id")


@query()
def inside_similarity(spark, sf_dir):
    """Edits in tokens of each required text against the closest stretch of its ten best readings."""
    return align.similarities(_top_pairs(spark, sf_dir, 10), ["rule_id", "reading_id"], "rule_tokens", "reading_tokens")


@query()
def align_ops(spark, sf_dir):
    """What the best aligned of each required text's ten readings has the same, different, missing and extra."""
    rows = align.aligned(_top_pairs(spark, sf_dir, 10), ["rule_id", "reading_id"], "rule_tokens", "reading_tokens")
    rows = tokens.top(rows, ["rule_id"], [F.desc("n_same"), F.desc("quality"), F.asc("reading_id")], 1)
    n = lambda k: F.size(F.filter("ops", lambda o: o["kind"] == k)).alias(k)
    return rows.select("rule_id", "reading_id", "coverage", *(n(k) for k in ("same", "replace", "uncertain", "missing", "extra")), F.size(F.filter("ops", lambda o: o["anchored"])).alias("anchored"))


@query()
def score_lines(spark, sf_dir):
    """Character, word, number, mark and letter errors of each required text against its ten best readings."""
    rows = _top_pairs(spark, sf_dir, 10).groupBy("rule_id").agg(F.min("rule_raw").alias("line"), F.sort_array(F.collect_list("reading_raw")).alias("readings"))
    return align.score_lines(rows, ["rule_id"], "line", "readings")


@query()
def score_totals(spark, sf_dir):
    """Errors of all required texts against all readings, in all and by what a text is like, with rates in per cent and the texts missed whole."""
    line = F.coalesce("text", F.lit(""))
    n = F.size(T.phrase_tokens(line))
    tags = F.array_compact(F.array(F.when(n < 25, "short").when(n < 60, "middle").otherwise("long"), F.when(line.rlike(r"\d"), "numbers"), F.when(line.rlike("[()%:;]"), "marks")))
    lines = table(spark, sf_dir, "benchmark").select("text", tags.alias("tags"))
    # the totals read the scores twice
    scores = kept(nearest.scored(lines, ["tags"], "text", _docs(spark, sf_dir).select(F.col("text").alias("raw"))), "scores")
    rates = [align.rate(F.col(f"{c}_errors"), F.col(f"{c}s")).alias(f"{c}_rate") for c in ("character", "word", "letter", "number", "mark", "token")]
    return align.totals(scores, "tags").select("tag", "lines", "missed", "characters", "character_errors", "tokens", "token_errors", *rates)


_LCS = """list_reduce(list_prepend(list_transform(range(0, len(b) + 1), lambda x: CAST(0 AS BIGINT)), list_transform(a, lambda t: [CAST(t AS BIGINT)])),
 lambda prev, x: list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, len(b) + 1), lambda j: [CAST(j AS BIGINT)])), lambda cur, j: list_append(cur, CASE WHEN b[j[1]] = x[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], cur[len(cur)]) END)))"""


@query(f"WITH p AS (SELECT o_custkey, list(o_orderkey % 13 ORDER BY o_orderkey) AS a, list(CAST(floor(o_totalprice) AS BIGINT) % 13 ORDER BY o_orderkey) AS b FROM orders GROUP BY o_custkey) SELECT o_custkey, CAST(list_last({_LCS}) AS INTEGER) AS common FROM p")
def token_lcs(spark, sf_dir):
    seq = lambda v: F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", (v % 13).cast("bigint").alias("v")))), lambda x: x["v"])
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(seq(F.col("o_orderkey")).alias("a"), seq(F.floor("o_totalprice")).alias("b"))
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    return rows.select("o_custkey", T.lcs_length(text(F.col("a")), text(F.col("b"))).alias("common"))


# ---- requirement documents ----------------------------------------------------------------------


@query(
    """WITH r AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT 'doc' || n_regionkey AS doc, CAST(k AS INTEGER) AS row_ix, CASE WHEN n_regionkey % 2 = 0 THEN 'Раздел ' || n_nationkey ELSE n_name END AS title, 'не менее ' || (n_nationkey + 1) || ' мм' AS "constraint", CASE WHEN n_regionkey % 2 = 0 THEN CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE n_name END ELSE 'Раздел ' || n_nationkey END AS text, n_regionkey % 2 = 0 AND n_nationkey % 7 = 0 AS source_review FROM r WHERE n_regionkey % 2 = 0
UNION ALL SELECT 'doc' || n_regionkey, CAST(k AS INTEGER), 'Раздел ' || n_nationkey, 'не менее ' || (n_nationkey + 1) || ' мм', n_name, false FROM r WHERE n_regionkey % 2 = 1"""
)
def table_rules(spark, sf_dir):
    """Nations as tables of requirements, one per region: with heads in another order for even regions, without for odd ones."""
    n = table(spark, sf_dir, "nation")
    even = F.col("n_regionkey") % 2 == 0
    name = F.when(even & (F.col("n_nationkey") % 7 == 0), "").otherwise(F.col("n_name"))
    title, cond = F.concat(F.lit("Раздел "), F.col("n_nationkey")), F.concat(F.lit("не менее "), F.col("n_nationkey") + 1, F.lit(" мм"))
    row = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    body = n.select(F.concat(F.lit("doc"), "n_regionkey").alias("doc"), row.alias("row_ix"), F.when(even, F.array(name, cond, title)).otherwise(F.array(title, cond, name)).alias("r"))
    heads = n.select("n_regionkey").distinct().select(F.concat(F.lit("doc"), "n_regionkey").alias("doc"), F.lit(0).alias("row_ix"), F.when(even, F.array(*map(F.lit, ("Текст надписи", "Требования", "Раздел")))).otherwise(F.array(*map(F.lit, ("1", "2", "3")))).alias("r"))
    cells = body.unionByName(heads).select("doc", F.lit(0).alias("table_ix"), "row_ix", F.posexplode("r").alias("col_ix", "text"))
    return requirements.table_rules(cells).select("doc", "row_ix", "title", "constraint", "text", "source_review")


@query(
    """WITH s AS (SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section, turn, text FROM conversations)
SELECT conv_id, CAST(section AS BIGINT) AS section, count(*) AS n_rows, string_agg(text, chr(10) ORDER BY turn, text) AS section_text FROM s GROUP BY ALL"""
)
def section_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return requirements.section_fold(rows, ["conv_id"], "turn", F.col("role") == "user", "text")


@query(
    """WITH c AS (SELECT conv_id, turn, role = 'user' AS u, CASE WHEN role = 'user' THEN [regexp_replace(text, '\\s+', ' ', 'g')] ELSE string_split(text, chr(10)) END AS ls FROM conversations),
l AS (SELECT conv_id, turn, u, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM c),
f AS (SELECT conv_id, min(turn) FILTER (u) AS first_user, min(turn) AS first FROM c GROUP BY conv_id),
s AS (SELECT l.*, CAST(sum(CASE WHEN u THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, k) + CASE WHEN coalesce(first_user > first, true) THEN 1 ELSE 0 END AS BIGINT) AS section FROM l JOIN f USING (conv_id)),
g AS (SELECT conv_id, section, min(CASE WHEN u THEN trim(line) END) AS head, coalesce(string_agg(CASE WHEN NOT u AND trim(line) <> '' THEN trim(line) END, chr(10) ORDER BY turn, k), '') AS text FROM s GROUP BY ALL)
SELECT conv_id AS doc, section AS section_ord, coalesce(head, 'Текст этикетки') AS title, '' AS "constraint", text, false AS extra, text = '' AS source_review FROM g"""
)
def paragraph_rules(spark, sf_dir):
    """Conversations as marked documents: a user's turn is a section, any other its text."""
    c = table(spark, sf_dir, "conversations")
    text = F.when(F.col("role") == "user", F.concat(F.lit("Раздел: "), F.regexp_replace("text", r"\s+", " "))).otherwise(F.concat(F.lit("Текст: "), "text"))
    return requirements.paragraph_rules(c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), text.alias("text"), F.lit(False).alias("heading")))


_BARE = S.rr(S.rr(S.rr(S.rr("html", r"(?is)<script\b.*?</script\s*>", ""), r"(?is)<style\b.*?</style\s*>", ""), r"(?is)<title\b.*?</title\s*>", ""), r"(?s)<!--.*?-->", "")
_BLOCKS = S.rr(_BARE, r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|nav|article|footer|header|body|html|head|tr|td|table|section)\b[^>]*>", chr(1))


@query(
    f"""WITH b AS (SELECT page_id, list_filter(list_transform(string_split({_BLOCKS}, chr(1)), lambda x: trim({S.rr(S.rr('x', '<[^>]*>', ''), S.X.WS + '+', ' ')})), lambda x: x <> '') AS f FROM pages)
SELECT page_id, CAST(unnest(range(len(f))) AS INTEGER) AS ord, unnest(f) AS text FROM b"""
)
def html_extract(spark, sf_dir):
    """Text blocks of pages by patterns alone."""
    return documents.markup_blocks(table(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT o_custkey, '<tr><td>' || o_orderkey || '</td><td>' || replace(replace(o_orderpriority, '&', '&amp;'), '<', '&lt;') || '</td></tr>' AS html FROM orders")
def report_rows(spark, sf_dir):
    return reports.html_rows(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey", "o_orderpriority"])


@query(
    "SELECT event_type, sum(value) FILTER (d = 0) AS \"0\", sum(value) FILTER (d = 1) AS \"1\", sum(value) FILTER (d = 2) AS \"2\" FROM (SELECT event_type, event_id % 3 AS d, floor(sum(value)) AS value FROM events GROUP BY ALL) GROUP BY event_type"
)
def pivot_methods(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 3).alias("d")).agg(F.floor(F.sum("value")).cast("double").alias("v"))
    return reports.pivoted(rows, ["event_type"], "d", [0, 1, 2], "v")


# ---- places around words --------------------------------------------------------------------------


def _placed_words(spark, sf_dir):
    """Words of a document laid out on a page: 12 a line, a fortieth of the page high."""
    w = tokens.word_rows(_docs(spark, sf_dir), "doc_id", "text")
    box = G.box(F.col("col") * 0.08, F.col("line") * 0.03, F.least(F.lit(0.07), F.char_length("word") * 0.006), F.lit(0.025))
    return w.withColumn("box", box)


@query(
    f"WITH {_WORDS}, p AS (SELECT doc_id, word_ix, (word_ix % 12) * 0.08 AS x, (word_ix // 12) * 0.03 AS y, least(0.07, length(word) * 0.006) AS w FROM u), "
    "n AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(w) OVER o AS pw FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY word_ix)), "
    "c AS (SELECT doc_id, sum(CASE WHEN px IS NOT NULL AND ((abs(y - py) < 0.65 * 0.025 AND x - px - pw < 6 * 0.025) OR (y >= py AND y - py - 0.025 < 2.5 * 0.025 AND x <= px + pw)) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY word_ix) AS chain FROM n) "
    "SELECT doc_id, CAST(chain AS BIGINT) AS chain, count(*) AS n_words FROM c GROUP BY ALL"
)
def reading_chains(spark, sf_dir):
    return layout.chains(_placed_words(spark, sf_dir), ["doc_id"]).groupBy("doc_id", "chain").agg(F.count("*").alias("n_words"))


@query("SELECT conv_id, max(CASE WHEN regexp_matches(text, '[A-Za-z]{5,}|[A-Za-z]{3,}\\s+[A-Za-z]{3,}') THEN 'rus+eng' ELSE 'rus' END) AS languages FROM conversations GROUP BY conv_id")
def reading_languages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sheet_id"), "text")
    return layout.languages(rows).withColumnRenamed("sheet_id", "conv_id")


@query(
    """WITH a AS (SELECT doc_id AS id, quality AS text FROM labels), b AS (SELECT doc_id AS id, length(text) % 7 AS status FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(a.id, b.id) AS id, a.text, b.status, CASE WHEN b.status IS NULL THEN 'not observed' WHEN a.text IS NULL THEN 'no reference' END AS gap FROM a FULL JOIN b ON a.id = b.id"""
)
def audit_join(spark, sf_dir):
    ref = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("text"))
    seen = _docs(spark, sf_dir).filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), (F.char_length("text") % 7).cast("long").alias("status"))
    return layout.audit(ref, seen)


@query(
    "SELECT user_id, event_type, value AS v, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1"
)
def latest_reviews(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("sheet_id"), F.col("event_type").alias("rule_id"), F.col("value").alias("v"), "event_id", F.lit(True).alias("not_applicable"), F.lit("seen").alias("note"))
    return layout.latest_reviews(rows, "event_id").select(F.col("sheet_id").alias("user_id"), F.col("rule_id").alias("event_type"), "v", "event_id")


@query(
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1"
)
def surest_reading(spark, sf_dir):
    return readings.supersede(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "value", "event_id").select("user_id", "event_id", "value")


_ATTEMPTS = """
o AS (SELECT l_orderkey AS s, l_linenumber AS i, min(l_partkey) AS p, min(l_suppkey) AS q, CAST(min(l_quantity) AS BIGINT) % 4 + 1 AS n FROM lineitem GROUP BY ALL),
t AS (SELECT s, i, q % 60 + 40e0 AS c, p % 4 AS k, CASE WHEN p % 3 > 0 THEN p // 4 % 2 END AS specks, CASE p % 4 WHEN 0 THEN n || ' мм' WHEN 1 THEN n || ',5 мм' WHEN 2 THEN '0' || n || ' мм' ELSE 'часть ' || n END AS raw,
  CASE p % 4 WHEN 0 THEN 'height ' || n WHEN 1 THEN 'height ' || n || '.5' WHEN 2 THEN 'unreadable' ELSE '' END AS said FROM o),
r AS (SELECT *, CASE WHEN k < 2 AND specks IS NOT NULL THEN specks = k END AS agree FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY CASE WHEN k = 3 THEN 0 WHEN k = 2 THEN 1 WHEN coalesce(agree, false) THEN 3 ELSE 2 END * 1000 + c DESC, i) AS rn FROM r)
"""


@query(f"WITH {_ATTEMPTS} SELECT b.s AS l_orderkey, b.raw, b.c AS confidence, b.agree AS marks_agree, CAST((SELECT count(*) FROM r WHERE r.s = b.s AND r.said = b.said) AS INTEGER) AS reads FROM b WHERE rn = 1")
def callout_readings(spark, sf_dir):
    """Of an order's lines as attempts at one callout the best: readable, marks as the ink has specks, surest, first; and how many say the same."""
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("i")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("q"), F.min("l_quantity").cast("long").alias("l"))
    n, k = (F.col("l") % 4 + 1).cast("string"), F.col("p") % 4
    raw = F.when(k == 0, F.concat(n, F.lit(" мм"))).when(k == 1, F.concat(n, F.lit(",5 мм"))).when(k == 2, F.concat(F.lit("0"), n, F.lit(" мм"))).otherwise(F.concat(F.lit("часть "), n))
    tries = one.select(F.col("s").alias("sheet_id"), F.lit(0).alias("callout_ix"), F.col("i").alias("attempt"), raw.alias("raw"), (F.col("q") % 60 + 40.0).alias("confidence"), F.when(F.col("p") % 3 > 0, (F.floor(F.col("p") / 4) % 2).cast("int")).alias("separators"))
    return callouts.best_reading(tries).select(F.col("sheet_id").alias("l_orderkey"), "raw", "confidence", "marks_agree", "reads")


@query()
def assess_rows(spark, sf_dir):
    """The core plan: each required text judged on each of its ten best documents, whose words get a made-up confidence."""
    rules, reads = _sides(spark, sf_dir)
    pairs = _pairs(rules, reads, 10).select("rule_id", F.col("reading_id").alias("sheet_id"))
    text = rules.select(F.col("id").alias("rule_id"), F.col("raw").alias("text"))
    table_ = pairs.join(text, "rule_id").select("sheet_id", "rule_id", F.lit("Текст").alias("title"), F.lit("").alias("constraint"), F.col("text").alias("original"), "text")
    docs = _docs(spark, sf_dir).join(pairs.select(F.col("sheet_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    w = tokens.word_rows(docs, "doc_id", "text")
    words = w.select(F.col("doc_id").alias("sheet_id"), "word_ix", F.lit("a").alias("pass"), F.col("word").alias("text"), (60 + F.col("word_ix") * 7 % 40).cast("double").alias("confidence"))
    return assess.assess(table_, words).drop("expected")


from . import place_queries, print_queries, rule_queries  # noqa: E402,F401  register their queries
