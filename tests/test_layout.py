"""Reading order and the places around phrases."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from concord.operators import layout
from concord.plans.queries import ORACLES, QUERIES

from .test_functions import value  # noqa: F401

B = "struct<x:double,y:double,w:double,h:double>"


def test_reading_order(spark):
    # two columns of three rows, a row in two pieces, and a lone piece that continues a justified row
    boxes = [(0, 0, 40, 10), (100, 0, 140, 10), (0, 12, 20, 22), (24, 12, 40, 22), (100, 12, 140, 22), (0, 24, 40, 34), (100, 24, 115, 34), (130, 24, 140, 34)]
    order = layout.order_lines(np.array(boxes, float), 0)
    assert [i for i, _, _ in order] == [0, 2, 3, 5, 1, 4, 6, 7]
    assert [b for _, _, b in order] == [0] * 4 + [1] * 4 and order[1][1] == order[2][1] and order[-1][1] == order[-2][1]
    turned = [(x0, 200 - b, y1, 200 - a) for a, x0, b, y1 in boxes]  # the same page a quarter turn round
    assert [i for i, _, _ in layout.order_lines(np.array([(a, b, c, d) for a, b, c, d in turned], float), 90)] == [0, 2, 3, 5, 1, 4, 6, 7]
    df = spark.createDataFrame([("s", i, 0, (float(a), float(b), float(c - a), float(d - b))) for i, (a, b, c, d) in enumerate(boxes)], f"sheet_id string, line_ix long, rotation int, box {B}")
    assert [r.line_ix for r in layout.reading_order(df).orderBy("pos").collect()] == [0, 2, 3, 5, 1, 4, 6, 7]


def test_respaced():
    target = "срок годности двенадцать месяцев".split()
    assert layout.respaced(target, ["срокгодности", "двенад", "цать", "12", "месяцев"]) == ["срок", "годности", "двенадцать", "12", "месяцев"]
    assert layout.respaced(["12", "34"], ["1234"]) == ["1234"]


def test_frames(spark, value):  # noqa: F811
    for turn in (0, 90, 180, 270):
        b = F.struct(*(F.lit(v).alias(n) for n, v in zip("xywh", (0.1, 0.2, 0.3, 0.25))))
        f = layout.turned_frame(b, F.lit(turn), F.lit(200.0), F.lit(100.0))
        back = value(layout.page_box(f["a0"], f["a1"], f["c0"], f["c1"], F.lit(turn), F.lit(200.0), F.lit(100.0)))
        assert [round(back[k], 9) for k in "xywh"] == [0.1, 0.2, 0.3, 0.25]


def test_gaps(spark):
    gaps = spark.createDataFrame([("s", 0, (0.1, 0.1, 0.1, 0.02), (0.4, 0.1, 0.1, 0.02), 0), ("s", 1, (0.1, 0.5, 0.1, 0.02), (0.4, 0.5, 0.1, 0.02), 0)], f"sheet_id string, gap_ix int, before {B}, after {B}, rotation int")
    words = spark.createDataFrame([("s", (0.25, 0.1, 0.1, 0.02), 0, 50.0, "слово"), ("s", (0.25, 0.5, 0.1, 0.02), 0, 10.0, "слово"), ("s", (0.11, 0.5, 0.09, 0.02), 0, 90.0, "ещё")], f"sheet_id string, box {B}, rotation int, confidence double, text string")
    assert [r.gap_ix for r in layout.unread_gaps(gaps, words).collect()] == [0]


def test_gaps_of_exactly_half_a_word_as_sql(spark, tmp_path):
    # the first word of each sheet lies half on the one before the gap: the SQL's rounding takes it for the same word
    rows = [(1, 1, 17285, 864, 4.0, 0.03, 0.06), (1, 5, 3864, 150, 2.0, 0.03, 0.06), (1, 6, 10660, 838, 28.0, 0.09, 0.03)]
    rows += [(2, 4, 13880, 18, 4.0, 0.02, 0.02), (2, 2, 7397, 462, 2.0, 0.02, 0.02), (2, 3, 4874, 224, 29.0, 0.09, 0.05)]
    rows += [(3, 1, 50, 0, 10.0, 0.01, 0.02), (3, 2, 50, 0, 10.0, 0.05, 0.02), (3, 3, 50, 0, 10.0, 0.03, 0.02)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in QUERIES["unread_gaps"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert got == set(con.execute(ORACLES["unread_gaps"]).fetchall()) == {(3, 1)}


def test_refinement(spark):
    m = [("s", "r0", False, 60, 0, [(0.1, 0.1, 0.1, 0.02), (0.21, 0.1, 0.1, 0.02)], [5, 5], "layout"), ("s", "r1", False, 60, 0, [(0.1, 0.1, 0.1, 0.02), (0.21, 0.1, 0.1, 0.02)], [5, 5], "words"), ("s", "r2", True, 100, 0, [], [], "layout"), ("s", "r3", False, 50, 90, [(0.7, 0.1, 0.02, 0.1), (0.7, 0.3, 0.02, 0.1)], [4, 4], "layout")]
    df = spark.createDataFrame(m, f"sheet_id string, rule_id string, exact boolean, coverage int, rotation int, boxes array<{B}>, chars array<int>, method string")
    rows = layout.refinement_areas(df).orderBy("rule_id").collect()
    assert [(r.rule_id, r.priority) for r in rows] == [("r0", 0), ("r3", 1)] and rows[0].area.x < 0.1


def test_edges(spark):
    e = spark.createDataFrame([("s", 0, "trailing", (0.5, 0.5, 0.1, 0.02), 5, 6, 0, 20.0, 100.0, 600.0, 1000.0, 1000.0)], f"sheet_id string, place_ix int, side string, anchor {B}, chars int, missing_chars int, rotation int, letter double, `from` double, `to` double, width double, height double")
    place = layout.edge_places(e).withColumn("expected", F.array(F.lit("годности")))
    areas = place.first()["areas"]
    assert len(areas) == 2 and areas[0].x > 0.6 and areas[1].y > 0.52
    sure = lambda text, blank: spark.createDataFrame([("s", i, tuple(a), 0, blank, text, 95.0) for i, a in enumerate(areas)], f"sheet_id string, probe_ix int, box {B}, rotation int, blank boolean, text string, confidence double")
    words = lambda t: spark.createDataFrame([("s", t, 90.0)], "sheet_id string, text string, confidence double")
    got = lambda p, w: tuple(layout.settled_edges(place, p, w).first())[2:4]
    assert got(sure("", True), words("иное")) == (True, True)
    assert got(sure("другие слова", False), words("иное")) == (True, False)
    assert got(sure("годности", False), words("иное"))[0] is False
    assert got(sure("", True), words("годности"))[0] is False


def test_beside(spark):
    phrases = spark.createDataFrame([("s", "r0", 0, (0.3, 0.1, 0.1, 0.02), (0.41, 0.1, 0.1, 0.02))], f"sheet_id string, rule_id string, rotation int, first {B}, last {B}")
    schema = f"sheet_id string, word_ix int, pass string, text string, confidence double, rotation int, box {B}"
    words = [("s", 0, "a", "не", 95.0, 0, (0.25, 0.1, 0.04, 0.02)), ("s", 1, "a", "слабо", 80.0, 0, (0.515, 0.1, 0.08, 0.02)), ("s", 2, "a", "иное", 95.0, 0, (0.25, 0.5, 0.04, 0.02))]
    taken = spark.createDataFrame([("s", (0.3, 0.1, 0.1, 0.02)), ("s", (0.41, 0.1, 0.1, 0.02))], f"sheet_id string, box {B}")
    got = lambda w: sorted((r.side, r.text) for r in layout.beside(phrases, spark.createDataFrame(w, schema), taken).collect())
    assert got(words) == [("before", "не")]
    assert got(words + [("s", 3, "b", "СЛАБО", 80.0, 0, (0.515, 0.1, 0.08, 0.02))]) == [("after", "слабо"), ("before", "не")] or got(words + [("s", 3, "b", "СЛАБО", 80.0, 0, (0.515, 0.1, 0.08, 0.02))])[0][0] == "after"


def test_small_joins(spark):
    g = "array<struct<text:string,height:double>>"
    found = spark.createDataFrame([("s", 0, "Вода", (0.1, 0.1, 0.1, 0.02), 50.0, [])], f"sheet_id string, word_ix int, text string, box {B}, confidence double, glyphs {g}")
    every = spark.createDataFrame([("s", 9, "вода", (0.1, 0.1, 0.1, 0.02), 90.0, [("в", 1.0), ("о", 1.0)])], f"sheet_id string, word_ix int, text string, box {B}, confidence double, glyphs {g}")
    assert len(layout.substitutes(found, every).first()["glyphs"]) == 2
    s = spark.createDataFrame([("s", "r", "Срок годности 5", 90), ("s", "r", "прочее", 90), ("s", "r", "Срок", 10)], "sheet_id string, rule_id string, text string, coverage int")
    c = spark.createDataFrame([("s", "r", 0, "срока годности"), ("s", "r", 1, "остальной текст")], "sheet_id string, rule_id string, check_ix int, scope string")
    assert sorted((r.check_ix, r.sentences) for r in layout.assigned(s, c).collect()) == [(0, ["Срок годности 5"]), (1, ["прочее"])]
    d = spark.createDataFrame([("s", "r", 0, (0.1, 0.1, 0.2, 0.02))], f"sheet_id string, rule_id string, rotation int, box {B}")
    w = spark.createDataFrame([("s", 0, "01.02.2024", 90.0, 0, (0.31, 0.1, 0.1, 0.02)), ("s", 1, "4600000000001", 90.0, 0, (0.31, 0.1, 0.1, 0.02)), ("s", 2, "7", 90.0, 0, (0.1, 0.9, 0.1, 0.02))], f"sheet_id string, word_ix int, text string, confidence double, rotation int, box {B}")
    assert tuple(layout.dates(d, w).first())[2:] == ("01.02.2024", 1)
    v = lambda *x: spark.createDataFrame(list(x), "rule_id string, verdict string, reading string")
    r = layout.compared_sections(v(("a", "", "")), v(("a", "match", "40 %")), v(("a", "match", "45 %"))).first()
    assert (r.verdicts_differ, r.numbers_differ) == (False, True)
    words = spark.createDataFrame([(0, (0.1, 0.1, 0.1, 0.02)), (1, (0.21, 0.1, 0.1, 0.02)), (2, (0.1, 0.13, 0.1, 0.02)), (3, (0.8, 0.8, 0.1, 0.02))], f"word_ix int, box {B}").withColumn("p", F.lit(1))
    assert [r.chain for r in layout.chains(words, ["p"]).orderBy("word_ix").collect()] == [1, 1, 1, 2]
