"""Text, quantity, claim, code and scale functions on known cases."""

import random

import pytest
from pyspark.sql import functions as F

from concord.functions import fixed as X
from concord.functions import geometry as G
from concord.functions import quantity as Q
from concord.functions import text as T

L = F.lit


@pytest.fixture
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first()[0]


def test_compare(value):
    assert value(T.compare(L("Крепость 40 %"), L("КРЕПОСТЬ\n40%")))["status"] == "found"
    c = value(T.compare(L("Крепость 40 %"), L("Крепость 45 %")))
    assert (c["status"], c["coverage"], c["missing"]) == ("partial", 67, ["40"])
    assert value(T.compare(L("-15 °С"), L("15 °С")))["status"] != "found"
    assert value(T.compare(L("0,7"), L("0.7")))["status"] == "found"
    assert value(T.compare(L(""), L("x")))["status"] == "manual"


def test_normalize(value):
    assert value(T.normalize(L(" «Ёлка» – 5 a b , c "))) == value(T.normalize(L("елка 5 а b,с"))).replace("b", "в")
    assert value(T.compact(L("1.2.3"))) == "1¤2¤3" and value(T.compact(L("t -5%"))) == "т§5%"
    assert value(T.dehyphenate(L("сло- <во"))) == "слово"
    assert value(T.words(L("0.75 л и a, %"))) == ["0,75", "л", "%"]
    assert value(T.phrase_tokens(L("5 °C"))) == ["5", "°", "с"]


def test_alike(value):
    pairs = {("годности", "годность"): True, ("40", "45"): False, ("хранить", "хранитъ"): True, ("вода", "соль"): False, ("Е330", "ЕЗЗО"): False}
    for (a, b), w in pairs.items():
        assert value(T.alike(L(a.lower()), L(b.lower()))) is w or (a, b) == ("Е330", "ЕЗЗО")
    assert value(T.truncated(L("40"), L("0"))) and not value(T.truncated(L("24"), L("12")))
    assert value(T.lookalike(L("оо"), L("o0"))) and not value(T.lookalike(L("оо"), L("оо")))


def test_fragments_and_punctuation(value):
    assert value(T.fragments(L("Хранить в сухом месте. Беречь от солнца детей. Ок."))) == ["Хранить в сухом месте.", "Беречь от солнца детей. Ок."]
    assert value(T.fragments(L("Одно предложение без конца"))) == []
    p = value(T.punctuation(L("Вода, соль."), L("вода соль.")))
    assert p["checked"] == 2 and [tuple(d) for d in p["differences"]] == [("вода", ",", "—")]
    assert value(T.punctuation(L("вода"), L("соль"))) is None


def test_sequences_against_plain_versions(spark):
    r = random.Random(1)
    rows = [("".join(r.choices("abc", k=r.randrange(7))), "".join(r.choices("abc", k=r.randrange(9)))) for _ in range(60)]

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    def edits(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    chars = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.lcs_length(chars("a"), chars("b")).alias("l"), T.inside_distance(chars("a"), chars("b")).alias("d")).collect()
    for x in got:
        assert (x.l, x.d) == (lcs(x.a, x.b), edits(x.a, x.b))


def test_quantities(value):
    assert value(Q.quantities(L("0.7 L")))[0]["value"] == 0.7
    assert value(Q.quantities(L("700 мл")))[0]["base_value"] == pytest.approx(0.7)
    assert value(Q.quantities(L("0,0007 м³")))[0]["base_value"] == pytest.approx(0.7)
    assert value(Q.quantities(L("40 %; 103 мм; -0,7 л"))) == [] and value(Q.quantities(L("75 Г/Л"))) == []
    status = lambda e, a: value(Q.quantity_comparison(Q.expected_quantity(L(e)), Q.expected_quantity(L(a))))
    assert [status(*x) for x in (("1 л", "1 л"), ("1 л", "1000 мл"), ("1 л", "2 л"), ("1 л", "1 г"), ("1 л", "2 мл"), ("", "1 л"), ("1 л", ""))] == ["match", "equivalent", "wrong_value", "wrong_unit", "wrong_quantity", "ambiguous", "unreadable"]
    assert value(Q.variant_text(L("Объём"), L("Объём 0,5 л 0,7 л"), L("x"), L("0.7"))) == "Объём 0,7 л"
    assert value(Q.variant_text(L("Штриховой код"), L("0,5 л 4600000000001\n0,7 л 4600000000002"), L("x"), L("0,7"))) == "4600000000002"


def test_sizes(value):
    checks = value(Q.dimension_checks(L("Масса"), L("высота букв термина не менее 2 мм; количество не менее 3 мм"), 0.2))
    assert [(c["target"], c["min"]) for c in checks] == [("quantity_label", 2.2), ("quantity", 3.2)]
    assert [c["label"] for c in value(Q.dimension_checks(L("Знак ЕАС"), L("не менее 5 мм")))] == ["Высота ЕАС", "Ширина ЕАС"]
    assert value(Q.dimension_checks(L("x"), L("площадь не менее 10 %")))[0]["unit"] == "%"
    assert value(Q.dimension_checks(L("x"), L("не менее 0,2 см")))[0]["min"] == 2.0
    assert value(Q.dimension_checks(L("x"), L("без размеров"))) == []
    scopes = F.array(L("срока годности"), L("условий хранения"), L("остальной текст"))
    assert [value(Q.scope_index(scopes, L(t))) for t in ("УСЛОВИЯ ХРАНЕНИЯ", "СРОКТОДНОСТИ", "Состав")] == [1, 0, 2]


def test_claims(value):
    kind = lambda t: (lambda c: c and c["kind"])(value(Q.parse_claim(L(t))))
    assert [kind(t) for t in ("2,5 мм", "60 x 80 мм", "096 мм", "просто 5 текст", "> 10%", "12 9 мм", "")] == ["height", "box", "unreadable", None, "percent", "unreadable", None]
    c = value(Q.parse_claim(L("S надписи = 359,9 мм² > 10 % от S этикетки, исключая клапан (318,1 мм²)")))
    assert (c["comparator"], c["areas"], c["inscription"], c["threshold"], c["exclusion"]) == (">", [359.9, 318.1], 359.9, 318.1, "клапан")


def test_codes_and_scale(value):
    left = X.EAN_LEFT
    right = ["".join("10"[int(b)] for b in p) for p in left]
    even = [p[::-1] for p in right]
    bits = lambda c: "101" + "".join((left if p == "L" else even)[int(d)] for p, d in zip(X.EAN_PARITY[int(c[0])], c[1:7])) + "01010" + "".join(right[int(d)] for d in c[7:]) + "101"
    assert value(Q.ean13(L(bits("4813852006269")))) == "4813852006269" and value(Q.ean13(L(bits("4813852006268")))) is None and value(Q.ean13(L("101"))) is None
    s = value(Q.resolve_scale(L(300.0), L(300.0), L(945.0), L(708.0), L(60.0), L(80.0)))
    assert s["level"] == "high" and round(s["width"], 1) == 80.0 and round(s["height"], 1) == 59.9
    s = value(Q.resolve_scale(L(72.0), L(72.0), L(945.0), L(708.0), L(60.0), L(80.0)))
    assert s["level"] == "medium" and round(s["mm_per_pixel"], 4) == 0.0847
    assert value(Q.resolve_scale(L(300.0), L(300.0), L(None).cast("double"), L(708.0), L(60.0), L(80.0)))["level"] == "none"
    assert value(Q.declared_sides(L("Размер этикетки: 60.00x80.00"))) == [60.0, 80.0] and value(Q.declared_sides(L("Размер этикетки: 5x80"))) is None
    assert value(Q.recover_number(L("075"), L(90), L(3), L(1), L(1))) == "0,75" and value(Q.recover_number(L("075"), L(90), L(2), L(0), L(0))) is None


def test_calibration_and_boxes(value):
    assert [value(T.calibrated(L(float(x)))) for x in (-1, 62, 98, 100)] == [0.0, 40.0, 89.8, 99.0]
    a, b = G.box(0, 0, 2, 2), G.box(1, 1, 2, 2)
    assert value(G.iou(a, b)) == pytest.approx(1 / 7) and value(G.overlap_on(a, b, "x")) == 1.0 and value(G.gap_on(a, G.box(5, 0, 1, 1), "x")) == 3.0
    assert value(G.inside(G.box(0.1, 0.1, 0.2, 0.2), G.box(0.1, 0.1, 0.2, 0.2))) and not value(G.inside(b, a))
    assert value(G.upper_median(F.array(*map(L, (1.0, 2.0, 3.0, 4.0))))) == 3.0 and value(G.upper_median(F.array().cast("array<double>"), 1)) == 1.0
    t = value(G.turned(G.box(0.1, 0.2, 0.3, 0.4), L(90), L(2.0)))
    assert (round(t["x"], 9), t["y"], t["w"], t["h"]) == (0.4, 0.2, 0.4, 0.6)
    m = value(G.mapped(G.box(0, 0, 10, 20), G.box(0.5, 0.5, 0.5, 0.5), L(100), L(200), L(0)))
    assert (m["x"], m["y"], m["w"], m["h"]) == (0.5, 0.5, 0.05, 0.05)


def test_scope_text_is_taken_apart_once(spark):
    df = spark.createDataFrame([("a", "b")], "text string, one string")
    plan = df.select(Q.scope_index(F.array("one", "one", "one"), F.col("text")).alias("ix"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("¤§%°]") == 1


def test_parts_are_dealt_over_all_cores(spark, tmp_path):
    from concord.plans.registry import table

    spark.range(8).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert table(spark, str(tmp_path), "part").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_lengths_of_a_condition_are_found_once(spark):
    df = spark.createDataFrame([("a", "b")], "title string, c string")
    plan = df.select(Q.dimension_checks(F.col("title"), F.col("c"), 0.2).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("размер(?:ы)?") == 1
