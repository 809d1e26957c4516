"""Alignment settled by print, and readings and areas by place."""

import random

import numpy as np
from pyspark.sql import functions as F

from concord.operators import align, layout, places
from concord.plans.assess import assess, confirmed

from .test_functions import value  # noqa: F401

B = "struct<x:double,y:double,w:double,h:double>"


def kinds(ops):
    return [(o["kind"], o["expected"], o["actual"]) for o in ops]


def row(*starts, y=0.0, w=8.0, h=2.0):
    return [(s, s + w, y, y + h) for s in starts]


def test_a_word_read_twice_is_one_word():
    boxes = np.array(row(0, 10) + row(10.5) + row(20))
    ops = align.operations("вода питьевая чистая".split(), "вода питьевая питьевая чистая".split(), [90] * 4, boxes)
    assert [o["kind"] for o in ops] == ["same"] * 3
    assert [o["kind"] for o in align.operations("вода питьевая чистая".split(), "вода питьевая питьевая чистая".split())].count("extra") == 1


def test_words_beside_the_phrase_are_no_differences():
    target = "хранить в сухом прохладном месте вдали от света".split()
    tokens = "хранить в сухом прохладном знак месте вдали от света".split()
    first, second = row(0, 10, 20, 30), row(0, 10, 20, 30, y=3.0)
    aside = np.array(first + row(60) + second)  # far right of the column, the phrase goes on below
    assert "extra" not in [o["kind"] for o in align.operations(target, tokens, [90] * 9, aside)]
    inside = np.array(row(0, 10, 20, 30) + row(40) + second)  # at a word space: a word really added
    assert [o["actual"] for o in align.operations(target, tokens, [90] * 9, inside) if o["kind"] == "extra"] == ["знак"]


def test_pairs_splits_and_weak_numbers():
    assert kinds(align.operations(["вода", "питьевая", "чистая"], ["вода", "столовая", "чистая"]))[1] == ("replace", "питьевая", "столовая")
    step = lambda e, a, i: {"kind": "replace", "expected": e, "actual": a, "anchored": False, "at": i}
    d = align.differences([step("е33", "езз", 0), step("0", "о", 1)], [90, 90])
    assert [(x["kind"], x["expected"], x["confidence"]) for x in d] == [("uncertain", "е33 0", 0.0)]
    d = align.differences([step("е330", "езз", 0), {**step("соль", None, None), "kind": "missing"}], [90, 90])
    assert [x["kind"] for x in d] == ["replace", "missing"]
    line = ["крепость", "40", "градусов"]
    sure, weak = align.operations(line, line, [90, 90, 90]), align.operations(line, line, [90, 60, 90])
    assert [o["kind"] for o in sure] == ["same"] * 3 and weak[1]["kind"] == "uncertain"
    # a letter is never a misread number, nor a number a misread word
    assert ("replace", "з", "3") not in kinds(align.operations(["а", "з"], ["а", "3"])) or align._related(["з"], ["3"])[0, 0] == 1
    ops = align.operations("один два три".split(), "один три".split())
    assert ops[1]["anchored"] and ops[1]["between"] == (0, 1)


def test_respaced_over_random_cuts():
    r = random.Random(3)
    words = ["".join(r.choice("абвгдежз") for _ in range(r.randint(4, 7))) for _ in range(40)]
    for _ in range(200):
        target = r.sample(words, 8)
        cut, j = [], 0
        while j < 8:
            if r.random() < 0.3 and j < 7:
                cut.append(target[j] + target[j + 1])
                j += 2
            elif r.random() < 0.3:
                k = r.randint(1, len(target[j]) - 1)
                cut += [target[j][:k], target[j][k:]]
                j += 1
            else:
                cut.append(target[j])
                j += 1
        got = layout.respaced_from(target, cut)
        assert [t for t, _, _ in got] == target
        assert all(i <= k for _, i, k in got) and got[0][1] == 0 and got[-1][2] == len(cut) - 1


def sheet(spark, items):
    return spark.createDataFrame(items, f"sheet_id string, word_ix int, pass string, text string, confidence double, box {B}")


def test_print_around_a_phrase_decides(spark):
    """One sheet for each case: nothing in the gap, unread print in it, a word beside an exact phrase, a second engine, a size by hand."""
    texts = {"r0": "хранить в сухом прохладном месте", "r1": "вода сахар соль", "r3": "масса 5 л", "r4": "вода"}
    rules = [(s, r, "Предупреждение" if r == "r4" else "Прочее", "площадь не менее 10 %" if r == "r4" else "", t, t) for s in "abcde" for r, t in texts.items()]
    rules = spark.createDataFrame(rules, "sheet_id string, rule_id string, title string, `constraint` string, original string, text string")

    def words(s, gap, extra=(), weak=""):
        line = [("хранить", 0.1, 0.1), ("в", 0.2, 0.1), ("сухом", 0.25, 0.1), ("месте", gap, 0.1), ("вода", 0.1, 0.3), ("сахар", 0.2, 0.3), ("соль", 0.3, 0.3), ("масса", 0.1, 0.7), ("5", 0.2, 0.7), ("дм3", 0.25, 0.7)]
        return [(s, i, "a", t, 60.0 if t == weak else 95.0, (x, y, 0.04 if len(t) < 3 else 0.09, 0.02)) for i, (t, x, y) in enumerate(line)] + [(s, *e) for e in extra]

    print_ = words("a", 0.36) + words("b", 0.55, [(50, "b", "нечётко", 40.0, (0.4, 0.1, 0.09, 0.02))]) + words("c", 0.36, [(51, "a", "перец", 95.0, (0.395, 0.3, 0.09, 0.02))]) + words("e", 0.36)
    # in sheet d the first engine has one word weakly wrong, the second reads the whole phrase there
    read = "хранить в сухом прохладном мести".split()
    print_ += [("d", i, "a", t, 60.0 if t == "мести" else 95.0, (0.1 + 0.1 * i, 0.1, 0.09, 0.02)) for i, t in enumerate(read)]
    second = [("d", i, "z", t, 95.0, (0.1 + 0.1 * i, 0.1, 0.09, 0.02)) for i, t in enumerate("хранить в сухом прохладном месте".split())]
    measured = spark.createDataFrame([("a", "r4", 0, 8.0, 0.1, True), ("b", "r4", 0, 8.0, 0.1, False)], "sheet_id string, rule_id string, check_ix int, value double, step double, by_hand boolean")
    rows = assess(rules, sheet(spark, print_), second=sheet(spark, second), measured=measured).collect()
    got = {(r.sheet_id, r.rule_id): (r.comparison, r.sure, r.status_label) for r in rows}
    assert got["a", "r0"] == ("partial", True, "Отличие текста")  # nothing between the neighbours: the word is not there
    assert got["b", "r0"] == ("uncertain", False, "Спорно")  # unread print in the gap: nothing is asserted
    assert got["a", "r3"] == ("found", False, "Другая запись единицы")
    assert got["a", "r1"][0] == "found" and got["c", "r1"] == ("uncertain", False, "Спорно")
    assert got["e", "r0"] == ("partial", True, "Отличие текста") and got["d", "r0"][:2] == ("found", False)  # token by token the second engine settles the weak word
    assert {(r.sheet_id, r.rule_id): r.resolved for r in rows}["d", "r0"] == 1
    status = {(r.sheet_id, r.rule_id): r.status for r in rows}
    assert status["a", "r4"] == "error" and status["b", "r4"] == "issue"


def test_second_engine_confirms(spark):
    b = lambda x: {"x": x, "y": 0.1, "w": 0.3, "h": 0.02}
    diff = "array<struct<kind:string,expected:string,actual:string,confidence:double,anchored:boolean>>"
    shape = f"sheet_id string, rule_id string, exact boolean, coverage int, diff {diff}, boxes array<{B}>"
    d = lambda c: [("uncertain", "а", "б", c, False)]
    first = spark.createDataFrame([("s", r, False, cov, d(c), [b(0.1)]) for r, cov, c in (("r0", 95, 10.0), ("r1", 80, 10.0), ("r2", 95, 80.0), ("r3", 95, 10.0))], shape)
    second = spark.createDataFrame([("s", r, True, 100, [], [b(0.9 if r == "r3" else 0.12)]) for r in ("r0", "r1", "r2", "r3")], shape)
    assert {r.rule_id: (r.exact, len(r.diff)) for r in confirmed(first, second).collect()} == {"r0": (True, 0), "r1": (False, 1), "r2": (False, 1), "r3": (False, 1)}


def test_lines_taken_once(spark):
    r = random.Random(8)
    rows = [("s", i, r.choice([0, 90]), (r.random(), r.random(), 0.2 + r.random() / 3, 0.1 + r.random() / 5)) for i in range(60)]
    kept = []
    for _, i, turn, (x, y, w, h) in rows:
        if not any(t == turn and min(a + c, x + w) - max(a, x) > 0.5 * min(c, w) and min(b + d, y + h) - max(b, y) > 0.5 * min(d, h) for _, t, (a, b, c, d) in kept):
            kept.append((i, turn, (x, y, w, h)))
    df = spark.createDataFrame(rows, f"sheet_id string, line_ix int, rotation int, box {B}")
    assert sorted(x.line_ix for x in places.taken_once(df).collect()) == [k[0] for k in kept]


def test_clusters_of_near_boxes(spark):
    rows = [("s", 0, 0, "а", (0.1, 0.1, 0.1, 0.02)), ("s", 1, 0, "б", (0.102, 0.1, 0.1, 0.02)), ("s", 2, 0, "а", (0.16, 0.1, 0.1, 0.02)), ("s", 3, 0, "в", (0.16, 0.1, 0.1, 0.02)), ("s", 4, 90, "а", (0.1, 0.1, 0.1, 0.02)), ("s", 5, 0, "а", (0.1, 0.1, 0.3, 0.02))]
    df = spark.createDataFrame(rows, f"sheet_id string, word_ix int, rotation int, value string, box {B}")
    got = {x.word_ix: x.cluster for x in places.clustered(df).collect()}
    assert got[0] == got[1] and got[3] != got[0] and got[5] not in (got[0], got[3])
