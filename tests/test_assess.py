"""The core plan on a drawn sheet."""

from concord.plans.assess import assess, first_volume, ready

RULES = [
    ("s", "r0", "Наименование", "", "Водка особая", "Водка особая"), ("s", "r1", "Крепость", "", "Крепость 40 %", "Крепость 40 %"), ("s", "r2", "Объём", "", "0,5 л", "0,5 л"), ("s", "r3", "Знаки", "", "ЕАС", "ЕАС"),
    ("s", "r4", "Прочее", "", "-", "-"), ("s", "r5", "Хранение", "", "Хранить в сухом прохладном месте", "Хранить в сухом прохладном месте"), ("s", "r6", "Предупреждение", "площадь не менее 10 %", "Чрезмерное употребление вредит", "Чрезмерное употребление вредит"),
    ("s", "r7", "Адрес", "", "", ""), ("t", "r0", "Наименование", "", "Водка", "Водка"),
]


def test_assess(spark):
    rules = spark.createDataFrame(RULES, "sheet_id string, rule_id string, title string, `constraint` string, original string, text string")
    text = "водка особая крепость 45 % объём 0,5 л хранить в сухом месте чрезмерное употребление вредит".split()
    weak = {"месте": 40.0}
    words = [("s", i, "a", w, weak.get(w, 96.0), (0.05 * i, 0.1, 0.04, 0.02)) for i, w in enumerate(text)]
    words = spark.createDataFrame(words, "sheet_id string, word_ix int, pass string, text string, confidence double, box struct<x:double,y:double,w:double,h:double>")
    measured = spark.createDataFrame([("s", "r6", 0, 8.0, 0.1)], "sheet_id string, rule_id string, check_ix int, value double, step double")
    reviews = spark.createDataFrame([("s", "r0", True, False, False, None), ("s", "r7", False, False, True, "нет")], "sheet_id string, rule_id string, text_confirmed boolean, rejected boolean, not_applicable boolean, note string")
    judged = assess(rules, words, volume="0,5", measured=measured, reviews=reviews).cache()
    rows = {(r.sheet_id, r.rule_id): r for r in judged.collect()}
    got = {k: (r.comparison, r.status, r.status_label) for k, r in rows.items()}
    assert got == {
        ("s", "r0"): ("found", "pass", None), ("s", "r1"): ("partial", "issue", "Проверить число"), ("s", "r2"): ("found", "detected", None), ("s", "r3"): ("manual", "pending", None), ("s", "r4"): ("na", "na", None),
        ("s", "r5"): ("partial", "issue", "Отличие текста"), ("s", "r6"): ("found", "issue", "Проверить размеры"), ("s", "r7"): ("manual", "na", None), ("t", "r0"): ("unreadable", "pending", None),
    }
    assert rows["s", "r2"].quantity == "match" and rows["s", "r1"].verdict == "difference"
    automatic = assess(rules, words, volume="0,5").collect()
    assert not any(r.status == "pass" for r in automatic)
    counts = {r.sheet_id: (r.issues, r.done) for r in ready(judged).collect()}
    assert counts == {"s": (3, False), "t": (0, False)}
    assert first_volume(rules).first()["volume"] == 0.5
