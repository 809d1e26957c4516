"""Operators beyond the registered queries."""

import io
import json
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import align, callouts, raster, readings, requirements, tokens, verdict
from concord.plans.queries import QUERIES
from concord.sources import documents, images, reports
from concord.sources import readings as sources
from concord.streaming import inbox

from .test_functions import value  # noqa: F401


def test_table_heads(spark):
    rows = [("d", 0, 0, ["Требования", "Текст", "Раздел"]), ("d", 0, 1, ["1", "2", "3"]), ("d", 0, 2, ["не менее 2 мм", "Вода", "Состав"]), ("d", 0, 3, ["x", "", "Пусто"]), ("d", 0, 4, ["", "", ""]), ("d", 1, 0, ["a", "b"]), ("d", 1, 1, ["c", "d"])]
    cells = spark.createDataFrame(rows, "doc string, table_ix int, row_ix int, r array<string>").select("doc", "table_ix", "row_ix", F.posexplode("r").alias("col_ix", "text"))
    got = sorted(tuple(r) for r in requirements.table_rules(cells).collect())
    assert got == [
        ("d", 0, 2, "Состав", "не менее 2 мм", "Вода", False), ("d", 0, 3, "Пусто", "x", "", True),
        ("d", 1, 0, "Неразобранная строка таблицы", "a · b", "", True), ("d", 1, 1, "Неразобранная строка таблицы", "c · d", "", True),
    ]


def test_paragraphs(spark):
    text = ["Общее условие", "Раздел: Состав", "Текст: Вода", "соль", "высота шрифта не менее 2 мм", "Указать: «Сделано»", "Хранение:", "Хранить в холоде", "*** Добавить информацию: Ещё", "хвост"]
    df = spark.createDataFrame([("d", i, t, False) for i, t in enumerate(text)], "doc string, ord int, text string, heading boolean")
    got = {(r.title, r.constraint, r.text, r.extra) for r in requirements.paragraph_rules(df).collect()}
    assert got == {(None, "", "Общее условие", False), ("Состав", "высота шрифта не менее 2 мм", "Вода\nсоль", False), ("Надпись", "", "Сделано", False), ("Хранение", "", "Хранить в холоде", False), ("Дополнительная информация под ***", "Обязательное наличие текста", "Ещё\nхвост", True)}


def test_margin(value):  # noqa: F811
    c = F.array(F.lit("просто"), F.lit("увеличивать высоту шрифта на 0,2 мм"))
    assert value(requirements.suggested_margin(c)) == 0.2 and value(requirements.suggested_margin(F.array(F.lit("запас высоты +3 мм")))) is None


def plain_affine(swap, foreign):
    m, n = swap.shape
    u = m + n + 2
    inf = 10**12
    kept = [[0] * (n + 1)] + [[i * 4 * u] + [0] * n for i in range(1, m + 1)]
    loose = [[inf] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            s = -1 if swap[i - 1, j - 1] < 0 else 4 * u if swap[i - 1, j - 1] == 0 else 8 * u
            kept[i][j] = min(min(kept[i - 1][j - 1], loose[i - 1][j - 1]) + s, min(kept[i - 1][j], loose[i - 1][j]) + 4 * u)
            loose[i][j] = min(kept[i][j - 1] + 4 * u, loose[i][j - 1] + (u if foreign[j - 1] else 4 * u))
    return min(kept[m]), u


def test_affine_costs():
    r = np.random.default_rng(3)
    for _ in range(150):
        m, n = r.integers(1, 7), r.integers(1, 9)
        swap, foreign = r.integers(-1, 2, (m, n)), r.integers(0, 2, n).astype(bool)
        best, u = plain_affine(swap, foreign)
        cost, run = 0, False
        for kind, i, j in align.affine(swap, foreign):
            if kind == "swap":
                cost += -1 if swap[i, j] < 0 else 4 * u if swap[i, j] == 0 else 8 * u
            elif kind == "missing":
                cost += 4 * u
            else:
                cost += u if run and foreign[j] else 4 * u
            run = kind == "extra"
        assert cost == best


def test_operations():
    ops = lambda a, b: [(o["kind"], o["expected"], o["actual"]) for o in align.operations(a.split(), b.split()) if o["kind"] != "same"]
    assert ops("крепость 40 %", "крепость 45 %") == [("replace", "40", "45")]
    assert ops("крепость 40 %", "крепость 40") == [("missing", "%", None)]
    assert ops("крепость 40 %", "крепость 0 %") == [("uncertain", "40", "0")]
    assert ops("не для детей", "для детей") == [("missing", "не", None)]
    assert ops("хранить в сухом месте", "хранить не в сухом месте") == [("extra", None, "не")]
    assert [o["anchored"] for o in align.operations("а б в".split(), "а в".split()) if o["kind"] == "missing"] == [True]


def test_inside_alignment():
    r = random.Random(2)
    for _ in range(100):
        a, b = r.choices("abc", k=r.randrange(1, 7)), r.choices("abc", k=r.randrange(0, 12))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        d = align.align_inside(a, b)
        assert d["distance"] == align.distance_inside(a, b) == min(row)
        assert sum(s != "same" for s in d["status"]) + sum(len(x) for x in d["inserted"][1:-1]) >= d["distance"] or d["distance"] == 0


def test_scores():
    s = align.score_line("Вес 0,75 л.", ["вес", "xx Вес 10,75 л."], "вес075л", ["вес1075л"])
    assert (s["numbers"], s["number_errors"], s["words"]) == (1, 1, 3)
    s = align.score_line("Вес 0,75 л.", ["xx Вес 0,75 л. yy"], "вес075л", ["ххвес075луу"])
    assert not any(v for k, v in s.items() if k.endswith("errors"))


def test_totals(spark):
    df = spark.createDataFrame([(1, "a b", ["a b"], ["x"]), (2, "c d", ["c x"], ["x", "y"])], "id int, line string, h array<string>, tags array<string>")
    s = align.score_lines(df, ["id"], "line", "h").join(df.select("id", "tags"), "id")
    assert sorted((r.tag or "", r.lines, r.word_errors) for r in align.totals(s, "tags").collect()) == [("", 2, 1), ("x", 2, 1), ("y", 1, 1)]


def test_callouts(spark):
    rules = spark.createDataFrame([("s", "r0", "Срок годности 12 месяцев", False), ("s", "r1", "Хранить в сухом прохладном месте", False), ("s", "r2", "Чрезмерное употребление вредит", True)], "sheet_id string, rule_id string, expected string, has_percent boolean")
    said = spark.createDataFrame([("s", 0, "height", ["ХРАНИТЬ В СУХОМ"]), ("s", 1, "percent", []), ("s", 2, "height", ["12"]), ("s", 3, "unreadable", ["Хранить"])], "sheet_id string, callout_ix int, kind string, texts array<string>")
    assert sorted((r.callout_ix, r.rule_id) for r in callouts.link(said, rules).collect()) == [(0, "r1"), (1, "r2")]
    tries = spark.createDataFrame([("s", 0, 0, "25 мм", 95.0, 1), ("s", 0, 1, "2,5 мм", 60.0, 1), ("s", 0, 2, "2,5 мм", 40.0, 1)], "sheet_id string, callout_ix int, attempt int, raw string, confidence double, separators int")
    best = callouts.best_reading(tries).first()
    assert (best.raw, best.reads, best.marks_agree) == ("2,5 мм", 2, True)
    lines = spark.createDataFrame([("s", 0, "Размер этикетки, мм", (0.1, 0.1, 0.2, 0.02)), ("s", 1, "60x80", (0.32, 0.1, 0.1, 0.02)), ("s", 2, "103x54", (0.6, 0.8, 0.1, 0.02))], "sheet_id string, line_ix int, text string, box struct<x:double,y:double,w:double,h:double>")
    assert callouts.declared_size(lines).first()["sides"] == [60.0, 80.0]


def test_consensus_and_conflicts(spark):
    rows = [(1, "40", "a", 96.0), (1, "45", "b", 95.0), (2, "40", "a", 50.0), (2, "40", "b", 40.0), (2, "4", "c", 70.0), (3, "x", "a", 10.0), (4, "y", "a", None)]
    got = {r.p: (r.v, r.support, r.conflict) for r in readings.consensus(spark.createDataFrame(rows, "p int, v string, pass string, c double"), ["p"], "v", "pass", "c").collect()}
    assert got == {1: ("40", 1, True), 2: ("40", 2, False), 4: ("y", 1, False)}


def test_verdict_ladders(value):  # noqa: F811
    t, f = F.lit(True), F.lit(False)
    kw = dict(rejected=f, failed=f, exempt=f, confirmed=f, sizes_pass=t, conditions=t, quantity_issue=f, notation=f, size_issue=f, has_text=t)
    status = lambda c, **k: value(verdict.row_status(F.lit(c), **(kw | k)))
    assert status("found") == "detected" and status("found", confirmed=t) == "pass" and status("found", rejected=t, confirmed=t) == "error"
    assert status("all_words") == "words" and status("partial") == "issue" and status("partial", has_text=f) == "pending" and status("na") == "na" and status("found", notation=t) == "issue"
    assert value(verdict.sure_difference(F.lit("missing"), F.lit(0), t)) and not value(verdict.sure_difference(F.lit("uncertain"), F.lit(99), t))
    assert value(verdict.numeric_difference(F.lit("replace"), F.lit("40"), F.lit("45"), F.lit(80))) and not value(verdict.numeric_difference(F.lit("replace"), F.lit("40"), F.lit("40 г"), F.lit(80)))


def plain_mutations(text):
    """The changes by their definition, one text at a time."""
    import re

    chosen = lambda items, k: items if len(items) <= k else [items[i * len(items) // k] for i in range(k)]
    parts = [p for p in re.split(r"\n+|(?<=[.!?;])\s+(?=[A-ZА-ЯЁ])", text) if p.strip(" ")]
    assert len(parts) == 1 or all(len(re.findall(r"\d+|[^\W\d_]+", p)) >= 3 for p in parts)  # else they would join
    spans, at = [], 0
    for p in parts if len(parts) > 1 else [text]:
        at = text.index(p, at)
        spans.append((at, at + len(p)))
        at += len(p)
    some = lambda s: re.search(r"[\d%°]|[^\W\d_]", s) is not None
    words = [m for m in re.finditer(r"[^\W\d_]{4,}", text)]
    lo_hi = lambda m: next((s for s in spans if s[0] <= m.start() < s[1]), None)
    inner = [m for m in words if lo_hi(m) and some(text[lo_hi(m)[0] : m.start()]) and some(text[m.end() : lo_hi(m)[1]])]
    out = []
    for m in chosen(list(re.finditer(r"[0-9]+", text)), 12):
        out.append(("number", m.start(), text[: m.end() - 1] + str((int(m[0][-1]) + 1) % 10) + text[m.end() :]))
    without = lambda m: re.sub(" {2,}", " ", text[: m.start()] + text[m.end() :])
    out += [("inside", m.start(), without(m)) for m in chosen(inner, 8)]
    out += [("edge", m.start(), without(m)) for m in chosen([m for m in words if m not in inner], 4)]
    out += [("added", m.start(), text[: m.start()] + verdict.ADDED + text[m.start() :]) for m in chosen(inner, 8)]
    for m in chosen([m for m in words if len(m[0]) >= 6], 8):
        at = m.start() + len(m[0]) // 2
        new = "ш" if text[at].lower() == "ж" else "ж"
        out.append(("letter", m.start(), text[:at] + (new if text[at].islower() else new.upper()) + text[at + 1 :]))
    return sorted(out)


def test_mutations(spark):
    texts = ["one two 40 four five six7 seven eight nine", "Срок годности двенадцать месяцев. Хранить в сухом прохладном месте при температуре 25 °С; Беречь от света и Жарыжы", "Короткий", " ".join(f"слово{i} ещё длинное" for i in range(30))]
    rows = verdict.mutations(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").collect()
    for i, t in enumerate(texts):
        got = sorted((r.kind, r.place, r.mutated) for r in rows if r.id == i)
        assert got == plain_mutations(t) and all(m != t for _, _, m in got)
    assert sum(r.kind == "letter" and r.id == 1 for r in rows) == 8


def test_spread(spark):
    for n, limit in ((10, 3), (1, 5), (100, 7), (61, 60), (0, 4)):
        df = spark.createDataFrame([((i * 37) % 1009, str(i)) for i in range(n)], "k int, s string")
        expected = sorted((i * 37) % 1009 for i in range(n))
        expected = expected if n <= limit else [expected[i * n // limit] for i in range(limit)]
        assert sorted(r.k for r in tokens.spread(df, ["k"], limit).collect()) == expected
        assert tokens.spread(df, ["s"], limit).count() == min(n, limit)


def test_rasters(spark):
    gray = np.full((60, 100), 250, np.uint8)
    gray[10:20, 10:30] = gray[10:20, 40:60] = gray[40:48, 10:90] = 20
    mask, light = raster.ink(gray)
    assert not light and raster.bands(mask) == [(10, 20), (40, 48)] and raster.visible_height(mask) == 10
    assert [(c["x"], c["y"], c["w"], c["h"], c["area"]) for c in raster.components(mask)] == [(10, 10, 20, 10, 200), (40, 10, 20, 10, 200), (10, 40, 80, 8, 640)]
    assert len(raster.cut(mask)) == 3 and len(raster.line_areas(mask)) == 2
    assert raster.ink(np.full((5, 5), 9, np.uint8)) is None and raster.ink(255 - gray)[1]
    hist = spark.createDataFrame([(int(v), int(n)) for v, n in zip(*np.unique(gray, return_counts=True))], "v int, n long")
    assert raster.otsu(hist).first()["threshold"] == raster.otsu_of(gray) == 20
    number = np.zeros((20, 40), bool)
    number[2:18, 2:8] = number[2:18, 14:20] = number[2:18, 24:30] = number[15:19, 10:12] = True
    assert raster.digits_and_marks(number) == {"digits": 3, "separators": 1, "mark_after": 1}
    rgb = np.full((100, 100, 3), 255, np.uint8)
    rgb[20:80, 20:80] = (230, 20, 20)
    rgb[23:77, 23:77] = 255
    assert raster.frames(rgb) == [{"x": 0.2, "y": 0.2, "w": 0.6, "h": 0.6}]
    rgba = np.dstack((rgb, np.full((100, 100), 255, np.uint8)))
    df = spark.createDataFrame([("s", 100, 100, bytearray(rgba.tobytes()))], "id string, width int, height int, data binary")
    assert raster.per_raster(df, "id", lambda a: raster.frames(a), "x double, y double, w double, h double").count() == 1


def test_components_against_flood_fill():
    r = np.random.default_rng(1)
    for diagonal in (True, False):
        for _ in range(30):
            m = r.random((12, 15)) < 0.4
            left, n = {tuple(p) for p in np.argwhere(m).tolist()}, 0
            while left:
                n, todo = n + 1, [left.pop()]
                while todo:
                    y, x = todo.pop()
                    for dy, dx in [(-1, 0), (1, 0), (0, -1), (0, 1)] + [(-1, -1), (-1, 1), (1, -1), (1, 1)] * diagonal:
                        if (q := (y + dy, x + dx)) in left:
                            left.discard(q)
                            todo.append(q)
            found = raster.components(m, diagonal)
            assert len(found) == n and sum(c["area"] for c in found) == m.sum()


def test_barcode():
    from concord.functions.fixed import EAN_LEFT, EAN_PARITY

    right = ["".join("10"[int(b)] for b in p) for p in EAN_LEFT]
    even = [p[::-1] for p in right]
    code = "4813852006269"
    bits = "101" + "".join((EAN_LEFT if p == "L" else even)[int(d)] for p, d in zip(EAN_PARITY[4], code[1:7])) + "01010" + "".join(right[int(d)] for d in code[7:]) + "101"
    line = np.repeat([0 if b == "1" else 255 for b in "0" * 9 + bits + "0" * 9], 3).astype(np.uint8)
    assert raster.scan_ean13(np.tile(line, (30, 1))) == code == raster.scan_ean13(np.tile(line[::-1], (30, 1)))
    assert raster.scan_ean13(np.full((10, 200), 255, np.uint8)) is None


def test_density():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBI", 9, b"pHYs", 11811, 11811, 1, 0)
    assert [round(x) for x in images.density(png)] == [300, 300]
    jfif = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1" + struct.pack(">BHH", 1, 72, 72) + b"\0\0"
    assert images.density(jfif) == (72.0, 72.0) and images.density(b"none") is None
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + struct.pack("<HHII", 0x011A, 5, 1, 50) + struct.pack("<HHII", 0x011B, 5, 1, 58) + struct.pack("<HHIHH", 0x0128, 3, 1, 3, 0) + struct.pack("<I", 0) + struct.pack("<IIII", 100, 1, 100, 1)
    exif = b"\xff\xe1" + struct.pack(">H", 2 + 6 + len(tiff)) + b"Exif\0\0" + tiff
    assert images.density(jfif + exif) == (254.0, 254.0)


def test_documents(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t, up="": f'<w:r>{"<w:rPr><w:vertAlign w:val=%s/></w:rPr>" % chr(34).join(["", "superscript", ""]) if up else ""}<w:t>{t}</w:t></w:r>'
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{run("Head")}</w:p><w:tbl><w:tr><w:tc><w:p>{run("25 ")}{run("0", "up")}{run("С")}</w:p></w:tc><w:tc><w:p>{run("b")}</w:p></w:tc></w:tr></w:tbl>'
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(z.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows = documents.read_docx(spark, str(tmp_path)).orderBy("path", "ord").collect()
    assert [(r.kind, r.heading, r.text) for r in rows] == [("paragraph", True, "Head"), ("cell", False, "25 °С"), ("cell", False, "b"), ("error", False, None)]
    (tmp_path / "c.txt").write_text("﻿one\r\ntwo", encoding="utf-8")
    assert [r.text for r in documents.read_text(spark, str(tmp_path / "c.txt")).orderBy("ord").collect()] == ["one", "two"]


def test_interchange(spark, tmp_path):
    word = {"text": "x", "box": {"x": 10, "y": 20, "w": 30, "h": 40}, "rotation": 0, "confidence": 50, "source": "recognition", "engine": "e", "pass": "p", "line": "0"}
    good = {"schema": "own.ocr-result/1", "method": "m", "page": {"width": 100, "height": 200}, "words": [word, word | {"source": "pdf-text", "pass": "pdf"}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text(json.dumps(good | {"schema": "other", "words": [word | {"text": " ", "rotation": 45, "confidence": 101, "source": "?", "box": {"x": 0, "y": 0, "w": 0, "h": 1}}]}))
    df = sources.read_interchange(spark, str(tmp_path))
    found = {r.path.rsplit("/")[-1]: r.problems for r in sources.problems(df).collect()}
    assert found["good.json"] == [] and len(found["bad.json"]) == 6
    rows = sources.to_fractions(df.filter("path like '%good.json'")).orderBy("word_ix").collect()
    assert [(r.confidence, tuple(r.box)) for r in rows] == [(50.0, (0.1, 0.1, 0.3, 0.2)), (100.0, (0.1, 0.1, 0.3, 0.2))]
    back = sources.to_pixels(sources.to_fractions(df.filter("path like '%good.json'")), F.lit(100.0), F.lit(200.0)).orderBy("word_ix").collect()
    assert [round(back[0].box[k]) for k in "xywh"] == [10, 20, 30, 40] and back[1].source == "pdf-text"


def test_tree_and_polygons(spark):
    box = lambda a, b, c, d: {"x0": a, "y0": b, "x1": c, "y1": d}
    words = [{"text": "ab", "confidence": 90.0, "bbox": box(0.0, 0.0, 50.0, 20.0), "symbols": [{"text": "a", "confidence": 95.0, "bbox": box(0.0, 0.0, 9.0, 10.0)}, {"text": "b", "confidence": 60.0, "bbox": box(9.0, 0.0, 20.0, 10.0)}]}, {"text": " ", "confidence": 9.0, "bbox": box(0.0, 0.0, 1.0, 1.0), "symbols": []}]
    df = spark.createDataFrame([("s", [{"paragraphs": [{"lines": [{"words": words}]}]}])], f"id string, blocks {sources.TREE}")
    from concord.functions import geometry as G

    r = sources.words_from_tree(df, "id", "blocks", G.box(0, 0, 1, 1), F.lit(100.0), F.lit(100.0), F.lit(0), F.lit(0.1), F.lit("p")).collect()
    assert len(r) == 1 and r[0].line == "0:0:0" and tuple(r[0].box) == (0.0, 0.0, 0.5, 0.2) and [(g.text, g.height) for g in r[0].glyphs] == [("a", 1.0)]
    poly = spark.createDataFrame([("s", [("x", 0.9, [[0.0, 0.0], [50.0, 0.0], [50.0, 10.0], [0.0, 10.0]]), ("flat", 0.9, [[0.0, 0.0], [0.0, 0.0]])])], "id string, items array<struct<text:string,score:double,poly:array<array<double>>>>")
    r = sources.words_from_polygons(poly, "id", "items", F.lit(100.0), F.lit(100.0)).collect()
    assert [(x.text, x.confidence, tuple(x.box)) for x in r] == [("x", 90.0, (0.0, 0.0, 0.5, 0.1))]


def test_packing(spark):
    df = spark.createDataFrame([("s", i, 1100) for i in range(60)], "id string, ix int, w int")
    rows = images.packed(df, ["id"], "ix", "w").orderBy("ix").collect()
    assert [(r.sheet, r.slot_x, r.slot_y) for r in rows[:3]] == [(0, 24, 24), (0, 1154, 24), (0, 24, 102)]
    assert len({(r.sheet, r.slot_x, r.slot_y) for r in rows}) == 60 and rows[-1].sheet == 1


def test_reports(spark):
    df = spark.createDataFrame([("s", 1, "<b>"), ("s", 0, "a&b")], "sheet string, ord int, text string")
    assert reports.html_report(df, "sheet", "ord", "T", ["text"]).first()["html"].endswith("<tr><td>a&amp;b</td></tr>\n<tr><td>&lt;b&gt;</td></tr>\n</table>")
    c = spark.createDataFrame([("s", "height", 1, True), ("s", "height", 0, None), ("s", "unreadable", 0, None)], "sheet string, kind string, n_links int, agrees boolean")
    assert tuple(reports.callout_counts(c, "sheet").first())[1:] == (2, 1, 1, 0, 1)


def test_orders(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "a", 1), (2, "b", 2)], "k int, v string, o int")
    assert sorted(tuple(r) for r in tokens.first_seen(df, ["k", "v"], "o").collect()) == [(1, "a", 1), (2, "b", 2)]
    assert sorted(tuple(r) for r in readings.supersede(df.withColumn("c", F.col("o") * 1.0), ["k"], "c", "c", "o").select("k", "o").collect()) == [(1, 3), (2, 2)]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    df.write.parquet(str(tmp_path / "in" / "0"))
    q = inbox.judge(inbox.watch(spark, str(tmp_path / "in" / "0"), "k string, v double"), lambda d: d.groupBy("k").agg(F.sum("v").alias("v")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1.0), ("b", 2.0)]


@pytest.mark.parametrize("name", ["locate_phrases", "locate_exact"])
def test_entry_runs(spark, name):
    from concord.plans.queries import QUERIES

    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_paragraph_rules_take_whole_turns(spark, tmp_path):
    from concord.plans.queries import QUERIES

    long = " ".join(f"слово{i}" for i in range(60))
    spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "Ответ")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [(r.title, r.text) for r in QUERIES["paragraph_rules"](spark, str(tmp_path)).collect()] == [(long, "Ответ")]


@pytest.fixture(scope="module")
def misread(spark, tmp_path_factory):
    """Required texts that stand in order, with a misread word, in the document of least overlap: two long ones hold all words scattered."""
    at = tmp_path_factory.mktemp("misread")
    one = [f"слово{chr(1072 + i)}{chr(1072 + i)}" for i in range(20)]
    scattered = " ".join(x for w in reversed(one) for x in (w, "прочее", "иное", "другое"))
    read = " ".join(w if i != 7 else "ошибка" for i, w in enumerate(one))
    spark.createDataFrame([(1, " ".join(one))], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    spark.createDataFrame([(i, scattered) for i in range(4)] + [(9, "начало " + read + " конец")], "doc_id long, text string").write.parquet(str(at / "documents.parquet"))
    return str(at)


def test_ten_readings_are_aligned(spark, misread):
    from concord.plans.queries import QUERIES

    assert [(r.reading_id, r.coverage) for r in QUERIES["align_ops"](spark, misread).collect()] == [(9, 95)]
    assert [(r.words, r.word_errors) for r in QUERIES["score_lines"](spark, misread).collect()] == [(20, 1)]
    assert {r.sheet_id: r.coverage for r in QUERIES["assess_rows"](spark, misread).collect()}[9] == 95


@pytest.mark.parametrize("make", ["top_pairs", "aligned", "compared"])
def test_readings_are_chosen_before_they_are_taken_apart(spark, misread, make):
    from concord.operators import locate
    from concord.plans import queries

    rules, reads = queries._sides(spark, misread)
    pairs = spark.createDataFrame([(1, 9, 20, 1)], "rule_id long, reading_id long, overlap long, rank int")
    df = {"top_pairs": lambda: queries._top_pairs(spark, misread, 10), "aligned": lambda: locate._aligned(rules, reads, pairs, 0.5), "compared": lambda: locate.compared(rules, reads, pairs)}[make]()
    assert df.count()
    plan = df._jdf.queryExecution().optimizedPlan()
    todo, joins = [plan], 0
    while todo:
        node = todo.pop()
        if "Join LeftSemi" in node.simpleString(25):
            joins += 1
            assert "regexp_extract_all" not in node.toString()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert joins == 1


def test_lines_are_scored_once_on_all_cores(spark, misread):
    from concord.plans.queries import QUERIES

    plan = QUERIES["score_totals"](spark, misread)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("Relation") == 2
    rows = spark.createDataFrame([(i, "a b", ["a b", "c"]) for i in range(40)], "id long, line string, readings array<string>").coalesce(1)
    assert align.score_lines(rows, ["id"], "line", "readings").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1


def test_tokens_pass_over_white_space_inside_numbers(spark):
    """Tokens are those of the normalized text, which is not made whole for them."""
    from concord.functions import text as T

    r = random.Random(9)
    some = ["-", "–", " ", "  ", "\n", "\u00a0", "\u3000", "\ufeff", "1", "25", "3.5", ".", ",", ":", "%", "º", "(", '"', "a", "Б", "İ", "٣", "x"]
    rows = [("- - 5",), ("a - 5 . 3 , 2",), ("- 5",), ("a- 5",), (None,), ("",)] + [("".join(r.choices(some, k=r.randrange(25))),) for _ in range(2000)]
    found = F.regexp_extract_all(T.normalize(T.dehyphenate(F.col("s"))), F.lit(r"-?\d+(?:[,.]\d+)?|\p{L}+|[%°]"), F.lit(0))
    plain = F.transform(found, lambda t: F.when(t.rlike(r"^\d+\.\d+$"), F.translate(t, ".", ",")).otherwise(t))
    df = spark.createDataFrame(rows, "s string")
    assert df.filter(~plain.eqNullSafe(T._tokens(F.col("s")))).count() == 0
    assert " *([,.:;%/()-]) *" not in df.select(T._tokens(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()


def test_totals_by_tag(spark):
    """Each line once in the total and once for each of its tags; a line without tags in the total alone; rates of nothing are null."""
    r = random.Random(3)
    rows = [(i, *(r.randrange(20) for _ in align.SCORES), r.sample(["a", "b", "c"], r.randrange(4))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} long" for c in align.SCORES) + ", tags array<string>")
    got = {x.tag: tuple(x[c] for c in (*align.SCORES, "lines")) for x in align.totals(df, "tags").collect()}
    sums = lambda some: (*(sum(x[1 + k] for x in some) for k in range(len(align.SCORES))), len(some))
    assert got == {None: sums(rows)} | {t: sums([x for x in rows if t in x[-1]]) for t in "abc"}
    one = spark.createDataFrame([(1, 8), (0, 0), (2, 3)], "e long, t long").select(align.rate(F.col("e"), F.col("t")).alias("r"))
    assert [x.r for x in one.collect()] == [12.5, None, 66.7]


def test_lines_cut_in_the_row_are_those_of_the_words(spark):
    from concord.operators import tokens

    texts = [(1, " ".join(f"w{i}" for i in range(30))), (1, "b\ta  c\n" * 7), (2, ""), (3, None), (4, " \t"), (5, "x" * 9), (None, "y z"), (6, " ".join("ab" for _ in range(24)))]
    df = spark.createDataFrame(texts, "id long, text string")
    got = tokens.text_lines(df, "id", "text")
    want = tokens.line_texts(tokens.word_rows(df, "id", "text"), "id")
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0] or 0, r[1])) == sorted(map(tuple, want.collect()), key=lambda r: (r[0] or 0, r[1]))
    # lines meet, not words
    assert "word_ix" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_alignment_holds_few_rows_at_a_time(spark):
    import pandas as pd

    from concord.operators import align

    rows = spark.range(100).coalesce(1)
    sizes = [r["n"] for r in align._mapped(rows, lambda b: pd.DataFrame({"n": [len(b)]}), "n long").collect()]
    assert sum(sizes) == 100 and max(sizes) <= align.ROWS
    assert [r["distance"] for r in align.similarities(rows.selectExpr("id", "array('a', 'b') AS a", "array('x', 'b') AS b").orderBy("id"), ["id"], "a", "b").collect()] == [1] * 100
