"""Marks drawn on small pages."""

import numpy as np

from concord.operators import marks

RED = (220, 20, 20)


def sheet(w=400, h=300):
    return np.full((h, w, 3), 255, np.uint8)


def signs(a, x, y, n=5, size=8, step=11, ink=RED, turned=False):
    for i in range(n):
        p, q = (x, y + i * step) if turned else (x + i * step, y)
        a[q : q + size, p : p + size - 2] = ink
        a[q + 2 : q + size - 2, p + 2 : p + size - 4] = 255


def test_clusters_and_gauges():
    a = sheet()
    signs(a, 100, 100)
    signs(a, 300, 100, turned=True)
    a[80:83, 90:160] = RED  # ticks above and below
    a[130:133, 90:160] = RED
    found = marks.clusters(a)
    assert [(c["vertical"], c["count"]) for c in found] == [(False, 5), (True, 5)]
    assert marks.gauges(a, found)[0] == {"type": "height", "from": 83, "to": 130}


def test_shapes():
    m = np.zeros((20, 40), bool)
    m[9:11] = True
    assert marks.hairline(m) and not marks.hairline(np.ones((10, 10), bool))
    assert marks.slanted(np.eye(30, dtype=bool)) and marks.slanted(np.eye(30, dtype=bool)[::-1])
    e = np.zeros((30, 30), bool)
    e[0] = True
    assert not marks.slanted(e)
    assert [(s["y"], s["h"], s["w"]) for s in marks.strokes(m, 10, 3)] == [(9, 2, 40)]
    assert marks.hue_gap(2, 178) == 4 and round(marks.mean_hue(np.array([178, 2]), np.ones(2)), 6) in (0, 180)


def test_region_and_frame():
    a = sheet(200, 400)
    assert marks.artwork_region(a)["h"] == 1.0
    a[300:302, 10:190] = a[320:322, 10:100] = a[340:342, 10:100] = 0
    assert round(marks.artwork_region(a)["h"], 3) == round(297 / 400, 3)
    b = sheet(200, 200)
    b[40:160, 40:43] = b[40:160, 157:160] = b[40:43, 40:160] = b[157:160, 40:160] = RED
    r = marks.refined(b, {"x": 0.215, "y": 0.22, "w": 0.57, "h": 0.56})
    assert abs(r["x"] - 0.2) <= 0.011 and abs(r["x"] + r["w"] - 0.79) <= 0.016


def test_single_frames(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    rows = [("s", 0, (0.0, 0.0, 1.0, 1.0)), ("s", 1, (0.05, 0.05, 0.4, 0.9)), ("s", 2, (0.5, 0.05, 0.45, 0.9)), ("t", 0, (0.0, 0.0, 1.0, 1.0)), ("t", 1, (0.0, 0.0, 0.5, 1.0)), ("t", 2, (0.5, 0.0, 0.5, 1.0))]
    got = marks.single_frames(spark.createDataFrame(rows, f"sheet_id string, frame_ix int, box {box}")).collect()
    assert sorted((r.sheet_id, r.frame_ix) for r in got) == [("s", 1), ("s", 2), ("t", 0), ("t", 1), ("t", 2)]


def test_seed_blocks():
    words = [(0, 40, 0, 10), (45, 90, 0, 10), (0, 60, 14, 24), (200, 260, 0, 10), (0, 30, 200, 230)]
    found = marks.seed_blocks(np.array([(*w, 100.0) for w in words]))
    assert [(s["start"], s["top"], s["lines"]) for s in found] == [(0.0, 0.0, 2), (200.0, 0.0, 1), (0.0, 200.0, 1)]


def test_columns_of_a_block():
    from concord.operators import lines

    gray = np.full((120, 200), 250, np.uint8)
    for y in (10, 50, 90):
        for x in range(10, 90, 14):
            gray[y : y + 20, x : x + 8] = 20
    gray[10:30, 150:160] = 20  # another column on the first row
    assert lines.columns(gray, 20, 6) == [(10, 88), (150, 160)] and len(lines.columns(gray, 20, 1)) == 1


def test_scans_and_crops():
    from concord.operators import lines

    rgb = np.full((60, 300, 3), 250, np.uint8)
    for x in range(40, 100, 12):
        rgb[20:40, x : x + 8] = 10
    rgb[20:40, 106:114] = 10  # at a word space
    rgb[20:40, 200:208] = 10  # far away
    band = lines.Band(rgb, 20, 40)
    assert band.first_ink(0, 1, 100) == (40, 40) and band.first_ink(120, 1, 20) is None
    assert band.follow(40, 1, 14) == 113 and band.line(40, 1, 14, 10) == {"from": 40, "to": 114, "low": 20, "high": 40}
    rgb[20:40, 99:103] = (250, 20, 20)  # another callout's ink bars the way
    assert lines.Band(rgb, 20, 40, tone=0.0).follow(40, 1, 14) == 95
    red = lines.hue_tone(rgb, 0.0)
    assert (red[20:40, 99:103] < 100).all() and (red[:, :90] == 255).all() and (lines.dark_tone(rgb)[20:40, 40:48] == 0).all()
    crop = lines.ink_crop(lines.dark_tone(rgb), scale=2, rotation=90, pad=3)
    assert crop.shape == (600 + 6, 120 + 6) and crop[0, 0] == 255 and crop.min() == 0
    upright = lines.ink_crop(np.array([[0.0, 255.0], [255.0, 255.0]]), rotation=90)
    assert upright.tolist() == [[255, 0], [255, 255]]


def test_artwork_engines_and_fixture(spark, tmp_path):
    from concord.plans.local import run_local
    from concord.sources import engines, images, readings, reports

    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8
    files = [("a", bytearray(b"%PDF-1.7 ...."), 10), ("b", bytearray(png), 10), ("c", bytearray(b"RIFF\0\0\0\0WEBPVP8 "), 10), ("d", bytearray(b"text of no kind"), 10), ("e", bytearray(png), 40 << 20)]
    got = {r.path: (r.kind, r.error) for r in images.artwork(spark.createDataFrame(files, "path string, content binary, length long")).collect()}
    assert got == {"a": ("pdf", None), "b": ("png", None), "c": ("webp", None), "d": (None, "unknown kind"), "e": (None, "too large")}
    words = spark.createDataFrame([("s", 0, 0, "вода", 90.0, 0, 0, 10, 5), ("s", 0, 1, "соль", 80.0, 12, 0, 20, 5), ("s", 1, 0, "лёд", 70.0, 0, 8, 9, 12)], "sheet_id string, line int, word_ix int, text string, confidence double, x0 int, y0 int, x1 int, y1 int")
    nested = engines.tree(words, "sheet_id").collect()[0]["blocks"]
    assert [[w.text for w in x.words] for x in nested[0].paragraphs[0].lines] == [["вода", "соль"], ["лёд"]]
    links = lambda *x: spark.createDataFrame(list(x), "a int, b int")
    path = str(tmp_path / "links")
    diff = reports.fixture(links((1, 1), (2, 2)), links((1, 1), (3, 3)), ["a", "b"], path)
    assert sorted((r.a, r.side) for r in diff.collect()) == [(2, "new"), (3, "missing")]
    assert sorted((r.a, r.expected) for r in spark.read.json(path).collect()) == [(1, True), (2, False)]
    rules = spark.createDataFrame([("s", "r0", "Прочее", "", "вода сахар", "вода сахар")], "sheet_id string, rule_id string, title string, `constraint` string, original string, text string")
    read = [("s", 0, 0, 0, "a", "иное", 95.0), ("s", 0, 90, 0, "a", "вода", 95.0), ("s", 0, 90, 1, "a", "сахар", 95.0)]
    df = spark.createDataFrame(read, "sheet_id string, region_ix int, turn int, word_ix int, pass string, text string, confidence double")
    assert run_local(rules, df).first()["comparison"] == "found"
    assert readings.SOURCES
