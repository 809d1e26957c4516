"""Lines, columns, marks of differences and one-to-one pairs against plain versions."""

import random

import pytest

from concord.operators import diff, pairing, sweep

WORDS = "page long, word_ix int, word string, line string, box struct<x:double,y:double,w:double,h:double>"


def page(seed, n=70, named=0.0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        line = r.randrange(8)
        h = r.choice([0.02, 0.02, 0.03, 0.1])
        out.append((i, f"w{i}", f"L{line}" if r.random() < named else None, (r.random(), line * 0.03 + r.random() * 0.02, r.choice([0.01, 0.05, 0.2]), h)))
    return out


def plain_lines(words):
    """Each line is a list of words; the rule word by word, over all lines."""
    lines, named = [], {}
    for w in sorted(words, key=lambda w: (w[3][1], w[3][0], w[0])):
        _, y, _, h = w[3]
        best, score = None, -1
        if w[2] is not None:
            best = named.get(w[2])
        else:
            for line in lines[-12:]:
                common = min(y + h, line["low"]) - max(y, line["y"])
                tall = line["low"] - line["y"]
                if common / min(h, tall) > 0.45 and common / min(h, tall) > score and max(h, tall) / min(h, tall) < 3.5:
                    best, score = line, common / min(h, tall)
        if best is None:
            best = {"y": y, "low": y + h, "words": []}
            lines.append(best)
            if w[2] is not None:
                named[w[2]] = best
        best["words"].append(w)
        best["y"], best["low"] = min(best["y"], y), max(best["low"], y + h)
    return lines


def plain_columns(words):
    pieces = []
    for no, line in enumerate(plain_lines(words)):
        row = sorted(line["words"], key=lambda w: (w[3][0], w[3][1], w[0]))
        height = sorted(w[3][3] for w in row)[len(row) // 2]
        parts = [[row[0]]]
        for p, w in zip(row, row[1:]):
            if w[3][0] - (p[3][0] + p[3][2]) > 3.5 * height:
                parts.append([])
            parts[-1].append(w)
        for k, part in enumerate(parts):
            x, y = min(w[3][0] for w in part), min(w[3][1] for w in part)
            pieces.append((y, x, no, k, max(w[3][0] + w[3][2] for w in part) - x, max(w[3][1] + w[3][3] for w in part) - y, height, [w[1] for w in part]))
    chains = []
    for p in sorted(pieces):
        y, x, _, _, w, _, height, _ = p
        best, least = None, float("inf")
        for c in chains:
            y0, x0, _, _, w0, h0, height0, _ = c[-1]
            gap, big, small = y - (y0 + h0), max(height, height0), min(height, height0)
            aligned = (min(x + w, x0 + w0) - max(x, x0)) / min(w, w0) > 0.25 or abs(x - x0) < big * 1.4
            if gap < -0.2 * small or gap > big * 2.2 or not aligned or big / small > 3.5:
                continue
            d = max(0, gap) / big + abs(x - x0) / (big * 8)
            if d < least:
                best, least = c, d
        if best is None:
            chains.append([p])
        else:
            best.append(p)
    return [(len(c), " ".join(w for p in c for w in p[7])) for c in chains]


@pytest.mark.parametrize("named", [0.0, 0.4])
def test_columns(spark, named):
    pages = {k: page(k, 70 if k else 1, named) for k in range(12)}
    rows = [(k, *w) for k, p in pages.items() for w in p]
    df = spark.createDataFrame(rows, WORDS).repartition(4)
    out = sweep.candidates(df, ["page"], name="line")
    got = sorted((r["page"], r["line_count"], r["text"]) for r in out.collect())
    assert got == sorted((k, *c) for k, p in pages.items() for c in plain_columns(p))
    lined = sweep.lines(df, ["page"], name="line").groupBy("page", "line_no").count().collect()
    assert sorted((r["page"], r["line_no"], r["count"]) for r in lined) == sorted((k, i, len(x["words"])) for k, p in pages.items() for i, x in enumerate(plain_lines(p)))


def test_flat_boxes_and_empty(spark):
    flat = [(1, i, "a", None, (0.1 * i, 0.5, 0.0, 0.0)) for i in range(3)]
    assert [(r["line_count"], r["text"]) for r in sweep.candidates(spark.createDataFrame(flat, WORDS), ["page"]).collect()] == [(3, "a a a")]
    assert sweep.candidates(spark.createDataFrame([], WORDS), ["page"]).count() == 0


@pytest.mark.parametrize("named", [0.0, 0.3])
def test_one_sweep_makes_the_pieces_of_the_steps(spark, named):
    rows = [(k, *w) for k in range(30) for w in page(100 + k, 1 + 5 * k, named)] + [(40, i, "a", None, (0.1 * i, 0.5, 0.0, 0.0)) for i in range(20)]
    df = spark.createDataFrame(rows, WORDS).repartition(4)
    steps = sweep.pieces(sweep.fragments(sweep.lines(df, ["page"], name="line"), ["page"]), ["page"])
    cols = ["page", "line_no", "fragment", "x", "y", "w", "h", "height", "n_words"]
    want = sorted((*(r[c] for c in cols), " ".join(r["words"])) for r in steps.collect())
    one = sweep.printed(df, ["page"], name="line")
    assert sorted((*(r[c] for c in cols), r["text"]) for r in one.collect()) == want
    # words meet in one shuffle
    assert one._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    chained = sweep.printed(df, ["page"], name="line", chained=True).collect()
    assert sorted((r["page"], r["line_no"], r["fragment"], r["column_no"]) for r in chained) == sorted((r["page"], r["line_no"], r["fragment"], r["column_no"]) for r in sweep.columns(steps, ["page"]).collect())


def traced(a, b):
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    one, two, i, j = [False] * n, [False] * m, 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            one[i] = two[j] = True
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return one, two


def test_marks_follow_the_trace(spark):
    r = random.Random(1)
    for _ in range(400):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(30))] for _ in range(2))
        one, two = diff.common(a, b)
        assert (one.tolist(), two.tolist()) == traced(a, b)
    a = [r.choice("abcdefgh") for _ in range(3000)]
    b = [x for x in a if r.random() < 0.9]
    one, two = diff.common(a, b)
    assert two.all() and one.sum() == len(b)
    rows = [(1, ["x", "y"], ["y", "z"]), (2, None, ["q"]), (3, [], []), (4, ["s"], ["s"])]
    out = diff.marks(spark.createDataFrame(rows, "id long, a array<string>, b array<string>"), "a", "b")
    assert {r["id"]: (r["left_same"], r["right_same"], r["different"]) for r in out.collect()} == {1: ([False, True], [True, False], True), 2: ([], [False], True), 3: ([], [], False), 4: ([True], [True], False)}


@pytest.mark.parametrize("small", [0, 5, pairing.SMALL])
def test_one_to_one(spark, small):
    r = random.Random(2)
    options = sorted({(r.randrange(4), r.randrange(15), r.randrange(15), float(r.randrange(12))) for _ in range(300)})
    options = list({o[:3]: o for o in options}.values())
    taken, plain = set(), []
    for p, a, b, c in sorted(options, key=lambda o: (o[3], o[:3])):
        if (p, "a", a) not in taken and (p, "b", b) not in taken:
            taken |= {(p, "a", a), (p, "b", b)}
            plain.append((p, a, b, c))
    df = spark.createDataFrame(options, "p long, a long, b long, cost double").repartition(3)
    out = pairing.one_to_one(df, ["p", "a"], ["p", "b"], ["cost", "p", "a", "b"], small)
    assert sorted(map(tuple, out.collect())) == sorted(plain)
