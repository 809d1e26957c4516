"""Links of callouts against a plain version that compares every callout with every rule."""

import random

from pyspark.sql import functions as F

from concord.functions import text as T
from concord.operators import callouts, linking

CALLOUTS = "sheet_id int, callout_ix int, kind string, values array<double>, texts array<struct<text:string,confidence:double>>, aspect double, via string, confidence double, marks_agree boolean, reads int"
RULES = "sheet_id int, rule_id int, expected string, percent boolean, sign boolean, formats array<array<double>>"
POOL = "срок годности указан хранить сухом прохладном месте масса нетто состав вода сахар соль лимонная кислота изготовитель адрес партия номер 12 0,75 употребление вредит здоровью".split()


def slip(r, text, n):
    for _ in range(n):
        i = r.randrange(len(text))
        text = text[:i] + r.choice(["", "ж", "ъъ"]) + text[i + 1 :]
    return text


def tables(seed):
    r = random.Random(seed)
    rules, said = [], []
    for s in range(9):
        for k in range(r.randrange(1, 9)):
            words = r.choices(POOL, k=r.choice([1, 2, 5, 9]))
            rules.append((s, k, " ".join(words), r.random() < 0.3, r.random() < 0.25, [[60.0, 80.0]] if r.random() < 0.15 else []))
        texts = [x[2] for x in rules if x[0] == s]
        for k in range(40):
            reads = []
            for _ in range(r.randrange(4)):
                w = r.choice(texts).split()
                a = r.randrange(len(w))
                t = " ".join(w[a : a + r.randrange(1, 6)])
                reads.append((r.choice([slip(r, t, r.randrange(3)), t + " " + r.choice(texts), "еан", "12", "", t]), float(r.choice([50, 70, 90]))))
            said.append((s, k, r.choice(["height", "height", "box", "box", "percent", "unreadable", None]), r.choice([[80.0, 60.02], [1.0, 2.0]]), reads, r.choice([None, 1.0, 3.0]), r.choice(["gauge", "leader", "beside", None]), float(r.randrange(20, 100)), r.choice([True, False, None]), r.randrange(4)))
    return said, rules


def inside(needle, hay):
    if not needle or not hay:
        return 0.0
    row = [0] * (len(hay) + 1)
    for i, a in enumerate(needle, 1):
        new = [i]
        for j, b in enumerate(hay, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return 1 - min(row) / len(needle)


def plain(said, rules, key, telling, fold, alike):
    need = lambda n: 1 if n <= 5 else 0.8 if n <= 10 else 0.7
    bare = lambda k: "".join(c for c in k if not c.isdigit())
    out = []
    for s, ix, kind, values, reads, aspect, via, conf, marks, n_reads in said:
        mine = [x for x in rules if x[0] == s]
        df = {}
        for x in mine:
            if key[x[2]]:
                for t in {fold[w] for w in telling[x[2]]}:
                    df[t] = df.get(t, 0) + 1

        def links(text):
            k, line, found, whole = key[text], telling[text], [], []
            if len(k) < 3 or k.isdigit() and len(k) <= 4:
                return []
            weight = [1 / df.get(fold[t], 1) for t in line]
            for x in mine:
                rk = key[x[2]]
                if not rk:
                    continue
                part = max(inside(k, rk), 0.95 * inside(bare(k), bare(rk)) if len(bare(k)) >= 5 else 0)
                hit = [any((t, w) in alike for w in telling[x[2]]) for t in line]
                share = sum(w for w, h in zip(weight, hit) if h) / sum(weight) if line else 0
                worded = share >= 0.5 and sum(hit) >= 2
                if part >= need(len(k)) or worded:
                    found.append((-max(part, 0.9 * share if worded else 0), x[1]))
                elif 4 <= len(rk) < len(k) and inside(rk, k) >= need(len(rk)) + 0.05:
                    whole.append((x[1], 0.0, inside(rk, k)))
            found.sort()
            one = [(found[0][1], -found[0][0], 0.0)] if found and (len(found) == 1 or found[1][0] - found[0][0] >= 0.08) else []
            return one + whole

        if kind in (None, "unreadable"):
            continue
        tries = sorted([t for t in reads if len(key[t[0]]) >= 2], key=lambda t: -t[1])
        shown, got = tries[0][0] if tries else "", []
        score = lambda y: y[0][1] + y[0][2]
        for t, _ in tries if kind != "percent" else []:
            new = links(t)
            better = new and (not got or score(new) > score(got) + 0.02)
            fuller = new and got and new[0][0] == got[0][0] and abs(score(new) - score(got)) <= 0.02 and len(new) >= len(got) and len(key[t]) > len(key[shown])
            if better or fuller:
                got, shown = new, t
        if got:
            same = [t for t, _ in tries if links(t)[:1] and links(t)[0][0] == got[0][0]]
            shown = max(same, key=lambda t: len(key[t]))
        how = "text"
        if not got:
            percents, signs = [x for x in mine if x[3]], [x for x in mine if x[4]]
            formats = [x for x in mine if any(abs(f[0] - a) < 0.051 and abs(f[1] - b) < 0.051 for f in x[5] for a, b in (values, values[::-1]))]
            keys = [key[t] for t, _ in tries]
            named = any(len(k) == 3 and sum(a == b for a, b in zip(k, "еас")) >= 2 for k in keys)
            square = aspect is not None and 0.7 <= aspect <= 1.45 and 2 * sum(len(k) <= 4 for k in keys) >= len(keys)
            if kind == "percent" and len(percents) == 1:
                how, got = "percent", [(percents[0][1], 0.0, 0.0)]
            elif kind == "box" and len(formats) == 1:
                how, got = "format", [(formats[0][1], 0.0, 0.0)]
            elif kind in ("height", "box") and aspect is not None and len(signs) == 1 and (named or square):
                how, got = "sign", [(signs[0][1], 0.67 if named else 0.5, 0.0)]
        if not got:
            continue
        textual = 0.5 if how in ("percent", "format") else max(max(x[1], x[2]) for x in got)
        sure = False if marks is False else conf >= (70 if marks else 80) or bool(marks) and n_reads >= 2 and conf >= 30
        pointer = via in ("gauge", "leader")
        level = "low" if not sure else "medium" if how != "text" else "high" if pointer and textual >= 0.75 else "medium" if pointer and textual >= 0.5 or via == "beside" and textual >= 0.6 else "low"
        out += [(s, ix, r, how, round(a, 6), round(b, 6), shown, level) for r, a, b in got]
    return out


def test_links(spark):
    said, rules = tables(1)
    texts = sorted({t for x in said for t, _ in x[4]} | {x[2] for x in rules})
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", linking._key(F.col("t")).alias("k"), callouts.telling(F.col("t")).alias("w")).collect()
    key, telling = {r.t: r.k for r in df}, {r.t: r.w for r in df}
    words = spark.createDataFrame([(w,) for w in sorted({w for v in telling.values() for w in v})], "w string")
    fold = {r.w: r.f for r in words.select("w", T.fold(F.col("w")).alias("f")).collect()}
    both = words.crossJoin(words.select(F.col("w").alias("x"))).filter(T.alike(F.col("w"), F.col("x"))).collect()
    want = plain(said, rules, key, telling, fold, {(r.w, r.x) for r in both})
    out = linking.linked(spark.createDataFrame(said, CALLOUTS).repartition(3), spark.createDataFrame(rules, RULES))
    got = [(r.sheet_id, r.callout_ix, r.rule_id, r.how, round(r.share, 6), round(r.whole, 6), r.shown, r.level) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert {x[3] for x in got} == {"text", "percent", "format", "sign"} and any(x[5] for x in got)
