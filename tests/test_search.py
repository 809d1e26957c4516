"""Phrases in readings: one scan against plain versions, in one shard and in many."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concord.functions import text as T
from concord.operators import locate, pieces, search

KIND = "id long, tokens array<string>"


def tables(seed, rules=60, readings=120):
    r = random.Random(seed)
    words = [f"t{i}" for i in range(40)]
    read = [(i, r.choices(words, [1 / (k + 1) for k in range(40)], k=r.choice([0, 1, 3, 20, 60]))) for i in range(readings)]
    want = []
    for i in range(rules):
        t = r.choice(read)[1]
        a = r.randrange(len(t) + 1)
        want.append((i, r.choice([t[a : a + r.randrange(1, 8)], r.choices(words, k=4), t[:2], [], ["none"], ["t0"]])))
    return want + [(1000, want[0][1]), (1001, ["t0", "t0"]), (1002, ["t0", "t1"])], read + [(5000, None), (5001, read[3][1])]


@pytest.mark.parametrize("size", [search.SHARD_BYTES, 40])
def test_runs(spark, size):
    want, read = tables(1)
    out = search.runs(spark.createDataFrame(want, KIND), spark.createDataFrame(read, KIND).repartition(5), size)
    has = lambda p, t: any(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1))
    plain = [(i, j) for i, p in want if p for j, t in read if t and has(p, t)]
    assert sorted((r["rule_id"], r["reading_id"]) for r in out.collect()) == sorted(plain)


def overlaps(want, read, k):
    out = []
    for i, p in want:
        hits = sorted((-len(set(p) & set(t or [])), j) for j, t in read if p and len(set(p) & set(t or [])) >= min(2, len(set(p))))
        out += [(i, j, -n, rank) for rank, (n, j) in enumerate(hits[:k], 1)]
    return out


@pytest.mark.parametrize("size,k,frequent,held", [(search.SHARD_BYTES, 10, 256, 1 << 17), (60, 3, 256, 5), (search.SHARD_BYTES, 2, 64, 1)])
def test_ranked(spark, monkeypatch, size, k, frequent, held):
    monkeypatch.setattr(search, "FREQUENT", frequent)
    monkeypatch.setattr(search, "HELD", held)
    want, read = tables(2)
    out = search.ranked(spark.createDataFrame(want, KIND), spark.createDataFrame(read, KIND).repartition(3), k, size)
    assert sorted((r["rule_id"], r["reading_id"], r["overlap"], r["rank"]) for r in out.collect()) == sorted(overlaps(want, read, k))


def test_pruned_readings_change_nothing():
    """Once readings with a phrase's rare tokens are known, readings of frequent tokens alone are not scored for it."""
    r = random.Random(3)
    common = [f"c{i}" for i in range(6)]
    want = [(i, common + [f"r{i}-{j}" for j in range(8)]) for i in range(20)]
    read = [(i, r.sample(common, 5) + (r.sample(r.choice(want)[1], 9) if i % 4 == 0 else [])) for i in range(600)]
    every = search.Overlaps([p for _, p in want], 2)
    parts, scored = [np.zeros(0, np.int64) for _ in range(3)], []
    for j, t in read:
        i, n = every.of(set(t))
        scored.append(len(i))
        cols = [np.concatenate(x) for x in zip(parts, (i, n, np.full(len(i), j)))]
        at = every.best(*cols)
        parts = [c[at] for c in cols]
    assert sorted((i, j, n) for i, n, j in zip(*map(np.ndarray.tolist, parts))) == sorted(x[:3] for x in overlaps(want, read, 2))
    assert scored[1] == 20 and sum(scored[500:]) < 100 and not len(every.reach)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], KIND), spark.createDataFrame([(1, ["a", "b"])], KIND)
    for f in (search.runs, search.ranked):
        assert f(none, some).count() == 0 and f(some, none).count() == 0
        assert f(spark.createDataFrame([(1, [])], KIND), some).count() == 0


def test_staged_finds_by_each_method(spark):
    rules = [(1, "alpha beta gamma delta"), (2, "one two three four. Five six seven eight"), (3, "nothing of this stands anywhere")]
    reads = [(7, "x alpha beta gamma delta y"), (8, "five six seven eight and one two three four"), (9, "alpha beta")]
    out = locate.staged(locate.prepared(spark.createDataFrame(rules, "k long, t string"), "k", "t"), locate.prepared(spark.createDataFrame(reads, "k long, t string"), "k", "t"))
    assert sorted((r["rule_id"], r["method"], r["reading_id"], r["coverage"]) for r in out.collect()) == [(1, "exact", 7, 100), (2, "fragments", 8, 100), (3, None, None, None)]


def odd_texts(seed, n):
    """Texts of what tokens reach over white space for, and of what looks like it."""
    r = random.Random(seed)
    some = ["-", "–", " ", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "﻿", " ", "1", "25", "7.5", ".", ",", ":", "%", "º", ")", '"', "«", "’", "<", "|", "]", "a", "C", "к", "Σ", "İ", "٣", "the", "The", "WORD", "ё", "\U0001d49c", "_"]
    fixed = ["сло- во", "a- <| b", "x - 5", "- - 5", "5 . 3", '5" .3', '5 " . 3', "5, - 3", "5 , 3", "-  5", "end. 5", "2025. 5 more", "a-b-c d", "ΟΣ ΟΣ. ΑΣ", "\x1c- 5", "", " ", None]
    return [(i, t) for i, t in enumerate(fixed + ["".join(r.choices(some, k=r.randrange(25))) for _ in range(n)])] + [(None, "a b")]


def test_pieces_hold_the_tokens_of_their_texts(spark):
    df = spark.createDataFrame(odd_texts(5, 3000), "id long, raw string").repartition(3)
    got = {}
    for x in pieces.cut(df).collect():
        at = iter(x["at"])
        got |= {i: {t for _ in range(n) for t in x["lines"][next(at)].split(" ") if t} for i, n in zip(x["ids"], x["sizes"])}
        assert next(at, None) is None
    want = {i: set(t) for i, t in df.filter("id IS NOT NULL AND raw IS NOT NULL").select("id", T.phrase_tokens(F.col("raw"))).collect()}
    assert got == want


@pytest.mark.parametrize("texts,found,sizes", [([], [], []), ([""], [], [0]), (["a"], ["a"], [1]), (["", " ", "5 "], ["5"], [0, 0, 1]), (["a B.", "b a", "- 5"], ["a", "b", "- 5"], [2, 2, 1])])
def test_pieces_of_little_text(texts, found, sizes):
    got, n, at = pieces.pieces(pa.array(texts, pa.string()))
    assert n.tolist() == sizes and {got[i].as_py() for i in at.tolist()} == set(found) and len(at) == sum(sizes)


def test_unsound_texts_have_pieces(spark):
    df = spark.sql("SELECT 1L AS id, CAST(unhex('FF206120622E20FE2D20C3') AS STRING) AS raw UNION ALL SELECT 2L, 'a b'")
    got = {i: n for x in pieces.cut(df).collect() for i, n in zip(x["ids"], x["sizes"])}
    assert got[2] == 2 and got[1] >= 3


def test_pieces_are_taken_apart_once(spark):
    """What is taken apart are distinct pieces, not texts: case of A to Z and marks behind a word make none."""
    r = random.Random(1)
    words = ["one", "One", "two,", "two", "three.", "слово", "слово.", "3", "x - 5"]
    rows = [(i, " ".join(r.choices(words, k=200))) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, raw string").coalesce(1)
    (x,) = pieces.cut(df).collect()
    assert len(x["ids"]) == 50 and len(x["lines"]) < 50 and sum(map(len, x["lines"])) < 1000
    plan = locate.candidates(locate.prepared(df, "id", "raw"), locate.prepared(df, "id", "raw"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "transform(pieces" in plan


def test_candidates_of_texts_are_those_of_their_tokens(spark):
    texts = odd_texts(6, 600)
    rules = locate.prepared(spark.createDataFrame(texts[:200], "k long, t string"), "k", "t")
    reads = locate.prepared(spark.createDataFrame(texts, "k long, t string").repartition(4), "k", "t")
    rows = lambda df: sorted(map(tuple, df.collect()))
    found = rows(locate.candidates(rules, reads, 3))
    assert len(found) > 200 and found == rows(search.ranked(rules, reads.drop("raw"), 3))
