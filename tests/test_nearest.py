import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concord.operators import align, nearest


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """A text whose closest reading is the twelfth by overlap (eleven hold all its words, scattered), one that no reading has a word of, none, and an empty one."""
    at = tmp_path_factory.mktemp("crowded")
    one = [f"слово{chr(1072 + i)}{chr(1072 + i)}" for i in range(20)]
    scattered = " ".join(x for w in reversed(one) for x in (w, "прочее", "иное", "другое"))
    read = " ".join(w if i != 7 else "ошибка" for i, w in enumerate(one))
    rules = [(1, " ".join(one)), (2, "ЩЩЪЪ"), (3, None), (4, "")]
    spark.createDataFrame(rules, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    spark.createDataFrame([(i, scattered) for i in range(11)] + [(99, "начало " + read + " конец"), (100, None), (101, " \n")], "doc_id long, text string").write.parquet(str(at / "documents.parquet"))
    return str(at)


def test_all_readings_count_and_texts_read_nowhere_too(spark, crowded):
    from concord.plans.queries import QUERIES

    every = {r.tag: r for r in QUERIES["score_totals"](spark, crowded).collect()}[None]
    # one word misread, one read nowhere
    assert (every.lines, every.missed, every.tokens, every.token_errors) == (4, 3, 21, 2)
    assert every.word_rate == 17.4  # 4 of 23: a text without words is one empty word


@pytest.mark.parametrize("spaced", [False, True])
def test_edits_of_many_lines_at_once_are_those_of_each(monkeypatch, spaced):
    r = random.Random(2)
    made = lambda letters, sizes: (" " if spaced else "").join(r.choices(letters, k=r.choice(sizes)))
    apart = lambda x: x.split(" ") if spaced else list(x)
    for _ in range(20):
        monkeypatch.setattr(nearest, "STRETCH", r.choice([1, 50, 4096]))
        monkeypatch.setattr(nearest, "CELLS", r.choice([1, 40, 1 << 15]))
        lines = [made("abcd", [1, 5, 63, 64, 65, 128, 129, 200]) for _ in range(5)]
        texts = [made("abcdef", [0, 1, 3, 60, 64, 300, 900]) for _ in range(4)]
        texts.append(texts[-1] + (" " if spaced else "") + lines[0])
        assert nearest.Coded(lines, spaced).distances(pa.array(texts)).tolist() == [[align.distance_inside(apart(p), apart(t)) for p in lines] for t in texts]


def test_scores_are_those_against_all_readings(spark, monkeypatch):
    """Against the plain score of each line with every reading beside it; some scans, of few lines each."""
    monkeypatch.setattr(nearest, "SHARD_LINES", 7)
    r = random.Random(5)
    some = ["Масса", "нетто", "0,75 л", "1", "10,75", "(a)", "x-", "ray", "«Q»", "%", "İ", "ё", "–", "°", "\n", " ", "б.", "e", "75"]
    made = lambda n: r.choice(["", " "]).join(r.choices(some, k=r.randrange(n)))
    raws = [(made(60),) for _ in range(20)] + [(made(900),), (None,), ("",), ("\n",)]
    lines = [(i, made(40)) for i in range(12)] + [(20 + i, raws[i][0][3:30]) for i in range(6)] + [(30, None), (31, ""), (32, "..."), (33, "q" * 150)]
    lines, raws = spark.createDataFrame(lines, "id long, text string"), spark.createDataFrame(raws, "raw string")
    every = raws.filter(r"raw rlike '\\S'").agg(F.sort_array(F.collect_list("raw")).alias("readings"))
    want = align.score_lines(lines.select("id", F.coalesce("text", F.lit("")).alias("text")).crossJoin(every), ["id"], "text", "readings")
    assert sorted(map(tuple, nearest.scored(lines, ["id"], "text", raws).collect())) == sorted(map(tuple, want.collect()))
