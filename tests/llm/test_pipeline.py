"""The pipeline against plain versions of its stages, and the registered queries on the smallest tables."""

import random

import numpy as np
import pytest

import corpus_pipeline
from concord.llm import quality
from concord.llm.queries import queries, tokenizer

from . import brute
from .test_operators import corpus, got, want

SMALL = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    import tiktoken

    from concord.llm import bpe

    r = random.Random(11)
    rows = [x for x in corpus() if x != (7, "another text of one id")]
    bad = [(5000 + i, " ".join(w.upper() + "!!" for w in r.choices("ab cd ef gh ij".split(), k=60))) for i in range(40)]
    rows = rows + bad
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(d, 0 if d and d >= 5000 else 1, 0) for d, _ in rows if d is not None and d != 12], "doc_id long, quality int, toxic int")
    items = [(0, " ".join(rows[4][1].split()[:30])), (1, "nothing of it here")]
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))

    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    weights = quality.fit(table, labels)
    left = [(x.doc_id, x.text) for x in quality.keep_good(table, weights).collect()]
    assert len(rows) - len(left) >= 35 and all(d is None or d < 5000 for d, _ in left)
    held = brute.lines(left)
    white = " \t\n\v\f\r"
    docs_of = {}
    for d, t in left:
        for x in (t or "").split("\n"):
            k = brute.low(x.strip(white))
            if d is not None and len(k) >= 20:
                docs_of.setdefault(k, set()).add(d)
    gone = lambda d, x: d is not None and len(docs_of.get(brute.low(x.strip(white)), ())) >= 3 and d != max(docs_of[brute.low(x.strip(white))])
    left = [(d, t if t is None else "\n".join(x for x in t.split("\n") if not gone(d, x))) for d, t in left]
    assert [brute.sha(t or "") for _, t in left] == [x[3] for x in held]
    away = {x[0] for x in brute.near(left, 5) if not x[3]}
    left = [(d, t) for d, t in left if d not in away]
    flags = brute.contaminated(left, items)
    left = [x for x, f in zip(left, flags) if not f[5]]
    assert away and any(f[5] for f in flags)
    path, pattern = tokenizer()
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    ids = [np.array(e.encode_ordinary(t or ""), "<u4").tobytes() for _, t in left]
    assert got(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want([(d, len(i) // 4, brute.sha(i), brute.sha(t or "")) for (d, t), i in zip(left, ids)])


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).schema.simpleString() == docs.schema.simpleString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_run(spark, name):
    if name == "op11_filter_audit":  # five steps of 120 orders for each part
        parts = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("coalesce(lang, '')").distinct().count()
        assert queries()[name](spark, SMALL).count() == 600 * parts
        return
    base = spark.read.parquet(f"{SMALL}/{'pages' if name in ('op4_html_text', 'op7_url_filter') else 'documents'}.parquet").count()
    n = queries()[name](spark, SMALL).count()
    assert n == base or name == "op6_token_counts" and 0 < n <= base
