"""Operators 11 to 13 against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from concord.llm import arrays as A
from concord.llm import filter_audit, simhash, token_alignment
from concord.llm.queries import ALIGNED

from . import brute

DOCS = "doc_id long, text string, lang string"
CLASH = ["h1", "h2", "part", "mask", "good", "toxic", "least", "fp", "t", "key", "level", "node", "component", "top", "pairs", "times", "n_a", "groups", "pair", "n", "fingerprint"]
A_PATH, B_PATH = map(public_tokenizers.path, ALIGNED)


def corpus(seed=5, n=50):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéßÄQ") for _ in range(r.randint(2, 7))) for _ in range(400)]
    rows = []
    for d in range(n):
        text = " ".join(r.choices(words[: r.choice([20, 400])], k=r.choice([1, 2, 3, 40, 199, 200, 201, 500])))
        if d % 5 == 0:
            text += r.choice([" #", "\n|x", " 5%", "&", " $1", "*"])
        if d % 7 == 0:
            text = text.upper()
        rows.append((d, text, r.choice(["en", "de", None, ""])))
    for d in range(n, n + 25):
        base = rows[r.randrange(12)][1].split(" ")
        for _ in range(r.choice([0, 1, 2])):
            base[r.randrange(len(base))] = "changed"
        rows.append((d, r.choice([" ", "  ", "\n"]).join(base), "en"))
    texts = [None, "", "  \n ", "x" * 200_000, "one", "One", "▁x", "a\x00b", "<|endoftext|> <s> <unk> <0x41>", " lead", "trail ", "ﬁ ½ 😀", "it's 'll've", "don 't"]
    rows += [(n + 30 + i, t, "fr") for i, t in enumerate(texts)]
    return rows + [(None, rows[5][1], "en"), (5, rows[5][1], "en"), (7, "another text of one id", "de"), (n + 60, rows[9][1], None), (n + 61, rows[9][1], "en"), (None, "nobody's words alone here", None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(4).cache()


def wide(df):
    return df.select("*", *(F.lit("z").alias(c) for c in CLASH if c not in df.columns))


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def want(rows):
    return sorted(rows, key=repr)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit(spark, docs, rows):
    marks = [(d, d % 2, int(d % 3 == 0)) for d in range(0, 90, 2)] + [(None, 1, 1), (4, 0, 0), (6, None, 1), (6, 1, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = got(filter_audit.audit(wide(docs), wide(labels)), *AUDIT)
    assert out == want(brute.audit(rows, marks))
    assert len(out) == 600 * 4 and sum(r[5] for r in out) > 0 and sum(r[7] for r in out) > 0
    # every removed document goes at one step of each order
    by = {}
    for r in out:
        by.setdefault((r[0], r[1]), []).append(r[4])
    assert len({(p, sum(v)) for (p, _), v in by.items()}) == 4


def test_audit_other_limits(spark, docs, rows):
    masks = filter_audit.masks(docs, min_words=3, max_capitals=100, symbols="x")
    for d, m in got(masks.filter("doc_id < 50 AND doc_id <> 5 AND doc_id <> 7"), "doc_id", "mask"):
        text = rows[d][1]
        assert (bool(m & 1), bool(m & 4), bool(m & 8)) == (len(text.split()) < 3, False, "x" in text)


def test_audit_empty(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], DOCS), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and {r["removed"] for r in one} == {0, 1}


def test_distinct_words_verifies_equal_hashes(monkeypatch):
    texts = ["a b a c", "", "abcdefghi abcdefghj abcdefghi", "x " * 70 + "y" * 70 + " " + "y" * 69 + "z", "same same"]
    w = A.Words(pa.array(texts))
    size = (w.end - w.start).astype(A.U)
    for h in (w.hashes(), np.zeros(len(w.start), A.U), size << A.U(40)):  # the last two bring words together that differ
        monkeypatch.setattr(w, "hashes", lambda h=h: h)
        assert filter_audit.distinct_words(w).tolist() == [len(set(t.split())) for t in texts]


def encoders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B_PATH)
    byte = token_alignment.byte_level(A_PATH).tokens
    for t in ("Ġthe", "Ċ", "é"):  # the table against the library's own decoder
        assert byte[a.token_to_id(t)].decode("utf-8", "replace") == ByteLevel().decode([t])

    def one(text):
        return [(i, byte[i]) for i in a.encode(text, add_special_tokens=False).ids]

    def two(text):
        ids = b.encode(text)
        return [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids]

    return one, two


ALIGN = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


@pytest.mark.parametrize("chunk", [token_alignment.CHUNK, 7])
def test_alignment(spark, docs, rows, chunk):
    out = got(token_alignment.alignment(wide(docs), A_PATH, B_PATH, chunk), *ALIGN)
    plain = brute.aligned([r[:2] for r in rows], *encoders())
    assert out == want(plain)
    assert sum(r[1] == 0 for r in out) >= 3 and any(r[6] < r[4] for r in out)


def test_alignment_digest_and_empty(spark):
    rows = [(1, "two words"), (2, None), (3, "▁")]
    df = token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A_PATH, B_PATH, digest=True)
    plain = {r[0]: r[5] for r in brute.aligned(rows, *encoders())}
    assert {r["doc_id"]: r["groups"] for r in df.collect()} == {1: brute.sha(plain[1]), 2: "", 3: ""}
    assert token_alignment.alignment(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).count() == 0
    assert token_alignment.alignment(spark.createDataFrame([(1, None)], "doc_id long, text string"), A_PATH, B_PATH).collect()[0]["count_sum"] == 0


def test_matches_are_encoded_once():
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    r = random.Random(5)
    odd = ["  ", "\n", "\t\n ", "'s", "'S", "''ll", "\x1c", "\x85", "\u00a0", "\u200b", "\u3000", "e\u0301", "٣", "²", "Ⅷ", "中文", "🙂", "\U0001e030", "<|endoftext|>", "x" * 200, "ab", "12", " ", " ", "!?", "ё"]
    texts = [""] + ["".join(r.choices(odd, k=r.randrange(1, 40))) for _ in range(400)]
    whole = [e.ids for e in a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    v = token_alignment.byte_level.__wrapped__(A_PATH)
    for _ in range(2):
        assert [x.tolist() for x in v.encode(texts)] == whole
    # a text with a character that the two splitters class differently goes through the model whole
    m = v.matches
    m.agreed.discard("ё")
    m.other.add("ё")
    assert [x.tolist() for x in v.encode(texts)] == whole
    # what was met before is not encoded again, long matches are not kept
    met = []
    m._match, made = lambda x: met.append(x) or made(x), m._match
    v.encode(["new words, new words"] * 3)
    v.encode(["new words"])
    assert sorted(met) == sorted(set(met)) and not any(len(x) > token_alignment.LONG for x in m.memory)


def test_pair_bound_holds(spark, docs):
    bound = token_alignment.pair_bound(A_PATH, B_PATH)
    counts = token_alignment.pair_counts(token_alignment.align(docs, A_PATH, B_PATH))
    a, b = token_alignment.byte_level(A_PATH).tokens, token_alignment.pieces(B_PATH).tokens
    for r in counts.collect():
        x, y = a[r["pair"] % len(a)], b[r["pair"] // len(a)]
        assert x.endswith(y) or y.endswith(x)
    assert counts.count() < bound < 1_000_000


def test_bits():
    r = random.Random(1)
    for n in (1, 64, 65, 1000):
        a, b = (np.unique([r.randrange(n) for _ in range(n // 2 + 1)]) for _ in range(2))
        both = token_alignment.Bits.of(a, n) & token_alignment.Bits.of(b, n)
        assert both.select().tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        every = np.arange(n)
        assert token_alignment.Bits.of(a, n).rank(every).tolist() == [int((a <= i).sum()) for i in range(n)]


def test_simhash(spark, docs, rows):
    out = got(simhash.components_of(wide(docs)), "doc_id", "fingerprint", "component_id")
    plain = brute.simhashes([r[:2] for r in rows])
    assert out == want(plain)
    assert sum(r[0] is not None and r[0] != r[2] for r in out) > 10


def test_simhash_empty_and_unlinked(spark):
    assert simhash.components_of(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = simhash.components_of(spark.createDataFrame([(3, None), (2, ""), (None, " "), (9, "a few words of text here")], "doc_id long, text string"))
    assert got(out, "doc_id", "component_id") == want([(3, 2), (2, 2), (None, 2), (9, 9)])


def points(seed, n=300):
    """Dense families: all within a few bits of some centres, so that buckets exceed a small limit at every level."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(5)] + [0, (1 << 64) - 1]
    out = set()
    while len(out) < n:
        x = r.choice(centres)
        for _ in range(r.randrange(5)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out | {centres[0] ^ x for x in range(1 << 8)})


@pytest.mark.parametrize("limit,radius", [(1024, 2), (32, 2), (16, 1)])
def test_links_lose_nothing(spark, limit, radius):
    every = points(limit + radius)
    df = spark.createDataFrame([(simhash._long(x),) for x in every], "fp long")
    bound = simhash.buckets(df, radius, limit).groupBy("level", "t", "key").count().agg(F.max("count")).collect()[0][0]
    assert bound <= limit
    found = simhash.links(df, radius, limit).collect()
    at = {simhash._long(x): i for i, x in enumerate(every)}
    i, j = (np.array([at[r[k]] for r in found], np.int64) for k in ("a", "b"))
    assert simhash.roots(len(every), i, j).tolist() == brute.components(every, radius)


def test_levels_cover_all_pairs():
    r = random.Random(2)
    for radius, limit in ((1, 16), (2, 1024), (3, 1024)):
        every = simhash.levels(radius, limit)
        assert all(2 ** (64 - m.bit_count()) <= limit for m in every[-1])
        for _ in range(200):
            diff = sum(1 << b for b in r.sample(range(64), radius))
            alive = {t for t, m in enumerate(every[0]) if not m & diff}
            assert alive
            for level in every[1:]:
                below = {t: [c for c in range(t * (radius + 1), (t + 1) * (radius + 1)) if not level[c] & diff] for t in alive}
                assert all(below.values())
                alive = {c for v in below.values() for c in v}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    x = rng.integers(0, 2**63, 200, dtype=np.uint64)
    x[1::3] = x[0] ^ (np.uint64(1) << rng.integers(0, 64, len(x[1::3]), dtype=np.uint64))
    for step in (1, 2, 63, 64, 65, 130):
        asked = rng.random(256) < 0.8
        asked[200 - step :] = False
        found = simhash.near(simhash.planes(x, step // 64 + 2), step, np.packbits(asked, bitorder="little").view("<u8"), radius)
        plain = [i for i in range(200 - step) if asked[i] and int(x[i] ^ x[i + step]).bit_count() <= radius]
        assert found.tolist() == plain
