"""Each operator against a plain version, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import bpe, decontaminate, fingerprint, html_text, line_dedup, near_dedup, quality, substring_dedup, token_counts, url_filter
from concord.llm.graph import components
from concord.llm.queries import URL_RULES, tokenizer

from . import brute

DOCS = "doc_id long, text string"
#: Names that operators use themselves.
CLASH = ["hit", "items", "_hit", "keep", "tkey", "n_lines", "at", "start", "component", "node", "_keep", "_d", "h1", "a", "id", "host"]


def corpus(seed=3, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 6))) for _ in range(300)]
    shared = [" ".join(r.choices(words, k=70)) for _ in range(3)]
    line = "A common Line of more than twenty characters"
    rows = []
    for d in range(n):
        text = " ".join(r.choices(words, k=r.choice([1, 5, 40, 120, 300])))
        if d % 4 == 0:
            text += "\n " + r.choice(shared) + " \n" + " ".join(r.choices(words, k=20))
        if d % 3 == 0:
            text += f"\n\t{line.upper() if d % 2 else line}  \nend"
        rows.append((d, text))
    for d in range(n, n + 20):
        base = rows[r.randrange(10)][1].split(" ")
        for _ in range(r.choice([0, 0, 1, 3])):
            base[r.randrange(len(base))] = "changed"
        rows.append((d, " ".join(base)))
    return rows + [(n + 20, None), (n + 21, ""), (n + 22, "   \n\n "), (n + 23, rows[3][1]), (n + 24, "x" * 200_000), (n + 25, "one"), (n + 26, "One"), (None, rows[5][1]), (5, rows[5][1]), (7, "another text of one id")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(4).cache()


def alternating(n, zero="a", one="b"):
    """The Thue-Morse word of n characters, and its opposite: equal under every polynomial hash modulo 2**64 from 1,024 on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((zero, one)[b] for b in bits), "".join((one, zero)[b] for b in bits)


def wide(df):
    return df.select("*", *(F.lit("z").alias(c) for c in CLASH))


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def want(rows):
    return sorted(rows, key=repr)


def test_substring(spark, docs, rows):
    out = substring_dedup.removed(wide(docs), substring_dedup.repeats(wide(docs)), digest=True)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want(brute.substring(rows))
    assert sum(r[2] for r in brute.substring(rows)) > 100
    texts = substring_dedup.removed(docs, substring_dedup.repeats(docs))
    assert texts.columns == docs.columns and texts.count() == len(rows)


def test_substring_rows_of_one_id(spark):
    """Texts of one doc_id that a 32-bit hash does not tell apart; and very many rows of one doc_id."""
    shared = " ".join(f"s{i}" for i in range(60))
    pair = [" ".join(f"w{i}" for i in range(60)) + " 4826", "short 87250"]
    rows = [(2, t) for t in pair] + [(1, pair[0])] + [(3, f"{i} {shared if i % 3 == 0 else ''} {i * i}") for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    one, two = df.filter("doc_id = 2").select(F.hash("text")).collect()
    assert one == two
    out = substring_dedup.removed(df, substring_dedup.repeats(df), digest=True)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want(brute.substring(rows))
    lost = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df), digest=True)
    assert got(lost, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want(brute.lines(rows))


def test_lines(spark, docs, rows):
    out = line_dedup.apply_bitmaps(wide(docs), line_dedup.keep_bitmaps(wide(docs)), digest=True)
    assert got(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want(brute.lines(rows))
    assert sum(r[2] for r in brute.lines(rows)) > 10
    kept = line_dedup.apply_bitmaps(wide(docs), line_dedup.keep_bitmaps(docs))
    assert kept.columns == wide(docs).columns and kept.filter("text IS NULL").count() == 1


def test_texts_built_to_collide(spark):
    """Long words, lines and word sequences that polynomial hashes modulo 2**64 can't tell apart."""
    a, b = alternating(2048)
    c, d = (x.split() for x in alternating(2048, "yes ", "no "))
    story = lambda w: " ".join([f"w{i}" for i in range(60)] + [w] + [f"v{i}" for i in range(60)])
    texts = [story(a), story(b), story(a), story("other"), a, b, a, "x\n" + a, b + "\ny", " ".join(c), " ".join(d), " ".join(c[:70]), " ".join(d[:70]), a + " " + b, b + " " + a]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, DOCS).repartition(2)
    out = substring_dedup.removed(df, substring_dedup.repeats(df), digest=True)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want(brute.substring(rows))
    out = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df), digest=True)
    assert got(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want(brute.lines(rows))
    for k in (2, 5):
        assert got(near_dedup.near_duplicates(df, k), "doc_id", "n_shingles", "component_id", "kept") == want(brute.near(rows, k))
    items = [(0, story(a)), (1, b), (2, " ".join(c[:13])), (3, a + " " + b)]
    out = decontaminate.judge(df, spark.createDataFrame(items, "item_id long, text string"))
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want(brute.contaminated(rows, items))


def test_byte_hashes():
    import pyarrow as pa

    from concord.llm import arrays as A

    words = sorted({"".join(random.Random(i).choices("abé\x00", k=i % 90 + 1)) for i in range(4000)} | {"\x00" * i for i in range(1, 200)})
    for which in range(3):
        h = A.Words(pa.array([" ".join(words)])).hashes(which)
        assert len(set(h.tolist())) == len(words)
        assert h.tolist() == [int(A.Words(pa.array([x])).hashes(which)[0]) for x in words]


def test_line_stream_over_any_cuts():
    import pyarrow as pa

    r = random.Random(5)
    for _ in range(300):
        rows = sorted({(r.randrange(4), 0, r.randrange(r.choice([2, 5, 12])), r.randrange(2)) for _ in range(r.randrange(1, 50))}, key=lambda x: (x[0], -x[2], x[3]))
        docs = {k: {x[2] for x in rows if x[0] == k} for k in range(4)}
        expected = {x for x in rows if len(docs[x[0]]) >= 3 and x[2] != max(docs[x[0]])}
        cuts = [i for i in range(1, len(rows)) if rows[i][:3] != rows[i - 1][:3]]
        cuts = sorted(r.sample(cuts, min(len(cuts), r.randrange(4))))
        found, late, n, top = [], [], {}, {}
        for a, b in zip([0] + cuts, cuts + [len(rows)]):
            part, batches = rows[a:b], []
            while part:
                size = r.randrange(1, 6)
                p, part = part[:size], part[size:]
                batches.append(pa.RecordBatch.from_arrays([pa.array([x[i] for x in p], pa.int64()) for i in (0, 1, 2, 3, 3)] + [pa.array([9] * len(p), pa.int32()), pa.array([[0]] * len(p), pa.list_(pa.int32()))], names=["h1", "h2", "doc_id", "t1", "t2", "n_lines", "at"]))
            for o in line_dedup._stream(3)(iter(batches)):
                for x in o.to_pylist():
                    k = (x["h1"], x["h2"], x["doc_id"], x["t1"])
                    if x["kind"] == 2:
                        n[x["h1"]] = n.get(x["h1"], 0) + x["docs"]
                        top[x["h1"]] = max(top.get(x["h1"], -1), x["doc_id"])
                    else:
                        (found if x["kind"] == 0 else late).append(k)
        found += [k for k in late if n[k[0]] >= 3 and k[2] < top[k[0]]]
        assert len(found) == len(set(found)) and set(found) == expected


@pytest.mark.parametrize("k", [2, 5])
def test_near(spark, docs, rows, k):
    # rows of one id with different texts are judged each by its own text; the plain version keeps rows apart too
    rows = [r for r in rows if r != (7, "another text of one id")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    out = near_dedup.near_duplicates(wide(df), k)
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == want(brute.near(rows, k))


def test_near_large_regions(spark):
    """Many near copies of one text, some linked only by chains."""
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words))]
    for d in range(1, 160):
        w = list(words)
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            w[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((d, " ".join(w)))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), 2)
    assert got(out, "doc_id", "component_id") == want([(a, c) for a, _, c, _ in brute.near(rows, 2)])


def test_near_pairs_in_families_below_the_limit(spark):
    """A family of texts too different to link, with pairs just above the limit: its large regions break up, the pairs stay."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(600)]

    def changed(w, n):
        w = list(w)
        for i in r.sample(range(600), n):
            w[i] = f"x{r.randrange(10**9)}"
        return w

    rows = []
    for d in range(200):
        w = changed(words, 52)
        rows.append((d, " ".join(w)))
        if d % 3 == 0:
            rows.append((1000 + d, " ".join(changed(w, 62))))
    expected = [(a, c) for a, _, c, _ in brute.near(rows, 1)]
    assert sum(a != c for a, c in expected) == 67
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), 1)
    assert got(out, "doc_id", "component_id") == want(expected)


def test_near_regions_in_pieces_and_blocks(spark):
    """The same result when a large region is streamed in pieces and its rest is cut into small blocks."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(200)]

    def changed(w, n):
        w = list(w)
        for i in r.sample(range(200), n):
            w[i] = f"x{r.randrange(10**9)}"
        return w

    rows = []
    for d in range(300):
        w = changed(words, r.choice([1, 2, 14, 16]))
        rows.append((d, " ".join(w)))
        if d % 5 == 0:
            rows.append((1000 + d, " ".join(changed(w, 18))))
    expected = [(a, c) for a, _, c, _ in brute.near(rows, 1)]
    old = near_dedup.HELD, near_dedup.SIGNATURES, near_dedup.BLOCK, near_dedup.BLOCK_SHINGLES
    try:
        near_dedup.HELD, near_dedup.SIGNATURES, near_dedup.BLOCK, near_dedup.BLOCK_SHINGLES = 60, 50, 20, 3000
        out = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), 1)
        assert got(out, "doc_id", "component_id") == want(expected)
    finally:
        near_dedup.HELD, near_dedup.SIGNATURES, near_dedup.BLOCK, near_dedup.BLOCK_SHINGLES = old


def test_candidate_pieces_cover_the_region():
    import pyarrow as pa

    r = np.random.default_rng(3)
    sizes = [3, 40, 9000, 1, 30, 25, 24, 5000]
    key = np.repeat(np.arange(len(sizes)), sizes).astype(np.int64)
    ids = r.permutation(len(key)).astype(np.int64)
    z = r.integers(0, 2**62, len(key))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.zeros(len(k), np.int8)), pa.array(k), pa.array(k), pa.array(i), pa.array(y), pa.array(y)], names=list("abcdef")) for k, i, y in zip(np.array_split(key, 40), np.array_split(ids, 40), np.array_split(z, 40))]
    old = near_dedup.HELD
    try:
        near_dedup.HELD = 2000
        rows = [x for b in near_dedup._candidates(iter(batches)) for x in b.to_pylist()]
    finally:
        near_dedup.HELD = old
    by = {}
    for x in rows:
        if x["kind"] == 1:
            by.setdefault(x["a"], set()).add(x["b"])
    assert sorted(map(sorted, by.values())) == sorted(sorted(ids[key == k].tolist()) for k, n in enumerate(sizes) if n > near_dedup.REGION)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    out = components(spark.createDataFrame(links, "a long, b long"))
    assert got(out, "node", "component") == want([(x, find(x)) for x in top])


def test_contamination(spark, docs, rows):
    r = random.Random(9)
    items = [(i, " ".join(rows[i * 4 % 60][1].split()[:k])) for i, k in enumerate([13, 20, 3, 1, 40, 13])] + [(99, None), (98, ""), (97, "..."), (None, rows[8][1]), (1, "nothing like it here at all in any of the texts of this small table")]
    r.shuffle(items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.judge(wide(docs), wide(bench))
    expected = brute.contaminated(rows, items)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(out, *cols) == want(expected)
    clean = decontaminate.remove(wide(docs), bench)
    assert clean.columns == wide(docs).columns and clean.count() == sum(not x[5] for x in expected)
    old = decontaminate.BLOCK_BYTES
    assert len(list(decontaminate.blocks(bench, 100))) > 5
    try:  # the same in several blocks and passes
        decontaminate.blocks.__defaults__ = (100,)
        assert got(decontaminate.judge(wide(docs), bench), *cols) == want(expected)
        clean = decontaminate.remove(wide(docs), bench)
        assert clean.columns == wide(docs).columns and clean.count() == sum(not x[5] for x in expected)
    finally:
        decontaminate.blocks.__defaults__ = (old,)


def test_longest_matches(spark):
    item = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(1, "zz " + " ".join(f"t{i}" for i in range(5, 25)) + " yy")], DOCS)
    out = decontaminate.matches(df, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert got(out, "doc_id", "doc_word", "item_id", "item_word", "n_words") == [(1, 1, "7", 5, 20)]


def test_longest_matches_against_all_pairs(spark):
    r = random.Random(11)
    text = lambda n: " ".join(r.choices("a b c".split(), k=n))
    rows = [(d, text(r.randrange(60))) for d in range(12)] + [(50, None), (51, "...")]
    items = [(i, text(r.choice([2, 4, 5, 9, 30]))) for i in range(8)] + [(9, "")]
    expected = []
    for d, t in rows:
        for i, q in items:
            x, y = (t or "").split(), q.split()
            x = [] if x == ["..."] else x
            least = min(5, len(y))
            for a in range(len(x)):
                for b in range(len(y)):
                    n = 0
                    while a + n < len(x) and b + n < len(y) and x[a + n] == y[b + n]:
                        n += 1
                    if n >= max(1, least) and (a == 0 or b == 0 or x[a - 1] != y[b - 1]):
                        expected.append((d, a, str(i), b, n))
    out = decontaminate.matches(wide(spark.createDataFrame(rows, DOCS)), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert got(out, "doc_id", "doc_word", "item_id", "item_word", "n_words") == want(expected)


def test_suffix_array_order():
    r = np.random.default_rng(4)
    for n in (1, 2, 30, 400):
        w = r.integers(0, 4, n).astype(np.uint64)
        sa = decontaminate.SuffixArray(w, 40)
        rank = (np.searchsorted(sa.vocabulary, w) + 1).tolist()
        suffixes = [tuple(rank[i : i + 40]) for i in sa.order]
        assert suffixes == sorted(suffixes)


def test_codec(spark, docs, rows):
    import tiktoken

    path, pattern = tokenizer()
    ranks = bpe.read_ranks(path)
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = ["  \n\n  x", "'s'S don't", "x" * 300, "汉字" * 40, "\x00\x01", "😀😀 a\xa0b", "½²٣", "a\x1cb \x85"]
    all_rows = rows + [(1000 + i, t) for i, t in enumerate(odd)]
    out = bpe.encode(wide(spark.createDataFrame(all_rows, DOCS)), path, pattern, forms=True)
    ids = {k: np.array(e.encode_ordinary(t or ""), "<u4").tobytes() for k, (_, t) in enumerate(all_rows)}
    expected = [(d, len(ids[k]) // 4, brute.sha(ids[k]), brute.sha(t or "")) for k, (d, t) in enumerate(all_rows)]
    assert got(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want(expected)
    assert all(bytes(r.decoded).decode() in {t or "" for _, t in all_rows} for r in out.select("decoded").collect())


def test_prefix_table_appends_and_edits():
    b = bpe.encoder(*tokenizer())
    r = random.Random(8)
    p = bpe.Prefixes(b)
    for _ in range(60):
        if r.random() < 0.5:
            p.append(bytes(r.choice(b"thenaing xyz") for _ in range(r.randrange(6))))
        elif p.data:
            i = r.randrange(len(p.data))
            p.replace(i, min(len(p.data), i + r.randrange(4)), bytes(r.choice(b"thening") for _ in range(r.randrange(4))))
        assert p.ids() == bpe.Prefixes(b, p.data).ids()
        assert b"".join(b.token[t] for t in p.ids()) == p.data


def test_token_counts(spark, docs, rows):
    path, pattern = tokenizer()
    lengths = [r.n_tokens for r in bpe.lengths(docs, path, pattern).collect()]
    hist = token_counts.histogram(bpe.lengths(docs, path, pattern))
    expected = []
    for x in sorted(set(lengths)):
        expected.append((x, lengths.count(x), sum(y >= x for y in lengths), sum(y for y in lengths if y >= x), sum(min(x, y) for y in lengths), sum(lengths)))
    assert got(token_counts.limits(hist), "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "truncated_total", "total_tokens") == want(expected)
    assert token_counts.truncated_total(hist, 50).first()["truncated"] == sum(min(50, y) for y in lengths)
    q = token_counts.quantiles(hist, [0.5, 0.9]).first()
    assert q["q0.5"] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert token_counts.limits(hist.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://a.EXAMPLE.com/en/71?x=1", "https://b.com/en/x#y", "http://com/en/", "http://q.net/de/8", "http://example.net/de/88", "ftp://x.example.net/de/9", "no url", None, "", "http://org", "http://k.org/es/a", "http://k.org/ES/a", "http://k.org?x=/es/", "http://notnet/de/", "http://example.com/en/6", "http://a.b.example.net/de/8?z://w"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def judge(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1].split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        host, path = brute.low(host), slash + path
        fit = [(len(h), len(p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    out = url_filter.filter_urls(df.withColumn("host", F.lit(1)).withColumn("rule", F.lit(2)), URL_RULES)
    assert got(out, "page_id", "host", "path", "rule", "verdict") == want([(i, *judge(u)) for i, u in enumerate(urls)])


def page(n, text, article=True):
    body = f"<article><h1>Title {n}</h1>{text}</article>" if article else f'<div class="txt">{text}</div>'
    return f'<!doctype html><html><head><title>t</title><script>var a="</p>";</script><style>p{{}}</style></head><body class="has-sidebar"><nav><ul><li>Home<li>About</ul></nav><div id="box">Subscribe to our list</div>{body}<div class="ad">buy {n}</div><aside>side {n}</aside><form><input><button>Go</button></form><section class="comments"><p>nice {n}</p></section><footer>&copy; {n}</footer></body></html>'


def test_html(spark):
    rows = [(i, "http://h.com/x", page(i, f"<p><b>Story {i}&amp; more<br><p>two  \n {i}</p>")) for i in range(5)]
    rows += [(10 + i, "http://plain.com/x", page(i, f"<p>Words {i} of a story</p><p>and {i} more</p>", False)) for i in range(6)]
    rows += [(20, None, page(1, "<p>alone")), (21, "http://h.com/y", None), (22, "http://h.com/y", ""), (23, "no host", "just text"), (0, "http://h.com/x", rows[0][2])]
    out = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract_pages(wide(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert out[0, "http://h.com/x"][0] == "Title 0\nStory 0& more\ntwo 0"
    assert out[13, "http://plain.com/x"] == ("Words 3 of a story\nand 3 more", 29)
    assert out[20, None][0] == "Title 1\nalone" and out[21, "http://h.com/y"] == ("", 0) and out[23, "no host"][0] == "just text"


def wrapped(pages):
    """The wrapper of these pages of one host, counted plainly."""
    trees = [html_text.outline(html_text.parse(p)) for p in dict.fromkeys(pages)]
    shapes = {}
    for t, _ in trees:
        shapes[t.write()] = shapes.get(t.write(), 0) + 1
    first = sorted(shapes, key=lambda s: (-shapes[s], html_text._outline_key(s)))[: html_text.SHAPES]
    w = html_text.induce(first)
    at, texts = {}, {}
    for t, members in trees:
        for i, j in html_text.align(html_text.Tree.read(w), t)[1]:
            own = [x for x in members[j] if x.tag == "#"]
            if own or len(members[j]) > 1 or j and t.kids[j]:
                n, c, x, lo, hi = at.get(i, (0, 0, 0, 10**9, 0))
                at[i] = n + 1, c + sum(len(y.text) for y in own), x + sum(y.links for y in own), min(lo, len(members[j])), max(hi, len(members[j]))
            for key in {html_text._key(y.text) for y in own}:
                texts[i, key] = texts.get((i, key), 0) + 1
    common = [(*k, n >= html_text.ALWAYS * at[k[0]][0]) for k, n in texts.items() if n >= html_text.LEAST and n >= html_text.ALIKE * at[k[0]][0]]
    return w, [(i, *at[i]) for i in at], common


def site(n, head="", foot=""):
    """Pages of a host whose names say nothing: a menu, a line that varies, a story of one to four paragraphs, a closing line."""
    r = random.Random(n)
    story = "".join(f"<p>paragraph {n} {j} tells more</p>" for j in range(1 + n % 4))
    menu = "".join(f"<li><a href=/x{r.random()}>item {r.random()}</a>" for _ in range(3 + n % 3))
    return f"<body><div class=k1><ul>{menu}</ul></div><div class=k2>buy {r.random()} now</div>{head}<div class=k3>{story}</div>{foot}<div class=k4>closing {r.random()}</div></body>"


def test_the_wrapper_decides(spark):
    """No name of these pages excludes anything: without the wrapper all text stays, with it the story alone."""
    pages = [site(n, f"<h2>Heading {n}</h2>") for n in range(12)]
    w = html_text.Wrapper(*wrapped(pages))
    for n, p in enumerate(pages):
        want_ = "\n".join([f"Heading {n}"] + [f"paragraph {n} {j} tells more" for j in range(1 + n % 4)])
        assert html_text.extract(p, w) == html_text.extract(p, w, names=False) == want_
        assert "buy" in html_text.extract(p) and "closing" in html_text.extract(p)
    df = spark.createDataFrame([(i, "http://h.org/x", p) for i, p in enumerate(pages + pages[:3])], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_text.extract_pages(df).collect()}
    assert out == {i: html_text.extract(p, w) for i, p in enumerate(pages + pages[:3])}
    made = html_text.wrappers(df.withColumn("host", F.lit("h.org"))).collect()
    tree, stats, common = wrapped(pages)
    assert len(made) == 1 and made[0]["wrapper"] == tree
    assert sorted(map(tuple, made[0]["stats"])) == sorted(stats) and sorted(map(tuple, made[0]["common"] or ())) == sorted(common)
    # the same through the join that stands beyond the broadcast's bound
    bound = html_text.MAX_BYTES
    try:
        html_text.MAX_BYTES = 0
        assert {r.page_id: r.text for r in html_text.extract_pages(df).collect()} == out
    finally:
        html_text.MAX_BYTES = bound


def test_the_wrapper_alone_finds_the_articles(spark):
    """Over the test table's pages: names switched off, the wrapper gives each page's article; without it no page is right."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "html", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"))
    made = {r.h: html_text.Wrapper(r.wrapper, [tuple(x) for x in r.stats], [tuple(x) for x in r.common or ()]) for r in html_text.wrappers(pages.select("host", "html")).collect()}
    rows = pages.collect()
    assert len(made) >= 50
    for r in rows:
        article = html_text.extract(re.search("<article>.*</article>", r.html, re.S)[0])
        assert html_text.extract(r.html, made[r.host], names=False) == article
        assert html_text.extract(r.html, None, names=False) != article


def test_all_content_of_a_page_stays():
    two = lambda i: f"<body><p>Our site</p><article><p>a long first part {i}</p></article><div>between {i}</div><article><p>second {i}</p></article></body>"
    wrap = html_text.Wrapper(*wrapped([two(i) for i in range(6)]))
    assert html_text.extract(two(9), wrap) == "a long first part 9\nbetween 9\nsecond 9"
    assert html_text.extract(two(9)) == "a long first part 9\nsecond 9"
    # two stories, a title outside of them, and names inside that exclude outside only
    more = lambda i: f"<body><main><h1>Title {i}</h1><article>{'<p>first {0}</p>'.format(i) * (1 + i % 3)}<p class=alert>beware {i}</p><div class=side>aside {i}</div></article><article>{'<p>second {0}</p>'.format(i) * (1 + i % 2)}</article></main><div class=alert>frame {i}</div></body>"
    wrap = html_text.Wrapper(*wrapped([more(i) for i in range(9)]))
    assert html_text.extract(more(4), wrap) == html_text.extract(more(4)) == "Title 4\nfirst 4\nfirst 4\nbeware 4\naside 4\nsecond 4"
    assert html_text.extract("<body><div class=content>one</div><div class=content><p>two</p></div></body>") == "one\ntwo"
    assert html_text.extract("<body><p>plain <p><a href=x>a linked block</a></body>") == "plain\na linked block"
    assert html_text.extract("<body><h1>Title</h1><nav>menu</nav><article><p>story</article>x</body>") == "Title\nstory"
    # stories right in the body, between menus without names
    flat = lambda i: f"<body><ul>{'<li><a href=x>go {0}</a>'.format(i) * (2 + i % 3)}</ul>{'<p>story {0}</p>'.format(i) * (1 + i % 4)}</body>"
    assert html_text.extract(flat(2), html_text.Wrapper(*wrapped([flat(i) for i in range(9)]))) == "story 2\nstory 2\nstory 2"
    # a page of another layout than its host's wrapper keeps its text
    assert html_text.extract("<body><table><tr><td>other</table></body>", wrap) == "other"


def sentence(r, n):
    return " ".join(r.choices("oak elm fir ash yew may bay fig plum pear".split(), k=n)) + "."


def hosts():
    """Five layouts of twelve pages, with what must come out: the article, and nothing of menu and footer."""
    r = random.Random(7)
    menu = "<ul class=top>" + "".join(f"<li><a href=/{x}>{x}</a>" for x in "abcd") + "</ul>"
    for n in range(12):
        story = [sentence(r, 20 + r.randrange(20)) for _ in range(3 + n % 4)]
        items = [sentence(r, 2) for _ in range(2 + n % 4)]
        par = lambda ts: "".join(f"<p>{t}</p>" for t in ts)
        li = "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>"
        slug = "-".join(r.choices("oak elm fir ash yew".split(), k=3))
        yield "a", n, f'<body>{menu}<div id="{slug}">{par(story)}{li}</div><div class=end>page {n}</div></body>', story + items
        yield "b", n, f"<body>{menu}<div class=mq><p>{story[0]}</p></div>{li}<div class=end>page {n}</div></body>", [story[0], *items]
        yield "c", n, f"<body>{menu}<div class=lead>{story[0]}</div><div class=txt>{par(story[1:])}</div><div class=end>page {n}</div></body>", story
        last = "All of this was first told in the village of Oakham, years ago." if n % 3 else sentence(r, 12)
        yield "d", n, f"<body>{menu}<article>{par([*story, last])}</article><div class=end>page {n}</div></body>", [*story, last]
        yield "e", n, f'<body>{menu}<article>{par(story)}<p class="related-work">{items[0]} {story[0]}</p><div class="related">see also {n}</div></article></body>', [*story, f"{items[0]} {story[0]}"]


def test_html_whole_articles(spark):
    """Ids made from the page, one paragraph a page beside a list, a lead above, a closing line of most pages, a class that only sounds like a frame's."""
    rows = [(h, n, source, "\n".join(text)) for h, n, source, text in hosts()]
    df = spark.createDataFrame([(i, f"http://{h}.org/{n}", source) for i, (h, n, source, _) in enumerate(rows)], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_text.extract_pages(df).collect()}
    assert [(h, n, out[i]) for i, (h, n, _, _) in enumerate(rows)] == [(h, n, text) for h, n, _, text in rows]


def test_every_outline_shapes_the_wrapper(spark):
    """More outlines than one piece holds: what only rare ones have is template or slot like the rest, and what one page alone has is judged in its page."""
    n_many = html_text.SHAPES + 30
    story = lambda i: "".join(f"<p>paragraph {i} {j}</p>" for j in range(1 + i % 4))
    often = lambda i: f"<body><div class=top><div class=f{i // 2}>lead {i}</div></div><div class=k3>{story(i)}</div></body>"
    rare = lambda i: f"<body><div class=top><div class=r{i}>lead {i}</div></div><div class=k3><div class=zz>our terms for all</div>{story(i)}<div class=m{i}>note {i}</div></div><div class=u{i}><a href=x>go on {i}</a></div></body>"
    rows = [(i, "http://many.com/x", often(i)) for i in range(2 * n_many)] + [(1000 + i, "http://many.com/y", rare(i)) for i in range(2 * html_text.SHAPES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want_ = {i: [f"paragraph {i} {j}" for j in range(1 + i % 4)] for i in range(2 * n_many)}
    want_ |= {1000 + i: [f"paragraph {i} {j}" for j in range(1 + i % 4)] + [f"note {i}"] for i in range(2 * html_text.SHAPES)}
    bound = html_text.MAX_BYTES
    try:
        for html_text.MAX_BYTES in (bound, 0):
            assert {r.page_id: r.text.split("\n") for r in html_text.extract_pages(df).collect()} == want_
    finally:
        html_text.MAX_BYTES = bound
    # what each page has alone is not in the wrapper, what two share is
    tree = html_text.wrappers(df.withColumn("host", F.lit("many.com"))).first()["wrapper"]
    assert "div.zz" in tree and "div.f0" in tree and "div.r0" not in tree and "div.u0" not in tree


def test_deep_and_long_pages(spark):
    deep = "<div>" * 100_000 + "bottom" + "</div>" * 100_000
    long = "<body><p>" + "word " * 400_000 + "</p></body>"
    rows = [(i, "http://deep.com/", d) for i, d in enumerate([deep, deep + "<p>tail", long, "<p>short", "<i>" * 50_000 + "x", "</div>" * 50_000 + "y", "<ul>" + "<li>z" * 20_000])]
    out = {r.page_id: (r.text[:12], r.n_chars) for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == ("bottom", 6) and out[1] == ("bottom\ntail", 11) and out[2] == ("word word wo", 1_999_999) and out[3] == ("short", 5) and out[5] == ("y", 1)
    assert out[6] == ("z\nz\nz\nz\nz\nz\n", 39_999)


def test_template_of_every_layout_and_size(spark):
    """Two layouts of one host, and a menu of 1,500 entries: the template of all goes, whatever their share."""
    menu = "".join(f"<li>entry number {j}</li>" for j in range(1500))
    big = lambda i: f"<body><ul>{menu}</ul><div><p>story {i}</p></div></body>"
    lay = lambda i, c: f"<body><div class={c}><p>all about {c}</p><p>item {i} is new</p></div></body>"
    rows = [(i, "http://big.com/x", big(i)) for i in range(4)] + [(10 + i, "http://two.com/x", lay(i, "abc"[i % 3])) for i in range(24)] + [(50, "http://one.com/x", "<p>one page")] * 5
    out = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"story {i}" for i in range(4)} | {10 + i: f"item {i} is new" for i in range(24)} | {50: "one page"}


def test_tree_matching():
    """Against the plain recursion over all pairs, and the pairs themselves: equal keys, order and ancestry kept."""

    def tree(r, depth=0):
        return (r.choice("ab"), [tree(r, depth + 1) for _ in range(r.randrange(4 if depth < 3 else 1))])

    def flat(t):
        out = html_text.Tree([t[0]], [-1])
        stack = [(0, t[1])]
        while stack:
            i, kids = stack.pop()
            stack += [(out.add(k[0], i, len(out.kids[i])), k[1]) for k in kids]
        return out

    def plain(a, b):
        if a[0] != b[0]:
            return 0
        m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for i, x in enumerate(a[1]):
            for j, y in enumerate(b[1]):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain(x, y))
        return 1 + m[-1][-1]

    r = random.Random(7)
    for _ in range(400):
        a, b = ("r", [tree(r) for _ in range(r.randrange(5))]), ("r", [tree(r) for _ in range(r.randrange(5))])
        x, y = flat(a), flat(b)
        size, pairs = html_text.align(x, y)
        assert size == plain(a, b) == len(pairs) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        of = dict(pairs)
        assert all(x.keys[i] == y.keys[j] and (i == 0 or of[x.parents[i]] == y.parents[j]) for i, j in pairs)
        for kids in x.kids:
            got_ = [y.kids[y.parents[of[k]]].index(of[k]) for k in kids if k in of]
            assert got_ == sorted(got_)
        # grown by b, the tree holds both
        html_text.grow(x, y)
        assert html_text.align(x, y)[0] == len(y.keys) and html_text.align(x, flat(a))[0] == len(flat(a).keys)


FINGER = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_fingerprints(spark, rows):
    out = fingerprint.compare_with_next(wide(spark.createDataFrame(rows, DOCS)))
    assert got(out, *FINGER) == want(brute.fingerprints(rows))
    by = {r.doc_id: r for r in out.collect()}
    assert by[83].fingerprint == by[3].fingerprint  # equal texts
    assert by[80].fingerprint == by[81].fingerprint == "" and by[80].n_chars == 0
    one = spark.createDataFrame([(None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g")], DOCS)
    assert [r.near_next for r in fingerprint.compare_with_next(one).collect()] == [1.0] * 3


def test_fingerprints_of_heavy_ids(spark):
    """Ids and nulls that hold many rows are split by their texts, in the same order."""
    r = random.Random(6)
    text = lambda: " ".join(r.choices("ab cd ef gh ij".split(), k=r.randrange(1, 60)))
    rows = [(d, text()) for d in [3] * 300 + [None] * 200 + [99] * 300 + list(range(400)) + [10**15, -(10**15)]]
    out = fingerprint.compare_with_next(spark.createDataFrame(rows, DOCS).repartition(5))
    assert got(out, *FINGER) == want(brute.fingerprints(rows))


def test_winnowing_is_the_rightmost_minimum(spark):
    r = random.Random(0)
    texts = [" ".join(r.choices("ab cd ef gh".split(), k=n)) for n in (0, 1, 3, 4, 5, 12, 13, 80, 400)] + ["same " * 100, "x" * 500, " \t\n", "a\u00a0b c"]
    kept = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", fingerprint.winnow(F.col("text")).alias("k")).collect()
    for r in kept:
        assert [(x["at"], x["hash"] % 2**64) for x in r.k] == brute.winnowed(texts[r.i])
        assert all(b["at"] - a["at"] <= fingerprint.WINDOW for a, b in zip(r.k, r.k[1:]))  # a kept gram in each window
    assert [x["at"] for x in kept[9].k] == list(range(9, 98))  # all grams are alike: the rightmost of each window


def test_follow_the_regularised_leader():
    """Weights against the update rule written out one coordinate at a time, and scores against plain sparse dot products."""
    import math

    import pyarrow as pa

    r = random.Random(2)
    examples = []
    for _ in range(30):
        i = sorted(r.sample(range(50), r.randrange(1, 8))) + [1 << quality.BITS]
        examples.append((np.array(i), np.array([r.random() * 2 for _ in i], np.float32), r.randrange(2)))
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[k]) - z[k]) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for i, x, y in examples:
            w = [weight(k) for k in i.tolist()]
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(a * b for a, b in zip(w, x.tolist()))))))
            for k, v, own in zip(i.tolist(), x.tolist(), w):
                g = (p - y) * v
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / quality.ALPHA * own
                n[k] = old + g * g
    learnt = quality._ftrl(examples)
    assert all(abs(learnt[k] - weight(k)) < 1e-6 for k in z) and np.count_nonzero(learnt) == sum(weight(k) != 0 for k in z)
    texts = ["One two, two THREE 4!", "", None, "a a a", "x"]
    i, where, count = quality.features(pa.array(texts))
    weights = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1)
    expected = []
    for row, t in enumerate(texts):
        total = sum(weights[k] for k, at in zip(i.tolist(), where.tolist()) if at == row) * quality.SCALE / max(1, len((t or "").split()))
        expected.append(1 / (1 + math.exp(-max(-35.0, min(35.0, total + weights[-1])))))
    assert np.allclose(quality._scores(pa.array(texts), weights), expected)
    # a word, its shape, the pair with the next, the pair's shapes, and a word repeated
    assert np.bincount(where, minlength=5).tolist() == [5 * 2 + 4 * 2 + 0, 0, 0, 3 * 2 + 2 * 2 + 2, 2] and count.tolist() == [5, 0, 0, 3, 1]


def test_quality(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(200)]
    good = lambda: " ".join(r.choices(words, k=40)).capitalize() + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in r.choices(words, k=40))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(400)] + [(900, None), (901, ""), (None, good())]
    labels = [(i, int(i % 5 != 0)) for i in range(400)] + [(1, None), (None, 1), (2, 1)]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    w = quality.fit(wide(docs), wide(lab))
    out = {r.doc_id: r for r in quality.score(wide(docs), w).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items() if d is not None)
    held = [d for d in range(400) if out[d].held_out]
    assert np.mean([out[d].predicted == int(d % 5 != 0) for d in held]) >= 0.95
    assert out[900].score == out[901].score and len(out) == len(rows)
    kept = quality.keep_good(wide(docs), w)
    assert kept.columns == wide(docs).columns and kept.count() == sum(r.predicted for r in out.values())
    assert set(quality.score(docs, quality.fit(docs, lab.limit(0))).select("score").distinct().collect()[0]) == {0.5}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    path, pattern = tokenizer()
    for df in (
        substring_dedup.removed(none, substring_dedup.repeats(none), digest=True), line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none), digest=True), near_dedup.near_duplicates(none),
        decontaminate.judge(none, bench), bpe.encode(none, path, pattern), fingerprint.compare_with_next(none), quality.score(none, quality.fit(none, labels)),
        token_counts.limits(token_counts.histogram(bpe.lengths(none, path, pattern))), url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES), html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.count() == 0


def test_judging_against_an_empty_benchmark(spark, docs, rows):
    out = decontaminate.judge(docs, spark.createDataFrame([], "item_id long, text string"))
    assert out.count() == len(rows) and out.filter("contaminated OR n_hit > 0").count() == 0
