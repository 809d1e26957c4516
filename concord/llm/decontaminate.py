"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a slice of documents (a few MB): its words become ranks, its suffixes are sorted by
their first 4, 12, 36, ... words until no two are alike or a window's length is reached. Every
benchmark suffix is found in that order by binary search; what begins there is extended on both sides to
longest verbatim matches, and these decide which words, items and documents are hit. Documents never span
shards, so there is no shuffle. The benchmark is the broadcast side: it is cut into blocks of at most
``BLOCK_BYTES`` of text, ``TOGETHER`` of which are searched in one pass over the documents, in one array per
shard. Further blocks take further passes, so the benchmark's size never decides whether a run fits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import fresh, plain, settle

WINDOW = 13
#: A document goes when at least 1 in SHARE of its words lies in a benchmark window.
SHARE = 20
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 1 << 20
#: Blocks searched in one pass over the documents.
TOGETHER = 4


class Queries:
    """Benchmark items as word hashes: the window suffixes to search, each with its item."""

    def __init__(self, items: pa.Table, window: int):
        text = items.column("text").combine_chunks()
        text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
        w = A.Words(text, A.ALNUM, lower=True)
        self.words = w.hashes()
        self.ids = items.column("item_id").cast(pa.string()).to_pylist()
        size = np.minimum(w.count, window)
        n = np.where(w.count > 0, w.count - size + 1, 0)
        self.start = A.ranges(w.first[:-1], n).astype(np.int32)
        self.size = np.repeat(size, n).astype(np.int32)
        self.item = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.first = w.first  # of each item's words: how far a longest match can reach


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.Table, bool]]:
    """The benchmark's non-empty items in blocks of about `limit` bytes, one at a time, and whether it is the last."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // limit))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield (items.filter(part == i) if n > 1 else items).toArrow(), i == n - 1


class SuffixArray:
    """Sorted suffixes of a shard's words. Suffixes of different documents may share words at their
    border; the searches that use it check the document's end."""

    def __init__(self, words: np.ndarray, depth: int):
        self.vocabulary = np.unique(words)
        self.n = len(words)
        rank = np.searchsorted(self.vocabulary, words) + 1  # 0: beyond the end
        self.ranks = np.concatenate((rank, np.zeros(4, np.int64)))
        bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        take = max(1, min(4, 63 // bits))
        key = np.zeros(self.n, np.int64)
        for k in range(take):
            key = (key << bits) | self.ranks[k : k + self.n]
        self.take, self.bits = take, bits
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]  # packed first words, for the first search
        cls, known = self._classes(key), take
        while known < depth and not self.unique:
            b = max(1, int(self.n + 1).bit_length())
            times = max(2, 63 // b)
            pad = np.concatenate((cls, np.zeros(known * (times - 1), np.int64)))
            tied = np.flatnonzero(self.tied)
            at = self.order[tied]
            k = cls[at]
            for j in range(1, times):
                k = (k << b) | pad[at + j * known]
            o = np.lexsort((at, k))
            self.order[tied] = at[o]
            k = k[o]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            # a class is numbered by the place where it begins, so untouched classes keep theirs
            begin = np.where(new, tied, 0)
            np.maximum.accumulate(begin, out=begin)
            cls = cls.copy()
            cls[at[o]] = begin + 1
            last = np.ones(len(k), bool)
            last[:-1] = new[1:]
            self.tied = np.zeros(self.n, bool)
            self.tied[tied] = ~(new & last)
            self.unique = not self.tied.any()
            known *= times

    def _classes(self, key: np.ndarray) -> np.ndarray:
        k = self.keys
        new = np.ones(self.n, bool)
        new[1:] = k[1:] != k[:-1]
        last = np.ones(self.n, bool)
        last[:-1] = new[1:]
        self.tied = ~(new & last)
        self.unique = not self.tied.any()
        begin = np.where(new, np.arange(self.n), 0)
        np.maximum.accumulate(begin, out=begin)
        cls = np.empty(self.n, np.int64)
        cls[self.order] = begin + 1
        return cls

    def find(self, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query words[start:start+size] the range lo..hi of suffixes that begin with it."""
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        rank = np.where(self.vocabulary[at] == words, at + 1, -1) if self.n else np.full(len(words), -1)
        bad = np.concatenate(([0], np.cumsum(rank < 0)))
        lo, hi = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        q = np.flatnonzero(bad[start + size] == bad[start])
        if not len(q):
            return lo, hi
        low, high = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for k in range(self.take):
            inside = size[q] > k
            r = rank[np.minimum(start[q] + k, len(rank) - 1)]
            low = (low << self.bits) | np.where(inside, r, 0)
            high = (high << self.bits) | np.where(inside, r, (1 << self.bits) - 1)
        a, b = np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")
        some = b > a
        q, a, b = q[some], a[some], b[some]
        # binary search for the first suffix not below, and the first beyond, the query
        lo[q] = self._bound(rank, start[q], size[q], a.copy(), b.copy(), False)
        hi[q] = self._bound(rank, start[q], size[q], lo[q].copy(), b.copy(), True)
        return lo, hi

    def _bound(self, rank, start, size, a, b, beyond: bool) -> np.ndarray:
        while True:
            live = np.flatnonzero(a < b)
            if not len(live):
                return a
            mid = (a[live] + b[live]) >> 1
            sign = self._compare(self.order[mid], rank, start[live], size[live])
            right = sign <= 0 if beyond else sign < 0
            a[live] = np.where(right, mid + 1, a[live])
            b[live] = np.where(right, b[live], mid)

    def _compare(self, at, rank, start, size) -> np.ndarray:
        """-1, 0 or 1: the suffix's first words against the query's."""
        out, live = np.zeros(len(at), np.int64), np.arange(len(at))
        for k in range(self.take, int(size.max(initial=0))):
            live = live[size[live] > k]
            if not len(live):
                break
            x = self.ranks[np.minimum(at[live] + k, self.n)]
            y = rank[start[live] + k]
            differ = x != y
            out[live[differ]] = np.sign(x - y)[differ]
            live = live[~differ]
        return out


def _longest(words: A.Words, hashes: np.ndarray, sa: SuffixArray, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest matches of at least a window: item, its word, the shard's word, and the length; none can be extended within both texts."""
    if not len(hashes) or not len(q.start):
        return (np.zeros(0, np.int64),) * 4
    lo, hi = sa.find(q.words, q.start, q.size)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    at = sa.order[A.ranges(lo, n)]
    doc = np.searchsorted(words.first, at, "right") - 1
    inside = at + q.size[which] <= words.first[doc + 1]
    which, at, doc = which[inside], at[inside], doc[inside]
    item, start, length = q.item[which].astype(np.int64), q.start[which].astype(np.int64), q.size[which].astype(np.int64)
    # to the left: a match that goes on there is found from its beginning
    left = np.flatnonzero((start > q.first[item]) & (at > words.first[doc]))
    begins = np.ones(len(at), bool)
    begins[left] = hashes[at[left] - 1] != q.words[start[left] - 1]
    item, start, at, doc, length = item[begins], start[begins], at[begins], doc[begins], length[begins]
    live = np.arange(len(at))
    while len(live):  # to the right
        x, y = at[live] + length[live], start[live] + length[live]
        on = (x < words.first[doc[live] + 1]) & (y < q.first[item[live] + 1])
        live, x, y = live[on], x[on], y[on]
        live = live[hashes[x] == q.words[y]]
        length[live] += 1
    return item, start - q.first[item], at, length


def _passes(docs: DataFrame, benchmark: DataFrame, window: int) -> Iterator[tuple[list, int, bool]]:
    """For each pass over the documents its broadcast blocks, the longest window in them, and whether it is the last."""
    spark, held, depth = docs.sparkSession, [], 1
    for block, last in blocks(benchmark):
        q = Queries(block, window)
        depth = max(depth, int(q.size.max(initial=1)))
        held.append(spark.sparkContext.broadcast(q))
        if last or len(held) == TOGETHER:
            yield held, depth, last
            held, depth = [], 1


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Longest verbatim matches: doc_id, doc_word, item_id, item_word, n_words.

    A match is at least a window (or a whole item of fewer words) long and cannot be extended on either
    side within both texts. Null texts have none; other columns are not read.
    """
    docs, found = plain(docs), None
    for shared, depth, _ in _passes(docs, benchmark, window):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, depth=depth) -> Iterator[pa.RecordBatch]:
            for b in A.pieces(batches, limit=SHARD_BYTES):
                w = A.Words(b.column(1), A.ALNUM, lower=True)
                h = w.hashes()
                sa = SuffixArray(h, depth)
                for x in shared:
                    item, word, at, length = _longest(w, h, sa, x.value)
                    doc = np.searchsorted(w.first, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(at - w.first[doc]), pa.array([x.value.ids[i] for i in item], pa.string()), pa.array(word), pa.array(length)], names=["doc_id", "doc_word", "item_id", "item_word", "n_words"])

        one = docs.mapInArrow(run, "doc_id long, doc_word long, item_id string, item_word long, n_words long")
        found = one if found is None else found.unionByName(one)
    return found


def _hits(w: A.Words, h: np.ndarray, shared: list, depth: int) -> tuple[np.ndarray, list[list[str]]]:
    """Which words of the shard lie in a match, and the items that each row's matches belong to."""
    edge = np.zeros(len(h) + 1, np.int64)
    items: list[list[str]] = [[] for _ in w.count]
    sa = SuffixArray(h, depth)
    for x in shared:
        q = x.value
        item, _, at, length = _longest(w, h, sa, q)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        pairs = np.unique(np.stack((np.searchsorted(w.first, at, "right") - 1, item)), axis=1)
        for d, i in pairs.T.tolist():
            if q.ids[i] is not None:
                items[d].append(q.ids[i])
    return np.cumsum(edge)[: len(h)] > 0, items


def _all(docs: DataFrame, benchmark: DataFrame, window: int, share: int, digest: bool) -> DataFrame:
    """Every pass over all documents; hit words and items so far travel as columns."""
    names = docs.columns
    text, ids = names.index("text"), names.index("doc_id")
    bits, found = fresh(docs, "hit", "items")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    more = f"{schema}, `{bits}` binary, `{found}` array<string>"
    done = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if digest else schema
    first = True
    for shared, depth, last in _passes(docs, benchmark, window):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, depth=depth, first=first, last=last) -> Iterator[pa.RecordBatch]:
            for b in A.pieces(batches, limit=SHARD_BYTES):
                w = A.Words(b.column(text), A.ALNUM, lower=True)
                hit, items = _hits(w, w.hashes(), shared, depth)
                if not first:
                    for i, (x, old) in enumerate(zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist())):
                        hit[w.first[i] : w.first[i + 1]] |= np.unpackbits(np.frombuffer(x, np.uint8), count=int(w.count[i])).astype(bool)
                        items[i] += old
                if not last:
                    packed = [np.packbits(hit[i:j]).tobytes() for i, j in zip(w.first[:-1], w.first[1:])]
                    yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(packed, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=[*names, bits, found])
                    continue
                n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[w.first])
                bad = (n_hit > 0) & (share * n_hit >= w.count)
                if digest:
                    items = [sorted(set(x)) for x in items]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(ids), pa.array(w.count), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array(bad)],
                        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                    )
                else:
                    yield b.select(range(len(names))).filter(pa.array(~bad))

        docs = docs.mapInArrow(run, done if last else more)
        if not last:  # blocks that are done are let go, by driver and executors
            docs = settle(docs, "decontamination")
        first = False
    return docs


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row, from its longest matches.

    Words are ASCII-lower-cased runs of ASCII letters, digits and all beyond ASCII. Null and empty
    texts have none and are clean; a null item_id marks words but names no item; repeated item ids
    count once; an empty benchmark finds nothing, an empty table gives an empty result; a very long text is a
    shard of its own; other columns are not read.
    """
    return _all(plain(docs), benchmark, window, share, True)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of docs, all columns whatever their names, that are not contaminated."""
    return _all(docs, benchmark, window, share, False)
