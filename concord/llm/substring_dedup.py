"""Substring dedup by seed and extend over winnowed anchors.

A window is LENGTH consecutive words. Of the SEED-word grams inside a window the one of least hash,
the rightmost on ties, is its anchor: equal windows have equal anchors at equal offsets. Neighbouring
windows with the same anchor form a span, the anchor extended both ways as far as it decides.

1. Each document gives one row per span (about one for 20 words): anchor hash, span hash, place.
2. Anchors in one document only, the bulk, go at once.
3. Spans equal to one in a document of smaller doc_id are repeats as a whole: inside a repeat all are.
4. At a repeat's ends spans differ though their anchors agree. There, and only there, the windows
   themselves are compared by hash, of one document per distinct span.
5. Per document, overlapping repeats merge into maximal ones.

Every grouping takes partial minima first and every join back has a plain shuffle on both sides, so
a passage in a third of all documents is no hot task; no pairs of documents are ever listed. What decides is
an anchor and a span (or window) of it, 64 bits each, made from two independent hashes of the words.

Defined cases: null, empty and short texts have no windows and lose nothing; a text of any length is one row;
an empty table gives an empty result; columns other than doc_id and text are passed on whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import fresh, mark, plain, release, settle, text_keys

LENGTH, SEED = 50, 8
#: Columns that tell rows of one doc_id apart by their texts.
KEY = ("t1", "t2")


def _spans(w: A.Words, length: int, seed: int):
    """Word hashes' prefix sums, and of each span: anchor hash, first window, number of windows, anchor's offset."""
    h = w.hashes()
    sums = A.Prefix(w.hashes(1), 1)
    i = np.arange(max(0, len(h) - seed + 1))
    grams = A.Prefix(h, 0).of(i, i + seed)
    least = A.window_argmin(grams, length - seed + 1)
    first = np.repeat(w.first[:-1], w.count)[: len(least)]
    end = np.repeat(w.first[1:], w.count)[: len(least)]
    i = np.flatnonzero(np.arange(len(least)) + length <= end)
    a, doc = least[i], first[i]
    new = np.ones(len(i), bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    start = i[head]
    return sums, grams[a[head]], start, np.diff(np.append(head, len(i))), a[head] - start


def _span_rows(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches):
            w = A.Words(b.column(1))
            sums, anchor, start, windows, offset = _spans(w, length, seed)
            row = np.searchsorted(w.first, start, "right") - 1
            span = sums.of(start, start + windows + length - 1)
            with np.errstate(over="ignore"):
                span = A.mix(span + offset.astype(A.U) * A.U(0x9E3779B97F4A7C15))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([A.signed(anchor), A.signed(span), *(b.column(i).take(take) for i in (0, 2, 3)), pa.array(start - w.first[row], pa.int32()), pa.array(windows, pa.int32())], names=["anchor", "span", "doc_id", "t1", "t2", "start", "windows"])

    return run


def _window_rows(length: int, seed: int):
    """Windows of the spans that begin at the given words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches):
            w = A.Words(b.column(1))
            sums, anchor, start, windows, _ = _spans(w, length, seed)
            at = b.column(4)
            wanted = np.asarray(at.flatten()) + np.repeat(w.first[:-1], np.asarray(at.value_lengths()))
            k = np.flatnonzero(np.isin(start, wanted))
            first = A.ranges(start[k], windows[k])
            owner = np.repeat(k, windows[k])
            row = np.searchsorted(w.first, first, "right") - 1
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([A.signed(anchor[owner]), A.signed(sums.of(first, first + length)), *(b.column(i).take(take) for i in (0, 2, 3)), pa.array(first - w.first[row], pa.int32())], names=["anchor", "window", "doc_id", "t1", "t2", "start"])

    return run


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, t1, t2 (the text's key), start and n (words) of each repeat of `length` words or more of a document of smaller doc_id.

    Repeats of one document may overlap; removed() merges them. Rows without doc_id neither have nor
    cause repeats; rows of one doc_id cause none in each other.
    """
    keyed = plain(docs).filter(F.col("doc_id").isNotNull()).withColumns(dict(zip(KEY, text_keys())))
    begun = mark()
    spans = settle(keyed.mapInArrow(_span_rows(length, seed), "anchor long, span long, doc_id long, t1 long, t2 long, start int, windows int"), "spans")
    shared = settle(spans.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("span").alias("a"), F.max("span").alias("b")).filter("lo < hi").select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "anchors")
    seeds = settle(spans.join(shared, "anchor"), "seeds")
    least = settle(seeds.groupBy("anchor", "span").agg(F.min("doc_id").alias("least")), "least")
    placed = settle(seeds.join(least, ["anchor", "span"]), "placed")
    whole = placed.filter("doc_id > least").select("doc_id", *KEY, "start", (F.col("windows") + length - 1).alias("n"))
    # ends of repeats: of each distinct span the document of least doc_id goes on, if its anchor has other spans in other documents
    ends = placed.filter("mixed AND doc_id = least").groupBy("doc_id", *KEY).agg(F.collect_set("start").alias("at"))
    windows = keyed.join(ends, ["doc_id", *KEY]).select("doc_id", "text", *KEY, "at").mapInArrow(_window_rows(length, seed), "anchor long, window long, doc_id long, t1 long, t2 long, start int")
    windows = settle(windows, "windows")
    early = settle(windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most"), "early")
    release(docs.sparkSession, begun, placed, windows, early)
    parts = windows.join(early, ["anchor", "window"]).filter("doc_id > least").select("doc_id", *KEY, "start", F.lit(length).alias("n"))
    return whole.unionByName(parts)


def _covered(count: int, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    edge = np.zeros(count + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n, -1)
    return np.cumsum(edge)[:count] > 0


def removed(docs: DataFrame, found: DataFrame, digest: bool = False) -> DataFrame:
    """All rows of docs without the words that repeats cover.

    With digest doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space); else
    docs' own columns, the text of a row that lost words being its kept words joined by one space.
    Null text has no words.
    """
    left = plain(docs) if digest else docs
    d, k1, k2, start_, n_ = fresh(left, "doc", "key1", "key2", "starts", "sizes")
    lists = found.groupBy("doc_id", *KEY).agg(F.collect_set(F.struct("start", "n")).alias("_at")).select(F.col("doc_id").alias(d), F.col("t1").alias(k1), F.col("t2").alias(k2), F.col("_at.start").alias(start_), F.col("_at.n").alias(n_))
    t1, t2 = text_keys()
    joined = left.join(lists, (F.col("doc_id").cast("long") == F.col(d)) & (t1 == F.col(k1)) & (t2 == F.col(k2)), "left").drop(d, k1, k2)
    names = joined.columns[:-2]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches):
            out = []
            for text, start, n in zip(b.column(at).to_pylist(), b.column(len(names)), b.column(len(names) + 1)):
                words = (text or "").encode().split()
                if start.is_valid:
                    gone = _covered(len(words), start.values.to_numpy(), n.values.to_numpy())
                    out.append((len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])))
                else:
                    out.append((len(words), 0, b" ".join(words)))
            if digest:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                new = pa.array([x[2].decode() if x[1] else t for x, t in zip(out, b.column(at).to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns[: len(names)])], names=names)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" if digest else docs.schema)
