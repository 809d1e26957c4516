"""Filter interaction audit: what each of five filters removes in every order of application.

1. Scan: byte classes of a slice's Arrow buffer and their prefix sums give each text's words, capitals, characters
   and symbols; word hashes, sorted inside their document and compared byte by byte where they are equal, give its
   distinct words. A document leaves 128 bits of its text and a mask of the conditions A to D that it fails.
2. Copies: partial minima of doc_id per text; a document whose text has a smaller doc_id fails E.
3. Cells: documents counted by part and mask, 32 rows a part at most.
4. Masks reduce: a part's 32 counts against fixed 0/1 matrices of (order, step) by mask.

No text is shuffled, and a text or label that a third of all rows share meets partial aggregates and plain
shuffled joins only.

Defined cases: see audit; a text of any length is one row of its slice; an empty table gives an empty result; columns
other than doc_id, text and the part's are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import mark, plain, release, settle

FILTERS = "ABCDE"
#: A: fewer words than this. B: fewer distinct words, in per cent. C: more capitals, in per cent of the characters. D: any of these.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 3, "#$%&*|"
_CELL = "array<struct<mask:int,n:bigint,good:bigint,toxic:bigint>>"
_OUT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _classes(symbols: str) -> np.ndarray:
    """For each byte: begins a character, is a capital, is a symbol."""
    t = np.zeros((3, 256), bool)
    t[0] = (np.arange(256) & 0xC0) != 0x80
    t[1, 65:91] = True
    t[2, list(symbols.encode("ascii"))] = True
    return t


def distinct_words(w: A.Words) -> np.ndarray:
    """Distinct words of each row: hashes sorted inside their row, equal neighbours held against each other byte by byte.

    A row where two words have one hash is counted anew, from its words.
    """
    row = w.rows()
    key = (row.astype(A.U) << A.U(54)) | (w.hashes() >> A.U(10))
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    i, j = order[same], order[same + 1]
    equal = A.same_bytes(w.data, w.start[i], w.end[i], w.start[j], w.end[j])
    n = w.count - np.bincount(row[i[equal]], minlength=len(w.count))
    for r in np.unique(row[i[~equal]]).tolist():
        n[r] = len({w.data[a:b].tobytes() for a, b in zip(w.start[w.first[r] : w.first[r + 1]].tolist(), w.end[w.first[r] : w.first[r + 1]].tolist())})
    return n


def _scan(min_words: int, min_distinct: int, max_capitals: int, symbols: str):
    classes = _classes(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches):
            w = A.Words(b.column(1))
            chars, capitals, marks = (np.diff(np.concatenate(([0], np.cumsum(c[w.data])))[w.offsets]) for c in classes)
            fails = (w.count < min_words, 100 * distinct_words(w) < min_distinct * w.count, 100 * capitals > max_capitals * chars, marks > 0)
            mask = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
            h1, h2 = A.digests(w.data, w.offsets[:-1], w.offsets[1:])
            yield pa.RecordBatch.from_arrays([A.signed(h1), A.signed(h2), b.column(0), b.column(2), pa.array(mask, pa.int32())], names=["h1", "h2", "doc_id", "part", "mask"])

    return run


def masks(docs: DataFrame, part: str = "lang", min_words: int = MIN_WORDS, min_distinct: int = MIN_DISTINCT, max_capitals: int = MAX_CAPITALS, symbols: str = SYMBOLS) -> DataFrame:
    """doc_id, part and mask of each row: bit k is set if the document fails the k-th filter."""
    keyed = plain(docs, F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = settle(keyed.mapInArrow(_scan(min_words, min_distinct, max_capitals, symbols), "h1 long, h2 long, doc_id long, part string, mask int"), "masks")
    # texts of several documents, the least of them; written, so that the join's two sides are shuffled plainly and a text of very many copies can be split
    first = settle(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most"), "copies")
    copy = F.when(F.col("doc_id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(first.hint("merge"), ["h1", "h2"], "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask"))


def _matrices() -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """Orders of the filters, each step's filter, and 0/1 by (order and step, mask) for each count."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    own = np.array([FILTERS.index(x) for o in orders for x in o])
    bit = (1 << own)[:, None]
    before = np.concatenate([np.concatenate(([0], np.cumsum(bit[i : i + len(FILTERS) - 1, 0]))) for i in range(0, len(bit), len(FILTERS))])[:, None]
    m = np.arange(1 << len(FILTERS))[None]
    fails, passed = (m & bit) != 0, (m & before) == 0
    return orders, own, {"kept": passed & ~fails, "removed": passed & fails, "redundant": ~passed & fails, "unique_fails": m == bit}


def _interactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders, own, by = _matrices()
    steps = len(FILTERS)
    for b in batches:
        for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n, good, toxic = np.zeros((3, 1 << steps), np.int64)
            for c in cells:
                n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
            removed = by["removed"] @ n
            every = np.zeros(steps, np.int64)
            np.add.at(every, own, removed)
            counts = [by["kept"] @ n, removed, by["redundant"] @ n, by["unique_fails"] @ n, by["removed"] @ good, by["removed"] @ toxic, every[own]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(own)), pa.array(np.repeat(np.array(orders, object), steps)), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders))), *map(pa.array, counts)],
                names=["part", "filter_order", "step", *_OUT],
            )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", **limits) -> DataFrame:
    """part, filter_order, step and counts: one row for each part, each of the 120 orders and each step of it.

    kept: documents left after this step; removed: those it removes; redundant: those that fail its filter but went
    earlier; unique_fails: those that fail this filter alone; good_lost and toxic_lost: removed ones that labels marks
    quality 1, toxic 1; shapley: documents that the step's filter removes, summed over all orders.

    A null part is the empty string, a null text the empty text (one text with it). A row without doc_id is no copy and
    has no label; rows of one doc_id are no copies of each other; if labels has a doc_id more than once, any mark counts.
    """
    spark, begun = docs.sparkSession, mark()
    judged = settle(masks(docs, part, **limits), "judged")
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = judged.join(settle(marks.filter("good = 1 OR toxic = 1"), "marks").hint("merge"), "doc_id", "left")
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    # 32 structs a part at most
    cells = settle(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).cast(_CELL).alias("cells")), "cells")
    release(spark, begun, cells)
    return cells.mapInArrow(_interactions, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _OUT))
