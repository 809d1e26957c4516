"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features are hashed uni- and bigrams of a text's words and of the words' shapes (runs of small
letters, capitals, digits and each other character, every run written once), and repeated words. A
feature's value is its share of the text's words; a score is the sparse dot product with the weights.

The model learns from at most ``SAMPLE`` labelled rows, those of least hash of doc_id; scoring covers
all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A

#: Bound of the labelled rows a model is fitted on; buckets of the feature hash; passes over the sample.
SAMPLE, BITS, EPOCHS = 8000, 18, 6
#: Follow-the-regularised-leader: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
THRESHOLD = 0.3
SCALE = 8.0
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of all words, the row of each, and the words per row."""
    w = A.Words(col)
    n = len(w.start)
    rows = w.rows()
    h = w.hashes()
    shape = _SHAPE[w.data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[w.start] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    s = A.byte_hash(shape[keep], at[w.start], at[w.end], 1)
    pairs = np.flatnonzero(rows[1:] == rows[:-1]) if n else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        hh = A.mix(h[pairs] * A.U(3) + h[pairs + 1])
        ss = A.mix(s[pairs] * A.U(5) + s[pairs + 1])
        same = pairs[h[pairs] == h[pairs + 1]]
        rest = np.full(len(same), A.mix(np.array([77], A.U))[0])
        every = np.concatenate((A.mix(h), A.mix(s + A.U(1)), hh, ss, rest))
    where = np.concatenate((rows, rows, rows[pairs], rows[pairs], rows[same]))
    return (every >> A.U(64 - BITS)).astype(np.int32), where, w.count


def _ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (the last is the bias) after EPOCHS passes in the given order."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(EPOCHS):
        for i, x, y in examples:
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i] += g - step * w
            n[i] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from labelled rows that are not held out.

    Null labels teach nothing, of several labels of one document the largest counts, of several texts
    the least; without any labelled row all weights are 0 and every score is 0.5.
    """
    seed = F.xxhash64("doc_id", F.lit("quality"))
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(seed, "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id")  # at most `sample` rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches):
            i, where, n = features(b.column(1))
            key, times = np.unique((where.astype(np.int64) << 32) | i, return_counts=True)
            row = key >> 32
            value = (times / np.maximum(n[row], 1) * SCALE).astype(np.float32)
            per = np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), A.lists((key & 0xFFFFFFFF).astype(np.int32), per, pa.int32()), A.lists(value, per, pa.float32())], names=["doc_id", "quality", "i", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for b in batches:
            i, x = b.column(2), b.column(3)
            for k, (d, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                a = np.append(i[k].values.to_numpy(), 1 << BITS), np.append(x[k].values.to_numpy(), np.float32(1)), int(y > 0)
                if d not in found or a[0].tobytes() < found[d][0].tobytes():
                    found[d] = a
        order = sorted(found)
        order = [order[k] for k in np.random.default_rng(7).permutation(len(order))]
        yield pa.RecordBatch.from_arrays([pa.array([_ftrl([found[d] for d in order]).tobytes()], pa.binary())], names=["w"])

    got = rows.select("doc_id", "text", "quality").mapInArrow(count, "doc_id long, quality int, i array<int>, x array<float>").repartition(1).mapInArrow(learn, "w binary").collect()
    return np.frombuffer(got[0][0]) if got else np.zeros((1 << BITS) + 1)


def _scores(col: pa.Array, weights: np.ndarray) -> np.ndarray:
    i, where, n = features(col)
    dot = np.bincount(where, weights[i], minlength=len(n)) * SCALE / np.maximum(n, 1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; a null or empty text gets the bias alone. A null doc_id is not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches):
            s = _scores(b.column(2), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches):
            yield b.filter(pa.array(_scores(b.column(at), shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
