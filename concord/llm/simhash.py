"""SimHash near-dedup: fingerprints within a few bits of each other, all of them, by bit-sliced comparison.

1. Each document gives a 64-bit fingerprint: bit by bit the majority over the XXH64 of its word shingles, repeats
   included. Documents of one fingerprint are one class; only distinct fingerprints go on.
2. Buckets by pigeonhole: of RADIUS + 2 blocks of the 64 bits, two are equal in any two fingerprints within RADIUS. Each
   fingerprint goes under every pair of blocks. A bucket of more than LIMIT is split by its free bits, again in
   RADIUS + 1 blocks of which one must be equal, and so on. Distinct fingerprints whose free bits are few cannot
   be more than LIMIT: every bucket ends bounded, however alike the documents are, and no pair is lost.
3. Bit slices: the buckets of a partition stand one after the other, bit k of 64 fingerprints in one word of plane k. All
   values are held against those `step` places on at once: plane by plane the differences are added into
   carry-save counters of 64 lanes each; words whose lanes have all passed the radius are abandoned.
4. A bucket returns a spanning forest of its links, not its pairs; forests contract to components.

Defined cases: see components_of; an empty table gives an empty result; a text of any length is one row of
its slice, hashed in chunks; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import mark, partitions, plain, release, settle
from .graph import components

SHINGLE, SEED, RADIUS, BITS = 3, 42, 2, 64
#: Fingerprints of a bucket that are held against each other.
LIMIT = 1024
#: Fingerprints whose planes are laid out together; shingles whose bits are.
CHUNK = 1 << 15
FULL = A.U((1 << 64) - 1)


def fingerprints_of(w: A.Words, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each row: bits set in over half of its shingles' hashes."""
    import xxhash

    size = w.end - w.start
    at = np.concatenate(([0], np.cumsum(size + 1)))
    joined = np.append(w.data, np.uint8(32))[A.ranges(w.start, size + 1)]
    joined[at[1:] - 1] = 32  # one space after each word, whatever stood there
    n = np.where(w.count >= k, w.count - k + 1, np.minimum(w.count, 1))
    first = A.ranges(w.first[:-1], n)
    row = np.repeat(np.arange(len(n)), n)
    last = first + np.minimum(w.count, k)[row] - 1
    view, digest = memoryview(np.ascontiguousarray(joined)), xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[i:j], seed) for i, j in zip(at[first].tolist(), (at[last] + size[last]).tolist())), A.U, len(first))
    ones = np.zeros((len(n), BITS), np.int64)
    for i in range(0, len(h), CHUNK):
        r = row[i : i + CHUNK]
        head = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        bits = np.unpackbits(h[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[r[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), A.signed(fingerprints_of(A.Words(b.column(1), lower=True), k, seed))], names=["doc_id", "fp"])

    return plain(docs).mapInArrow(run, "doc_id long, fp long")


def _split(free: int, blocks: int) -> list[int]:
    """The set bits of `free`, in order, as masks of about equal size."""
    at = [i for i in range(BITS) if free >> i & 1]
    cut = [len(at) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << i for i in at[a:b]) for a, b in zip(cut, cut[1:])]


def levels(radius: int, limit: int) -> list[list[int]]:
    """Masks of the bits that a bucket fixes, level by level; below mask t lie masks t * (radius + 1) and those after it.

    Two values within the radius agree under one mask of the first level, and if they do under one that lies below it,
    under one of the next. The last level leaves so few bits free that a bucket cannot exceed the limit.
    """
    every = (1 << BITS) - 1
    parts = _split(every, radius + 2)
    out = [[a | b for a, b in combinations(parts, 2)]]
    while max(BITS - m.bit_count() for m in out[-1]) > limit.bit_length() - 1:
        out.append([m | x for m in out[-1] for x in _split(every & ~m, radius + 1)])
    return out


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets(points: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """t, key and fp: distinct fingerprints under each mask t, in buckets of at most `limit`."""
    every = levels(radius, limit)
    masked = [F.col("fp").bitwiseAND(F.lit(_long(m))) for m in every[0]]
    rows, done = points.select(F.posexplode(F.array(*masked)).alias("t", "key"), "fp"), []
    for level, _ in enumerate(every):
        rows = settle(rows, "buckets")
        if level == len(every) - 1:
            break
        # keys of large buckets grow with the documents: shuffled joins, which adaptive execution splits
        large = settle(rows.groupBy("t", "key").count().filter(F.col("count") > limit).select("t", "key"), "large")
        if large.isEmpty():
            break
        done.append(rows.join(large.hint("merge"), ["t", "key"], "left_anti"))
        below = F.array(*[F.array(*[F.lit(_long(m)) for m in every[level + 1][i : i + radius + 1]]) for i in range(0, len(every[level + 1]), radius + 1)])
        split = rows.join(large.hint("merge"), ["t", "key"], "left_semi").select("t", "fp", F.posexplode(F.transform(below[F.col("t")], lambda m: F.col("fp").bitwiseAND(m))).alias("j", "key"))
        rows = split.select((F.col("t") * (radius + 1) + F.col("j")).alias("t"), "key", "fp").withColumn("t", F.col("t").cast("int"))
    out = rows.withColumn("level", F.lit(len(done)))
    for i, d in enumerate(done):
        out = out.unionByName(d.withColumn("level", F.lit(i)))
    return out


def planes(values: np.ndarray, spare: int) -> np.ndarray:
    """Bit k of 64 values in each word of row k; `spare` words of zeros at the end."""
    n = len(values)
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = np.zeros((BITS, (n + 63) // 64 + spare), A.U)
    words.view(np.uint8)[:, : (n + 7) // 8] = np.packbits(bits, axis=0, bitorder="little").T
    return words


def near(slices: np.ndarray, step: int, asked: np.ndarray, radius: int) -> np.ndarray:
    """Places i where the i-th and the (i + step)-th value differ in at most `radius` bits, of the places asked for (a bit each).

    Counters of 64 lanes begin so that the first difference beyond the radius carries out of them.
    """
    skip, shift = divmod(step, 64)
    width = radius.bit_length()
    begin = (1 << width) - 1 - radius
    at = np.flatnonzero(asked)
    over = ~asked[at]
    counters = [np.full(len(at), FULL if begin >> k & 1 else 0, A.U) for k in range(width)]
    for k in range(BITS):
        other = slices[k, at + skip] >> A.U(shift)
        if shift:
            other |= slices[k, at + skip + 1] << A.U(64 - shift)
        carry = slices[k, at] ^ other
        for c in range(width):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        over |= carry
        if k % 8 == 7:
            on = over != FULL
            if not on.all():
                at, over, counters = at[on], over[on], [c[on] for c in counters]
                if not len(at):
                    return at
    lanes = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, lane = np.nonzero(lanes)
    return at[word] * 64 + lane


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that links i - j connect with each of n."""
    top = np.arange(n)
    while True:
        a, b = top[i], top[j]
        on = a != b
        if not on.any():
            return top
        np.minimum.at(top, np.maximum(a, b)[on], np.minimum(a, b)[on])
        while (top[top] != top).any():
            top = top[top]


def forest(bucket: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between values of one bucket that differ in at most `radius` bits, as a spanning forest; equal buckets stand together."""
    rows, ones, twos = np.arange(len(fp)), [], []
    step = relay = 0
    while True:
        step += 1
        if step >= relay:  # laid out anew, without the buckets that do not reach `step` places on; about half of them go each time
            own = bucket[rows]
            size = np.diff(np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)]), len(own)))
            rows, own, size = rows[np.repeat(size > step, size)], own[np.repeat(size > step, size)], size[size > step]
            if not len(rows):
                break
            relay = max(step + 1, int(np.median(size)))
            slices = planes(fp[rows], int(size.max()) // 64 + 2)
        same = np.zeros((len(rows) + 63) // 64 * 64, bool)
        if step < len(rows):
            same[: len(rows) - step] = own[step:] == own[:-step]
        if not same.any():
            break
        i = near(slices, step, np.packbits(same, bitorder="little").view("<u8"), radius)
        ones.append(rows[i])
        twos.append(rows[i + step])
    if not ones:
        return np.zeros(0, A.U), np.zeros(0, A.U)
    top = roots(len(fp), np.concatenate(ones), np.concatenate(twos))
    leaf = np.flatnonzero(top != np.arange(len(fp)))
    return fp[leaf], fp[top[leaf]]


def _forests(radius: int):
    """Over rows level, t, key, fp in order: links a, b of each bucket. A bucket is bounded; what is held is a chunk and one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        total = 0

        def work(cols: list[np.ndarray]) -> pa.RecordBatch:
            level, t, key, fp = cols
            new = np.ones(len(fp), bool)
            new[1:] = (level[1:] != level[:-1]) | (t[1:] != t[:-1]) | (key[1:] != key[:-1])
            a, b = forest(np.cumsum(new), fp.view(A.U), radius)
            return pa.RecordBatch.from_arrays([A.signed(a), A.signed(b)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append([np.asarray(c) for c in b.columns])
            total += b.num_rows
            if total < CHUNK:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield work([c[:cut] for c in cols])
            held, total = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if total:
            yield work([np.concatenate(x) for x in zip(*held)])

    return run


def links(points: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) within the radius, enough to connect all that such links connect."""
    order = ["level", "t", "key"]
    rows = buckets(points, radius, limit).repartition(partitions(points.sparkSession), *order).sortWithinPartitions(*order)
    return rows.select(*order, "fp").mapInArrow(_forests(radius), "a long, b long").distinct()


def components_of(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, limit: int = LIMIT) -> DataFrame:
    """doc_id, fp, fingerprint (16 hexadecimal digits) and component_id of each row.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are k words joined by one space, of fewer words the
    whole sequence. Texts without words, null ones too, have fingerprint zero and link like any other. component_id is the
    smallest doc_id among the rows that links reach. Rows without doc_id carry links but no id: a component of such rows
    alone has component_id null. Rows of one doc_id with different texts are judged each by its own text.
    """
    spark, begun = docs.sparkSession, mark()
    rows = settle(fingerprints(docs, k, seed), "simhashes")
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-classes")
    found = settle(links(classes.select("fp"), radius, limit), "fp-links")
    if found.isEmpty():
        of = classes.select("fp", F.col("least").alias("component_id"))
    else:
        tops = settle(components(found), "fp-components")
        topped = settle(classes.join(tops.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("top")), "fp-tops")
        least = settle(topped.groupBy("top").agg(F.min("least").alias("component_id")), "fp-least")
        of = topped.join(least.hint("merge"), "top").select("fp", "component_id")
    of = settle(of, "fp-of")
    release(spark, begun, rows, of)
    return rows.join(of.hint("merge"), "fp", "left").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
