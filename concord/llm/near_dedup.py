"""MinHash near-dedup with an LSH forest.

1. Each document gives its shingle set's size, a 128-bit hash of the set, and a signature of minima.
   Documents of equal sets are one class; its smallest doc_id stands for it from here on.
2. The forest: each of ORDERS orders lists the classes sorted by DEPTH signature values, drawn anew
   for each order. Rows are range-partitioned and sorted, so a dense region spreads over tasks.
3. Neighbours with a long common prefix are candidates. A region is a run that shares its first BASE
   values. All pairs of a region of at most REGION rows are candidates. In a larger one every member
   meets the region's smallest doc_id, and it is split by the next value, and so on, at full depth with
   neighbours too: that finds most links cheaply, and the whole region's rest is taken up in step 6.
4. Two-bit sketches drop pairs far below the limit; the others are confirmed on full sets.
5. Confirmed links contract to components.
6. The rest: members of a region of more than REGION rows that are not in its least component are
   held against all its members, block by block: first by signatures alone (MATCHES), then those with a partner,
   and only their texts, on full sets. Components are taken again. So every pair that shares a region of any size is decided.

A region cut by a partition's border is two regions in that order; the other orders do not share the
border. A pair shares BASE values in at least one of these orders but for odds of 3.2e-4 at similarity
0.80, 1.2e-4 at 0.82 and 2.1e-5 at 0.85 (simulated; the orders draw from the same VALUES values). A large
region is streamed: a task never holds more than HELD rows of it.

Defined cases: see near_duplicates; an empty table gives an empty result, a text of any length is one row of
its slice, columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import mark, partitions, plain, release, settle
from .graph import components

VALUES, ORDERS, BASE, DEPTH, REGION, NEAR = 64, 24, 4, 8, 24, 4
#: A pair goes on if so many of its VALUES two-bit sketch values agree: 5 deviations below what 0.8 gives.
AGREE = 40
#: Signature values, of VALUES, that a pair of the rest must share to be held against each other on full sets: 5 deviations below what 0.8 gives.
MATCHES = 35
#: Members on each side of a block of the rest, of signatures and of texts, and shingles on each side of the latter.
SIGNATURES, BLOCK, BLOCK_SHINGLES = 2048, 512, 1 << 19
#: Rows of one region that a task holds.
HELD = 1 << 18
#: Ids that are broadcast, at most, to pick the texts of large regions.
MAX_IDS = 200_000
_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * A.U(2) + A.U(1)
_DRAWN = np.stack([_rng.permutation(VALUES)[:DEPTH] for _ in range(ORDERS)])


def shingles(w: A.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, shingle) keys: row << 54 | 54 bits of hash; and the rows. A text of fewer than k words is one shingle."""
    h = w.hashes()
    n = np.where(w.count >= k, w.count - k + 1, np.minimum(w.count, 1))
    start = A.ranges(w.first[:-1], n)
    row = np.repeat(np.arange(len(n)), n)
    x = A.Prefix(h, 1).of(start, start + np.minimum(w.count, k)[row])
    key = np.sort((row.astype(A.U) << A.U(54)) | (x >> A.U(10)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key, (key >> A.U(54)).astype(np.int64)


def _signature_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches):
            key, row = shingles(A.Words(b.column(1), lower=True), k)
            n = np.bincount(row, minlength=b.num_rows)
            x = A.mix(key << A.U(10))
            s = np.zeros((2, b.num_rows), A.U)
            sig = np.zeros((b.num_rows, VALUES), np.uint16)
            some = np.flatnonzero(n)
            if len(some):
                at = np.concatenate(([0], np.cumsum(n)[:-1]))[some]
                with np.errstate(over="ignore"):
                    for i, f in enumerate((1, 0x9E3779B97F4A7C15)):
                        s[i, some] = np.add.reduceat(A.mix(x * A.U(f)), at)
                    buf = np.empty_like(x)
                    for j in range(VALUES):
                        np.multiply(x, _FACTORS[j], out=buf)
                        sig[some, j] = A.mix(np.minimum.reduceat(buf, at)) >> A.U(48)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), A.signed(s[0]), A.signed(s[1]), pa.array([r.tobytes() for r in sig], pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "sig"])

    return run


def _forest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(n, VALUES).astype(A.U)
        two = sig & A.U(3)
        sketch = [np.zeros(n, A.U), np.zeros(n, A.U)]
        for j in range(VALUES):
            sketch[j // 32] |= two[:, j] << A.U(2 * (j % 32))
        key = [np.zeros((n, ORDERS), A.U), np.zeros((n, ORDERS), A.U)]
        for d in range(DEPTH):
            key[d // 4] |= sig[:, _DRAWN[:, d]] << A.U(48 - 16 * (d % 4))
        rep = lambda a: np.repeat(a, ORDERS)
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(ORDERS, dtype=np.int8), n)), A.signed(key[0].ravel()), A.signed(key[1].ravel()), pa.array(rep(np.asarray(b.column(0)))), A.signed(rep(sketch[0])), A.signed(rep(sketch[1]))], names=["o", "k1", "k2", "id", "z1", "z2"])


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two-bit values that two sketches share; a and b: uint64 of shape (2, n)."""
    x = a ^ b
    x = (x | (x >> A.U(1))) & A.U(0x5555555555555555)
    return VALUES - np.bitwise_count(x).sum(0).astype(np.int64)


def _regions(o: np.ndarray, k1: np.ndarray, k2: np.ndarray, ids: np.ndarray, z: np.ndarray):
    """Candidate pairs, and members of large BASE regions, of rows in whole BASE regions."""
    found, n = [], len(ids)

    def pair(i: np.ndarray, j: np.ndarray) -> None:
        on = ids[i] != ids[j]
        i, j = i[on], j[on]
        on = agree(z[:, i], z[:, j]) >= AGREE
        i, j = ids[i[on]], ids[j[on]]
        found.append(np.stack((np.minimum(i, j), np.maximum(i, j))))

    rows = np.arange(n)
    edge = np.ones(n, bool)
    edge[1:] = (o[1:] != o[:-1]) | (k1[1:] != k1[:-1])
    for d in range(BASE, DEPTH + 1):
        # rows are those still undecided; their regions at depth d
        new = np.ones(len(rows), bool)
        if d == BASE:
            new = edge
        else:
            kk = k2[rows] >> A.U(16 * (DEPTH - d))
            new[1:] = (np.diff(rows) > 1) | edge[rows[1:]] | (kk[1:] != kk[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(rows)))
        region = np.cumsum(new) - 1
        small = size <= REGION
        for step in range(1, REGION):
            i = np.flatnonzero((region[:-step] == region[step:]) & small[region[:-step]]) if len(rows) > step else rows[:0]
            if not len(i):
                break
            pair(rows[i], rows[i + step])
        large = np.flatnonzero(~small[region])
        if len(large):
            r, idl = rows[large], ids[rows[large]]
            first = np.flatnonzero(np.concatenate(([True], region[large][1:] != region[large][:-1])))
            least = np.minimum.reduceat(idl, first)
            per = np.diff(np.append(first, len(large)))
            hub = np.flatnonzero(idl == np.repeat(least, per))
            own = np.searchsorted(first, hub, "right") - 1
            _, once = np.unique(own, return_index=True)
            pair(r, r[np.repeat(hub[once], per)])
            if d == DEPTH:
                for step in range(1, NEAR + 1):
                    i = np.flatnonzero(region[large][:-step] == region[large][step:]) if len(large) > step else large[:0]
                    pair(r[i], r[i + step])
        rows = rows[large]
        if d == BASE:
            members = rows
        if not len(rows):
            break
    pairs = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs, members


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: candidate a, b; kind 1: region a has member b."""
    def work(cols: list[np.ndarray]) -> pa.RecordBatch:
        o, k1, k2, ids, z1, z2 = cols
        k1, k2, z = k1.view(A.U), k2.view(A.U), np.stack((z1.view(A.U), z2.view(A.U)))
        pairs, m = _regions(o, k1, k2, ids, z)
        with np.errstate(over="ignore"):
            uid = A.mix(k1[m] + o[m].astype(A.U) * A.U(0x9E3779B97F4A7C15))
        n, k = pairs.shape[1], len(m)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array([0, 1], np.int8), (n, k))), pa.array(np.concatenate((pairs[0], uid.view(np.int64)))), pa.array(np.concatenate((pairs[1], ids[m])))],
            names=["kind", "a", "b"],
        )

    held: list[list[np.ndarray]] = []
    total, need = 0, 4096
    for b in batches:
        if not b.num_rows:
            continue
        held.append([np.asarray(c) for c in b.columns])
        total += b.num_rows
        if total < need:
            continue
        cols = [np.concatenate(x) for x in zip(*held)]
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield work([c[:cut] for c in cols])
            cols = [c[cut:] for c in cols]
        elif total >= HELD:
            # a piece of one large region: its least row and its end stay, so that the next piece is large and linked with this one
            yield work(cols)
            stay = np.concatenate(([int(np.argmin(cols[3]))], np.arange(total - REGION, total)))
            cols = [c[stay] for c in cols]
        held, total = [cols], len(cols[0])
        need = max(4096, 2 * total)
    if total:
        yield work([np.concatenate(x) for x in zip(*held)])


def _confirm(k: int, percent: int):
    """Pairs whose whole shingle sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(A.pieces(batches, "text_a"), "text_b"):
            (one, r1), (two, r2) = (shingles(A.Words(b.column(i), lower=True), k) for i in (2, 3))
            every = np.sort(np.concatenate((one, two)))
            both = np.bincount((every[1:][every[1:] == every[:-1]] >> A.U(54)).astype(np.int64), minlength=b.num_rows)
            union = np.bincount(r1, minlength=b.num_rows) + np.bincount(r2, minlength=b.num_rows) - both
            yield b.select([0, 1]).filter(pa.array((100 * both >= percent * union) & (union > 0)))

    return run


def _confirmed(pairs: DataFrame, keyed: DataFrame, k: int, percent: int) -> DataFrame:
    # a shuffle at every size: the few pairs of a small run must not turn into a broadcast that a large one can't have
    one = pairs.join(keyed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    two = one.join(keyed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(k, percent), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Words are runs without ASCII white space, A-Z lower-cased; texts are linked when their sets of
    distinct k-word shingles share at least `percent` per cent. Null and empty texts have no
    shingles, link with nothing and are their own component. A null doc_id has component null and is
    kept. Rows of one doc_id with different texts are judged each by its own text.
    """
    spark = docs.sparkSession
    keyed, begun = plain(docs), mark()
    sigs = settle(keyed.mapInArrow(_signature_rows(k), "doc_id long, n_shingles long, s1 long, s2 long, sig binary"), "signatures")
    known = sigs.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = settle(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n")), "classes")
    forest = settle(classes.select("id", "sig").mapInArrow(_forest_rows, "o tinyint, k1 long, k2 long, id long, z1 long, z2 long"), "forest")
    order = ["o", "k1", "k2", "id"]
    found = settle(forest.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_candidates, "kind tinyint, a long, b long"), "candidates")
    pairs = settle(found.filter("kind = 0").select("a", "b").distinct(), "pairs")
    known_text = keyed.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    links = settle(_confirmed(pairs, known_text, k, percent), "links")
    if links.isEmpty():
        tops = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    else:
        tops = settle(components(links), "components")
    new = _rest(found, tops, classes, known_text, k, percent)
    if not new.isEmpty():
        tops = settle(components(links.unionByName(new)), "components")
    of = settle(classes.select("s1", "s2", F.col("id").alias("node")).join(tops, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component_id")), "class-components")
    release(spark, begun, sigs, of)
    rows = sigs.join(of, ["s1", "s2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _blocked(rows: DataFrame, most: int, weight: int | None, *cols: str) -> DataFrame:
    """Rows (hub, id, top, n and cols) dealt to blocks (hub, i, j): each member outside the hub's component once per
    column j as one that asks, each member once per row i; at most about `most` members (and `weight` shingles) on a side."""
    outside = F.col("top") != F.col("hub")
    enough = lambda on: F.greatest(F.ceil(F.count_if(on) / most), F.ceil(F.sum(F.when(on, F.col("n")).otherwise(0)) / weight) if weight else F.lit(1), F.lit(1)).cast("int")
    sizes = settle(rows.groupBy("hub").agg(enough(F.lit(True)).alias("blocks"), enough(outside).alias("outer")), "sizes")
    rows = rows.join(sizes, "hub")
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rows.filter(outside).select("hub", spot("outer").alias("i"), every("blocks").alias("j"), F.lit(True).alias("asks"), "id", "top", *cols)
    two = rows.select("hub", every("outer").alias("i"), spot("blocks").alias("j"), F.lit(False).alias("asks"), "id", "top", *cols)
    return one.unionByName(two)


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(t.column(c).combine_chunks()) for c in names]


def _screen(t: pa.Table) -> pa.Table:
    """Members of a block that share MATCHES signature values with one of another component."""
    asks, ids, top = _columns(t, "asks", "id", "top")
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
    theirs = np.flatnonzero(~asks)
    keep = np.zeros(len(ids), bool)
    for i in np.flatnonzero(asks):
        near = theirs[((sig[theirs] == sig[i]).sum(1) >= MATCHES) & (top[theirs] != top[i])]
        keep[near] = True
        keep[i] |= len(near) > 0
    return pa.table({"hub": np.repeat(np.asarray(t.column("hub").combine_chunks())[:1], keep.sum()), "id": ids[keep]})


def _rest(found: DataFrame, tops: DataFrame, classes: DataFrame, keyed: DataFrame, k: int, percent: int) -> DataFrame:
    """Links a, b that large regions still hide, all of them, in blocks.

    Regions with members of several components are grouped by their least component. Every member
    outside it is held against every member of the group, first by signatures, then on full sets, and
    leaves one link for each other component it belongs to. No pair is listed.
    """
    members = found.filter("kind = 1").select(F.col("a").alias("region"), F.col("b").alias("id")).distinct()
    members = settle(members.join(tops, F.col("id") == F.col("node"), "left").select("region", "id", F.coalesce("component", "id").alias("top")), "members")
    hubs = settle(members.groupBy("region").agg(F.min("top").alias("hub"), F.max("top").alias("most")).filter("hub < most").select("region", "hub"), "hubs")
    if hubs.isEmpty():
        return members.select(F.col("id").alias("a"), F.col("top").alias("b")).limit(0)
    torn = members.join(hubs, "region").select("hub", "id", "top").distinct()
    torn = settle(torn.join(classes.select("id", "sig", "n").hint("merge"), "id"), "torn")
    near = _blocked(torn, SIGNATURES, None, "sig").groupBy("hub", "i", "j").applyInArrow(_screen, "hub long, id long").distinct()
    torn = settle(torn.drop("sig").join(settle(near, "screened").hint("merge"), ["hub", "id"]), "torn-near")
    ids = settle(torn.select(F.col("id").alias("doc_id")).distinct(), "torn-ids")
    if ids.count() <= MAX_IDS:  # then only their texts are shuffled; beyond it all are
        keyed = keyed.join(F.broadcast(ids), "doc_id", "left_semi")
    texts = torn.join(keyed.hint("merge"), F.col("id") == F.col("doc_id")).select("hub", "id", "top", "n", "text")

    def block(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks, ids, top = _columns(t, "asks", "id", "top")
        sets = []
        for at in range(0, len(ids), 512):
            key, row = shingles(A.Words(t.column("text").combine_chunks().slice(at, 512), lower=True), k)
            sets.append((key & A.U((1 << 54) - 1), row + at))
        x, row = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
        n = np.bincount(row, minlength=len(ids))
        _, x = np.unique(x, return_inverse=True)
        first = np.concatenate(([0], np.cumsum(n)))
        mark = np.zeros(int(x.max(initial=0)) + 1, bool)
        theirs = np.flatnonzero(~asks & (n > 0))
        mine = np.repeat(np.isin(np.arange(len(ids)), theirs), n)
        y, begin = x[mine], np.concatenate(([0], np.cumsum(n[theirs])[:-1])).astype(np.int64)
        out: set[tuple[int, int]] = set()
        for i in np.flatnonzero(asks & (n > 0)) if len(theirs) else ():
            own = x[first[i] : first[i + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[y].astype(np.int64), begin)
            mark[own] = False
            alike = theirs[(100 * both >= percent * (n[i] + n[theirs] - both)) & (top[theirs] != top[i])]
            _, lead = np.unique(top[alike], return_index=True)
            out.update((min(ids[i], ids[m]), max(ids[i], ids[m])) for m in alike[lead])
        pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return settle(_blocked(texts, BLOCK, BLOCK_SHINGLES, "text").groupBy("hub", "i", "j").applyInArrow(block, "a long, b long"), "rest")
