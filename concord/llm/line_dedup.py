"""Line dedup over range-partitioned line hashes.

1. Each document gives one row per distinct long line: 128 bits of BLAKE2b of its key, doc_id, positions.
2. The rows are range-partitioned by (hash, doc_id descending) and sorted: a line that stands in a
   third of all documents is spread over many partitions, in order.
3. Each partition streams its rows. The first document of a hash, the largest doc_id, keeps its
   lines; the later ones lose theirs once `least` documents have been seen. Only runs at a partition's
   two ends can lack knowledge; they leave a few open rows and one summary each, joined afterwards.
4. What returns is one compressed keep bitmap per document, not text.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import fresh, mark, partitions, plain, release, settle, text_keys

MIN_CHARS, MIN_DOCS = 20, 3
_ROWS = "h1 long, h2 long, doc_id long, t1 long, t2 long, n_lines int, at array<int>"
#: Columns that tell rows of one doc_id apart by their texts.
KEY = ("t1", "t2")


def _lines(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, and of each line start, end and row; a row without text has one empty line."""
    data, off = A.buffers(col)
    cut = np.flatnonzero(data == 10)
    start = np.concatenate((off[:-1], cut + 1))
    end = np.concatenate((cut, off[1:]))
    start.sort()  # a newline at a row's end leaves an empty line there, before the next row's first
    end.sort()
    row = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(cut, off)) + 1)
    return data, off, start, end, row


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches):
            data, off, start, end, row = _lines(b.column(1))
            n_lines = np.bincount(row, minlength=b.num_rows)
            at = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(n_lines)[:-1])), n_lines)
            solid = np.flatnonzero(A.NOT_BLANK[data])
            i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
            some = np.flatnonzero(j > i)
            first, last = solid[i[some]], solid[j[some] - 1] + 1
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            long = points[last] - points[first] >= min_chars
            some, first, last = some[long], first[long], last[long]
            low = A.LOWER[data]
            h1, h2 = A.digests(low, first, last)
            order = np.lexsort((at[some], h2, h1, row[some]))
            r, h1, h2, at = row[some][order], h1[order], h2[order], at[some][order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            head = np.flatnonzero(new)
            take = pa.array(r[head])
            yield pa.RecordBatch.from_arrays(
                [A.signed(h1[head]), A.signed(h2[head]), *(b.column(i).take(take) for i in (0, 2, 3)), pa.array(n_lines[r[head]], pa.int32()), A.lists(at, np.diff(np.append(head, len(r))), pa.int32())],
                names=["h1", "h2", "doc_id", *KEY, "n_lines", "at"],
            )

    return run


_OUT = ["kind", "h1", "h2", "doc_id", *KEY, "n_lines", "at", "docs"]


def _stream(least: int):
    """Over rows sorted by hash and falling doc_id. kind 0: lines to drop; 1: dropped iff `least` documents
    hold the line and doc_id is not the largest; 2: a run's documents here and its largest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the run that reaches a batch's end: key, documents so far, largest doc_id, whether it is the first run, rows not yet decided
        key, seen, last_doc, top, opening, held = None, 0, None, None, True, []

        def close(final: bool) -> Iterator[pa.RecordBatch]:
            if key is not None and (opening or final):
                rows = pa.Table.from_batches(held) if held else None
                if rows is not None:
                    for x in rows.to_batches():
                        yield out(x, 1)
                yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([top], pa.int64()), *(pa.array([None], pa.int64()) for _ in KEY), pa.array([None], pa.int32()), pa.array([None], pa.list_(pa.int32())), pa.array([seen], pa.int64())], names=_OUT)

        def out(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
            n = rows.num_rows
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *rows.columns, pa.nulls(n, pa.int64())], names=_OUT)

        for b in batches:
            if not b.num_rows:
                continue
            h1, h2, doc = (np.asarray(b.column(k)) for k in (0, 1, 2))
            n = len(h1)
            new = np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = key is None or (h1[0], h2[0]) != key
            step = np.ones(n, bool)
            step[1:] = doc[1:] != doc[:-1]
            step[0] = new[0] or doc[0] != last_doc
            step |= new
            run_no = np.cumsum(new)  # 0: goes on from the batch before
            steps = np.cumsum(step)
            heads = np.flatnonzero(new)
            # documents seen up to each row within its run
            base = np.concatenate(([-seen], steps[heads] - 1))
            rank = steps - base[run_no]
            tails = np.append(heads - 1, n - 1) if heads.size else np.array([n - 1])
            # total of each run, as far as this batch goes: index by run_no
            total = np.zeros(len(heads) + 1, np.int64)
            total[0] = seen if new[0] else rank[tails[0]]
            if len(heads):
                total[1:] = rank[np.append(heads[1:], n) - 1]
            tot = total[run_no]
            ends_here = run_no < len(heads)  # its run does not reach the batch's end
            first_run = (run_no == 0) & opening if key is not None else run_no == 1
            whole = ends_here & ~first_run
            sure = (tot >= least) & (rank > 1)
            # rows held from before, if their run is settled now
            if key is not None and held and not opening and total[0] >= least:
                for x in held:
                    d = np.asarray(x.column(2)) != top
                    if d.any():
                        yield out(x.filter(pa.array(d)), 0)
                held = []
            elif key is not None and held and opening and total[0] >= least:
                rest = []
                for x in held:
                    d = np.asarray(x.column(2)) != top
                    if d.any():
                        yield out(x.filter(pa.array(d)), 0)
                    if not d.all():
                        rest.append(x.filter(pa.array(~d)))
                held = rest
            drop = np.flatnonzero(sure)
            if len(drop):
                yield out(b.take(pa.array(drop)), 0)
            waits = ~sure & ~whole & ~((tot >= least) & (rank == 1) & ~first_run)
            cont = waits & (run_no == 0)
            if key is not None and len(heads):  # the run from before ends in this batch
                held += [b.take(pa.array(np.flatnonzero(cont)))] if cont.any() else []
                total_before, seen = seen, int(total[0])
                yield from close(False)
                held, opening, seen = [], False, total_before
                cont = np.zeros(n, bool)
            if key is None and len(heads) > 1:  # the partition's first run lies wholly in this batch
                f = np.flatnonzero(waits & (run_no == 1))
                key, seen, top = (int(h1[0]), int(h2[0])), int(total[1]), int(doc[0])
                held = [b.take(pa.array(f))] if len(f) else []
                yield from close(False)
                held, opening = [], False
            if len(heads):  # a new run reaches the end
                tail = run_no == len(heads)
                opening = opening and len(heads) == 1 and key is None
                start = heads[-1]
                key, top = (int(h1[start]), int(h2[start])), int(doc[start])
                f = np.flatnonzero(waits & tail)
                held = [b.take(pa.array(f))] if len(f) else []
            elif cont.any():
                held.append(b.take(pa.array(np.flatnonzero(cont))))
            seen, last_doc = int(total[-1]), int(doc[-1])
        yield from close(True)

    return run


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, least: int = MIN_DOCS) -> DataFrame:
    """doc_id, t1, t2 (the text's key), n_lines and the dropped line numbers `at` of each document that loses lines."""
    spark = docs.sparkSession
    keyed = plain(docs).filter(F.col("doc_id").isNotNull()).withColumns(dict(zip(KEY, text_keys())))
    begun = mark()
    rows = settle(keyed.mapInArrow(_line_rows(min_chars), _ROWS), "lines")
    ranged = rows.repartitionByRange(partitions(spark), "h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"))
    found = settle(ranged.mapInArrow(_stream(least), "kind tinyint, " + _ROWS + ", docs long"), "line-runs")
    release(spark, begun, found)
    # two summaries and a few open rows per partition: bounded by the partitions, not by the rows
    ends = found.filter("kind = 2").groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("doc_id").alias("top"))
    late = found.filter("kind = 1").drop("kind", "docs").join(F.broadcast(ends), ["h1", "h2"]).filter((F.col("n") >= least) & (F.col("doc_id") < F.col("top")))
    cols = ["doc_id", *KEY, "n_lines", "at"]
    every = found.filter("kind = 0").select(cols).unionByName(late.select(cols))
    # repeated rows (same id and text) bring the same numbers again
    return every.groupBy("doc_id", *KEY).agg(F.max("n_lines").alias("n_lines"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))


def _pack(n: int, at: list[int]) -> bytes:
    keep = np.ones(n, bool)
    keep[at] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, least: int = MIN_DOCS) -> DataFrame:
    """doc_id, t1, t2, n_lines, n_dropped and keep: the zlib-compressed bitmap of lines that stay.

    Only documents that lose lines have a row. Null and empty texts have one empty line and lose
    none; rows without doc_id lose none and count for none; rows of one doc_id count as one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, at = b.column(3).to_pylist(), b.column(4).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(list(map(len, at)), pa.int32()), pa.array([_pack(*x) for x in zip(n, at)], pa.binary())], names=["doc_id", *KEY, "n_lines", "n_dropped", "keep"])

    return drops(docs, min_chars, least).mapInArrow(run, "doc_id long, t1 long, t2 long, n_lines int, n_dropped int, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, digest: bool = False) -> DataFrame:
    """All rows of docs; with digest doc_id, n_lines, n_dropped and kept_sha256, else docs' own columns with the lines that stay in text.

    A row whose text is null stays null, unless a digest is asked for (that of the empty text).
    """
    left = plain(docs) if digest else docs
    d, k1, k2, bitmap = fresh(left, "doc", "key1", "key2", "bitmap")
    keep = bitmaps.select(F.col("doc_id").alias(d), F.col("t1").alias(k1), F.col("t2").alias(k2), F.col("keep").alias(bitmap))
    t1, t2 = text_keys()
    on = (F.col("doc_id").cast("long") == F.col(d)) & (t1 == F.col(k1)) & (t2 == F.col(k2))
    joined = left.join(keep, on, "left").drop(d, k1, k2)
    names = joined.columns[:-1]
    at, bits = names.index("text"), len(names)

    def kept(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
        lines = (text or "").split("\n")
        if bitmap is None:
            return len(lines), 0, text or ""
        flags = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
        stay = [x for x, f in zip(lines, flags.tolist()) if f]
        return len(lines), len(lines) - len(stay), "\n".join(stay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.pieces(batches):
            texts, maps = b.column(at).to_pylist(), b.column(bits).to_pylist()
            if digest:
                done = [kept(*x) for x in zip(texts, maps)]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in done], pa.int64()) for i in (0, 1)), pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in done], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
            else:
                new = pa.array([t if m is None else kept(t, m)[2] for t, m in zip(texts, maps)], pa.string())
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns[:-1])], names=names)

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" if digest else docs.schema)
