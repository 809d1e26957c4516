"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece exactly one token can be the last of its encoding. ``last[i]`` stores
it; the encoding is read backwards. A stored table takes appended bytes exactly (only new prefixes
are computed) and re-encodes after an edit from the first changed byte on.

A token t may follow token p iff the merges could not have joined across their border earlier: both
are taken apart along their own merges, highest rank first, and no pair across the border may be a
token that would have been merged before them.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

#: Distinct pieces whose ids a worker remembers; beyond it the memory is cleared, results stay the same.
REMEMBERED = 320_000
#: Longer pieces go through the scalar table.
LANE = 48
#: Values of the bytes in hashes of token-long ranges.
_BYTE = np.random.default_rng(0xC0FFEE).integers(1, 2**63, 256, dtype=np.uint64)
_MISS = np.int64(-1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Hash:
    """uint64 keys to int64 values by open addressing, looked up as arrays; an absent key gives -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, _MISS)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            s = slot[todo]
            free = self.values[s] == _MISS
            _, lead = np.unique(np.where(free, s, -1), return_index=True)
            lead = lead[free[lead]]
            self.keys[s[lead]], self.values[s[lead]] = keys[todo[lead]], values[todo[lead]]
            done = np.zeros(len(todo), bool)
            done[lead] = True
            todo = todo[~done]
            taken = self.values[slot[todo]] != _MISS
            slot[todo[taken]] = (slot[todo[taken]] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (A.mix(keys) >> A.U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out, todo = np.full(len(keys), _MISS), None
        while True:
            s = slot if todo is None else slot[todo]
            k = keys if todo is None else keys[todo]
            v = self.values[s]
            hit = (self.keys[s] == k) & (v != _MISS)
            if todo is None:
                out[hit] = v[hit]
                todo = np.flatnonzero(~hit & (v != _MISS))
            else:
                out[todo[hit]] = v[hit]
                todo = todo[~hit & (v != _MISS)]
            if not len(todo):
                return out
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)


class Bpe:
    """An encoder and decoder for one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # the white space of the pattern is Unicode's property, as in the library's own engine
        self.split = regex.compile(pattern).findall
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.lengths = sorted({len(b) for b in ranks})
        top = max(ranks.values()) + 1
        self.parts = {}
        self.joined: dict[tuple[int, int], int] = {}
        for i in sorted(self.token):
            self._take_apart(i, self.token[i])
        pairs = np.array([(a << 32) | b for a, b in self.joined], np.uint64)
        self.pairs = _Hash(pairs, np.fromiter(self.joined.values(), np.int64, len(self.joined)))
        self.left, self.right = np.arange(top), np.arange(top)
        for i, (a, b) in self.parts.items():
            self.left[i], self.right[i] = a, b
        self.size = np.zeros(top, np.int64)
        self.offset = np.zeros(top, np.int64)
        blob, at = [], 0
        for i, b in self.token.items():
            self.size[i], self.offset[i] = len(b), at
            blob.append(b)
            at += len(b)
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        ids = np.fromiter(self.token, np.int64, len(self.token))
        self.by_hash = _Hash(A.Prefix(_BYTE[self.blob], 3).of(self.offset[ids], self.offset[ids] + self.size[ids]), ids)
        self.memory: dict[str, bytes] = {}

    def _take_apart(self, i: int, b: bytes) -> None:
        for n in range(len(b) - 1, 0, -1):
            one, two = self.ranks.get(b[:n], i), self.ranks.get(b[n:], i)
            if one < i and two < i and self.follows(one, two):
                self.parts[i], self.joined[one, two] = (one, two), i
                return

    def follows(self, one: int, two: int) -> bool:
        """Whether the encoding of a text can hold token `two` right after token `one`."""
        never = 1 << 60
        limit = never
        while True:
            if self.joined.get((one, two), never) < limit:
                return False
            if one > two:
                limit, one = one, self.parts.get(one, (one, one))[1]
                if one != limit:
                    continue
                limit, two = two + 1, self.parts.get(two, (two, two))[0]
                if two + 1 == limit:
                    return True
            else:
                limit, two = two + 1, self.parts.get(two, (two, two))[0]
                if two + 1 != limit:
                    continue
                limit, one = one, self.parts.get(one, (one, one))[1]
                if one == limit:
                    return True

    def follow(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """follows() for arrays."""
        out = np.ones(len(one), bool)
        todo, one, two, limit = np.arange(len(one)), one.copy(), two.copy(), np.full(len(one), 1 << 60)
        while len(todo):
            pair = self.pairs.get((one.astype(np.uint64) << A.U(32)) | two.astype(np.uint64))
            bad = (pair >= 0) & (pair < limit)
            out[todo[bad]] = False
            r, s = self.right[one], self.left[two]
            first = one > two
            can_one, can_two = r != one, s != two
            take_one = np.where(first, can_one, ~can_two & can_one)
            take_two = np.where(first, ~can_one & can_two, can_two)
            limit = np.where(take_one, one, two + 1)
            one, two = np.where(take_one, r, one), np.where(take_two, s, two)
            on = ~bad & (take_one | take_two)
            todo, one, two, limit = todo[on], one[on], two[on], limit[on]
        return out

    def _lanes(self, texts: list[bytes]) -> list[bytes]:
        """Ids of many short pieces at once: one dynamic-programming step per byte position."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))[order]
        size = size[order]
        sums = A.Prefix(_BYTE[data], 3)
        most = int(size[0])
        last = np.full((len(texts), most + 1), _MISS)
        for i in range(1, most + 1):
            live = np.searchsorted(-size, -i, "right")
            open_ = np.arange(live)
            for n in range(min(i, self.longest), 0, -1):
                end = begin[open_] + i
                t = self.by_hash.get(sums.of(end - n, end))
                hit = np.flatnonzero(t >= 0)
                if n < i and len(hit):
                    hit = hit[self.follow(last[open_[hit], i - n], t[hit])]
                if len(hit):
                    last[open_[hit], i] = t[hit]
                    rest = np.ones(len(open_), bool)
                    rest[hit] = False
                    open_ = open_[rest]
                    if not len(open_):
                        break
        # backwards, all pieces together
        ids = np.zeros((len(texts), most), np.uint32)
        at, count, live = size.copy(), np.zeros(len(texts), np.int64), np.flatnonzero(size > 0)
        while len(live):
            t = last[live, at[live]]
            count[live] += 1
            ids[live, most - count[live]] = t
            at[live] -= self.size[t]
            live = live[at[live] > 0]
        out: list[bytes] = [b""] * len(texts)
        for k, row, c in zip(order.tolist(), ids, count.tolist()):
            out[k] = row[most - c :].tobytes()
        return out

    def learn(self, wanted: set[str]) -> None:
        if len(self.memory) + len(wanted) > REMEMBERED:
            self.memory.clear()
        short = []
        for p in wanted:
            b = p.encode()
            if b in self.ranks:
                self.memory[p] = self.ranks[b].to_bytes(4, "little")
            elif len(b) <= LANE:
                short.append(p)
            else:
                self.memory[p] = np.array(Prefixes(self, b).ids(), "<u4").tobytes()
        if short:
            self.memory.update(zip(short, self._lanes([p.encode() for p in short])))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        wanted = set().union(*split).difference(self.memory) if split else set()
        if wanted:
            if len(wanted) + len(self.memory) > REMEMBERED:
                self.memory.clear()
                wanted = set().union(*split)
            self.learn(wanted)
        get = self.memory.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids, and where those of each id end."""
        size = self.size[ids]
        return self.blob[A.ranges(self.offset[ids], size)], np.cumsum(size)


class Prefixes:
    """The last token of each prefix of one piece; bytes may be appended or replaced."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        b, done = self.data + more, len(self.data)
        ranks, follows, last = self.bpe.ranks, self.bpe.follows, self.last
        for i in range(done + 1, len(b) + 1):
            for n in self.bpe.lengths:
                if n > i:
                    raise ValueError("the vocabulary lacks a byte")
                t = ranks.get(b[i - n : i])
                if t is not None and (n == i or follows(last[i - n], t)):
                    last.append(t)
                    break
        self.data = b

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Prefixes before the edit stay as they are."""
        rest = new + self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(rest)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.bpe.token[self.last[at]])
        return out[::-1]


_made: dict[tuple, Bpe] = {}


def encoder(path: str, pattern: str) -> Bpe:
    """The worker's encoder for a rank file; path names a file of an installed package, there on each executor."""
    key = (path, os.path.getmtime(path), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(read_ranks(path), pattern)
    return _made[key]


def _sha(x) -> str:
    return hashlib.sha256(x).hexdigest()


def encode(docs: DataFrame, path: str, pattern: str, digest: bool = True, forms: bool = False) -> DataFrame:
    """doc_id and n_tokens of each row's text; with digest ids_sha256 and decoded_sha256, with forms ids (binary,
    little-endian uint32) and decoded (binary).

    Null text is empty and has no ids. One row out for each row in, null doc_ids and repeated rows too;
    only doc_id and text are read.
    """
    columns = [("doc_id", "long"), ("n_tokens", "long")]
    columns += [("ids_sha256", "string"), ("decoded_sha256", "string")] * digest + [("ids", "binary"), ("decoded", "binary")] * forms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in A.pieces(batches, limit=2 << 20):
            ids = bpe.encode_many([t or "" for t in b.column(1).to_pylist()])
            data, ends = bpe.decode(np.frombuffer(b"".join(ids), "<u4").astype(np.int64))
            data, counts = data.tobytes(), [len(x) // 4 for x in ids]
            ends = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
            texts = [data[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            out = [b.column(0), pa.array(counts, pa.int64())]
            out += [pa.array(list(map(_sha, x)), pa.string()) for x in (ids, texts)] if digest else []
            out += [pa.array(x, pa.binary()) for x in (ids, texts)] if forms else []
            yield pa.RecordBatch.from_arrays(out, names=[c for c, _ in columns])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(" ".join(c) for c in columns))


def lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and n_tokens alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in A.pieces(batches, limit=2 << 20):
            counts = [len(x) // 4 for x in bpe.encode_many([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
