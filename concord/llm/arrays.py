"""Vectorised text primitives on Arrow buffers: words, lines and rolling hashes as numpy arrays.

Every function works on the concatenated UTF-8 bytes of a slice of rows, so its memory follows the
slice's bytes (``pieces`` bounds them), never the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
# Workers live through many tasks: freed memory goes back to the system (see trim), Arrow's too.
pa.set_memory_pool(pa.system_memory_pool())
SLICE_BYTES = 1 << 19


def trim() -> None:
    """Returns freed memory to the system, where the C library can."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def _table(blanks: Iterable[int]) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(blanks)] = False
    return t


#: Word bytes: all but ASCII white space; and ASCII letters and digits with everything beyond ASCII.
NOT_BLANK = _table([0x20, *range(0x09, 0x0E)])
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Byte strings of up to this many bytes are hashed in blocks of eight, all at once; longer ones by BLAKE2b.
SHORT = 64
_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; a base is odd, so it has an inverse."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            a = np.full(size, b, U)
            a[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.cumprod(a, dtype=U))
        have = (out[0], out[1])
        if size <= 8 * SLICE_BYTES:
            _powers[which] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all 64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Prefix:
    """Polynomial prefix sums: the hash of any range of values in constant time.

    For values that are hashes themselves, in ranges of at most some hundred: an odd base modulo 2**64 has
    differences that vanish for chosen sequences of 1,024 values and more.
    """

    def __init__(self, values: np.ndarray, which: int):
        up, self.down = powers(which, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.down[start]
            return mix(h + (end - start).astype(U) * U(0x632BE59BD9B4E019))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n+1, from 0) of a string or binary column; null counts as empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `rows` rows and `limit` bytes in `column`, or one row."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, off = buffers(batch.column(batch.schema.get_field_index(column)))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
                j = min(j, i + rows, batch.num_rows)
                yield batch.slice(i, j - i)
                i = j
    finally:
        trim()


class Words:
    """Words of a slice: start and end bytes, first[i]..first[i+1] are those of row i, 64-bit hashes."""

    def __init__(self, col: pa.Array, word: np.ndarray = NOT_BLANK, lower: bool = False):
        raw, self.offsets = buffers(col)
        self.raw = raw
        self.data = LOWER[raw] if lower else raw
        n = len(raw)
        inside = np.zeros(n + 1, bool)
        inside[:n] = word[self.data]
        begins = inside[:n].copy()
        begins[1:] &= ~inside[: n - 1]
        cut = self.offsets[:-1][self.offsets[:-1] < n]
        begins[cut] = inside[cut]
        self.start = np.flatnonzero(begins)
        ends = inside[:n] & ~inside[1:]
        last = self.offsets[1:][self.offsets[1:] > 0] - 1
        ends[last] = inside[last]
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, which: int = 0) -> np.ndarray:
        return byte_hash(self.data, self.start, self.end, which)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; behind the end zeros."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))).tobytes(), 0, (1,))


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Whether data[start:end] and data[start2:end2] are equal, for each pair of ranges; in blocks of eight bytes."""
    size = end - start
    out = size == end2 - start2
    eight = _eights(data)
    live = np.flatnonzero(out & (size > 0) & (size <= SHORT))
    a, b, left = start[live], start2[live], size[live]
    while len(live):
        cut = U(8) * (U(8) - np.minimum(left, 8).astype(U))
        equal = ((eight[a] ^ eight[b]) << cut) == 0
        out[live[~equal]] = False
        on = equal & (left > 8)
        live, a, b, left = live[on], a[on] + 8, b[on] + 8, left[on] - 8
    for i in np.flatnonzero(out & (size > SHORT)).tolist():
        out[i] = np.array_equal(data[start[i] : end[i]], data[start2[i] : end2[i]])
    return out


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """64-bit hashes of data[start:end]: each block of eight bytes is mixed into all bits before the next; `which` gives independent ones."""
    size = end - start
    out = (size.astype(U) + U(which + 1)) * U(_BASES[which])
    eight = _eights(data)
    live = np.flatnonzero(size <= SHORT)
    at, left = start[live], size[live]
    while len(live):
        cut = U(8) * (U(8) - np.minimum(left, 8).astype(U))
        with np.errstate(over="ignore"):
            block = np.where(left > 0, eight[at] << (cut & U(63)), U(0))
            out[live] = mix((out[live] ^ block) * U(_BASES[which]))
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    return out


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of data[start:end], as two halves: nobody knows two strings of one digest."""
    view = memoryview(np.ascontiguousarray(data))
    both = b"".join([blake2b(view[i:j], digest_size=16).digest() for i, j in zip(start.tolist(), end.tolist())])
    halves = np.frombuffer(both, "<u8").reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... of count[i] numbers each, one after the other."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return np.arange(total) + skip


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the minimum of h[i:i+w], the rightmost on ties, for each i with a whole window."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(h)), 1
    while size * 2 <= w:
        a, b = at[:-size], at[size:]
        at, size = np.where(h[b] <= h[a], b, a), size * 2
    if size < w:
        a, b = at[:n], at[w - size : w - size + n]
        at = np.where(h[b] <= h[a], b, a)
    return at[:n]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
