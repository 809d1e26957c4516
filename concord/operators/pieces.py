"""Texts cut at the white space that no token reaches over, so that pieces that many texts share are taken apart once.

What T.phrase_tokens finds in a text it finds in the text's pieces. White space inside what it joins (a word hyphenated over a line, a dash before
a number, a decimal mark among spaces) is no place to cut; in doubt a piece stays longer. Cutting knows no tokens: those are made by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import fixed as X
from concord.functions import text as T

#: Bytes of texts that are cut together: their pieces are made distinct.
GROUP_BYTES = 8 << 20

# what is taken away, or passed over, between the parts of a number: quotes and white space that bytes.split() leaves
_THIN = tuple(c.encode() for c in X.QUOTES + "\u00a0\ufeff\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
_DASHES = tuple(c.encode() for c in "-" + X.DASHES)
_OPEN = _DASHES + tuple(c.encode() for c in "<>|{}[]")
# how a piece ends: surely closed; before anything; with a digit; with a decimal mark
_CLOSED, _ANY, _DIGIT, _MARK = range(4)
# how the next one begins: with neither; with nothing; with a decimal mark; with a digit or a dash
_OTHER, _NOTHING, _POINT, _NUMBER = range(4)
_REACHES = np.zeros((4, 4), bool)
_REACHES[_ANY] = _REACHES[_DIGIT, [_NOTHING, _POINT]] = _REACHES[_MARK, [_NOTHING, _NUMBER]] = True


# outer bytes of words that may be other than closed, or begin other than _OTHER
_table = lambda some: np.isin(np.arange(256), [*some])
_LAST, _FIRST = (_table({c[i] for c in (*_THIN, *_OPEN)} | set(b"0123456789,.")) for i in (-1, 0))
_MARKS, _LETTERS = _table(b",."), _table(range(ord("a"), ord("z") + 1)) | _table(range(ord("A"), ord("Z") + 1))


def _end(c: bytes) -> bytes:
    while c.endswith(_THIN):
        c = c[: -next(len(t) for t in _THIN if c.endswith(t))]
    return c


def _ends(word: bytes) -> int:
    c = _end(word)
    if not c or c.endswith(_OPEN):
        return _ANY
    if c[-1:].isdigit():
        return _DIGIT
    if c[-1:] not in (b",", b"."):
        return _CLOSED
    before = _end(c[:-1])
    return _MARK if not before or before[-1:].isdigit() else _CLOSED


def _begins(c: bytes) -> int:
    while c.startswith(_THIN):
        c = c[next(len(t) for t in _THIN if c.startswith(t)) :]
    if not c:
        return _NOTHING
    return _POINT if c[:1] in (b",", b".") else _NUMBER if c[:1].isdigit() or c.startswith(_DASHES) else _OTHER


def _kinds(words: pa.Array) -> np.ndarray:
    """How each word ends and begins. Only words whose outer bytes may matter are looked at one by one."""
    out = np.zeros((len(words), 2), np.int8)
    # bytes, as texts need not be sound UTF-8
    words = words.view(pa.binary())
    size = pc.binary_length(words).to_numpy()
    end = np.cumsum(size, dtype=np.int64)
    # two bytes before and one behind: words may be empty
    every = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"")[0].as_py()
    data = np.frombuffer(b"\0\0" + every + b"\0", np.uint8)
    last, first = data[end + 1], data[end - size + 2]
    plain = _MARKS[last] & (size > 1) & _LETTERS[data[end]]
    for i in np.flatnonzero(_LAST[last] & ~plain):
        out[i, 0] = _ends(words[i].as_py())
    for i in np.flatnonzero(_FIRST[first]):
        out[i, 1] = _begins(words[i].as_py())
    return out


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces of the texts, how many of them each text holds, and their numbers text by text.

    Case of A to Z and marks at a piece's end are no part of a token: pieces that differ in them alone are one.
    """
    split = pc.ascii_split_whitespace(texts)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    coded = split.flatten().dictionary_encode()
    at, words = coded.indices.to_numpy(), coded.dictionary
    some = pc.binary_length(words).to_numpy()[at] > 0 if len(at) else np.zeros(0, bool)
    at, text = at[some], text[some]
    kinds = _kinds(words)[at]
    first = np.ones(len(at), bool)
    first[1:] = (text[1:] != text[:-1]) | ~_REACHES[kinds[:-1, 0], kinds[1:, 1]]
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(at))[: len(begin)]
    long = np.flatnonzero(end - begin > 1)
    sizes = end[long] - begin[long]
    offsets = np.append(0, np.cumsum(sizes))
    of = words.take(pa.array(at[np.repeat(begin[long] - offsets[:-1], sizes) + np.arange(offsets[-1])]))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), of), " ")
    at, text = at[begin].astype(np.int64), text[begin]
    at[long] = len(words) + np.arange(len(long))
    every = pc.ascii_rtrim(pc.ascii_lower(pa.concat_arrays([words, joined])), ",.;:!?").dictionary_encode()
    n = max(1, len(every.dictionary))
    held = np.sort(text * n + every.indices.to_numpy()[at])
    held = held[np.append(True, held[1:] != held[:-1])[: len(held)]]
    return every.dictionary, np.bincount(held // n, minlength=len(texts)), held % n


def cut(readings: DataFrame) -> DataFrame:
    """ids, sizes, at, lines: a row for some readings (id, raw) each. lines: the tokens of their distinct pieces, by spaces; at: numbers of each
    reading's pieces, `sizes` of them. Readings without id or text hold nothing and are left out."""
    readings.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(GROUP_BYTES))
    lists = lambda *xs: [pa.array([x], pa.list_(t)) for x, t in xs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, sizes, at = pieces(b.column(1))
            yield pa.RecordBatch.from_arrays(lists((b.column(0).to_numpy(), pa.int64()), (sizes, pa.int32()), (at, pa.int32()), (found, pa.string())), names=["ids", "sizes", "at", "pieces"])

    rows = readings.filter("id IS NOT NULL AND raw IS NOT NULL").select(F.col("id").cast("long").alias("id"), "raw")
    grouped = rows.mapInArrow(run, "ids array<long>, sizes array<int>, at array<int>, pieces array<string>")
    return grouped.select("ids", "sizes", "at", F.transform("pieces", lambda p: F.array_join(T.phrase_tokens(p), " ")).alias("lines"))
