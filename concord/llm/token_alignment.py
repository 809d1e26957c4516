"""Cross-tokenizer alignment: which tokens of two vocabularies end together in a corpus.

1. Each text, with one space before it, is encoded by a byte-level BPE (A) and a piece model (B, which adds the space
   itself). If the tokens' bytes, joined, are not the text's, it has no alignment.
2. Packed bitsets mark the bytes where tokens end; their AND is the shared cuts. Popcounts, summed word by
   word, give each cut's rank among the ends of A and of B: the tokens of its group. Every cut links the
   two tokens that end there.
3. Links are counted by id pair: in each task first, then over the corpus. Where two tokens end together one's
   bytes are a suffix of the other's, so a vocabulary of given lengths bounds the pairs whatever the corpus (see pair_bound):
   the counts are broadcast, never the links.
4. Each document looks its pairs up.

Work is by row but for the counts; no key is ever hot. A long text is cut where neither vocabulary can join the two sides (a space between
letters) and encoded in pieces of CHUNK characters, so a task holds one piece's tokens as objects.

Defined cases: see align; an empty table gives an empty result, repeated rows are counted each,
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import plain, settle

#: Characters of a text that are encoded at a time.
CHUNK = 1 << 16
#: A space between letters: the splitting pattern of A begins a word there, and no piece of B goes on behind it.
_SEAM = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: Distinct pairs that a task counts before it merges them.
MERGE = 1 << 20
#: The splitting pattern of the byte-level format: each match is encoded by itself.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct matches of up to LONG characters whose ids a worker remembers; beyond REMEMBERED they are forgotten, results stay the same.
REMEMBERED, LONG = 320_000, 64


class Vocabulary:
    """Bytes of each id, one after the other, and an encoder of lists of texts into id arrays."""

    def __init__(self, tokens: list[bytes], encode, seams: bool, matches: Matches | None = None):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.tokens, self.encode, self.seams, self.matches = tokens, encode, seams, matches
        digits = len(str(max(1, len(tokens) - 1)))
        places = np.arange(len(tokens))[:, None] // 10 ** np.arange(digits - 1, -1, -1)
        self.digits = (places % 10 + 48).astype(np.uint8)
        self.shown = places > 0
        self.shown[:, -1] = True

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[A.ranges(self.first[ids], self.size[ids])]


class Matches:
    """Ids of texts by a byte-level model, each distinct match of the splitting pattern encoded once.

    The pattern's classes depend on the Unicode tables of whoever splits: a text with a character that the model's own splitter
    takes for another class goes through the model whole.
    """

    def __init__(self, model, shown: dict[int, str]):
        self.model, self.split, self.shown = model, regex.compile(_SPLIT).findall, str.maketrans(shown)
        self.memory: dict[str, bytes] = {}
        self.agreed, self.other = set(map(chr, range(32, 127))), set()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _match(self, m: str) -> bytes:
        return array("I", [t.id for t in self.model.model.tokenize(m.encode().decode("latin-1").translate(self.shown))]).tobytes()

    def _agrees(self, c: str) -> bool:
        own = self.model.pre_tokenizer.pre_tokenize_str
        return all([s[i:j] for _, (i, j) in own(s)] == self.split(s) for s in (f"x{c}x", f"1{c}1", f"!{c}!", f"x {c} x"))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        new = set().union(*texts).difference(self.agreed, self.other)
        self.other.update(c for c in new if not self._agrees(c))
        self.agreed |= new - self.other
        whole = [i for i, t in enumerate(texts) if self.other and not self.other.isdisjoint(t)]
        out = dict(zip(whole, self._whole([texts[i] for i in whole])))
        split = {i: self.split(t) for i, t in enumerate(texts) if i not in out}
        every = set().union(*split.values())
        if len(self.memory) + len(every) > REMEMBERED:
            self.memory.clear()
        fresh = every.difference(self.memory)
        self.memory.update((m, self._match(m)) for m in fresh)
        out.update((i, b"".join(map(self.memory.__getitem__, s))) for i, s in split.items())
        for m in fresh:
            if len(m) > LONG:
                del self.memory[m]
        return [np.frombuffer(out[i], np.uint32).astype(np.int64) for i in range(len(texts))]


@functools.lru_cache(2)
def byte_level(path: str) -> Vocabulary:
    """The vocabulary of a byte-level BPE in the `tokenizers` format. Special tokens' strings in a text are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    # the format writes each byte as one character: visible ones of Latin-1 as they are, the others from 256 on, in order
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    tokens = [b""] * model.get_vocab_size(with_added_tokens=True)
    for t, i in model.get_vocab(with_added_tokens=True).items():
        tokens[i] = bytes(map(byte.__getitem__, t))
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    plain_split = own["normalizer"] is None and own["pre_tokenizer"]["type"] == "ByteLevel" and own["pre_tokenizer"]["use_regex"]

    alone = plain_split and not own["pre_tokenizer"]["add_prefix_space"] and own["model"]["dropout"] is None and all(t["special"] for t in own["added_tokens"])
    matches = Matches(model, {b: c for c, b in byte.items()}) if alone else None

    def encode(texts: list[str]) -> list[np.ndarray]:
        spaced = [" " + t for t in texts]
        if matches:
            return matches.encode(spaced)
        return [np.array(e.ids, np.int64) for e in model.encode_batch_fast(spaced, add_special_tokens=False)]

    return Vocabulary(tokens, encode, plain_split, matches)


@functools.lru_cache(2)
def pieces(path: str) -> Vocabulary:
    """The vocabulary of a `sentencepiece` model that puts a space, written U+2581, before each text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)]

    return Vocabulary(tokens, encode, not any(" " in t.lstrip(b" ").decode("utf-8", "replace") for t in tokens))


def chunks(text: str, size: int) -> list[str]:
    """The text in pieces of about `size` characters, cut at seams; the seam's space is left out, as encoders put it back."""
    out, at = [], 0
    while len(text) - at > size and (m := _SEAM.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def encode(v: Vocabulary, texts: list[list[str]]) -> list[np.ndarray]:
    """Ids of each text, given in chunks."""
    every = v.encode(list(chain.from_iterable(texts)))
    out, at = [], 0
    for t in texts:
        out.append(np.concatenate(every[at : at + len(t)]))
        at += len(t)
    return out


class Bits:
    """A bitset over n places: AND, popcount rank, select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def of(cls, places: np.ndarray, n: int) -> Bits:
        flags = np.zeros((n + 63) // 64 * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def select(self) -> np.ndarray:
        """All set places, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set places up to and with each given one."""
        word, bit = places >> 6, (places & 63).astype(A.U)
        upto = self.words[word] << (A.U(63) - bit)
        return self.before[word] + np.bitwise_count(upto)


def cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two lists of token ends (bytes, rising) over the same bytes: shared ends, and the tokens of each list up to them."""
    n = int(a[-1]) if len(a) else 0
    one, two = Bits.of(a - 1, n), Bits.of(b - 1, n)
    at = (one & two).select()
    return at + 1, one.rank(at), two.rank(at)


def _written(va: Vocabulary, vb: Vocabulary, a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all groups, `a1,a2|b1;a3|b2,b3`, and where each group ends; behind a document's last group nothing stands."""
    width = max(va.digits.shape[1], vb.digits.shape[1])
    na, nb = np.diff(ra, prepend=0), np.diff(rb, prepend=0)
    text, shown = np.zeros((2, len(a) + len(b), width + 1), np.uint8)
    # a group's tokens of A stand behind the tokens of B of the groups before it, those of B behind A's with its own
    for v, ids, place, rank, mark in ((va, a, np.arange(len(a)) + np.repeat(rb - nb, na), ra + rb - nb, b"|"), (vb, b, np.arange(len(b)) + np.repeat(ra, nb), ra + rb, b";")):
        text[place, width - v.digits.shape[1] : width] = v.digits[ids]
        shown[place, width - v.shown.shape[1] : width] = v.shown[ids]
        text[place, width], shown[place, width] = ord(","), 1
        text[rank - 1, width] = ord(mark)
    shown[(ra + rb)[last] - 1, width] = 0
    per = np.cumsum(shown.sum(1, dtype=np.int64))
    return text[shown.astype(bool)], per[ra + rb - 1]


def _align(a_path: str, b_path: str, chunk: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = byte_level(a_path), pieces(b_path)
        base = np.int64(len(va.tokens))
        for s in A.pieces(batches):
            texts = s.column(1).to_pylist()
            n_rows = len(texts)
            rows = [i for i, t in enumerate(texts) if t]
            parts = [chunks(texts[i], chunk) if va.seams and vb.seams else [texts[i]] for i in rows]
            both = []
            for v in (va, vb):
                ids = encode(v, parts) if rows else []
                raw = v.joined(np.concatenate(ids)) if rows else np.zeros(0, np.uint8)
                end = np.cumsum([int(v.size[x].sum()) for x in ids]).tolist()
                both.append((ids, [raw[i:j].tobytes() for i, j in zip([0, *end], end)]))
            whole = [k for k, i in enumerate(rows) if both[0][1][k] == both[1][1][k] == b" " + texts[i].encode()]
            n_a, n_b, n_groups = np.zeros((3, n_rows), np.int64)
            groups, codes, times, per = [""] * n_rows, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_rows, np.int64)
            if whole:
                at = np.array([rows[k] for k in whole])
                a, b = (np.concatenate([ids[k] for k in whole]) for ids, _ in both)
                n_a[at], n_b[at] = ([len(ids[k]) for k in whole] for ids, _ in both)
                ends, ra, rb = cuts(np.cumsum(va.size[a]), np.cumsum(vb.size[b]))
                doc = np.searchsorted(np.cumsum([len(both[0][1][k]) for k in whole]), ends)  # a text's end is always shared
                last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
                n_groups[at] = np.diff(last, prepend=-1)
                flat, end = _written(va, vb, a, b, ra, rb, last)
                end = end[last].tolist()
                for i, x, y in zip(at.tolist(), [0, *end], end):
                    groups[i] = hashlib.sha256(flat[x:y]).hexdigest() if digest else flat[x:y].tobytes().decode()
                pair = b[rb - 1] * base + a[ra - 1]
                key, times = np.unique(at[doc] * (base * len(vb.tokens)) + pair, return_counts=True)
                owner, codes = np.divmod(key, base * len(vb.tokens))
                per = np.bincount(owner, minlength=n_rows)
            yield pa.RecordBatch.from_arrays(
                [s.column(0), *map(pa.array, (n_a, n_b, n_groups, n_groups)), pa.array(groups, pa.string()), A.lists(codes, per, pa.int64()), A.lists(times, per, pa.int32())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
            )

    return run


def align(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, and the distinct id pairs linked in the row with how often (pairs, times).

    groups: `a1,a2|b1;a3|b2,b3`, ids in order, one group for each stretch between shared cuts; with digest its
    SHA-256. pairs holds b * (ids of A) + a. A text that is null, empty or not what its tokens' bytes say has no tokens:
    zeros, groups empty (never digested). As no token is empty, one token of each side ends at a cut: a link for each group.
    """
    return plain(docs).mapInArrow(_align(a_path, b_path, chunk, digest), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")


def pair_bound(a_path: str, b_path: str) -> int:
    """How many id pairs any corpus can link: the bytes of one are a suffix of the other's."""
    a, b = byte_level(a_path).tokens, pieces(b_path).tokens
    in_a, in_b = Counter(a), Counter(b)
    return sum(in_b[t[i:]] for t in a for i in range(len(t))) + sum(in_a[t[i:]] for t in b for i in range(1, len(t)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, at, np.concatenate([p[1] for p in parts]))
    return key, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for b in batches:
        held.append((np.asarray(b.column(0).flatten()), np.asarray(b.column(1).flatten()).astype(np.int64)))
        size += len(held[-1][0])
        if size > MERGE:
            held, size = [_merged(held)], 0
    pair, n = _merged(held)
    for i in range(0, len(pair), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], names=["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair and n: links of the corpus by id pair, at most pair_bound rows."""
    return aligned.select("pairs", "times").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def score(aligned: DataFrame, counts: DataFrame, a_path: str) -> DataFrame:
    """aligned with n_best (links whose pair is as frequent as any of its B id) and count_sum (the counts of its links, added)."""
    table = counts.orderBy("pair").toArrow()  # bounded by the vocabularies, see pair_bound
    pair, n = (np.asarray(table.column(c).combine_chunks()) for c in ("pair", "n"))
    b = pair // len(byte_level(a_path).tokens)
    head = np.flatnonzero(np.append(True, b[1:] != b[:-1])[: len(b)])
    top = np.repeat(np.maximum.reduceat(n, head), np.diff(np.append(head, len(b)))) if len(b) else n
    shared = aligned.sparkSession.sparkContext.broadcast((pair, n, n == top))
    names = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for x in batches:
            at = {c: x.schema.get_field_index(c) for c in x.schema.names}
            lists, times = x.column(at["pairs"]), np.asarray(x.column(at["times"]).flatten()).astype(np.int64)
            k = np.searchsorted(pair, np.asarray(lists.flatten()))
            off = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
            sums = (np.diff(np.concatenate(([0], np.cumsum(v)))[off]) for v in (times * best[k], times * n[k]))
            yield pa.RecordBatch.from_arrays([*(x.column(at[c]) for c in names), *map(pa.array, sums)], names=[*names, "n_best", "count_sum"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in names)
    return aligned.mapInArrow(run, schema + ", n_best long, count_sum long")


def alignment(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, digest: bool = False) -> DataFrame:
    """align's columns with n_best and count_sum by the counts of all rows, without the pair lists."""
    # encoding is by far the dearest step: done once, read twice
    aligned = settle(align(docs, a_path, b_path, chunk, digest), "alignment")
    return score(aligned, pair_counts(aligned), a_path)
