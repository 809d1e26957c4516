"""Sequence alignment. One row of a table at a time as numpy arrays, over pairs that earlier stages chose."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import text as T

from . import layout


#: Rows that a task holds as Python objects at a time, and bytes of the batches they come in: a row is two whole token lists, its result a step for each token.
ROWS, BATCH_BYTES = 32, 4 << 20


def _mapped(rows: DataFrame, work, schema: str) -> DataFrame:
    """rows through work(slice), a pandas frame of at most ROWS rows: what a task holds does not grow with its share of the table."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), ROWS):
                yield work(b.iloc[i : i + ROWS].reset_index(drop=True))

    return rows.mapInPandas(run, schema)


def _coded(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    codes: dict = {}
    return tuple(np.array([codes.setdefault(x, len(codes)) for x in s], np.int64) for s in (a, b))


def _rows(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the edit table of x inside y, both ends of y free."""
    step = np.arange(len(y) + 1)
    row = np.zeros(len(y) + 1, np.int64)
    yield row
    for i, item in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (y != item), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - step) + step
        yield row


def distance_inside(reference: Sequence, hypothesis: Sequence) -> int:
    """Edits of reference against the closest stretch of hypothesis."""
    row = None
    for row in _rows(*_coded(reference, hypothesis)):
        pass
    return int(row.min())


def align_inside(reference: Sequence, hypothesis: Sequence) -> dict:
    """The same written out: distance, status of each item (same, other, missing), where it was read, and what was read before each."""
    x, y = _coded(reference, hypothesis)
    m = len(x)
    last = None
    for last in _rows(x, y):
        pass
    end = int(last.argmin())
    # a path of at most m edits spans at most 2 m items
    begin = max(0, end - 2 * m)
    table = np.stack(list(_rows(x, y[begin:end])))
    status, at, before = ["missing"] * m, [-1] * m, [[] for _ in range(m + 1)]
    i, j = m, end - begin
    while i:
        here = table[i, j]
        if j and here == table[i - 1, j - 1] + (x[i - 1] != y[begin + j - 1]):
            i, j = i - 1, j - 1
            status[i], at[i] = ("same" if x[i] == y[begin + j] else "other"), begin + j
        elif here == table[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
            before[i].insert(0, hypothesis[begin + j])
    return {"distance": int(last.min()), "status": status, "at": at, "inserted": before}


def closest(reference: Sequence, hypotheses: Sequence[Sequence]) -> dict:
    best, least = None, len(reference) + 1
    for h in hypotheses:
        if len(h) and (d := distance_inside(reference, h)) < least:
            best, least = h, d
            if not d:
                break
    if best is None:
        return {"distance": len(reference), "status": ["missing"] * len(reference), "at": [-1] * len(reference), "inserted": [[] for _ in range(len(reference) + 1)], "hypothesis": ()}
    return align_inside(reference, best) | {"hypothesis": best}


def affine(swap: np.ndarray, foreign: np.ndarray) -> list[tuple[str, int, int]]:
    """Best semi-global alignment with affine gaps of foreign tokens: (kind, target, token) steps, kind swap, missing or extra.

    swap[i, j] is -1 where token j reads target i, 0 where the two are related, 1 else; foreign[j] tells a token that
    continues an insertion cheaply. Start and end are free in the tokens; the leftmost best end wins.
    """
    m, n = swap.shape
    u = m + n + 2
    miss = open_ = 4 * u
    cost = np.where(swap < 0, -1, np.where(swap == 0, miss, miss + open_)).astype(np.int64)
    further = np.concatenate(([0], np.where(foreign, u, open_))).astype(np.int64)
    run = np.cumsum(further)
    far = np.int64(1) << 50
    kept, loose = [np.zeros(n + 1, np.int64)], [np.full(n + 1, far)]
    for i in range(1, m + 1):
        up = np.minimum(kept[-1], loose[-1])
        k = np.empty(n + 1, np.int64)
        k[0] = i * miss
        k[1:] = np.minimum(up[:-1] + cost[i - 1], up[1:] + miss)
        # an insertion opened after column j and gone on to column t costs open_ + run[t] - run[j + 1]
        best = np.minimum.accumulate(k[:-1] + open_ - run[1:])
        lo = np.full(n + 1, far)
        lo[1:] = best + run[1:]
        kept.append(k)
        loose.append(lo)
    j, i, out = int(kept[m].argmin()), m, []
    inside = False
    while i:
        if inside:
            out.append(("extra", i, j - 1))
            inside = loose[i][j] != kept[i][j - 1] + open_
            j -= 1
            continue
        value = kept[i][j]
        if j and value == kept[i - 1][j - 1] + cost[i - 1, j - 1]:
            out.append(("swap", i - 1, j - 1))
            i, j = i - 1, j - 1
        elif j and value == loose[i - 1][j - 1] + cost[i - 1, j - 1]:
            out.append(("swap", i - 1, j - 1))
            i, j, inside = i - 1, j - 1, True
        else:
            out.append(("missing", i - 1, -1))
            inside = not (value == kept[i - 1][j] + miss or i * miss == value and j == 0)
            i -= 1
    return out[::-1]


_FOLD = str.maketrans(*T.FOLD)


def _lookalike(a: str, b: str) -> bool:
    from concord.functions.fixed import CONFUSION

    return len(a) == len(b) and a != b and all(x == y or any(x in g and y in g for g in CONFUSION) for x, y in zip(a, b))


def _alike(a: str, b: str) -> bool:
    x, y = a.translate(_FOLD), b.translate(_FOLD)
    if x == y:
        return True
    if any(c.isdigit() for c in a + b):
        return False
    p = next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
    least = min(len(x), len(y))
    return (p >= 4 and least >= 4 and abs(len(x) - len(y)) <= 2 and p >= least - 2) or (len(x) == len(y) >= 6 and sum(c != d for c, d in zip(x, y)) <= 1)


def _digits(s: str) -> str:
    return "".join(filter(str.isdigit, s))


def _typed(expected: str, actual: str) -> str:
    """What reading actual for expected means: a look-alike or a number cut short is no sure difference."""
    da, db = _digits(expected), _digits(actual)
    cut = bool(da) and 0 < len(db) < len(da) and (da.startswith(db) or da.endswith(db))
    return "uncertain" if _lookalike(expected, actual) or cut else "replace"


def _foreign(target: Sequence[str], words: Sequence[str]) -> np.ndarray:
    """Words that have nothing of the target: no folded token, no digit where the target has one, no shared stem of four letters."""
    folded = {t.translate(_FOLD) for t in target}
    stems = {f[:4] for f in folded if len(f) >= 4}
    numeric = any(map(_digits, target))
    return np.array([w.translate(_FOLD) not in folded and not (numeric and _digits(w)) and w.translate(_FOLD)[:4] not in stems for w in words], bool)


def _keys(f: str) -> list:
    """What a folded word shares with any word alike: its stem, or one half of a word of its length."""
    half = len(f) // 2
    return [f, f[:4]] + ([(len(f), f[:half]), (-len(f), f[half:])] if len(f) >= 6 else [])


def _related(target: Sequence[str], words: Sequence[str]) -> np.ndarray:
    """-1 where word j is target i, 0 where the two may be one misread, 1 else. Only words that share a stem, a half or digits are compared."""
    swap = np.ones((len(target), len(words)), np.int8)
    near: dict = {}
    for i, t in enumerate(target):
        for k in {t, *_keys(t.translate(_FOLD))} | ({"digit"} if _digits(t) else set()):
            near.setdefault(k, set()).add(i)
    folded = "\n".join(words).translate(_FOLD).split("\n")
    for j, (w, f) in enumerate(zip(words, folded)):
        numeric = not w.isalpha() and _digits(w)
        if not (numeric or f[:4] in near or w in near or f in near or (len(f) >= 6 and ((len(f), f[: len(f) // 2]) in near or (-len(f), f[len(f) // 2 :]) in near))):
            continue
        some = set().union(*(near.get(k, ()) for k in [w, *_keys(f), *(["digit"] if numeric else [])]))
        for i in some:
            t = target[i]
            # a number may only be another number misread
            swap[i, j] = -1 if t == w else 0 if (numeric if _digits(t) else not numeric and _alike(t, w)) else 1
    return swap


def _step(kind: str, expected: str | None, actual: str | None, at: int | None) -> dict:
    return {"kind": kind, "expected": expected, "actual": actual, "anchored": False, "at": at}


def operations(target: Sequence[str], tokens: Sequence[str], confidence: Sequence[float] | None = None, boxes: np.ndarray | None = None, words: Sequence[int] | None = None) -> list[dict]:
    """same, replace, uncertain, missing and extra steps of the best alignment, settled.

    An extra reading of a word that is there goes, and so do extra words beside the phrase (boxes: start, end, top, bottom of each token as it
    reads, one row a token; words: the word each token is of). A missing word and an extra one in its place are one replacement.
    A weakly read number (below 75) reads nothing for sure. A missing word between two read neighbours is anchored. `at` is the token's place.
    """
    lost = [_step("missing", t, None, None) for t in target]
    if not len(target) or not len(tokens):
        return lost
    code: dict[str, int] = {}
    spots = np.array([code.setdefault(t, len(code)) for t in tokens])
    names = list(code)
    swap = _related(target, names)[:, spots]
    if confidence is not None:
        weak = np.array([not t.isalpha() and bool(_digits(t)) for t in names])[spots] & (np.asarray(confidence, float) < 75)
        swap[:, weak] = np.maximum(swap[:, weak], 0)
    # what lies further than the target's length from all related tokens is in no best alignment
    some = np.flatnonzero((swap <= 0).any(0))
    if not len(some):
        return lost
    lo, hi = max(0, int(some[0]) - len(target)), min(len(tokens), int(some[-1]) + 1 + len(target))
    foreign = _foreign(target, tokens[lo:hi])
    out = []
    for kind, i, j in affine(swap[:, lo:hi], foreign):
        if kind == "swap":
            j += lo
            a, b = target[i], str(tokens[j])
            same = swap[i, j] < 0
            out.append(_step("same" if same else "uncertain" if a == b else _typed(a, b), a, b, j))
        elif kind == "missing":
            out.append(_step("missing", target[i], None, None))
        else:
            out.append(_step("extra", None, str(tokens[j + lo]), j + lo))
    if boxes is not None:
        out = _in_flow(_read_once(out, boxes), boxes, None if confidence is None else np.asarray(confidence, float))
    out = _paired(out)
    for k, op in enumerate(out):
        if op["kind"] == "missing":
            left = next((o for o in out[k - 1 :: -1] if o["kind"] != "missing"), None) if k else None
            right = next((o for o in out[k + 1 :] if o["kind"] != "missing"), None)
            op["anchored"] = bool(left and right and left["kind"] == right["kind"] == "same")
            if op["anchored"]:
                op["between"] = (left["at"], right["at"])
    return out


def _read_once(ops: list[dict], boxes: np.ndarray) -> list[dict]:
    """Without extra words that repeat the equal step beside them over the same print."""
    keep = []
    for k, o in enumerate(ops):
        twin = False
        if o["kind"] == "extra":
            for p in (ops[i] for i in (k - 1, k + 1) if 0 <= i < len(ops)):
                a, b = boxes[o["at"]], boxes[p["at"]] if p["at"] is not None else boxes[o["at"]]
                twin |= p["kind"] == "same" and p["expected"] == o["actual"] and min(a[1], b[1]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[2], b[2])
        if not twin:
            keep.append(o)
    return keep


def _in_flow(ops: list[dict], boxes: np.ndarray, confidence: np.ndarray | None) -> list[dict]:
    """Without runs of extra words beside the phrase: fewer than half of a run's words follow its left neighbour on the line, lead up to its
    right one, or stand on lines between the two inside the phrase's area; or the run, surely read, stands apart from the column's edge."""
    read = [o["at"] for o in ops if o["kind"] == "same"]
    if not read:
        return ops
    own = boxes[read]
    from_, to = own[:, 0].min(), own[:, 1].max()
    slack = 0.5 * float(np.sort(np.minimum(own[:, 1] - own[:, 0], own[:, 3] - own[:, 2]))[len(own) // 2])
    area = (from_ - slack, to + slack, own[:, 2].min() - slack, own[:, 3].max() + slack)
    level = lambda p, q: min(p[3], q[3]) - max(p[2], q[2]) >= 0.4 * min(p[3] - p[2], q[3] - q[2])

    def chain(run: np.ndarray, anchor, ahead: bool) -> int:
        """Words that follow one another from the neighbour on, at word spacing."""
        n, last = 0, anchor
        for w in run[np.argsort(run[:, 0] if ahead else -run[:, 0], kind="stable")]:
            gap = w[0] - last[1] if ahead else last[0] - w[1]
            if not level(w, last) or gap > 3 * (last[3] - last[2]) or gap < -(w[1] - w[0]):
                break
            last, n = w, n + 1
        return n

    def flows(w, p, q) -> bool:
        middle = (w[0] + w[1]) / 2, (w[2] + w[3]) / 2
        if not (area[0] <= middle[0] <= area[1] and area[2] <= middle[1] <= area[3]):
            return False
        if p is not None and level(w, p) and w[0] >= p[0]:
            return q is None or not level(w, q) or w[1] <= q[1]
        if q is not None and level(w, q) and w[1] <= q[1]:
            return True
        return p is not None and q is not None and w[2] >= p[2] and w[3] <= q[3] and not level(p, q)

    def apart(at: list[int], run: np.ndarray, p, q) -> bool:
        if confidence is not None and (confidence[at] < 75).any():
            return False
        after = p is not None and all(level(w, p) for w in run) and (q is None or not level(q, p))
        if after and run[:, 0].min() > to + 0.5 * (p[3] - p[2]) and run[:, 0].min() - p[1] > 1.2 * (p[3] - p[2]):
            return True
        before = q is not None and all(level(w, q) for w in run) and (p is None or not level(p, q))
        return bool(before and run[:, 1].max() < from_ - 0.5 * (q[3] - q[2]) and q[0] - run[:, 1].max() > 1.2 * (q[3] - q[2]))

    out, k = [], 0
    while k < len(ops):
        end = k
        while end < len(ops) and ops[end]["kind"] == "extra":
            end += 1
        if end > k:
            at = [o["at"] for o in ops[k:end]]
            run = boxes[at]
            p = next((boxes[o["at"]] for o in ops[k - 1 :: -1] if o["kind"] == "same"), None) if k else None
            q = next((boxes[o["at"]] for o in ops[end:] if o["kind"] == "same"), None)
            inside = max(chain(run, p, True) if p is not None else 0, chain(run, q, False) if q is not None else 0, sum(flows(w, p, q) for w in run))
            if inside >= 0.5 * len(run) and not apart(at, run, p, q):
                out += ops[k:end]
            k = end
        if k < len(ops):
            out.append(ops[k])
            k += 1
    return out


def _paired(ops: list[dict]) -> list[dict]:
    """Of a run of missing and extra steps as many as possible become replacements: the first missing with the first extra, and so on."""
    out, k = [], 0
    while k < len(ops):
        end = k
        while end < len(ops) and ops[end]["kind"] in ("missing", "extra"):
            end += 1
        run = ops[k:end]
        added = [o for o in run if o["kind"] == "extra"]
        n = min(len(added), len(run) - len(added))
        gone, used = 0, 0
        for o in run:
            if o["kind"] == "missing" and gone < n:
                read = added[gone]
                out.append(_step(_typed(o["expected"], read["actual"]), o["expected"], read["actual"], read["at"]))
                gone += 1
            elif o["kind"] == "extra" and used < n:
                used += 1
            else:
                out.append(o)
        if end < len(ops):
            out.append(ops[end])
        k = end + 1
    return out


def differences(ops: Sequence[dict], confidence: Sequence[float] | None = None) -> list[dict]:
    """Steps that differ, neighbours of one kind made one; a pair or a split of the same shapes (look-alikes folded, spaces left out) is uncertain.

    Each has kind, expected, actual, confidence (the highest of its words, 0 if uncertain), anchored, and the steps `first` to `last` it covers.
    """
    sure = lambda o: float(confidence[o["at"]]) if confidence is not None and o["at"] is not None and o["kind"] in ("replace", "extra") else 0.0
    out: list[dict] = []
    for k, o in enumerate(ops):
        if o["kind"] == "same":
            continue
        last = out[-1] if out else None
        if last and last["kind"] == o["kind"] and last["anchored"] == o["anchored"] and last["last"] == k - 1:
            for c in ("expected", "actual"):
                last[c] = " ".join(x for x in (last[c], o[c]) if x) or None
            last.update(last=k, confidence=max(last["confidence"], sure(o)))
        else:
            out.append({c: o[c] for c in ("kind", "expected", "actual", "anchored")} | {"confidence": sure(o), "first": k, "last": k})
    shape = lambda *texts: "".join(t or "" for t in texts).replace(" ", "").translate(_FOLD)
    settled: list[dict] = []
    for d in out:
        last = settled[-1] if settled else None
        both = last and all(x["kind"] in ("missing", "replace", "uncertain") for x in (last, d)) and (last["actual"] or d["actual"])
        if both and not last.get("whole") and shape(last["expected"], d["expected"]) == shape(last["actual"], d["actual"]):
            last.update(kind="uncertain", confidence=0.0, anchored=False, last=d["last"], whole=True, **{c: " ".join(x for x in (last[c], d[c]) if x) or None for c in ("expected", "actual")})
            continue
        if d["kind"] == "replace" and shape(d["expected"]) == shape(d["actual"]):
            d.update(kind="uncertain", confidence=0.0, whole=True)
        settled.append(d)
    for d in settled:
        d.pop("whole", None)
    return settled


def quality(target: Sequence[str], ops: Sequence[dict]) -> float:
    """1 less the weighed share of steps that are not same: words foreign to the target that go on with an insertion weigh a quarter."""
    weighed, last = 0.0, None
    for o in ops:
        if o["kind"] != "same":
            weighed += 0.25 if o["kind"] == last == "extra" and _foreign(target, [o["actual"]])[0] else 1
        last = o["kind"]
    return 1 - weighed / max(1, len(target))


_OPS = "array<struct<kind:string,expected:string,actual:string,anchored:boolean,at:int>>"
_DIFF = "array<struct<kind:string,expected:string,actual:string,confidence:double,anchored:boolean,before:int,after:int,at:int,first:int,last:int>>"


def aligned(pairs: DataFrame, keys: Sequence[str], target: str, tokens: str, confidences: str | None = None, spans: str | None = None) -> DataFrame:
    """keys, coverage (per cent of target tokens read), n_same, quality, ops and diff of each pair's best alignment.

    confidences: one of each token. spans: start, end, top and bottom of each token as it reads, one after the other; with them words read twice
    or standing beside the phrase are no differences. In diff, `before` and `after` are the read tokens round an anchored gap, `at` the first token read there, `first` to `last`
    the steps of ops that the difference covers.
    """
    kept = [pairs.schema[k] for k in keys]
    more = [c for c in (confidences, spans) if c]

    def one(x, y, c, b) -> dict:
        x, y = list(x), list(y)
        box = np.asarray(b, float).reshape(-1, 4) if b is not None and y and len(b) == 4 * len(y) else None
        # spaces that the reading lost or added are undone first
        made = layout.respaced_from(x, y)
        if len(made) != len(y) or any(i != j for _, i, j in made):
            c = None if c is None else [float(np.min(c[i : j + 1])) for _, i, j in made]
            box = None if box is None else np.array([(box[i : j + 1, 0].min(), box[i : j + 1, 1].max(), box[i : j + 1, 2].min(), box[i : j + 1, 3].max()) for _, i, j in made])
        ops = operations(x, [t for t, _, _ in made], c, box)
        at = lambda i, end=False: None if i is None else made[i][2 if end else 1]
        same = sum(o["kind"] == "same" for o in ops)
        diff = []
        for d in differences(ops, c):
            gap = ops[d["first"]].get("between") or (None, None)
            diff.append({k: d[k] for k in ("kind", "expected", "actual", "confidence", "anchored")} | {"before": at(gap[0], True), "after": at(gap[1]), "at": at(ops[d["first"]]["at"]), "first": d["first"], "last": d["last"]})
        return {"coverage": int(100 * same / max(1, len(x)) + 0.5), "n_same": same, "quality": quality(x, ops), "ops": [{k: o[k] for k in ("kind", "expected", "actual", "anchored")} | {"at": at(o["at"])} for o in ops], "diff": diff}

    def work(b: pd.DataFrame) -> pd.DataFrame:
        none = [None] * len(b)
        rows = [one(*r) for r in zip(b[target], b[tokens], b[confidences] if confidences else none, b[spans] if spans else none)]
        return b[list(keys)].assign(**{c: pd.Series([r[c] for r in rows], dtype=t) for c, t in (("coverage", "int32"), ("n_same", "int32"), ("quality", "float64"), ("ops", object), ("diff", object))})

    return _mapped(pairs.select(*keys, target, tokens, *more), work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + f", coverage int, n_same int, quality double, ops {_OPS}, diff {_DIFF}")


def similarities(pairs: DataFrame, keys: Sequence[str], needle: str, hay: str) -> DataFrame:
    """keys, distance and similarity (1 - distance / length) of each needle inside its hay; both are arrays."""
    kept = [pairs.schema[k] for k in keys]

    def work(b: pd.DataFrame) -> pd.DataFrame:
        d = np.array([distance_inside(x, y) if len(x) else 0 for x, y in zip(b[needle], b[hay])], np.int64)
        n = np.array([len(x) for x in b[needle]])
        return b[list(keys)].assign(distance=d, similarity=np.where(n > 0, 1 - d / np.maximum(n, 1), 0.0))

    return _mapped(pairs.select(*keys, needle, hay), work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", distance long, similarity double")


_MARKS = frozenset(".,:;()%/+-°\"!?")
SCORES = ("characters", "character_errors", "words", "word_errors", "numbers", "number_errors", "marks", "mark_errors", "letters", "letter_errors", "tokens", "token_errors", "number_tokens", "number_token_errors", "missed")


def score_line(line: str, hypotheses: Sequence[str], letters: str, letter_hypotheses: Sequence[str], tokens: Sequence[str] = (), token_hypotheses: Sequence[Sequence[str]] = ()) -> dict:
    """Error counts of one true line against all readings: characters, words, numbers, marks, letters, the tokens that texts are compared by and
    those with a digit; missed is 1 where no character was read. Texts come in strict form, tokens taken apart."""
    by_char = closest(list(line), [list(h) for h in hypotheses])
    by_word = closest(line.split(" "), [h.split(" ") for h in hypotheses])
    by_letter = closest(list(letters), [list(h) for h in letter_hypotheses])
    numbers = wrong = at = 0
    for token in line.split(" "):
        start, end = at, at + len(token)
        at = end + 1
        if not any(c.isdigit() for c in token):
            continue
        while start < end and line[start] in '"(':
            start += 1
        while end > start and line[end - 1] in '").,;:]':
            end -= 1
        if start == end:
            continue
        numbers += 1
        hyp, pos = by_char["hypothesis"], by_char["at"]
        good = all(by_char["status"][i] == "same" and not (i > start and by_char["inserted"][i]) for i in range(start, end))
        beside = lambda k: 0 <= k < len(hyp) and str(hyp[k]).isdigit()
        wrong += not good or beside(pos[start] - 1) or beside(pos[end - 1] + 1)
    marks = [i for i, c in enumerate(line) if c in _MARKS]
    by_token = closest(list(tokens), [list(h) for h in token_hypotheses])
    numeric = [i for i, t in enumerate(tokens) if _digits(t)]
    more = (len(tokens), by_token["distance"], len(numeric), sum(by_token["status"][i] != "same" for i in numeric), int(all(x == "missing" for x in by_char["status"])))
    return dict(zip(SCORES, (*(len(line), by_char["distance"], len(line.split(" ")), by_word["distance"], numbers, wrong, len(marks), sum(by_char["status"][i] != "same" for i in marks), len(letters), by_letter["distance"]), *more)))


def score_lines(lines: DataFrame, keys: Sequence[str], text: str, readings: str) -> DataFrame:
    """keys and the counts of SCORES for each true line; readings is an array of texts."""
    kept = [lines.schema[k] for k in keys]
    # few rows of much work: dealt over all cores, however small what groups them is
    lines = lines.repartition(lines.sparkSession.sparkContext.defaultParallelism, *keys)
    rows = lines.select(*keys, T.strict(F.col(text)).alias("_t"), F.transform(readings, T.strict).alias("_h"), T.letters(F.col(text)).alias("_l"), F.transform(readings, T.letters).alias("_g"), T.phrase_tokens(F.col(text)).alias("_k"), F.transform(readings, T.phrase_tokens).alias("_n"))

    def work(b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([score_line(*x) for x in zip(b["_t"], b["_h"], b["_l"], b["_g"], b["_k"], b["_n"])], columns=list(SCORES))
        return pd.concat([b[list(keys)], out.astype("int64")], axis=1)

    return _mapped(rows, work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + "".join(f", {s} long" for s in SCORES))


def totals(scores: DataFrame, tags: str) -> DataFrame:
    """Sums over all lines and for each tag (grouping sets): tag null is the total; each line counts once in it."""
    sums = [F.sum(c).alias(c) for c in SCORES]
    every = scores.agg(*sums, F.count("*").alias("lines")).select(F.lit(None).cast("string").alias("tag"), "*")
    by = scores.select("*", F.explode(tags).alias("tag")).groupBy("tag").agg(*sums, F.count("*").alias("lines"))
    return every.unionByName(by)


def rate(errors, total):
    """One decimal per cent, null of nothing."""
    return F.when(total > 0, F.floor(errors / total * 1000 + 0.5) / 10)
