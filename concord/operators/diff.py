"""What two token sequences have in common, token by token."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_MARKS = pa.list_(pa.bool_())


def _above(below: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequence from one more left token on, by the right token they begin at."""
    row = np.append(np.where(equal, below[1:] + 1, below[:-1]), 0)
    return np.maximum.accumulate(row[::-1])[::-1]


def common(left: Sequence[str], right: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of either side belong to a longest common subsequence.

    Of several the one found from the front: equal tokens pair at once, else the left token goes first if that loses nothing. Every
    so many rows of lengths are kept, as many as lie between two kept ones, and those between are made again on the way: memory
    is the right side's length times the root of the left's.
    """
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(t, len(number)) for t in side], np.int64) for side in (left, right))
    n, m = len(a), len(b)
    one, two = np.zeros(n, bool), np.zeros(m, bool)
    step = isqrt(n) + 1
    row, kept = np.zeros(m + 1, np.int32), {}
    for i in range(n, -1, -1):
        if i < n:
            row = _above(row, a[i] == b)
        if i % step == 0 or i == n:
            kept[i] = row
    i = j = 0
    while i < n and j < m:
        if i % step == 0:  # rows i .. i + step
            end = min(i + step, n)
            rows = [kept[end]]
            for k in range(end - 1, i - 1, -1):
                rows.append(_above(rows[-1], a[k] == b))
            rows.reverse()
            base = i
        while i < min(base + step, n) and j < m:
            if a[i] == b[j]:
                one[i] = two[j] = True
                i, j = i + 1, j + 1
            elif rows[i - base + 1][j] >= rows[i - base][j + 1]:
                i += 1
            else:
                j += 1
    return one, two


def marks(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with left_same and right_same, a flag for each token of the array columns, and different: some token has no partner.

    A null array counts as empty.
    """
    names = pairs.columns
    i, j = names.index(left), names.index(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                b = batch.slice(at, 1)
                one, two = common(*(b.column(k).to_pylist()[0] or [] for k in (i, j)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one], _MARKS), pa.array([two], _MARKS), pa.array([not (one.all() and two.all())])], names=[*names, "left_same", "right_same", "different"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, schema + ", left_same array<boolean>, right_same array<boolean>, different boolean")
