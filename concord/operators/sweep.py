"""Lines, fragments and columns of print from word boxes, by sweeps down the page.

A sweep reads rows in page order and needs what is still open alone: the twelve newest lines, or the columns whose last
piece is near. So a task streams its pages and holds that, not a page. `printed` makes lines, pieces and columns in one sweep, so
that words are sorted once; `lines`, `fragments` and `pieces` are the same in steps, with windows and groupings between.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

#: Fixed values of the method: newest lines that a word may join; least common height; greatest ratio of heights; a gap
#: that ends a fragment, in heights; how far below a piece goes on, in heights; what counts as aligned: common width, or starts in heights.
OPEN, COMMON, RATIO, GAP, BELOW, ABOVE, WIDTH, START = 12, 0.45, 3.5, 3.5, 2.2, 0.2, 0.25, 1.4


def _listed(c: pa.Array) -> list:
    """to_pylist, in a tenth of its time for numbers and texts."""
    plain = pa.types.is_string(c.type) or (not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type)))
    return c.to_numpy(zero_copy_only=False).tolist() if plain else c.to_pylist()


def swept(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], state: Callable, name: str) -> DataFrame:
    """df with the long column `name`: what state(), made anew for each value of keys, gives for each row's fields in the given order."""
    schema = StructType([*df.schema.fields]).add(name, LongType())
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, object()
        for b in batches:
            of = lambda cols: zip(*(_listed(b.column(names.index(c))) for c in cols))
            out = np.empty(b.num_rows, np.int64)
            for i, (key, row) in enumerate(zip(of(keys), of(fields))):
                if key != at:
                    now, at = state(), key
                out[i] = now.place(*row)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*names, name])

    return rows.mapInArrow(run, schema)


class Lines:
    """A word joins the open line it shares most height with, one of a named line that line; else it begins one."""

    def __init__(self):
        self.open: deque[list[float]] = deque(maxlen=OPEN)
        self.named: dict = {}
        self.n = 0

    def place(self, y: float, h: float, name=None) -> int:
        best, most = None, COMMON
        low = y + h
        if name is not None:
            best = self.named.get(name)
        else:
            for line in self.open:
                top, bottom = line[0], line[1]
                common = min(low, bottom) - max(y, top)
                if common <= 0:
                    continue
                small, large = sorted((h, bottom - top))
                if common > most * small and large < RATIO * small:
                    best, most = line, common / small
        if best is None:
            best = [y, low, self.n]
            self.n += 1
            self.open.append(best)
            if name is not None:
                self.named[name] = best
        else:
            best[0], best[1] = min(best[0], y), max(best[1], low)
        return int(best[2])


class Columns:
    """A piece goes on below the nearest column it is aligned with; else it begins one."""

    def __init__(self):
        self.tails: list[tuple] = []
        self.n = 0

    def place(self, x: float, y: float, w: float, h: float, height: float) -> int:
        # a piece is at most RATIO heights of the one above: what lies further up can never be gone on with
        self.tails = [t for t in self.tails if y - t[1] <= BELOW * RATIO * t[3]]
        best, least = None, float("inf")
        for i, (x0, bottom, w0, height0, _) in enumerate(self.tails):
            small, large = sorted((height0, height))
            gap, shift = y - bottom, abs(x - x0)
            if gap < -ABOVE * small or gap > BELOW * large or large > RATIO * small:
                continue
            common = min(x + w, x0 + w0) - max(x, x0)
            if not (common > WIDTH * min(w, w0) or shift < START * large):
                continue
            distance = max(0.0, gap) / large + shift / (8 * large)
            if distance < least:
                best, least = i, distance
        if best is None:
            number, best = self.n, len(self.tails)
            self.n += 1
            self.tails.append(None)
        else:
            number = self.tails[best][4]
        self.tails[best] = (x, y + h, w, height, number)
        return number


def lines(words: DataFrame, keys: Sequence[str], order: str = "word_ix", name: str | None = None) -> DataFrame:
    """words (box x, y, w, h) with line_no, from 0 down each page; name: a column that names the line of some words."""
    rows = words.withColumns({"_y": F.col("box.y"), "_x": F.col("box.x"), "_h": F.col("box.h")})
    fields = ["_y", "_h", *([name] if name else [])]
    return swept(rows, keys, ["_y", "_x", order], fields, Lines, "line_no").drop("_y", "_x", "_h")


def _middle(value: Column, by: Sequence[str | Column]) -> Column:
    """The upper median of each group, 1 for 0."""
    w = W.partitionBy(*by)
    at = F.row_number().over(w.orderBy(value)) == F.floor(F.count(F.lit(1)).over(w) / 2) + 1
    return F.struct(at.alias("at"), value.alias("v"))


def fragments(lined: DataFrame, keys: Sequence[str], order: str = "word_ix") -> DataFrame:
    """lined words with height (the upper median of their line's heights) and fragment: a gap of over GAP heights ends one."""
    by = [*keys, "line_no"]
    rows = lined.withColumn("_m", _middle(F.col("box.h"), by))
    height = F.max(F.when(F.col("_m.at"), F.col("_m.v"))).over(W.partitionBy(*by))
    rows = rows.withColumn("height", F.when(height == 0, F.lit(1.0)).otherwise(height)).drop("_m")
    w = W.partitionBy(*by).orderBy(F.col("box.x"), F.col("box.y"), order)
    new = F.col("box.x") - F.lag(F.col("box.x") + F.col("box.w")).over(w) > GAP * F.col("height")
    return rows.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("fragment", F.sum("_new").over(w)).drop("_new")


def pieces(words: DataFrame, keys: Sequence[str], order: str = "word_ix") -> DataFrame:
    """keys, line_no, fragment, x, y, w, h, height, n_words and words (in order of x) of each fragment."""
    b = F.col("box")
    word = F.struct(b["x"].alias("x"), b["y"].alias("y"), F.col(order).alias("ix"), F.col("word").alias("word"))
    rows = words.groupBy(*keys, "line_no", "fragment").agg(
        F.min(b["x"]).alias("x"), F.min(b["y"]).alias("y"), F.max(b["x"] + b["w"]).alias("_r"), F.max(b["y"] + b["h"]).alias("_b"), F.first("height").alias("height"), F.count("*").alias("n_words"), F.sort_array(F.collect_list(word)).alias("_words"),
    )
    return rows.withColumns({"w": F.col("_r") - F.col("x"), "h": F.col("_b") - F.col("y"), "words": F.transform("_words", lambda x: x["word"])}).drop("_r", "_b", "_words")


class Printed:
    """The same lines as Lines makes, each cut into pieces as soon as no later word can join it; with `chained` each piece has its column.

    A line is done when it ends above the word at hand or is no longer one of the newest; a named one at the page's end. Pieces wait until
    nothing open begins above them: then they are in the order that columns are swept in.
    """

    def __init__(self, out: Callable, chained: bool):
        self.out, self.columns = out, Columns() if chained else None
        self.open: list[list] = []  # top, low, number, name, words of lines that unnamed words may join
        self.named: dict = {}
        self.waiting: list[tuple] = []
        self.n = 0

    def add(self, x: float, y: float, w: float, h: float, ix, word, name=None) -> None:
        best, most, low, over = None, COMMON, y + h, False
        for line in self.open:
            top, bottom = line[0], line[1]
            if bottom <= y:  # words come from above: no unnamed one joins it any more, as it is
                over = over or line[3] is None
                continue
            common = (low if low < bottom else bottom) - (y if y > top else top)
            if name is not None or common <= 0:
                continue
            small, large = (h, bottom - top) if h < bottom - top else (bottom - top, h)
            if common > most * small and large < RATIO * small:
                best, most = line, common / small
        if name is not None:
            best = self.named.get(name)
        if best is None:
            best = [y, low, self.n, name, []]
            self.n += 1
            self.open.append(best)
            over = over or self.open[0][2] < self.n - OPEN
            if name is not None:
                self.named[name] = best
        else:
            best[0], best[1] = min(best[0], y), max(best[1], low)
        best[4].append((x, y, ix, word, x + w, low, h))
        if over:
            self._close(y)

    def _close(self, y: float) -> None:
        still, done = [], []
        for line in self.open:
            (still if (line[1] > y or line[3] is not None) and line[2] >= self.n - OPEN else done).append(line)
        self.open = still
        for line in done:
            if line[3] is None:
                self._cut(line)
        if self.columns is not None:
            self._chain(min([y, *(line[0] for line in self.open), *(line[0] for line in self.named.values())]))

    def _cut(self, line: list) -> None:
        words = line[4]
        words.sort()
        height = sorted([v[6] for v in words])[len(words) // 2] or 1.0
        first, fragment = 0, 0
        for i in range(1, len(words) + 1):
            if i < len(words) and not words[i][0] - words[i - 1][4] > GAP * height:
                continue
            part = words[first:i]
            x, top = part[0][0], min([v[1] for v in part])
            text = [v[3] for v in part if v[3] is not None]
            piece = (top, x, line[2], fragment, max([v[4] for v in part]) - x, max([v[5] for v in part]) - top, height, len(part), " ".join(text) if text else None)
            if self.columns is None:
                self.out(piece, None)
            else:
                heapq.heappush(self.waiting, piece)
            first, fragment = i, fragment + 1

    def _chain(self, above: float) -> None:
        while self.waiting and self.waiting[0][0] < above:
            p = heapq.heappop(self.waiting)
            self.out(p, self.columns.place(p[1], p[0], p[4], p[5], p[6]))

    def end(self) -> None:
        for line in [*(v for v in self.open if v[3] is None), *self.named.values()]:
            self._cut(line)
        if self.columns is not None:
            self._chain(float("inf"))


#: Pieces in one batch that printed hands on.
BATCH = 4096


def printed(words: DataFrame, keys: Sequence[str], order: str = "word_ix", name: str | None = None, chained: bool = False, dealt: bool = False) -> DataFrame:
    """keys, line_no, fragment, x, y, w, h, height, n_words, text (words in order of x) of each piece of print, with chained its column_no.

    One shuffle of the words by keys, none if the words of a page are dealt to one partition already.
    """
    b = F.col("box")
    rows = words.select(*keys, b["x"].alias("_x"), b["y"].alias("_y"), b["w"].alias("_w"), b["h"].alias("_h"), F.col(order).alias("_ix"), F.col("word").alias("_word"), *([F.col(name).alias("_name")] if name else []))
    rows = (rows if dealt else rows.repartition(*keys)).sortWithinPartitions(*keys, "_y", "_x", "_ix")
    n = len(keys)
    numbers = [("line_no", "long"), ("fragment", "long"), *((c, "double") for c in ("x", "y", "w", "h", "height")), ("n_words", "long"), ("text", "string"), *([("column_no", "long")] if chained else [])]
    schema = ", ".join([*(f"`{k}` {words.schema[k].dataType.simpleString()}" for k in keys), *(f"{c} {t}" for c, t in numbers)])
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        page, at, types = None, object(), None

        def out(p: tuple, column: int | None) -> None:
            found.append((*at, p[2], p[3], p[1], p[0], *p[4:9], *([column] if chained else [])))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*found))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*types, *(kinds[t] for _, t in numbers)])], names=[*keys, *(c for c, _ in numbers)])

        for x in batches:
            types = [x.schema.field(i).type for i in range(n)]
            for row in zip(zip(*(_listed(x.column(i)) for i in range(n))), *(_listed(x.column(i)) for i in range(n, x.num_columns))):
                if row[0] != at:
                    if page is not None:
                        page.end()
                    page, at = Printed(out, chained), row[0]
                page.add(*row[1:])
            if len(found) >= BATCH:
                yield batch()
        if page is not None:
            page.end()
        if found:
            yield batch()

    return rows.mapInArrow(run, schema)


def columns(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pieces with column_no: pieces chained downward, each to the nearest column it is aligned with."""
    return swept(found, keys, ["y", "x", "line_no", "fragment"], ["x", "y", "w", "h", "height"], Columns, "column_no")


def candidates(words: DataFrame, keys: Sequence[str], order: str = "word_ix", name: str | None = None, dealt: bool = False) -> DataFrame:
    """keys, column_no, line_count, n_words and text of each column, read line by line: what a phrase may stand in."""
    row = F.struct("y", "x", "line_no", "fragment", "text")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["text"]), " ")
    return printed(words, keys, order, name, True, dealt).groupBy(*keys, "column_no").agg(F.count("*").alias("line_count"), F.sum("n_words").alias("n_words"), text.alias("text"))
