"""One-to-one assignment of two sides by rising cost, in rounds of mutual best pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.sources.shared import kept

#: Options left over that one task may settle, in order.
SMALL = 50_000


def _greedy(one: Sequence[int], two: Sequence[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: tuple[set, set] = (set(), set())
        for b in batches:
            keep = []
            for left, right in zip(*(zip(*(b.column(i).to_pylist() for i in side)) for side in (one, two))):
                free = left not in taken[0] and right not in taken[1]
                keep.append(free)
                if free:
                    taken[0].add(left)
                    taken[1].add(right)
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def one_to_one(options: DataFrame, left: Sequence[str], right: Sequence[str], by: Sequence[str], small: int = SMALL) -> DataFrame:
    """The options that remain when they are taken in order of `by`, each left and each right once.

    by tells any two options apart. In each round the options that are the least of both their sides are taken: no earlier
    option can take either side from them. The rows with those sides go, and the next round begins, until at most `small` options
    are left, which one task goes through in order. Minima are partial before any shuffle, so a side with very many options is no hot task.
    """
    cols = options.columns
    rest, done = kept(options, "options"), []
    cost = F.struct(*by)
    while rest.count() > small:
        least = lambda side, name, r=rest: kept(r.groupBy(*side).agg(F.min(cost).alias(name)), "least")
        best = rest.join(least(left, "_a"), list(left)).join(least(right, "_b"), list(right))
        picked = kept(best.filter((F.col("_a") == cost) & (F.col("_b") == cost)).select(cols), "picked")
        done.append(picked)
        rest = kept(rest.join(picked.select(*left), list(left), "left_anti").join(picked.select(*right), list(right), "left_anti").select(cols), "options")
    place = lambda side: [cols.index(c) for c in side]
    out = rest.coalesce(1).sortWithinPartitions(*by).mapInArrow(_greedy(place(left), place(right)), options.schema)
    for d in done:
        out = out.unionByName(d)
    return out
