"""Reading order, and the places around a located phrase that decide what its differences mean.

Boxes are compared in the frame their text reads in: `along` the line and `across` lines. Greedy
clustering of one page's lines is the only grouped map; all else is joins with range predicates
inside a sheet.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import fixed as X
from concord.functions import geometry as G
from concord.functions import text as T


def _framed(x0, y0, x1, y1, turn):
    """start, end, top, bottom of boxes in the frame of a quarter turn."""
    return {0: (x0, x1, y0, y1), 90: (-y1, -y0, x0, x1), 180: (-x1, -x0, -y1, -y0), 270: (y0, y1, -x1, -x0)}[turn]


def _joined(links: np.ndarray) -> np.ndarray:
    """The least member of each node's connected component; links: a symmetric boolean matrix."""
    lab = np.arange(len(links))
    while True:
        new = np.minimum(lab, np.where(links, lab, len(lab)).min(1, initial=len(lab)))
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _extents(group: np.ndarray, start, end, top, low) -> tuple[np.ndarray, ...]:
    """Groups and the bounds of each."""
    ids, at = np.unique(group, return_inverse=True)
    out = [np.full(len(ids), np.inf), np.full(len(ids), -np.inf), np.full(len(ids), np.inf), np.full(len(ids), -np.inf)]
    for o, v, f in zip(out, (start, end, top, low), (np.minimum, np.maximum) * 2):
        f.at(o, at, v)
    return at, *out


def _level(top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Pairs on one baseline and of one size."""
    h = low - top
    least, most = np.minimum.outer(h, h), np.maximum.outer(h, h)
    return (np.abs(np.subtract.outer(top + low, top + low)) / 2 < 0.5 * least) & (most < 1.8 * least)


def order_lines(boxes: np.ndarray, turn: int) -> list[tuple[int, int, int]]:
    """(index, row, block) of boxes (x0, y0, x1, y1) of one rotation in reading order.

    Rows are connected components of boxes on one baseline less than .8 of a height apart. A row lies under
    another (gap up to 1.5 heights, overlap of .3 or starts within 1.5 heights) if each is the other's nearest;
    blocks are the components of that. A piece of a block of one or two rows that follows a row of a block of three
    by up to 4 heights, inside that block's column, belongs to the row.
    """
    n = len(boxes)
    if not n:
        return []
    start, end, top, low = (np.asarray(v, float) for v in _framed(*boxes.T, turn))
    h = low - top
    gap = start[None, :] - end[:, None]  # from i to j
    after = _level(top, low) & (gap >= -h / 2) & (gap < 0.8 * h) & ~np.eye(n, dtype=bool)
    row, s, e, t, b = _extents(_joined(after | after.T), start, end, top, low)
    height = b - t
    least, most = np.minimum.outer(height, height), np.maximum.outer(height, height)
    drop = t[None, :] - b[:, None]  # from the row above to the one below
    common = np.minimum.outer(e, e) - np.maximum.outer(s, s)
    width = e - s
    column = (common >= 0.3 * np.minimum.outer(width, width)) | (np.abs(np.subtract.outer(s, s)) <= 1.5 * most)
    under = (drop >= -0.5 * least) & (drop <= 1.5 * most) & (most <= 1.8 * least) & column & (t[None, :] + b[None, :] > (t + b)[:, None])
    far = np.where(under, drop, np.inf)
    k = np.arange(len(s))
    mutual = under & (far.argmin(1)[:, None] == k[None, :]) & (far.argmin(0)[None, :] == k[:, None])
    block = _joined(mutual | mutual.T)
    rows_in = np.bincount(block, minlength=len(k))
    big = rows_in[block] > 2
    # lone pieces go to the row they continue
    of = k.copy()
    _, left, right, _, _ = _extents(block, s, e, t, b)
    place = np.unique(block, return_inverse=True)[1]
    piece_gap = s[None, :] - e[:, None]
    hosted = _level(t, b) & big[:, None] & ~big[None, :] & (piece_gap >= -height / 2) & (piece_gap < 4 * height)
    hosted &= (left[place][:, None] - height / 2 <= s[None, :]) & (e[None, :] <= right[place][:, None] + height / 2)
    lone = np.flatnonzero(hosted.any(0))
    of[lone] = np.where(hosted, piece_gap, np.inf).argmin(0)[lone]
    row, block = of[row], block[of]
    key = np.full((len(k), 2), np.inf)  # where a block begins: its highest row, then its start
    for i in np.unique(row):
        key[block[i]] = min(tuple(key[block[i]]), (t[i], s[i]))
    order = np.lexsort((start, s[row], t[row], *key[block[row]].T[::-1]))
    name = {v: i for i, v in enumerate(dict.fromkeys(row[order].tolist()))}
    blocks = {v: i for i, v in enumerate(dict.fromkeys(block[row[order]].tolist()))}
    return [(int(i), name[int(row[i])], blocks[int(block[row[i]])]) for i in order]


def reading_order(lines: DataFrame, sheet: str = "sheet_id", order: str = "line_ix") -> DataFrame:
    """sheet, line_ix, rotation, pos, row, block of each line: one page and rotation at a time. lines: box (x, y, w, h) in pixels, rotation."""
    kind = lines.schema[sheet].dataType.simpleString()

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(order, ignore_index=True)
        found = order_lines(b[["x0", "y0", "x1", "y1"]].to_numpy(float), int(b["rotation"].iloc[0]))
        i = [f[0] for f in found]
        return pd.DataFrame({sheet: b[sheet].iloc[0], order: b[order].to_numpy()[i], "rotation": b["rotation"].iloc[0], "pos": range(len(i)), "row": [f[1] for f in found], "block": [f[2] for f in found]})

    rows = lines.select(sheet, F.col(order).cast("long").alias(order), F.col("rotation").cast("int").alias("rotation"), F.col("box.x").alias("x0"), F.col("box.y").alias("y0"), (F.col("box.x") + F.col("box.w")).alias("x1"), (F.col("box.y") + F.col("box.h")).alias("y1"))
    return rows.groupBy(sheet, "rotation").applyInPandas(run, f"{sheet} {kind}, {order} long, rotation int, pos int, row int, block int")


def chains(words: DataFrame, keys: Sequence[str], order: str = "word_ix") -> DataFrame:
    """words with `chain`: a new one begins where the next word stands neither on the row (centres within .65 of a height, gap below 6)
    nor on the next one (gap below 2.5): gaps and islands over box."""
    w = W.partitionBy(*keys).orderBy(order)
    b, p = F.col("box"), F.lag("box").over(w)
    h = F.greatest(b["h"], p["h"])
    row = (F.abs(b["y"] + b["h"] / 2 - p["y"] - p["h"] / 2) < 0.65 * h) & (b["x"] - p["x"] - p["w"] < 6 * h)
    below = (b["y"] >= p["y"]) & (b["y"] - p["y"] - p["h"] < 2.5 * h) & (b["x"] <= p["x"] + p["w"])
    rows = words.withColumn("_new", F.when(row | below, 0).otherwise(1))
    return rows.withColumn("chain", F.sum("_new").over(w)).drop("_new")


def joined_hyphens(tokens: Column) -> Column:
    """Tokens of words in order, a word ending in a hyphen joined with the next one."""
    return F.transform(F.split(F.regexp_replace(F.array_join(tokens, " "), r"(\p{L})- (?=\p{L})", "$1"), " "), lambda t: t)


def respaced(target: Sequence[str], tokens: Sequence[str]) -> list[str]:
    return [t for t, _, _ in respaced_from(target, tokens)]


def respaced_from(target: Sequence[str], tokens: Sequence[str]) -> list[tuple[str, int, int]]:
    """tokens, each with the first and last one it is made of, cut anew where letters spell the target: of all ways to keep a token, to part one into two or three
    neighbouring target tokens, or to join two or three into one, that which leaves least tokens foreign to the target,
    then changes least. Numbers and tokens of the target stay as they are."""
    known = set(target)
    spelled: dict[str, tuple[str, ...]] = {w: (w,) for w in known if w.isalpha()}
    for n in (2, 3):
        for part in zip(*(target[i:] for i in range(n))):
            if all(map(str.isalpha, part)):
                spelled.setdefault("".join(part), part)
    # moves from a token: how many tokens, and what they become; only tokens that begin something spelled have any
    begins = {w[:k] for w in spelled for k in range(1, len(w) + 1)} - known
    moves: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
    for j in (j for j, t in enumerate(tokens) if t in begins):
        for k in range(1, min(3, len(tokens) - j) + 1):
            part = tokens[j : j + k]
            if part[-1] in known or not part[-1].isalpha():
                break
            whole = spelled.get("".join(part))
            if whole and (k == 1 or len(whole) == 1):
                moves.setdefault(j, []).append((k, whole))
    out: list[tuple[str, int, int]] = []
    j = 0
    for first in sorted(moves):
        if first < j:
            continue
        out += [(t, j + i, j + i) for i, t in enumerate(tokens[j:first])]
        # tokens that chained moves reach are settled together
        end, at = first + 1, first
        while at < end:
            end = max([end, *(at + k for k, _ in moves.get(at, ()))])
            at += 1
        best: dict[int, tuple] = {end: (0, 0)}
        for i in range(end - 1, first - 1, -1):
            ways = [((tokens[i] not in known) + best[i + 1][0], best[i + 1][1], 1, (tokens[i],))]
            ways += [(best[i + k][0], best[i + k][1] + 1, k, whole) for k, whole in moves.get(i, ())]
            best[i] = min(ways)
        j = first
        while j < end:
            _, _, k, whole = best[j]
            out += [(t, j, j + k - 1) for t in whole]
            j += k
    return out + [(t, j + i, j + i) for i, t in enumerate(tokens[j:])]


def turned_frame(b: Column, turn: Column, width: Column, height: Column) -> Column:
    """struct<a0, a1, c0, c1>: page pixels along and across the reading direction."""
    x0, x1, y0, y1 = b["x"] * width, (b["x"] + b["w"]) * width, b["y"] * height, (b["y"] + b["h"]) * height
    make = lambda *v: F.struct(*(c.alias(n) for c, n in zip(v, ("a0", "a1", "c0", "c1"))))
    return F.when(turn == 90, make(-y1, -y0, x0, x1)).when(turn == 180, make(-x1, -x0, -y1, -y0)).when(turn == 270, make(y0, y1, -x1, -x0)).otherwise(make(x0, x1, y0, y1))


def page_box(a0: Column, a1: Column, c0: Column, c1: Column, turn: Column, width: Column, height: Column) -> Column:
    """The inverse, cut at the page's edges, in fractions."""
    pick = lambda i: F.when(turn == 90, (c0, c1, -a1, -a0)[i]).when(turn == 180, (-a1, -a0, -c1, -c0)[i]).when(turn == 270, (-c1, -c0, a0, a1)[i]).otherwise((a0, a1, c0, c1)[i])
    x, y = F.greatest(F.lit(0.0), pick(0)), F.greatest(F.lit(0.0), pick(2))
    return G.box(x / width, y / height, (F.least(width, pick(1)) - x) / width, (F.least(height, pick(3)) - y) / height)


def unread_gaps(gaps: DataFrame, words: DataFrame) -> DataFrame:
    """gaps that are not blank: some readable word of the same turn stands between the two neighbours (left semi join in the sheet).

    gaps: sheet_id, gap_ix, before, after (boxes), rotation; words: sheet_id, box, rotation, confidence, text. A missing
    confidence counts as 100; other readings of either neighbour (more than half of their length on its line) do not count.
    """
    # the length is the box's own side: the difference of its rounded ends would decide other words of exactly half
    length = F.when(F.col("rotation").isin(90, 270), F.col("box.h")).otherwise(F.col("box.w"))
    w = words.filter((F.coalesce("confidence", F.lit(100.0)) >= X.FLOOR_BLANK) & F.col("text").rlike(r"[\p{L}\p{N}]")).select("sheet_id", F.col("rotation").alias("_r"), turned_frame(F.col("box"), F.col("rotation"), F.lit(1.0), F.lit(1.0)).alias("m"), length.alias("_len"))
    g = gaps.select("*", *(turned_frame(F.col(c), F.col("rotation"), F.lit(1.0), F.lit(1.0)).alias(f"_{c}") for c in ("before", "after")))
    b, a, m = F.col("_before"), F.col("_after"), F.col("m")
    size = b["c1"] - b["c0"]
    row = lambda p, q: F.abs(p["c0"] + p["c1"] - q["c0"] - q["c1"]) / 2 < 0.6 * size
    again = lambda p: (F.least(m["a1"], p["a1"]) - F.greatest(m["a0"], p["a0"]) > 0.5 * F.col("_len")) & row(m, p)
    later, sooner = row(m, b) & (m["a0"] >= b["a1"] - 0.3 * size), row(m, a) & (m["a1"] <= a["a0"] + 0.3 * size)
    between = F.when(row(b, a), later & sooner).otherwise(later | sooner)
    on = (F.col("sheet_id") == F.col("_s")) & (F.col("rotation") == F.col("_r")) & ~again(b) & ~again(a) & between
    return g.join(w.withColumnRenamed("sheet_id", "_s"), on, "left_semi").drop("_before", "_after")


def refinement_areas(matches: DataFrame, limit: int = 8) -> DataFrame:
    """sheet_id, rule_id, area, rotation, priority: places to read again, at most `limit` a sheet.

    matches: sheet_id, rule_id, exact, coverage, rotation, boxes, chars (letters of each word), method. Not exact ones
    of coverage 45 and two words, padded by three letters and .7 of a height; scattered words first, then turned text;
    of two areas at one place the first stays.
    """
    m = matches.filter(~F.col("exact") & (F.col("coverage") >= 45) & (F.size("boxes") >= 2))
    b = G.bounds_of(F.col("boxes"))
    h = G.upper_median(F.transform("boxes", lambda x: x["h"]), 1)
    letter = G.upper_median(F.zip_with("boxes", "chars", lambda x, n: x["w"] / F.greatest(F.lit(1), n)), 1)
    px, py = F.greatest(F.lit(0.002), 3 * letter), F.greatest(F.lit(0.002), 0.7 * h)
    x, y = F.greatest(F.lit(0.0), b["x"] - px), F.greatest(F.lit(0.0), b["y"] - py)
    area = G.box(x, y, F.least(F.lit(1.0), b["x"] + b["w"] + px) - x, F.least(F.lit(1.0), b["y"] + b["h"] + py) - y)
    m = m.select("sheet_id", "rule_id", "rotation", area.alias("area"), F.when(F.col("method") == "words", 2).when(F.col("rotation") % 180 != 0, 1).otherwise(0).alias("priority"))
    e = m.select(F.col("sheet_id").alias("_s"), F.col("rule_id").alias("_i"), F.col("rotation").alias("_t"), F.col("area").alias("_a"))
    alike = G.same_place(F.col("area"), F.col("_a")) & (F.least(G.area(F.col("area")), G.area(F.col("_a"))) > 0.65 * F.greatest(G.area(F.col("area")), G.area(F.col("_a"))))
    m = m.join(e, (F.col("sheet_id") == F.col("_s")) & (F.col("_i") < F.col("rule_id")) & (F.col("rotation") == F.col("_t")) & alike, "left_anti")
    rank = F.row_number().over(W.partitionBy("sheet_id").orderBy(F.desc("priority"), "rule_id"))
    return m.withColumn("_k", rank).filter(F.col("_k") <= limit).drop("_k")


def edge_places(edges: DataFrame) -> DataFrame:
    """edges with `areas`: the rest of the line and the neighbouring line where words missing at a phrase's edge would stand.

    edges: side (leading, trailing), anchor (box of the read word beside the gap), chars of it, missing_chars, rotation,
    letter, from and to (the phrase's extent, page pixels along), width and height of the page.
    """
    f = turned_frame(F.col("anchor"), F.col("rotation"), F.col("width"), F.col("height"))
    rows = edges.withColumn("_f", f)
    f, s = F.col("_f"), F.col("letter")
    mid = (f["c0"] + f["c1"]) / 2
    c0, c1 = mid - s / 2, mid + s / 2
    length = F.greatest(4 * s, F.col("missing_chars") * (f["a1"] - f["a0"]) / F.greatest(F.lit(1), F.col("chars")) * 1.6)
    back = lambda *v: page_box(*v, F.col("rotation"), F.col("width"), F.col("height"))
    after = F.array(back(f["a1"] + 0.2 * s, f["a1"] + 0.2 * s + length, c0 - 0.15 * s, c1 + 0.15 * s), back(F.col("from"), F.col("from") + length, c1 + 0.1 * s, c1 + 2.6 * s))
    before = F.array(back(f["a0"] - 0.2 * s - length, f["a0"] - 0.2 * s, c0 - 0.15 * s, c1 + 0.15 * s), back(F.col("to") - length, F.col("to"), c0 - 2.6 * s, c0 - 0.1 * s))
    areas = F.filter(F.when(F.col("side") == "trailing", after).otherwise(before), lambda b: (b["w"] > 0) & (b["h"] > 0))
    return rows.withColumn("areas", areas).drop("_f")


def settled_edges(places: DataFrame, probes: DataFrame, words: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """place_ix, sheet_id, anchored, blank, seen of each place: absent from the print only if every area is blank or surely holds
    other words, and the telling ones (four letters or more) are not all printed elsewhere.

    places: sheet_id, place_ix, rotation, expected (tokens), areas; probes: sheet_id, probe_ix, box, rotation, blank, text,
    confidence; words: sheet_id, text, confidence (and box), outside the phrase. own: sheet_id, place_ix, box of the words of the place's
    own phrase, where words holds them too.
    """
    a = places.select("sheet_id", "place_ix", "rotation", "expected", F.posexplode("areas").alias("area_ix", "area"))
    p = probes.select(F.col("sheet_id").alias("_s"), "probe_ix", F.col("box").alias("_b"), F.col("rotation").alias("_t"), "blank", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    near = (F.col("sheet_id") == F.col("_s")) & (F.col("rotation") == F.col("_t")) & (G.shared(F.col("_b"), F.col("area")) >= 0.6 * G.area(F.col("area")))
    first = a.join(p, near, "left").groupBy("sheet_id", "place_ix", "area_ix").agg(F.min(F.struct("probe_ix", "blank", "text", "confidence", "expected")).alias("p"), F.first("expected").alias("expected"))
    tokens = T.phrase_tokens(F.col("p.text"))
    other = ~F.arrays_overlap(tokens, F.col("expected")) & (F.col("p.confidence") >= X.FLOOR_SURE) & F.exists(tokens, lambda t: F.char_length(t) >= 3)
    good = F.col("p.probe_ix").isNotNull() & (F.coalesce("p.blank", F.lit(False)) | other)
    told = first.select("sheet_id", "place_ix", "expected", F.coalesce(good, F.lit(False)).alias("good"), F.coalesce("p.blank", F.lit(False)).alias("b"), F.when(other, F.col("p.text")).alias("t"))
    sums = told.groupBy("sheet_id", "place_ix").agg(F.bool_and("good").alias("good"), F.bool_and("b").alias("blank"), F.collect_list("t").alias("seen"), F.first("expected").alias("expected"))
    at = [] if own is None else ["box"]
    surely = words.filter(F.coalesce("confidence", F.lit(0.0)) >= X.FLOOR_USABLE).select("sheet_id", *at, F.explode(T.phrase_tokens(F.col("text"))).alias("token")).distinct()
    telling = sums.select("sheet_id", "place_ix", F.explode(F.filter("expected", lambda t: F.char_length(t) >= 4)).alias("token"))
    there = telling.join(surely, ["sheet_id", "token"])
    if own is not None:
        o = own.select(F.col("sheet_id").alias("_s"), F.col("place_ix").alias("_p"), F.col("box").alias("_b"))
        there = there.join(o, (F.col("sheet_id") == F.col("_s")) & (F.col("place_ix") == F.col("_p")) & F.col("box").eqNullSafe(F.col("_b")), "left_anti")
    there = there.select("sheet_id", "place_ix", "token").distinct().withColumn("there", F.lit(1))
    printed = telling.join(there, ["sheet_id", "place_ix", "token"], "left").groupBy("sheet_id", "place_ix").agg((F.count("there") == F.count("*")).alias("elsewhere"))
    out = sums.join(printed, ["sheet_id", "place_ix"], "left")
    return out.select("sheet_id", "place_ix", (F.col("good") & ~F.coalesce("elsewhere", F.lit(False))).alias("anchored"), "blank", "seen")


def beside(phrases: DataFrame, words: DataFrame, taken: DataFrame) -> DataFrame:
    """sheet_id, rule_id, side, text: the word right beside an exact phrase that no requirement accounts for.

    phrases: sheet_id, rule_id, rotation, first and last (boxes of its end words); words: sheet_id, word_ix, pass, text,
    confidence, rotation, box; taken: sheet_id, box of words that requirements claim. Such a word is of the phrase's size, less
    than a height away on its line, read with confidence 90 or alike by two passes, no closing mark between, and over no claimed word.
    """
    one = F.lit(1.0)
    w = words.filter((F.coalesce("confidence", F.lit(0.0)) >= X.FLOOR_USABLE) & F.exists(T.phrase_tokens(F.col("text")), lambda t: (F.char_length(t) >= 2) | t.rlike(r"\d")))
    t = taken.select(F.col("sheet_id").alias("_s"), F.col("box").alias("_b"))
    free = w.join(t, (F.col("sheet_id") == F.col("_s")) & (G.shared(F.col("box"), F.col("_b")) > 0.3 * F.least(G.area(F.col("box")), G.area(F.col("_b")))), "left_anti")
    said = T.let(T.phrase_tokens(F.col("text")), lambda x: F.array_join(F.transform(x, T.fold), " "))
    again = w.select(F.col("sheet_id").alias("_s"), F.col("pass").alias("_p"), F.col("rotation").alias("_t"), F.col("box").alias("_b"), said.alias("_said"))
    twice = free.withColumn("said", said).join(again, (F.col("sheet_id") == F.col("_s")) & (F.col("pass") != F.col("_p")) & (F.col("rotation") == F.col("_t")) & (F.col("said") == F.col("_said")) & (G.shared(F.col("box"), F.col("_b")) > 0.5 * F.least(G.area(F.col("box")), G.area(F.col("_b")))), "left_semi")
    sure = free.filter(F.col("confidence") >= X.FLOOR_SINGLE).unionByName(twice.drop("said")).dropDuplicates(["sheet_id", "word_ix"])
    ends = phrases.select("sheet_id", "rule_id", "rotation", F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("first").alias("anchor")), F.struct(F.lit("after").alias("side"), F.col("last").alias("anchor")))).alias("e")).select("sheet_id", "rule_id", "rotation", "e.side", turned_frame(F.col("e.anchor"), F.col("rotation"), one, one).alias("a"))
    s = sure.select(F.col("sheet_id").alias("_s"), "word_ix", F.trim("text").alias("text"), F.col("rotation").alias("_t"), turned_frame(F.col("box"), F.col("rotation"), one, one).alias("m"))
    a, m = F.col("a"), F.col("m")
    h, k = a["c1"] - a["c0"], m["c1"] - m["c0"]
    line = F.least(a["c1"], m["c1"]) - F.greatest(a["c0"], m["c0"]) >= 0.4 * F.least(h, k)
    gap = F.when(F.col("side") == "before", a["a0"] - m["a1"]).otherwise(m["a0"] - a["a1"])
    closed = F.when(F.col("side") == "before", F.col("text").rlike("[.;:!?][\"»”)]*$")).otherwise(F.lit(False))
    rows = ends.join(s, (F.col("sheet_id") == F.col("_s")) & (F.col("rotation") == F.col("_t")) & line & (k > 0.5 * h) & (k < 1.6 * h) & (gap > -0.3 * h) & (gap < h)).filter(~closed)
    return rows.withColumn("gap", gap).groupBy("sheet_id", "rule_id", "side").agg(F.min(F.struct("gap", "word_ix", "text"))["text"].alias("text"))


def substitutes(found: DataFrame, every: DataFrame) -> DataFrame:
    """found with `glyphs` lent by another reading of the same word at the same place when its own are fewer than two.

    found, every: sheet_id, word_ix, text, box, confidence, glyphs; the first by word_ix lends.
    """
    poor = found.filter(F.size("glyphs") < 2).select("sheet_id", "word_ix", T.normalize(F.col("text")).alias("n"), F.col("box").alias("_b"))
    rich = every.filter((F.size("glyphs") >= 2) & (F.coalesce("confidence", F.lit(0.0)) >= X.FLOOR_SURE)).select("sheet_id", F.col("word_ix").alias("_i"), T.normalize(F.col("text")).alias("n"), "box", F.col("glyphs").alias("_g"))
    lent = poor.join(rich, ["sheet_id", "n"]).filter(G.same_place(F.col("_b"), F.col("box"), 0.6)).groupBy("sheet_id", "word_ix").agg(F.min(F.struct("_i", "_g"))["_g"].alias("_g"))
    return found.join(lent, ["sheet_id", "word_ix"], "left").withColumn("glyphs", F.coalesce("_g", "glyphs")).drop("_g")


def assigned(sentences: DataFrame, checks: DataFrame) -> DataFrame:
    """sheet_id, rule_id, check_ix, sentences: each located sentence (coverage 80) under the minimum whose subject it names first."""
    from concord.functions.quantity import scope_index

    scopes = checks.groupBy("sheet_id", "rule_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("check_ix", F.coalesce("scope", F.lit("")).alias("s")))), lambda x: F.nullif(x["s"], F.lit(""))).alias("scopes"))
    rows = sentences.filter("coverage >= 80").join(scopes, ["sheet_id", "rule_id"]).withColumn("check_ix", scope_index(F.col("scopes"), F.col("text")))
    return rows.filter("check_ix >= 0").groupBy("sheet_id", "rule_id", "check_ix").agg(F.sort_array(F.collect_list("text")).alias("sentences"))


def compared_sections(rules: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """rule_id, verdicts and readings of two methods, and whether verdict and numbers differ; a method without a result has nulls."""
    side = lambda d, n: d.select("rule_id", F.col("verdict").alias(f"verdict_{n}"), F.col("reading").alias(f"reading_{n}"))
    j = rules.select("rule_id").join(side(one, "one"), "rule_id", "left").join(side(two, "two"), "rule_id", "left")
    numbers = lambda c: T.number_tokens(T.phrase_tokens(F.coalesce(c, F.lit(""))))
    return j.withColumn("verdicts_differ", ~F.col("verdict_one").eqNullSafe(F.col("verdict_two"))).withColumn("numbers_differ", numbers(F.col("reading_one")) != numbers(F.col("reading_two")))


def audit(reference: DataFrame, observed: DataFrame) -> DataFrame:
    """Full join of a person's findings with the engine's by id, with what is missing on either side."""
    j = reference.join(observed, "id", "full_outer")
    return j.withColumn("gap", F.when(F.col("status").isNull(), "not observed").when(F.col("text").isNull(), "no reference"))


def latest_reviews(reviews: DataFrame, time: str) -> DataFrame:
    """The last review of each rule; text is confirmed, or a rule set aside, only with a note where its text is missing."""
    last = reviews.groupBy("sheet_id", "rule_id").agg(F.max_by(F.struct(*(c for c in reviews.columns if c not in ("sheet_id", "rule_id"))), F.col(time)).alias("r")).select("sheet_id", "rule_id", "r.*")
    noted = F.trim(F.coalesce("note", F.lit(""))) != ""
    return last.withColumn("not_applicable", F.coalesce("not_applicable", F.lit(False)) & noted)


def probe_summary(readings: DataFrame) -> DataFrame:
    """sheet_id, probe_ix, blank, text (first six different readings), confidence of each examined place."""
    r = readings.withColumn("t", F.trim(F.coalesce("text", F.lit(""))))
    texts = F.array_join(F.slice(F.array_distinct(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("attempt", "t"))), lambda x: x["t"]), lambda t: t != "")), 1, 6), " ")
    return r.groupBy("sheet_id", "probe_ix").agg(F.bool_and(~F.col("inked")).alias("blank"), texts.alias("text"), F.avg(F.when(F.col("t") != "", F.col("confidence"))).alias("confidence"))


def languages(rules: DataFrame) -> DataFrame:
    """sheet_id, languages: rus+eng when some rule has a Latin word of five letters or two of three in a row."""
    return rules.groupBy("sheet_id").agg(F.when(F.bool_or(F.col("text").rlike(r"[A-Za-z]{5,}|[A-Za-z]{3,}\s+[A-Za-z]{3,}")), "rus+eng").otherwise("rus").alias("languages"))


def dates(captions: DataFrame, words: DataFrame) -> DataFrame:
    """sheet_id, rule_id, text, n: surely read digits right of or below a date caption, in its own frame; long codes left out.

    captions: sheet_id, rule_id, rotation, box; words: sheet_id, word_ix, text, confidence, rotation, box.
    """
    one = F.lit(1.0)
    d = words.filter((F.coalesce("confidence", F.lit(0.0)) >= X.FLOOR_SURE) & F.col("text").rlike(r"^[\d.,/: -]*\d[\d.,/: -]*$") & ~F.col("text").rlike(r"^\d{13}$"))
    d = d.select(F.col("sheet_id").alias("_s"), "word_ix", "text", F.col("rotation").alias("_t"), turned_frame(F.col("box"), F.col("rotation"), one, one).alias("m"))
    c = captions.select("sheet_id", "rule_id", "rotation", turned_frame(F.col("box"), F.col("rotation"), one, one).alias("a"))
    a, m = F.col("a"), F.col("m")
    h = a["c1"] - a["c0"]
    place = (m["a0"] >= a["a0"] - h) & (m["a0"] < a["a1"] + 8 * h) & (((m["a0"] >= a["a1"] - 0.3 * h) & (F.abs(m["c0"] - a["c0"]) < 1.5 * h)) | ((m["c0"] >= a["c1"] - 0.1 * h) & (m["c0"] < a["c1"] + 3 * h)))
    rows = c.join(d, (F.col("sheet_id") == F.col("_s")) & (F.col("rotation") == F.col("_t")) & place)
    return rows.groupBy("sheet_id", "rule_id").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("word_ix", "text"))), lambda x: x["text"])), " ").alias("text"), F.count("*").alias("n"))
