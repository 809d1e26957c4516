"""Dimension marks on pixels: clusters of coloured signs, strokes, gauges, frames of labels, blocks of read words.

Rasters come one at a time (raster.per_raster); pairs of shapes are compared as whole matrices.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import geometry as G

from .raster import CHROMA, DARK, _runs, bands, classify, components

HUE = 14  # half degrees within which two inks are one


class Shapes:
    """Boxes x0, y0, x1, y1 as columns, with overlaps and gaps of all pairs on an axis."""

    def __init__(self, parts: list[dict]):
        a = np.array([(p["x"], p["y"], p["x"] + p["w"], p["y"] + p["h"]) for p in parts], float).reshape(-1, 4)
        self.lo, self.hi = {"x": a[:, 0], "y": a[:, 1]}, {"x": a[:, 2], "y": a[:, 3]}

    def span(self, axis: str) -> np.ndarray:
        return self.hi[axis] - self.lo[axis]

    def lap(self, axis: str) -> np.ndarray:
        return np.minimum(self.hi[axis][:, None], self.hi[axis]) - np.maximum(self.lo[axis][:, None], self.lo[axis])


def groups(linked: np.ndarray) -> list[np.ndarray]:
    """Connected components of a symmetric matrix of links."""
    top = np.arange(len(linked))
    while True:
        least = np.where(linked, top, len(top)).min(1, initial=len(top))
        new = np.minimum(top, least)
        new = new[new]
        if (new == top).all():
            return [np.flatnonzero(top == t) for t in np.unique(top)]
        top = new


def hue_gap(a, b):
    d = np.abs(np.asarray(a, float) - b) % 180
    return np.minimum(d, 180 - d)


def mean_hue(hue: np.ndarray, weight: np.ndarray) -> float:
    turn = hue.astype(float) * np.pi / 90
    return float(np.arctan2((np.sin(turn) * weight).sum(), (np.cos(turn) * weight).sum()) * 90 / np.pi % 180)


def longest_runs(mask: np.ndarray) -> np.ndarray:
    """Longest run of ink in each row."""
    row, start, end = _runs(mask)
    out = np.zeros(mask.shape[0], int)
    np.maximum.at(out, row, end - start)
    return out


def hairline(mask: np.ndarray) -> bool:
    """A thin straight stroke along most of the shape, which is more than twice as deep as it."""
    for m in (mask, mask.T):
        thick = max((b - a for a, b in bands((longest_runs(m) >= 0.8 * m.shape[1])[:, None])), default=0)
        if thick and thick <= max(1, m.shape[1] * 0.07) and m.shape[0] > 2 * thick:
            return True
    return False


def slanted(mask: np.ndarray) -> bool:
    """Ink along one of the diagonals of the shape's box."""
    h, w = mask.shape
    wide = np.pad(mask, 2)
    inked = lambda x, y: wide[int(y) : int(y) + 5, int(x) : int(x) + 5].any()
    return any(all(inked((w - 1) * t, (h - 1) * (1 - t if up else t)) for t in (0.1, 0.3, 0.5, 0.7, 0.9)) for up in (False, True))


def clusters(rgb: np.ndarray, dark: bool = False) -> list[dict]:
    """Lines of three or more signs of one ink, upright or turned: x, y, w, h, vertical, count, size, hue.

    Signs are components no longer than 2.2 % of the page that are neither thin strokes nor ticks. Two stand on a line when
    they overlap across it by half the smaller, are alike in size within two, and closer than .8 of the larger; a
    small mark that mostly lies within a neighbour's extent joins it. Longer lines are taken first; lines of one ink with a
    word space between become one.
    """
    kind, hue = classify(rgb)
    value, unit = (DARK if dark else CHROMA), max(kind.shape) / 1000
    parts = []
    for c in components(kind == value):
        m = kind[c["y"] : c["y"] + c["h"], c["x"] : c["x"] + c["w"]] == value
        long, short = max(c["w"], c["h"]), min(c["w"], c["h"])
        thin = short <= max(2, unit) and long >= 6 * short and long >= 4 * unit
        tick = long >= 6 * unit and c["area"] < 0.22 * c["w"] * c["h"] and hairline(m)
        if c["area"] >= 2 and not thin and not tick and long <= 22 * unit:
            tone = hue[c["y"] : c["y"] + c["h"], c["x"] : c["x"] + c["w"]][m]
            parts.append(c | {"hue": mean_hue(tone, np.ones(len(tone))) if len(tone) else 0.0})
    if not parts:
        return []
    s, tones = Shapes(parts), np.array([p["hue"] for p in parts])
    one_ink = np.ones((len(parts), len(parts)), bool) if dark else hue_gap(tones[:, None], tones) <= HUE
    lines = []
    for along, across in (("x", "y"), ("y", "x")):
        size = s.span(across)
        big, small = np.maximum(size[:, None], size), np.minimum(size[:, None], size)
        lap, near = s.lap(across), -s.lap(along) <= 0.8 * big
        letters = (small > 0.5 * big) & (lap >= 0.5 * small)
        marks = (small <= 0.5 * big) & (lap >= 0.9 * small)
        linked = one_ink & near & (lap > 0) & (letters | marks)
        np.fill_diagonal(linked, True)
        lines += [(g, along == "y") for g in groups(linked)]
    taken, out = np.zeros(len(parts), bool), []
    for g, vertical in sorted(lines, key=lambda x: -len(x[0])):
        g = g[~taken[g]]
        if len(g) < 3:
            continue
        box = [min(s.lo["x"][g]), min(s.lo["y"][g]), max(s.hi["x"][g]), max(s.hi["y"][g])]
        w, h = box[2] - box[0], box[3] - box[1]
        along, across = (h, w) if vertical else (w, h)
        if along < 1.6 * across or across < 5 or len(g) > 110:
            continue
        taken[g] = True
        sizes = np.sort(s.span("x" if vertical else "y")[g])
        out.append({"x": box[0], "y": box[1], "w": w, "h": h, "vertical": vertical, "count": len(g), "size": float(sizes[int(len(sizes) * 0.75)]), "hue": mean_hue(tones[g], np.array([parts[i]["area"] for i in g]))})
    return sorted(_joined(out), key=lambda c: (c["y"], c["x"]))


def _joined(lines: list[dict]) -> list[dict]:
    while True:
        s = Shapes(lines)
        size, turn, tone = (np.array([c[k] for c in lines]) for k in ("size", "vertical", "hue"))
        big = np.maximum(size[:, None], size)
        linked = np.zeros((len(lines), len(lines)), bool)
        for vertical, along, across in ((False, "x", "y"), (True, "y", "x")):
            small = np.minimum(s.span(across)[:, None], s.span(across))
            linked |= (turn[:, None] == vertical) & (turn == vertical) & (s.lap(across) >= 0.7 * small) & (-s.lap(along) <= 1.6 * big)
        linked &= (hue_gap(tone[:, None], tone) <= HUE) & (np.minimum(size[:, None], size) >= 0.75 * big)
        if len(lines) < 2 or (linked.sum() == len(lines)):
            return lines
        out = []
        for g in groups(linked):
            x, y = min(s.lo["x"][g]), min(s.lo["y"][g])
            most = max((lines[i] for i in g), key=lambda c: c["count"])
            out.append(most | {"x": x, "y": y, "w": max(s.hi["x"][g]) - x, "h": max(s.hi["y"][g]) - y, "count": sum(lines[i]["count"] for i in g), "size": max(size[g])})
        if len(out) == len(lines):
            return lines
        lines = out


def strokes(mask: np.ndarray, least: int, thick: int) -> list[dict]:
    """Horizontal strokes: runs of at least `least` pixels, stacked to at most `thick` rows. Use the transpose for vertical ones."""
    row, start, end = _runs(mask)
    long = end - start >= least
    m = np.zeros_like(mask)
    for y, a, b in zip(row[long], start[long], end[long]):
        m[y, a:b] = True
    return [c for c in components(m, diagonal=False) if c["h"] <= thick]


def gauges(rgb: np.ndarray, lines: list[dict]) -> list[dict | None]:
    """The pair of parallel strokes that bounds what each callout measures: type (height or width), from, to; null without.

    Strokes lie within three letter sizes of the callout, overlap by .6 and stand up to seven sizes apart. The callout between
    them claims the tightest pair, one beside them the nearest; a pair serves one callout, best first.
    """
    kind, hue = classify(rgb)
    options = []
    for n, c in enumerate(lines):
        s = c["size"]
        x0, y0, x1, y1 = (int(v) for v in (max(0, c["x"] - 3 * s), max(0, c["y"] - 3 * s), c["x"] + c["w"] + 3 * s, c["y"] + c["h"] + 3 * s))
        m = (kind[y0:y1, x0:x1] == CHROMA) & (hue_gap(hue[y0:y1, x0:x1], c["hue"]) <= HUE)
        for o in lines:
            a, b = max(0, int(o["y"]) - y0), max(0, int(o["x"]) - x0)
            m[a : max(a, int(o["y"] + o["h"]) - y0), b : max(b, int(o["x"] + o["w"]) - x0)] = False
        for kind_, grid, lo, size, mid in (("height", m, y0, x0, c["y"] + c["h"] / 2), ("width", m.T, x0, y0, c["x"] + c["w"] / 2)):
            found = strokes(grid, max(6, round(0.4 * s)), max(3, round(0.2 * s)))
            for i, p in enumerate(found):
                for q in found[i + 1 :]:
                    p, q = (p, q) if p["y"] <= q["y"] else (q, p)
                    lap = min(p["x"] + p["w"], q["x"] + q["w"]) - max(p["x"], q["x"])
                    start, end = lo + p["y"] + p["h"], lo + q["y"]
                    if not 2 <= end - start <= 7 * s or lap < 0.6 * max(p["w"], q["w"]):
                        continue
                    between = start <= mid <= end
                    options.append((end - start if between else 7 * s + abs((start + end) / 2 - mid), n, kind_, start, end, size + min(p["x"], q["x"])))
    out: list[dict | None] = [None] * len(lines)
    used: list[tuple] = []
    for _, n, kind_, start, end, at in sorted(options):
        if out[n] is None and not any(k == kind_ and abs(a - start) <= 3 and abs(b - end) <= 3 and abs(w - at) <= 20 for k, a, b, w in used):
            used.append((kind_, start, end, at))
            out[n] = {"type": kind_, "from": int(start), "to": int(end)}
    return out


def artwork_region(rgb: np.ndarray) -> dict:
    """What lies above the printing protocol: above a divider wider than .43 of the page in its lower part, when two more lines wider than .23 follow."""
    h, w = rgb.shape[:2]
    run = longest_runs(rgb[..., :3].max(-1) < 145)
    for y in range(int(h * 0.55), int(h * 0.92)):
        if run[y] > 0.43 * w and len(bands((run[y + 4 : min(h, int(y + 0.16 * h))] > 0.23 * w)[:, None], 1, 3)) >= 2:
            return {"x": 0.0, "y": 0.0, "w": 1.0, "h": max(0.5, (y - 3) / h)}
    return {"x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0}


def refined(rgb: np.ndarray, box: dict) -> dict:
    """A frame with each side moved, by up to 7 %, onto the fullest row or column of the frame's own ink (.55 covered)."""
    kind, hue = classify(rgb)
    h, w = kind.shape
    x0, y0, x1, y1 = (round(v) for v in (box["x"] * w, box["y"] * h, (box["x"] + box["w"]) * w, (box["y"] + box["h"]) * h))
    slack = max(3, round(max(h, w) * 0.004))
    rows = slice(int(y0 + (y1 - y0) * 0.25), int(y1 - (y1 - y0) * 0.25))
    edge = [(kind[rows, max(0, x - slack) : x + slack + 1], hue[rows, max(0, x - slack) : x + slack + 1]) for x in (x0, x1)]
    tones = np.concatenate([t[k == CHROMA] for k, t in edge])
    if len(tones) < 12:
        return box
    own = (kind == CHROMA) & (hue_gap(hue, mean_hue(tones, np.ones(len(tones)))) <= 8)

    def side(at: int, lines: np.ndarray, size: int) -> int:
        reach = round(size * 0.07) + slack
        lo = max(0, at - reach)
        cover = lines[lo : at + reach + 1].mean(1)
        best = int(cover.argmax()) if len(cover) else 0
        return lo + best if len(cover) and cover[best] >= 0.55 else at

    m = own[int(y0 + (y1 - y0) * 0.15) : int(y1 - (y1 - y0) * 0.15)].T
    left, right = side(x0, m, x1 - x0), side(x1, m, x1 - x0)
    m = own[:, int(x0 + (x1 - x0) * 0.15) : int(x1 - (x1 - x0) * 0.15)]
    top, low = side(y0, m, y1 - y0), side(y1, m, y1 - y0)
    if right - left < 0.8 * (x1 - x0) or low - top < 0.8 * (y1 - y0):
        return box
    return {"x": left / w, "y": top / h, "w": (right - left) / w, "h": (low - top) / h}


def single_frames(frames: DataFrame) -> DataFrame:
    """frames (sheet_id, frame_ix, box) without outlines around two others that a gutter divides: each of 20 to 80 % of its area."""
    side = lambda n: frames.select(F.col("sheet_id").alias(f"s{n}"), F.col("frame_ix").alias(f"i{n}"), F.col("box").alias(f"b{n}"))
    within = lambda n: (F.col("sheet_id") == F.col(f"s{n}")) & (F.col(f"i{n}") != F.col("frame_ix")) & G.inside(F.col(f"b{n}"), F.col("box"), 0.006) & (G.area(F.col(f"b{n}")) > 0.2 * G.area(F.col("box"))) & (G.area(F.col(f"b{n}")) < 0.8 * G.area(F.col("box")))
    parts = frames.join(side(1), within(1)).join(side(2), within(2) & (F.col("i1") < F.col("i2")))
    apart = (G.gap_on(F.col("b1"), F.col("b2"), "x") > 0.006) | (G.gap_on(F.col("b1"), F.col("b2"), "y") > 0.006)
    return frames.join(parts.filter(apart).select("sheet_id", "frame_ix").distinct(), ["sheet_id", "frame_ix"], "left_anti")


def seed_blocks(boxes: np.ndarray, limit: int = 60) -> list[dict]:
    """Stacks of lines of read words of one direction: boxes are rows start, end, top, bottom, weight in the frame they read in.

    Words of a line overlap by half, differ in size by 1.8 at most and stand up to 2.5 sizes apart; lines of a stack differ by 1.35,
    stand up to 2.2 sizes apart and overlap by .3. The heaviest `limit` stacks stay, in order.
    """
    if not len(boxes):
        return []

    def link(b: np.ndarray, lap: float, ratio: float, gap: float, line: bool) -> np.ndarray:
        s = Shapes([{"x": r[0], "y": r[2], "w": r[1] - r[0], "h": r[3] - r[2]} for r in b])
        size = s.span("y")
        big, small = np.maximum(size[:, None], size), np.minimum(size[:, None], size)
        a, c = ("x", "y") if line else ("y", "x")
        least = small if line else np.minimum(s.span("x")[:, None], s.span("x"))
        m = (s.lap(c) >= lap * least) & (big <= ratio * small) & (-s.lap(a) <= gap * big)
        np.fill_diagonal(m, True)
        return m

    middle = lambda v: np.sort(v)[len(v) // 2]
    lines = np.array([(boxes[g, 0].min(), boxes[g, 1].max(), middle(boxes[g, 2]), middle(boxes[g, 3]), boxes[g, 4].sum()) for g in groups(link(boxes, 0.5, 1.8, 2.5, True))])
    stacks = [{"start": float(lines[g, 0].min()), "end": float(lines[g, 1].max()), "top": float(lines[g, 2].min()), "bottom": float(lines[g, 3].max()), "lines": len(g), "weight": float(lines[g, 4].sum())} for g in groups(link(lines, 0.3, 1.35, 2.2, False))]
    return sorted(sorted(stacks, key=lambda s: -s["weight"])[:limit], key=lambda s: (s["top"], s["start"]))
