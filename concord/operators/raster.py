"""Pixel operators. Histograms are relational; the rest works on one raster at a time as numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def otsu(histogram: DataFrame) -> DataFrame:
    """threshold of one histogram (v, n; 256 values at most): the value up to which the classes differ most."""
    w, every = W.orderBy("v"), W.orderBy("v").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = lambda c, over: F.sum(c).over(over)
    rows = histogram.select("v", total(F.col("n"), w).alias("w0"), total(F.col("n") * F.col("v"), w).alias("s0"), total(F.col("n"), every).alias("w"), total(F.col("n") * F.col("v"), every).alias("s")).filter("w0 < w")
    rest = F.col("w") - F.col("w0")
    between = F.col("w0") * rest * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / rest, F.lit(2))
    return rows.select(F.col("v").alias("threshold"), between.alias("between")).orderBy(F.desc("between"), "threshold").limit(1)


# ---- one raster at a time: numpy arrays -----------------------------------------------------------


PAPER, DARK, CHROMA = 0, 1, 2


def classify(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each pixel and half its hue in degrees: coloured ink (spread 70, brightest 110), dark ink (brightest below 140, spread below 75) or paper."""
    x = rgb[..., :3].astype(np.int64)
    top, low = x.max(-1), x.min(-1)
    spread = top - low
    kind = np.full(top.shape, PAPER, np.uint8)
    kind[(top < 140) & (spread < 75)] = DARK
    kind[(spread >= 70) & (top >= 110)] = CHROMA
    r, g, b = (x[..., i] for i in range(3))
    d = np.maximum(spread, 1)
    hue = np.where(top == r, ((g - b) / d) % 6, np.where(top == g, (b - r) / d + 2, (r - g) / d + 4)) * 60
    return kind, np.where(kind == CHROMA, hue / 2, 0).astype(np.uint8)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last+1 column of each run of ink."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1]


def components(mask: np.ndarray, diagonal: bool = True) -> list[dict]:
    """Connected components with box and area in reading order of their first run: runs of neighbouring rows are joined by union-find."""
    row, start, end = _runs(mask)
    top = list(range(len(row)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    reach = 1 if diagonal else 0
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] + reach and start[j] < end[i] + reach:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    groups: dict[int, list[int]] = {}
    for i in range(len(row)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for g in groups.values():
        g = np.array(g)
        x, y = int(start[g].min()), int(row[g].min())
        out.append({"x": x, "y": y, "w": int(end[g].max()) - x, "h": int(row[g].max()) - y + 1, "area": int((end[g] - start[g]).sum())})
    return out


def otsu_of(gray: np.ndarray) -> int:
    """The same threshold as otsu() for one grey raster."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(w * (w[-1] - w) * (s / w - (s[-1] - s) / (w[-1] - w)) ** 2)
    return int(between.argmax())


def ink(gray: np.ndarray, contrast: int = 45) -> tuple[np.ndarray, bool] | None:
    """Mask of the print and whether it is light on dark; None when print and ground are too close."""
    t = otsu_of(gray)
    dark = gray <= t
    if dark.all() or not dark.any() or gray[~dark].mean() - gray[dark].mean() < contrast:
        return None
    light_on_dark = dark.mean() > 0.5
    return (~dark if light_on_dark else dark), bool(light_on_dark)


def bands(mask: np.ndarray, least: int = 1, gap: int = 0) -> list[tuple[int, int]]:
    """Ranges of rows with at least `least` inked pixels, joined over gaps of up to `gap` rows."""
    inked = mask.sum(1) >= least
    edge = np.diff(np.pad(inked.astype(np.int8), 1))
    out: list[list[int]] = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if out and a - out[-1][1] <= gap:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(b) for b in out]


def line_areas(mask: np.ndarray, least: int = 1, limit: int = 60) -> list[dict]:
    """Boxes of text lines: bands of rows whose height is .45 to 2.5 of the middle one's."""
    found = bands(mask, least)
    if not found:
        return []
    heights = sorted(b - a for a, b in found)
    typical = heights[len(heights) // 2]
    out = []
    for a, b in found:
        if 0.45 * typical <= b - a <= 2.5 * typical:
            cols = np.flatnonzero(mask[a:b].any(0))
            out.append({"x": int(cols[0]), "y": a, "w": int(cols[-1] - cols[0] + 1), "h": b - a})
    return out[:limit]


def cut(mask: np.ndarray, depth: int = 4, gap: int = 8) -> list[dict]:
    """Recursive cuts along the widest blank rows or columns, to `depth` levels."""

    def part(y: int, x: int, m: np.ndarray, left: int) -> list[dict]:
        rows, cols = np.flatnonzero(m.any(1)), np.flatnonzero(m.any(0))
        if not len(rows):
            return []
        y, x, m = y + int(rows[0]), x + int(cols[0]), m[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]
        if left:
            for axis in (0, 1):
                pieces = bands(m if axis == 0 else m.T, 1, gap - 1)
                if len(pieces) > 1:
                    return [p for a, b in pieces for p in (part(y + a, x, m[a:b], left - 1) if axis == 0 else part(y, x + a, m[:, a:b], left - 1))]
        return [{"x": x, "y": y, "w": m.shape[1], "h": m.shape[0]}]

    return part(0, 0, mask, depth)


def digits_and_marks(mask: np.ndarray) -> dict:
    """Digits and separators of a printed number: separators are small specks low in the line; where a mark stands counts digits before it."""
    parts = sorted(components(mask, diagonal=False), key=lambda p: p["x"])
    if not parts:
        return {"digits": 0, "separators": 0, "mark_after": 0}
    tall = max(p["h"] for p in parts)
    digit = [p for p in parts if p["h"] >= 0.6 * tall]
    marks = [p for p in parts if p["h"] <= 0.42 * tall and p["y"] + p["h"] >= max(d["y"] + d["h"] for d in digit) - 0.3 * tall]
    after = sum(d["x"] < marks[0]["x"] for d in digit) if len(marks) == 1 else 0
    return {"digits": len(digit), "separators": len(marks), "mark_after": after}


def visible_height(mask: np.ndarray) -> int:
    """The longest unbroken range of inked rows."""
    return max((b - a for a, b in bands(mask)), default=0)


def scan_ean13(gray: np.ndarray, wanted: str | None = None, rows: int = 24) -> str | None:
    """A code read along scan lines: 95 modules sampled between the outermost bars; the wanted one is preferred, then the most frequent."""
    found: dict[str, int] = {}
    for y in np.unique(np.linspace(0, gray.shape[0] - 1, rows).astype(int)):
        for line in (gray[y], gray[y][::-1]):
            line = line.astype(int)
            if line.max() - line.min() < 60:
                continue
            dark = line < (line.max() + line.min()) / 2
            at = np.flatnonzero(dark)
            width = (at[-1] - at[0] + 1) / 95
            if width < 1:
                continue
            bits = "".join("01"[int(dark[int(at[0] + (k + 0.5) * width)])] for k in range(95))
            if (code := decode_ean13(bits)) is not None:
                found[code] = found.get(code, 0) + 1
    return wanted if wanted in found else max(found, key=lambda c: (found[c], c), default=None)


def decode_ean13(bits: str) -> str | None:
    """The Column function's rules, for a single string."""
    from concord.functions.fixed import EAN_LEFT, EAN_PARITY

    right = ["".join("10"[int(b)] for b in p) for p in EAN_LEFT]
    even = [p[::-1] for p in right]
    if len(bits) != 95 or bits[:3] != "101" or bits[-3:] != "101" or bits[45:50] != "01010":
        return None
    left = [bits[3 + 7 * i : 10 + 7 * i] for i in range(6)]
    code = "".join("L" if c in EAN_LEFT else "G" if c in even else "?" for c in left)
    last = [bits[50 + 7 * i : 57 + 7 * i] for i in range(6)]
    if code not in EAN_PARITY or any(c not in right for c in last):
        return None
    d = [EAN_PARITY.index(code), *(EAN_LEFT.index(c) if p == "L" else even.index(c) for c, p in zip(left, code)), *map(right.index, last)]
    return "".join(map(str, d)) if (10 - sum(x * (3 if i % 2 else 1) for i, x in enumerate(d[:12])) % 10) % 10 == d[12] else None


def frames(rgb: np.ndarray, least: float = 0.2, limit: int = 8) -> list[dict]:
    """Rectangles drawn in coloured ink, largest first, as fractions of the page: components of coloured ink that are
    hollow, cover both sides of their box, and take `least` of the page's width or height; near copies are left out."""
    kind, _ = classify(rgb)
    h, w = kind.shape
    out: list[dict] = []
    for c in sorted(components(kind == CHROMA), key=lambda c: -c["w"] * c["h"]):
        if c["w"] < least * w or c["h"] < least * h or c["area"] > 0.5 * c["w"] * c["h"]:
            continue
        m = kind[c["y"] : c["y"] + c["h"], c["x"] : c["x"] + c["w"]] == CHROMA
        sides = (m[:, : max(1, c["w"] // 20)].any(1).mean(), m[:, -max(1, c["w"] // 20) :].any(1).mean(), m[: max(1, c["h"] // 20)].any(0).mean(), m[-max(1, c["h"] // 20) :].any(0).mean())
        if min(sides) < 0.55:
            continue
        box = {"x": c["x"] / w, "y": c["y"] / h, "w": c["w"] / w, "h": c["h"] / h}
        if not any(all(abs(box[k] - o[k]) < 0.02 for k in "xywh") for o in out):
            out.append(box)
    return out[:limit]


def per_raster(rasters: DataFrame, key: str, function, schema: str) -> DataFrame:
    """function(gray or rgb array) -> list of dicts, for each raster (key, width, height, data: RGBA bytes), one at a time."""
    import pandas as pd

    kind = rasters.schema[key].dataType.simpleString()
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for b in batches:
            for k, w, h, data in zip(b[key], b["width"], b["height"], b["data"]):
                found = function(np.frombuffer(data, np.uint8).reshape(h, w, 4))
                yield pd.DataFrame([{key: k, **f} for f in found], columns=[key, *names])

    return rasters.select(key, "width", "height", "data").mapInPandas(run, f"{key} {kind}, {schema}")
