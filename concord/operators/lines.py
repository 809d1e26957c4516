"""Single lines of print on one raster: crops of one ink, scans along a line, columns of a block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .marks import HUE, hue_gap
from .raster import CHROMA, DARK, classify, ink

# ---- crops of one ink -------------------------------------------------------------------------------


def hue_tone(rgb: np.ndarray, hue: float) -> np.ndarray:
    """Gray of the ink of one hue (half degrees), white elsewhere: the more colour, the darker."""
    x = rgb[..., :3].astype(float)
    spread = x.max(-1) - x.min(-1)
    own = (spread >= 45) & (x.max(-1) >= 110)
    tones = _half_hue(x)
    own &= hue_gap(np.round(tones) % 180, hue) <= HUE + 4
    return np.where(own, np.maximum(0, 255 - (spread - 40) * 2.2), 255.0)


def _half_hue(x: np.ndarray) -> np.ndarray:
    top, low = x.max(-1), x.min(-1)
    d = np.maximum(top - low, 1e-9)
    r, g, b = (x[..., i] for i in range(3))
    return np.where(top == r, ((g - b) / d) % 6, np.where(top == g, (b - r) / d + 2, (r - g) / d + 4)) * 30


def dark_tone(rgb: np.ndarray) -> np.ndarray:
    """Gray of dark ink, white where the pixel has a colour."""
    x = rgb[..., :3].astype(float)
    top = x.max(-1)
    return np.where(top - x.min(-1) >= 90, 255.0, np.clip((top - 35) * 1.7, 0, 255))


def ink_crop(tone: np.ndarray, scale: float = 1.0, stretch: float = 1.0, rotation: int = 0, pad: int = 0, only: list[dict] | None = None) -> np.ndarray:
    """A gray crop enlarged by bilinear sampling at pixel centres, turned clockwise until its text stands upright, on a white margin.
    only: boxes (x, y, w, h) outside of which all is paper."""
    gray = tone.astype(float)
    if only is not None:
        keep = np.zeros(gray.shape, bool)
        for b in only:
            keep[b["y"] : b["y"] + b["h"], b["x"] : b["x"] + b["w"]] = True
        gray = np.where(keep, gray, 255.0)
    for axis, by in ((0, scale), (1, scale * stretch)):
        n = gray.shape[axis]
        at = np.clip((np.arange(max(1, round(n * by))) + 0.5) / by - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        share = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        gray = np.take(gray, low, axis) * (1 - share) + np.take(gray, np.minimum(n - 1, low + 1), axis) * share
    upright = np.rot90(gray, {0: 0, 90: -1, 180: 2, 270: 1}[rotation])
    return np.pad(np.rint(upright).astype(np.uint8), pad, constant_values=255)


# ---- scans along a line -----------------------------------------------------------------------------


class Band:
    """Rows low..high of a raster whose lines run along its columns; of vertical lines the raster is transposed first."""

    def __init__(self, rgb: np.ndarray, low: int, high: int, vertical: bool = False, tone: float = 0.0):
        kind, hue = classify(rgb)
        if vertical:
            kind, hue = kind.T, hue.T
        self.low, self.high = max(0, low), min(kind.shape[0], high)
        self.dark = kind == DARK
        own = kind[self.low : self.high]
        self.inked = self.dark[self.low : self.high].any(0)
        self.barred = ((own == CHROMA) & (hue_gap(hue[self.low : self.high], tone) <= HUE)).any(0)

    def first_ink(self, start: int, step: int, reach: int) -> tuple[int, int] | None:
        """Place and distance of the first inked column that ink follows within two columns."""
        n = len(self.inked)
        for gap in range(reach + 1):
            a = start + gap * step
            if not 0 <= a < n:
                return None
            if self.inked[a] and any(0 <= a + k * step < n and self.inked[a + k * step] for k in (1, 2)):
                return a, gap
        return None

    def follow(self, start: int, step: int, gap: int) -> int:
        """The last inked column of a line: it ends at a blank of more than `gap` columns, at another callout's ink, or where, after more
        than a word space, what comes next is lower than half of the band or runs far out of it."""
        size = self.high - self.low
        word, last, empty = max(3, round(0.6 * size)), start, 0
        a, n = start, len(self.inked)
        while 0 <= a < n:
            if not self.inked[a]:
                empty += 1
                if self.barred[a] or empty > gap:
                    break
            else:
                if empty > word and not self._goes_on(a, step, size):
                    break
                last, empty = a, 0
            a += step
        return last

    def _goes_on(self, a: int, step: int, size: int) -> bool:
        ahead = max(3, int(np.ceil(size * 0.5)))
        cols = [c for c in (a + k * step for k in range(ahead)) if 0 <= c < len(self.inked)]
        rows = np.flatnonzero(self.dark[self.low : self.high, cols].any(1))
        above, below = self.dark[max(0, self.low - size) : self.low, cols][::-1], self.dark[self.high : self.high + size, cols]
        edge = (self.dark[self.low, cols], self.dark[self.high - 1, cols])
        # unbroken ink that leaves the band through an inked edge pixel
        run = lambda m, e: int((np.logical_and.accumulate(m, 0) & e).sum(0).max(initial=0)) if m.size else 0
        return len(rows) > 0 and rows[-1] - rows[0] >= 0.5 * size and max(run(above, edge[0]), run(below, edge[1])) <= 0.6 * size

    def line(self, hit: int, step: int, gap: int, most: int) -> dict:
        """Box (along, across) of the line met at `hit`: followed on, back over a third of the gap, then widened over inked rows by up to `most`."""
        ends = sorted((self.follow(hit, step, gap), self.follow(hit, -step, max(2, round(gap * 0.35)))))
        rows = self.dark[:, ends[0] : ends[1] + 1].any(1)
        low, high = self.low, self.high
        while low > 0 and self.low - low < most and rows[low - 1]:
            low -= 1
        while high < len(rows) and high - self.high < most and rows[high]:
            high += 1
        return {"from": ends[0], "to": ends[1] + 1, "low": low, "high": high}


# ---- lines of a block -------------------------------------------------------------------------------


def columns(gray: np.ndarray, size: float, n_lines: int) -> list[tuple[int, int]]:
    """Ranges of columns of a block between gutters: blank for .45 of a letter in blocks of six lines, for a letter from three lines, never below."""
    found = ink(gray)
    if found is None:
        return []
    inked = found[0].sum(0) > max(1, gray.shape[0] * 0.004)
    least = size * 0.45 if n_lines >= 6 else size if n_lines >= 3 else np.inf
    at = np.flatnonzero(inked)
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > least)
    return [(int(a), int(b) + 1) for a, b in zip(at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]])]


# ---- how well heights can be measured ---------------------------------------------------------------


def height_errors(trials: DataFrame, step: float) -> DataFrame:
    """height, bias and rms error, in mm, of three ways to measure a bar of that height whose edges fall anywhere on the raster.

    trials: height (mm), phase (0 to 1, where in a pixel the bar begins). Pixels of `step` mm hold the share of ink over them: whole counts those half
    inked or more; fine does so on a raster of a quarter of the pixel; gray adds up the shares, rounded to 1/255 as a gray value is.
    """
    end = F.col("phase") + F.col("height") / step
    pixels = F.sequence(F.lit(0), F.ceil(end).cast("int"))
    share = lambda size: F.transform(pixels if size == 1 else F.sequence(F.lit(0), F.ceil(end / size).cast("int")), lambda i: F.greatest(F.lit(0.0), F.least(end, (i + 1) * size) - F.greatest(F.col("phase"), i * size)) / size)
    count = lambda size: F.size(F.filter(share(size), lambda s: s >= 0.5)) * size * step
    gray = F.aggregate(F.transform(share(1.0), lambda s: F.floor(s * 255 + 0.5) / 255), F.lit(0.0), lambda a, s: a + s) * step
    rows = trials.select("height", *((m - F.col("height")).alias(n) for n, m in (("whole", count(1.0)), ("fine", count(0.25)), ("gray", gray))))
    return rows.groupBy("height").agg(*(f.alias(f"{n}_{k}") for n in ("whole", "fine", "gray") for k, f in (("bias", F.avg(n)), ("rms", F.sqrt(F.avg(F.col(n) * F.col(n)))))))
