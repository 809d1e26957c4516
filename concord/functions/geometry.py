"""Boxes as struct<x, y, w, h>: turning, containing, overlapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INSIDE, SAME_PLACE = 0.002, 0.65


def box(x, y, w, h) -> Column:
    col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(*(col(v).cast("double").alias(n) for v, n in zip((x, y, w, h), "xywh")))


def turned(b: Column, rotation: Column, aspect: Column) -> Column:
    """The page box as its text reads, for turns of 0, 90, 180 and 270 degrees; x in heights of the page."""
    x, y, w, h = (b[k] for k in "xywh")
    return (
        F.when(rotation == 90, box(1 - y - h, x * aspect, h, w * aspect))
        .when(rotation == 180, box((1 - x - w) * aspect, 1 - y - h, w * aspect, h))
        .when(rotation == 270, box(y, (1 - x - w) * aspect, h, w * aspect))
        .otherwise(box(x * aspect, y, w * aspect, h))
    )


def mapped(b: Column, region: Column, width: Column, height: Column, rotation: Column) -> Column:
    """A pixel box in a turned crop (width x height after turning) as fractions of the page, by way of the region cropped."""
    x, y, w, h = (b[k] for k in "xywh")
    flat = (
        F.when(rotation == 90, box(y / height, 1 - (x + w) / width, h / height, w / width))
        .when(rotation == 180, box(1 - (x + w) / width, 1 - (y + h) / height, w / width, h / height))
        .when(rotation == 270, box(1 - (y + h) / height, x / width, h / height, w / width))
        .otherwise(box(x / width, y / height, w / width, h / height))
    )
    return box(region["x"] + flat["x"] * region["w"], region["y"] + flat["y"] * region["h"], flat["w"] * region["w"], flat["h"] * region["h"])


def overlap_on(a: Column, b: Column, axis: str) -> Column:
    size = {"x": "w", "y": "h"}[axis]
    return F.greatest(F.lit(0.0), F.least(a[axis] + a[size], b[axis] + b[size]) - F.greatest(a[axis], b[axis]))


def gap_on(a: Column, b: Column, axis: str) -> Column:
    size = {"x": "w", "y": "h"}[axis]
    return F.greatest(F.lit(0.0), F.greatest(a[axis], b[axis]) - F.least(a[axis] + a[size], b[axis] + b[size]))


def shared(a: Column, b: Column) -> Column:
    return overlap_on(a, b, "x") * overlap_on(a, b, "y")


def area(a: Column) -> Column:
    return a["w"] * a["h"]


def iou(a: Column, b: Column) -> Column:
    s = shared(a, b)
    return F.when(area(a) + area(b) - s > 0, s / (area(a) + area(b) - s)).otherwise(0.0)


def same_place(a: Column, b: Column, least: float = SAME_PLACE) -> Column:
    m = F.least(area(a), area(b))
    return F.when(m > 0, shared(a, b) / m > least).otherwise(False)


def inside(b: Column, label: Column, slack: float = INSIDE) -> Column:
    return (b["x"] >= label["x"] - slack) & (b["y"] >= label["y"] - slack) & (b["x"] + b["w"] <= label["x"] + label["w"] + slack) & (b["y"] + b["h"] <= label["y"] + label["h"] + slack)


def bounds_of(boxes: Column) -> Column:
    """Bounding box of an array of boxes."""
    of = lambda f: F.transform(boxes, f)
    x, y = F.array_min(of(lambda b: b["x"])), F.array_min(of(lambda b: b["y"]))
    return box(x, y, F.array_max(of(lambda b: b["x"] + b["w"])) - x, F.array_max(of(lambda b: b["y"] + b["h"])) - y)


def along(b: Column, rotation: Column) -> Column:
    """struct<from, to, low, high>: the box along and across the direction it reads in."""
    x, y, r, d = b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"]
    make = lambda p, q, s, t: F.struct(p.alias("from"), q.alias("to"), s.alias("low"), t.alias("high"))
    return F.when(rotation == 90, make(y, d, 1 - r, 1 - x)).when(rotation == 180, make(1 - r, 1 - x, 1 - d, 1 - y)).when(rotation == 270, make(1 - d, 1 - y, x, r)).otherwise(make(x, r, y, d))


def upper_median(values: Column, none: float | None = None) -> Column:
    """The middle of the sorted values, the upper of two; never in between."""
    s = F.sort_array(values)
    return F.coalesce(F.get(s, F.floor(F.size(s) / 2).cast("int")), F.lit(none).cast("double"))


def upright_size(width: Column, height: Column, rotation: Column) -> Column:
    """struct<width, height> of a line crop once its text stands upright."""
    aside = rotation % 180 != 0
    return F.struct(F.when(aside, height).otherwise(width).alias("width"), F.when(aside, width).otherwise(height).alias("height"))


def source_pixel(x0: Column, y0: Column, x1: Column, y1: Column, rotation: Column, u: Column, v: Column) -> Column:
    """struct<x, y>: the page pixel under pixel (u, v) of the upright crop of x0..x1, y0..y1."""
    make = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.when(rotation == 90, make(x0 + v, y1 - 1 - u)).when(rotation == 180, make(x1 - 1 - u, y1 - 1 - v)).when(rotation == 270, make(x1 - 1 - v, y0 + u)).otherwise(make(x0 + u, y0 + v))


def unstretched(b: Column, stretch: Column) -> Column:
    """A box read in an image drawn wider by `stretch`, in the image itself."""
    return box(b["x"] / stretch, b["y"], b["w"] / stretch, b["h"])


def turned_quad(x: Column, y: Column, advance: Column, font: Column, angle: Column, width: Column, height: Column) -> Column:
    """Bounding box, in fractions of the page, of a run of text of a text layer: its origin, length, size and direction in page units."""
    corner = lambda a, b: (x + a * F.cos(angle) - b * F.sin(angle), y + a * F.sin(angle) + b * F.cos(angle))
    corners = [corner(a, b) for a in (F.lit(0.0), advance) for b in (F.lit(0.0), -font)]
    xs, ys = F.array(*(c[0] / width for c in corners)), F.array(*(c[1] / height for c in corners))
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
