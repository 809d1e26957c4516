"""Readings and areas by where they stand on the sheet: clusters, corroboration, areas to read again, amounts with their captions.

Rows meet inside one sheet, by equal keys first and a range predicate after; the two rules that depend on the order
of a page's own rows (first-fit clusters, lines taken once) are grouped maps of one page and direction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import fixed as X
from concord.functions import geometry as G
from concord.functions import quantity as Q
from concord.functions import text as T

from . import readings

CAPTION = r"(?iu)^(?:об[ъь]?[её]м|масса|нетто|количество)$"
AREA_CAPTION = r"(?iu)^(?:об[ъь]?[её]м|масса(?: нетто)?)$"
NUTRITION = "(?iu)^(?:на|продукта|ценность|ценности|углеводы|белки|жиры|калорийность)$"
UNIT_WORD = "(?iu)^(?:л|l|мл|ml|кг|kg|г|g)$"


def _renamed(df: DataFrame, mark: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(mark + c) for c in columns))


# ---- several readings of one place -----------------------------------------------------------------


def clustered(words: DataFrame, sheet: str = "sheet_id") -> DataFrame:
    """words with `cluster`: each word joins the cluster whose first box it covers most, by more than .6 of the smaller box, or
    .2 where the cluster has the same value, sizes below 2.5 apart; else it begins one.

    words: sheet, word_ix, rotation, value, box; first-fit in order of word_ix, a page and direction at a time. Boxes are looked up by
    cells of a hundredth of the page.
    """
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in words.schema.fields if f.name in (sheet, "word_ix", "rotation")]

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("word_ix", ignore_index=True)
        cells: dict[tuple[int, int], list[int]] = {}
        first: list[tuple[float, ...]] = []
        values: list[set] = []
        out = []
        for value, x, y, w, h in zip(b["value"], b["x"], b["y"], b["w"], b["h"]):
            cx, cy = int(np.floor((x + w / 2) * 100)), int(np.floor((y + h / 2) * 100))
            best, most = None, 0.0
            for k in (k for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in cells.get((cx + dx, cy + dy), ())):
                a = first[k]
                lap = max(0.0, min(a[0] + a[2], x + w) - max(a[0], x)) * max(0.0, min(a[1] + a[3], y + h) - max(a[1], y)) / (min(a[2] * a[3], w * h) or 1)
                if lap > most and (lap > 0.6 or (lap > 0.2 and value in values[k])) and max(a[2], w) < 2.5 * min(a[2], w) and max(a[3], h) < 2.5 * min(a[3], h):
                    best, most = k, lap
            if best is None:
                best = len(first)
                first.append((x, y, w, h))
                values.append(set())
                cells.setdefault((cx, cy), []).append(best)
            values[best].add(value)
            out.append(best)
        return pd.DataFrame({sheet: b[sheet], "word_ix": b["word_ix"], "rotation": b["rotation"], "cluster": np.array(out, np.int64)})

    rows = words.select(sheet, "word_ix", "rotation", "value", *(F.col(f"box.{k}").alias(k) for k in "xywh"))
    found = rows.groupBy(sheet, "rotation").applyInPandas(run, ", ".join(kept) + ", cluster long")
    return words.join(found, [sheet, "word_ix", "rotation"])


def consensus(words: DataFrame, sheet: str = "sheet_id") -> DataFrame:
    """sheet, rotation, cluster, value, support, confidence, conflict, box: the best reading of each place of the page, found by its boxes.
    words: as for clustered, with pass and confidence. Very weak readings (below 20) do not count."""
    sure = words.filter((F.coalesce("confidence", F.lit(100.0)) >= X.FLOOR_CONSENSUS) & F.col("box").isNotNull())
    rows = clustered(sure, sheet)
    best = readings.consensus(rows, [sheet, "rotation", "cluster"], "value", "pass", "confidence")
    place = rows.groupBy(sheet, "rotation", "cluster").agg(F.min_by("box", "word_ix").alias("box"))
    return best.join(place, [sheet, "rotation", "cluster"])


def unsettled(tokens: DataFrame, conflicts: DataFrame) -> DataFrame:
    """tokens (sheet_id, value, pass, box, ...) with `uncertain`: a number at the place of a conflict of numbers; a bar code's digits stay."""
    c = _renamed(conflicts, "_", "sheet_id", "box").distinct()
    at = (F.col("sheet_id") == F.col("_sheet_id")) & G.same_place(F.col("box"), F.col("_box"))
    number = F.col("value").rlike(r"^-?\d") & (F.col("pass") != "barcode")
    hit = tokens.filter(number).join(c, at, "left_semi").withColumn("uncertain", F.lit(True))
    rest = tokens.join(hit.select("sheet_id", "token_ix"), ["sheet_id", "token_ix"], "left_anti").withColumn("uncertain", F.lit(False))
    return hit.unionByName(rest)


def exact_places(rules: DataFrame, tokens: DataFrame, label: Column | None = None) -> DataFrame:
    """sheet_id, rule_id, pass, from_ix, score: the best place where a rule's tokens stand one after the other.

    rules: sheet_id, rule_id, tokens. tokens: sheet_id, pass, ix (without gaps in a pass), value, confidence (80 if missing), box. The best has
    the highest mean confidence, 200 more if all of it is inside the label, 1 more for a bar code, .1 for plain reading against consensus.
    A place is found by the rule's first token, then checked in whole: no pass is joined with all rules.
    """
    lists = tokens.groupBy("sheet_id", "pass").agg(F.sort_array(F.collect_list(F.struct("ix", "value", F.coalesce("confidence", F.lit(80.0)).alias("c"), "box"))).alias("t"))
    starts = tokens.select("sheet_id", "pass", F.col("ix").alias("from_ix"), F.col("value").alias("first"))
    r = rules.filter(F.size("tokens") > 0).select("sheet_id", "rule_id", "tokens", F.get("tokens", F.lit(0)).alias("first"))
    pairs = starts.join(r, ["sheet_id", "first"]).join(lists, ["sheet_id", "pass"])
    part = F.slice("t", F.col("from_ix") - F.get("t", F.lit(0))["ix"] + 1, F.size("tokens"))
    pairs = pairs.withColumn("part", part).filter(F.transform("part", lambda x: x["value"]) == F.col("tokens"))
    mean = F.aggregate("part", F.lit(0.0), lambda s, x: s + x["c"]) / F.size("part")
    within = F.lit(0.0) if label is None else F.when(F.forall("part", lambda x: G.inside(x["box"], label, 0.003)), 200.0).otherwise(0.0)
    kind = F.when(F.col("pass") == "barcode", 1.0).when(F.col("pass").startswith("consensus"), 0.0).otherwise(0.1)
    scored = pairs.withColumn("score", mean + within + kind)
    best = scored.groupBy("sheet_id", "rule_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "pass", "from_ix")).alias("b"))
    return best.select("sheet_id", "rule_id", "b.pass", "b.from_ix", (-F.col("b.s")).alias("score"))


def fused(first: DataFrame, second: DataFrame, letter: float = 1.5) -> DataFrame:
    """sheet_id, rule_id, ix, outcome of each step of the first engine's alignment, by what the second reads at that place.

    first: sheet_id, rule_id, ix, token_ix (null for an extra word), kind, expected, actual, confidence, anchored, box (null if missing).
    second: sheet_id, rule_id, token_ix, kind, confidence, box, and extra_after where it reads a word between this token and the next. The place of a step lies between its nearest equal steps, `letter` letters
    wider. Where the second surely has the expected token there, a gap held to be empty is contradicted, a sure other
    reading disputed, anything else resolved; a weak extra word goes where the second surely has both neighbours; all else stays open.
    """
    w = W.partitionBy("sheet_id", "rule_id").orderBy("ix")
    same = F.when(F.col("kind") == "same", F.col("box"))
    rows = first.withColumn("_b", F.last(same, True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("_a", F.first(same, True).over(w.rowsBetween(1, W.unboundedFollowing)))
    rows = rows.withColumn("_left", F.last("token_ix", True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    near = F.filter(F.array("_b", "_a", F.when(F.col("kind") != "missing", F.col("box"))), lambda b: b.isNotNull())
    pad = letter * G.upper_median(F.transform(near, lambda b: F.least(b["w"], b["h"])), 0.0)
    u = G.bounds_of(near)
    rows = rows.withColumn("_area", F.when(F.size(near) > 0, G.box(u["x"] - pad, u["y"] - pad, u["w"] + 2 * pad, u["h"] + 2 * pad)))
    seen = second.select("sheet_id", "rule_id", F.col("token_ix").alias("_t"), ((F.col("kind") == "same") & (F.coalesce("confidence", F.lit(0.0)) >= X.FLOOR_SURE)).alias("_sure"), F.col("box").alias("_seen"))
    key = F.coalesce("token_ix", "_left")
    after = seen.select("sheet_id", "rule_id", (F.col("_t") - 1).alias("_t"), F.col("_sure").alias("_next"))
    if "extra_after" in second.columns:
        more = second.filter("extra_after").select("sheet_id", "rule_id", F.col("token_ix").alias("_t"))
        after = after.join(more, ["sheet_id", "rule_id", "_t"], "left_anti")
    rows = rows.withColumn("_t", key).join(seen, ["sheet_id", "rule_id", "_t"], "left").join(after, ["sheet_id", "rule_id", "_t"], "left")
    there = F.coalesce(F.col("_sure") & F.col("_seen").isNotNull() & F.col("_area").isNotNull() & (G.shared(F.col("_seen"), F.col("_area")) > 0), F.lit(False))
    numbers = F.coalesce(F.col("expected"), F.lit("")).rlike(r"\d") & F.coalesce(F.col("actual"), F.lit("")).rlike(r"\d")
    c = F.coalesce("confidence", F.lit(0.0))
    strong = (F.col("kind") == "replace") & ((c >= X.FLOOR_USABLE) | ((c >= 50) & numbers))
    outcome = (
        F.when(F.col("kind") == "same", "same").when(F.col("kind") == "extra", F.when((c < X.FLOOR_USABLE) & there & F.coalesce("_next", F.lit(False)), "resolved").otherwise("open"))
        .when(~there, "open").when(F.coalesce("anchored", F.lit(False)), "contradicted").when(strong, "disputed").otherwise("resolved")
    )
    return rows.select("sheet_id", "rule_id", "ix", outcome.alias("outcome"))


def one_direction(words: DataFrame) -> DataFrame:
    """words (sheet_id, word_ix, rotation, confidence, box) without those over which, by half of the smaller box, a surer (then larger, then earlier) word of another direction stands."""
    o = _renamed(words, "_", "sheet_id", "word_ix", "rotation", "confidence", "box")
    mine, other = F.struct(F.col("confidence"), G.area(F.col("box")), -F.col("word_ix")), F.struct(F.col("_confidence"), G.area(F.col("_box")), -F.col("_word_ix"))
    over = G.shared(F.col("box"), F.col("_box")) > 0.5 * F.least(G.area(F.col("box")), G.area(F.col("_box")))
    return words.join(o, (F.col("sheet_id") == F.col("_sheet_id")) & (F.col("rotation") != F.col("_rotation")) & over & (other > mine), "left_anti")


def taken_once(lines: DataFrame) -> DataFrame:
    """lines (sheet_id, line_ix, rotation, box) without those that an earlier kept line of their direction covers by half of the shorter side on both axes."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("line_ix", ignore_index=True)
        kept: list[int] = []
        v = b[["x", "y", "w", "h"]].to_numpy(float)
        for i, (x, y, w, h) in enumerate(v):
            k = v[kept]
            lap_x = np.minimum(k[:, 0] + k[:, 2], x + w) - np.maximum(k[:, 0], x)
            lap_y = np.minimum(k[:, 1] + k[:, 3], y + h) - np.maximum(k[:, 1], y)
            if not ((lap_x > 0.5 * np.minimum(k[:, 2], w)) & (lap_y > 0.5 * np.minimum(k[:, 3], h))).any():
                kept.append(i)
        return b.loc[kept, ["sheet_id", "line_ix", "rotation"]]

    rows = lines.select("sheet_id", "line_ix", "rotation", *(F.col(f"box.{k}").alias(k) for k in "xywh"))
    keys = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in ("sheet_id", "line_ix", "rotation"))
    return rows.groupBy("sheet_id", "rotation").applyInPandas(run, keys)


def across(areas: DataFrame, words: DataFrame) -> DataFrame:
    """sheet_id, area_ix, word_ix, text, confidence of words of another direction over an area, surely read (80) and read alike, at that place, by another pass (50).

    areas: sheet_id, area_ix, rotation, box. words: sheet_id, word_ix, pass, rotation, text, confidence, box.
    """
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}%]", "")
    w = words.withColumn("said", F.when(plain != "", plain).otherwise(F.trim("text")))
    o = _renamed(w.filter(F.coalesce("confidence", F.lit(0.0)) >= 50), "_", "sheet_id", "pass", "rotation", "said", "box")
    b, p = F.col("box"), F.col("_box")
    both = (G.overlap_on(b, p, "x") > 0.5 * F.least(b["w"], p["w"])) & (G.overlap_on(b, p, "y") > 0.5 * F.least(b["h"], p["h"]))
    again = (F.col("sheet_id") == F.col("_sheet_id")) & (F.col("said") == F.col("_said")) & (F.col("rotation") == F.col("_rotation")) & (F.col("pass") != F.col("_pass")) & both
    sure = w.filter((F.coalesce("confidence", F.lit(0.0)) >= X.FLOOR_SURE) & (F.trim("text") != "")).join(o, again, "left_semi")
    a = _renamed(areas, "_", "sheet_id", "area_ix", "rotation", "box")
    hit = (F.col("sheet_id") == F.col("_sheet_id")) & (F.col("rotation") != F.col("_rotation")) & (G.shared(b, p) > 0)
    return sure.join(a, hit).select("sheet_id", F.col("_area_ix").alias("area_ix"), "word_ix", F.trim("text").alias("text"), "confidence")


# ---- frames, areas ---------------------------------------------------------------------------------


def fitting_frames(frames: DataFrame, slack: float = 0.03) -> DataFrame:
    """frames whose sides are, within 3 %, those the sheet states; all of a sheet's frames where none is. frames: sheet_id, frame_ix, width, height (mm), long, short (stated, or null)."""
    near = lambda side, stated: F.abs(side - stated) <= stated * slack
    fits = F.coalesce(near(F.greatest("width", "height"), F.col("long")) & near(F.least("width", "height"), F.col("short")), F.lit(False))
    rows = frames.withColumn("_fits", fits).withColumn("_any", F.max("_fits").over(W.partitionBy("sheet_id")))
    return rows.filter(F.col("_fits") | ~F.col("_any")).drop("_fits", "_any")


def best_orientation(scores: DataFrame) -> DataFrame:
    """sheet_id, region_ix, rotation, score, has_contour: the region read best upright; if all score 0, the first region and turn that
    scores, the turns of one region before the next; the whole page, without a contour, if none does.

    scores: sheet_id, region_ix, rotation, score (sum of coverage over the rules).
    """
    upright = F.when(F.col("rotation") == 0, F.struct((-F.col("score")).alias("s"), "region_ix", "rotation"))
    turned = F.when((F.col("rotation") != 0) & (F.col("score") > 0), F.struct("region_ix", "rotation", "score"))
    rows = scores.groupBy("sheet_id").agg(F.min(upright).alias("u"), F.sort_array(F.collect_list(turned)).alias("t"))
    # of each region only its first turn that scores counts; the best of these wins, the first on ties
    firsts = F.filter("t", lambda x: ~F.exists(F.filter("t", lambda y: (y["region_ix"] == x["region_ix"]) & (y["rotation"] < x["rotation"])), lambda _: F.lit(True)))
    best = F.array_min(F.transform(firsts, lambda x: F.struct((-x["score"]).alias("s"), x["region_ix"].alias("region_ix"), x["rotation"].alias("rotation"))))
    chosen = F.when(F.col("u.s") < 0, F.col("u")).otherwise(best)
    rows = rows.withColumn("c", chosen)
    return rows.select("sheet_id", F.col("c.region_ix").alias("region_ix"), F.coalesce("c.rotation", F.lit(0)).alias("rotation"), F.coalesce(-F.col("c.s"), F.lit(0)).alias("score"), F.col("c").isNotNull().alias("has_contour"))


def _unturned(b: Column, rotation: Column, aspect: Column) -> Column:
    """A box in reading terms back on the page, in fractions, cut at its edges."""
    x, y, w, h = (b[k] for k in "xywh")
    r = (
        F.when(rotation == 90, G.box(y / aspect, 1 - x - w, h / aspect, w)).when(rotation == 180, G.box(1 - (x + w) / aspect, 1 - y - h, w / aspect, h))
        .when(rotation == 270, G.box(1 - (y + h) / aspect, x, h / aspect, w)).otherwise(G.box(x / aspect, y, w / aspect, h))
    )
    left, top = F.greatest(F.lit(0.0), r["x"]), F.greatest(F.lit(0.0), r["y"])
    return G.box(left, top, F.least(F.lit(1.0), r["x"] + r["w"]) - left, F.least(F.lit(1.0), r["y"] + r["h"]) - top)


def quantity_areas(words: DataFrame, label: Column | None = None, limit: int = 6) -> DataFrame:
    """sheet_id, area_ix, rotation, box: where an amount may stand, below and right of each surely read caption, in its direction; near copies (.003) once, `limit` a sheet.

    words: sheet_id, word_ix, text, confidence, rotation, aspect, box.
    """
    a = words.filter((F.coalesce("confidence", F.lit(0.0)) >= X.FLOOR_SURE) & F.trim("text").rlike(AREA_CAPTION))
    if label is not None:
        a = a.filter(G.inside(F.col("box"), label))
    aspect = F.when(F.col("rotation") == 0, 1.0).otherwise(F.coalesce("aspect", F.lit(1.0)))
    b = G.turned(F.col("box"), F.col("rotation"), aspect)
    below = G.box(b["x"] - b["h"] * 0.2, b["y"] + b["h"], b["w"] + b["h"] * 0.4, b["h"] * 2.35)
    right = G.box(b["x"] + b["w"], b["y"] - b["h"] * 0.5, b["w"] * 1.5, b["h"] * 2.1)
    rows = a.select("sheet_id", "rotation", "word_ix", aspect.alias("aspect"), F.posexplode(F.array(below, right)).alias("side", "r"))
    rows = rows.select("sheet_id", "rotation", (F.col("word_ix") * 2 + F.col("side")).alias("ix"), _unturned(F.col("r"), F.col("rotation"), F.col("aspect")).alias("box")).filter("box.w > 0 AND box.h > 0")
    if label is not None:
        rows = rows.filter(G.inside(F.col("box"), label))
    flat = rows.select("sheet_id", "rotation", "ix", "box", *(F.col(f"box.{k}").alias(k) for k in "xy"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
    once = readings.distinct_boxes(flat, ["sheet_id"], "ix", 0.003)
    rank = F.row_number().over(W.partitionBy("sheet_id").orderBy("ix"))
    return once.withColumn("area_ix", rank).filter(F.col("area_ix") <= limit).select("sheet_id", "area_ix", "rotation", "box")


def number_areas(areas: DataFrame, words: DataFrame) -> DataFrame:
    """sheet_id, area_ix, word_ix, box: left of the surest unit word inside each upright area lies its number. words: sheet_id, word_ix, text, confidence, box."""
    u = _renamed(words.filter((F.col("confidence") >= X.FLOOR_USABLE) & F.trim("text").rlike(UNIT_WORD)), "_", "sheet_id", "word_ix", "confidence", "box")
    a, b = F.col("box"), F.col("_box")
    inside = (b["x"] > a["x"]) & (b["x"] < a["x"] + a["w"]) & (b["y"] >= a["y"]) & (b["y"] + b["h"] <= a["y"] + a["h"] + 0.001)
    rows = areas.filter("rotation = 0").join(u, (F.col("sheet_id") == F.col("_sheet_id")) & inside)
    best = rows.groupBy("sheet_id", "area_ix").agg(F.min(F.struct((-F.col("_confidence")).alias("c"), "_word_ix", "_box", "box")).alias("m"))
    return best.select("sheet_id", "area_ix", F.col("m._word_ix").alias("word_ix"), G.box(F.col("m.box.x"), F.col("m.box.y"), F.col("m._box.x") - F.col("m.box.x"), F.col("m.box.h")).alias("box"))


# ---- amounts ---------------------------------------------------------------------------------------


def amounts(words: DataFrame) -> DataFrame:
    """sheet_id, pass, ix, size, value, unit, kind, base_value, score, anchored: amounts of one to three neighbouring words of a reading.

    words: sheet_id, pass, ix, text, trust, box (as the text reads), in order. The words stand on one row, at most 1.5 heights apart, in reading
    order, each trusted by 75; no `/` follows; no word of a nutrition table stands within three words, on their row, of their size
    and ten heights away. An amount is anchored when a caption among the four words before it stands left of it on its row.
    """
    w = W.partitionBy("sheet_id", "pass").orderBy("ix")
    row = F.struct("text", "trust", "box")
    rows = words.withColumn("_g", F.collect_list(row).over(w.rowsBetween(0, 2))).withColumn("_p", F.collect_list(row).over(w.rowsBetween(-4, -1))).withColumn("_f", F.collect_list(row).over(w.rowsBetween(1, 6)))
    rows = rows.select("sheet_id", "pass", "ix", "_g", "_p", "_f", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("size")).filter(F.size("_g") >= F.col("size"))
    group = F.slice("_g", F.lit(1), F.col("size"))
    rows = rows.withColumn("_g", group)
    first = F.get("_g", F.lit(0))["box"]
    height = F.array_max(F.transform("_g", lambda x: x["box"]["h"]))
    mid = lambda b: b["y"] + b["h"] / 2
    level = F.forall("_g", lambda x: F.abs(mid(x["box"]) - mid(first)) <= height * 0.6)
    step = F.forall(F.sequence(F.lit(1), F.greatest(F.col("size") - 1, F.lit(1))), lambda i: (F.col("size") == 1) | ((F.get("_g", i)["box"]["x"] - F.get("_g", i - 1)["box"]["x"] - F.get("_g", i - 1)["box"]["w"] <= height * 1.5) & (F.get("_g", i)["box"]["x"] >= F.get("_g", i - 1)["box"]["x"])))
    after = F.coalesce(F.get("_f", F.col("size") - 1)["text"], F.lit(""))
    text = F.array_join(F.transform("_g", lambda x: x["text"]), " ")
    rows = rows.filter(F.forall("_g", lambda x: x["trust"] >= X.FLOOR_USABLE) & level & step & ~after.rlike(r"^\s*/") & text.rlike(r"^\s*\d+[.,]?\d*\s*[\p{L}³\d]+\s*$"))
    rows = rows.withColumn("q", Q.quantities(text)).filter(F.size("q") == 1).withColumn("q", F.get("q", F.lit(0)))

    def table(x: Column) -> Column:
        r = x["box"]
        beside = lambda y: (F.abs(mid(r) - mid(y["box"])) < 0.8 * F.least(r["h"], y["box"]["h"])) & (F.greatest(r["h"], y["box"]["h"]) < 1.8 * F.least(r["h"], y["box"]["h"])) & (F.abs(r["x"] - y["box"]["x"]) < 10 * r["h"])
        return F.regexp_replace(x["text"], "[.,:;()]", "").rlike(NUTRITION) & F.exists("_g", beside)

    # three words on either side, the amount's own among them
    around = F.concat(F.slice("_p", F.greatest(F.size("_p") - 2, F.lit(1)), 3), F.col("_g"), F.slice("_f", F.col("size"), 3))
    rows = rows.filter(~F.exists(around, table))

    def caption(x: Column) -> Column:
        b = x["box"]
        h = F.greatest(first["h"], b["h"])
        return F.trim(x["text"]).rlike(CAPTION) & (F.abs(mid(first) - mid(b)) < h * 0.9) & (first["x"] >= b["x"] + b["w"] - h * 0.5) & (first["x"] - b["x"] - b["w"] < h * 10)

    return rows.select("sheet_id", "pass", "ix", "size", "q.value", "q.unit", "q.kind", "q.base_value", F.array_min(F.transform("_g", lambda x: x["trust"])).alias("score"), F.exists("_p", caption).alias("anchored"))


def check_for(claims: DataFrame, checks: DataFrame) -> DataFrame:
    """claim_ix, check_ix: the size conditions of its rule that a stated dimension speaks for.

    claims: claim_ix, rule_id, title, kind (height, box, percent), gauge (width or null), sign (a square mark), texts (readings of the inscription).
    checks: rule_id, check_ix, label, unit, target, scope. A share goes to the first share; a sign's size to the sign alone, both sides for a box; a height
    to the only size, to an amount's caption or digits, to a date's letters or digits, or to the sentences its subject names.
    """
    item = F.struct("check_ix", "label", "unit", "target", "scope")
    sets = checks.groupBy("rule_id").agg(F.sort_array(F.collect_list(item)).alias("k"))
    c = claims.join(sets, "rule_id")
    sized = F.filter("k", lambda x: x["unit"] == "мм")
    of = lambda test: F.transform(F.filter(sized, test), lambda x: x["check_ix"])
    has = lambda test: F.exists(sized, test)
    none = F.array().cast("array<int>")
    words = T.words(F.col("title"))
    caption = F.exists("texts", lambda t: F.exists(T.words(t), lambda a: F.exists(words, lambda b: T.alike(a, b))))
    amount = F.exists("texts", lambda t: F.size(Q.quantities(t)) > 0)
    letters = F.exists("texts", lambda t: t.rlike(r"\p{L}{3,}"))
    scopes = F.transform("k", lambda x: x["scope"])
    named = F.coalesce(F.get(F.filter(F.transform("texts", lambda t: Q.scope_index(scopes, t)), lambda i: i >= 0), F.lit(0)), F.lit(-1))
    side = F.when(F.coalesce(F.col("gauge"), F.lit("")) == "width", "Ширина").otherwise("Высота")
    chosen = (
        F.when(F.col("kind") == "percent", F.slice(F.transform(F.filter("k", lambda x: x["unit"] == "%"), lambda x: x["check_ix"]), 1, 1)).when(F.size(sized) == 0, none)
        .when(has(lambda x: x["label"].contains("ЕАС")), F.when(~F.col("sign"), none).when(F.col("kind") == "box", of(lambda x: F.lit(True))).otherwise(of(lambda x: x["label"].contains(side))))
        .when(F.col("kind") != "height", none).when(F.size(sized) == 1, of(lambda x: F.lit(True)))
        .when(has(lambda x: x["target"] == "quantity"), of(lambda x: F.when(x["target"] == "quantity_label", caption).otherwise(amount)))
        .when(has(lambda x: x["target"] == "date_label"), of(lambda x: x["target"] == F.when(letters, "date_label").otherwise("date_digits")))
        .otherwise(F.transform(F.filter("k", lambda x, i: (i == named) & (x["unit"] == "мм")), lambda x: x["check_ix"]))
    )
    return c.select("claim_ix", F.explode(chosen).alias("check_ix"))
