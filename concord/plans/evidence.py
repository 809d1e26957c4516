"""Evidence beside the first reading: a second engine's tokens, places looked at again, other codes, dates.

found, wherever it is asked for: sheet_id, rule_id, exact, coverage, diff, boxes, steps (one row for each step of the alignment: kind, expected,
actual, confidence, box, turn) and aspect, as `assess.located` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import geometry as G
from concord.functions import quantity as Q
from concord.functions import text as T
from concord.operators import layout, places

DATE = "(?iu)окно.*дат"
#: Fixed values of the ranking of codes: a caption word seen, a figure of the code; how far back captions are looked for.
ANCHOR, FIGURE, BACK = 100, 2, 80
_KEY = ["sheet_id", "rule_id"]


def _boxed(c: str = "boxes") -> Column:
    return F.filter(c, lambda b: b.isNotNull())


def unfused(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.lit(0) for c in ("resolved", "contradicted", "disputed")})


def _steps(found: DataFrame) -> DataFrame:
    """sheet_id, rule_id, ix, token_ix (null for an extra word) and the parts of each step."""
    rows = found.select(*_KEY, F.posexplode("steps").alias("ix", "s")).select(*_KEY, "ix", "s.*")
    extra = F.col("kind") == "extra"
    n = F.sum(F.when(extra, 0).otherwise(1)).over(W.partitionBy(*_KEY).orderBy("ix"))
    return rows.withColumn("token_ix", F.when(~extra, n - 1).cast("int"))


def fused(first: DataFrame, second: DataFrame, rules: DataFrame) -> DataFrame:
    """first with its differences as a second engine's reading of the same place leaves them, and how many steps that resolved, contradicted, disputed.

    Token by token, each engine errs in its own places: a difference goes if the second surely has every expected token there; a gap held
    to be empty is no longer, if it reads something of it there; a sure other reading becomes uncertain. Amounts and dates are left alone. Both must cover half of
    the smaller of their places and have the same tokens.
    """
    texts = rules.filter(~Q.is_quantity_title(F.col("title")) & ~F.col("title").rlike(DATE)).select(*_KEY)
    tokens = lambda c: F.size(F.filter(c, lambda s: s["kind"] != "extra"))
    one = first.filter(~F.col("exact") & (F.size("diff") > 0)).join(texts, _KEY, "left_semi").select(*_KEY, "steps", "diff", G.bounds_of(_boxed()).alias("_a"), tokens("steps").alias("_n"))
    two = second.filter(~F.col("notation")).select(*_KEY, F.col("steps").alias("_steps"), G.bounds_of(_boxed()).alias("_b"), tokens("steps").alias("_m"))
    a, b = F.col("_a"), F.col("_b")
    both = one.join(two, _KEY).filter((F.col("_n") == F.col("_m")) & a["x"].isNotNull() & b["x"].isNotNull() & (G.shared(a, b) >= 0.5 * F.least(G.area(a), G.area(b))))
    mine = _steps(both).withColumn("_i", F.col("ix"))
    gaps = both.select(*_KEY, F.explode(F.filter("diff", lambda d: d["anchored"] & d["first"].isNotNull())).alias("d")).select(*_KEY, F.explode(F.sequence("d.first", "d.last")).alias("ix"), F.lit(True).alias("anchored")).distinct()
    mine = mine.join(gaps, [*_KEY, "ix"], "left").withColumn("anchored", F.coalesce("anchored", F.lit(False)))
    theirs = _steps(both.select(*_KEY, F.col("_steps").alias("steps")))
    after = F.coalesce(F.lead("kind").over(W.partitionBy(*_KEY).orderBy("ix")) == "extra", F.lit(False))
    theirs = theirs.withColumn("extra_after", after).filter("token_ix IS NOT NULL")
    outcome = places.fused(mine, theirs)
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    told = outcome.groupBy(*_KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("ix", "outcome"))), lambda x: x["outcome"]).alias("_o"), n("resolved"), n("contradicted"), n("disputed"))
    rows = first.join(told, _KEY, "left")

    def judged(d: Column) -> Column:
        part = F.slice("_o", d["first"] + 1, d["last"] - d["first"] + 1)
        has = lambda o: F.coalesce(F.array_contains(part, o), F.lit(False))
        doubt = (d["kind"] == "replace") & has("disputed")
        return F.struct(
            F.when(doubt, "uncertain").otherwise(d["kind"]).alias("kind"), d["expected"].alias("expected"), d["actual"].alias("actual"), F.when(doubt, 0.0).otherwise(d["confidence"]).alias("confidence"),
            (d["anchored"] & ~has("contradicted")).alias("anchored"), d["first"].alias("first"), d["last"].alias("last"),
            F.coalesce(F.forall(part, lambda o: o.isin("resolved", "same")), F.lit(False)).alias("gone"),
        )

    kind = first.schema["diff"].dataType
    left = F.transform(F.filter(F.transform("diff", judged), lambda d: ~d["gone"]), lambda d: d.dropFields("gone")).cast(kind)
    rows = rows.withColumn("_d", F.when(F.col("_o").isNull(), F.col("diff")).otherwise(left))
    clear = F.col("_o").isNotNull() & (F.size("_d") == 0)
    rows = rows.withColumn("exact", F.col("exact") | clear).withColumn("coverage", F.when(clear, 100).otherwise(F.col("coverage"))).withColumn("diff", F.col("_d"))
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("resolved", "contradicted", "disputed")}).drop("_o", "_d")


def edges(found: DataFrame) -> DataFrame:
    """sheet_id, rule_id, side, rotation, expected, areas: where words of the requirement before the first read word, or after the last one, would stand.

    Something read there, however badly, is a reading to compare, not a gap.
    """
    kinds = F.transform("steps", lambda s: s["kind"])
    rows = found.filter(~F.col("exact")).withColumn("_f", F.array_position(kinds, "same").cast("int")).filter("_f > 0")
    rows = rows.withColumn("_l", (F.size("steps") + 1 - F.array_position(F.reverse(kinds), "same")).cast("int"))
    ends = F.array(
        F.struct(F.lit("leading").alias("side"), F.slice("steps", F.lit(1), F.col("_f") - 1).alias("beyond"), F.element_at("steps", F.col("_f")).alias("word")),
        F.struct(F.lit("trailing").alias("side"), F.slice("steps", F.col("_l") + 1, F.size("steps") - F.col("_l")).alias("beyond"), F.element_at("steps", F.col("_l")).alias("word")),
    )
    width, height = F.coalesce("aspect", F.lit(1.0)), F.lit(1.0)
    turn = F.element_at("steps", F.col("_f"))["turn"]
    read = F.filter("steps", lambda s: (s["kind"] == "same") & s["box"].isNotNull())
    rows = rows.withColumn("rotation", turn).withColumn("_r", F.transform(read, lambda s: layout.turned_frame(s["box"], F.col("rotation"), width, height))).filter(F.size("_r") > 0)
    rows = rows.select(*_KEY, "rotation", width.alias("width"), height.alias("height"), "_r", F.explode(ends).alias("e")).filter((F.size("e.beyond") > 0) & F.forall("e.beyond", lambda s: s["kind"] == "missing") & F.col("e.word.box").isNotNull())
    of = lambda k: F.transform("_r", lambda r: r[k])
    rows = rows.select(
        *_KEY, "rotation", "width", "height", F.col("e.side").alias("side"), F.transform("e.beyond", lambda s: s["expected"]).alias("expected"), F.col("e.word.box").alias("anchor"), F.char_length("e.word.actual").alias("chars"),
        F.aggregate("e.beyond", F.lit(0), lambda n, s: n + F.char_length(s["expected"]) + 1).alias("missing_chars"), G.upper_median(F.transform("_r", lambda r: r["c1"] - r["c0"]), 1.0).alias("letter"), F.array_min(of("a0")).alias("from"), F.array_max(of("a1")).alias("to"),
    )
    return layout.edge_places(rows).filter(F.size("areas") > 0).select(*_KEY, "side", "rotation", "expected", "areas")


def edges_settled(found: DataFrame, probes: DataFrame, words: DataFrame) -> DataFrame:
    """found with missing ends anchored, and their number as edges, where a second look says so: every place they could stand in is blank or surely holds other
    words, and they are not printed elsewhere. Where a place was not examined, or the words were seen there, nothing is asserted."""
    asked = edges(found).withColumn("place_ix", F.struct("rule_id", "side"))
    own = found.join(asked.select(*_KEY, "place_ix"), _KEY).select("sheet_id", "place_ix", F.explode(_boxed()).alias("box"))
    sure = layout.settled_edges(asked, probes, words, own).filter("anchored").select("sheet_id", "place_ix")
    told = asked.join(sure, ["sheet_id", "place_ix"], "left_semi").groupBy(*_KEY).agg(F.collect_set(F.array_join("expected", " ")).alias("_w"))
    rows = found.join(told, _KEY, "left")
    gone = lambda d: (d["kind"] == "missing") & ~d["anchored"] & F.coalesce(F.array_contains("_w", d["expected"]), F.lit(False))
    edges_ = F.size(F.filter("diff", gone))
    return rows.withColumn("edges", edges_).withColumn("diff", F.transform("diff", lambda d: d.withField("anchored", d["anchored"] | gone(d)))).drop("_w")


def code_evidence(rules: DataFrame, readings_: DataFrame) -> DataFrame:
    """sheet_id, rule_id, wanted, code, confidence: the likeliest other code printed in the place of the one that a text expects.

    rules: sheet_id, rule_id, expected; readings_: sheet_id, pass, reading, and said (its words, with confidence). A code has six figures or more; the two words before
    the expected one are its caption. Another code counts where a caption word stands up to BACK characters before it and no further code between. Most
    caption words win, then confidence and length of the code less the distance; the first pass of equals.
    """
    code = r"\d{6,}(?:[.-]\d+)*"
    e = F.col("expected")
    r = rules.filter(F.size(F.regexp_extract_all(e, F.lit(code), F.lit(0))) == 1)
    words = F.regexp_extract_all(F.split(e, code, 2)[0], F.lit(r"\p{L}{2,}"), F.lit(0))
    r = r.select(*_KEY, F.regexp_extract(e, f"({code})", 1).alias("wanted"), F.transform(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), F.lower).alias("caption")).filter(F.size("caption") > 0)
    # codes of a reading and what stands before each, once for all rules of a sheet
    printed = r"\d{6,}(?:\s*[.-]\s*\d+)*"
    parts, found = F.split("reading", printed), F.regexp_extract_all("reading", F.lit(printed), F.lit(0))
    read = readings_.filter(F.col("reading").rlike(r"\d{6,}")).select("sheet_id", "pass", "said", parts.alias("parts"), found.alias("raws")).select("*", F.posexplode("raws").alias("i", "raw"))
    near = F.get("parts", F.col("i"))
    # a caption word further back than the code before this one is seen, though the last one must stand behind that code
    earlier = F.transform(F.sequence(F.greatest(F.lit(0), F.col("i") - BACK // 6), F.greatest(F.lit(0), F.col("i") - 1)), lambda k: F.concat(F.get("parts", k), F.get("raws", k)))
    before = F.when(F.col("i") > 0, F.concat(F.array_join(earlier, ""), near)).otherwise(near)
    head = F.regexp_extract("raw", r"^(\d{6,})", 1)
    word = F.get(F.filter("said", lambda w: F.contains(w["text"], head)), F.lit(0))
    read = read.select("sheet_id", "pass", "i", F.regexp_replace("raw", r"\s+", "").alias("code"), F.lower(F.right(before, F.lit(BACK))).alias("before"), F.lower(F.right(near, F.lit(BACK))).alias("near"), word["confidence"].alias("confidence"), word.isNotNull().alias("worded")).filter("worded")
    p = r.join(read, "sheet_id").filter(F.col("code") != F.col("wanted"))
    ends = F.transform("caption", lambda w: F.when(F.contains(F.col("near"), w), F.char_length(F.element_at(F.split(F.col("near"), F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), -1))))
    p = p.withColumn("between", F.array_min(F.filter(ends, lambda n: n.isNotNull()))).filter("between IS NOT NULL")
    seen = F.size(F.filter("caption", lambda w: F.contains(F.col("before"), w)))
    score = ANCHOR * seen + F.coalesce("confidence", F.lit(0.0)) + FIGURE * F.char_length("code") - F.col("between")
    best = p.groupBy(*_KEY).agg(F.min(F.struct((-score).alias("s"), "pass", "i", "wanted", "code", "confidence")).alias("b"))
    return best.select(*_KEY, "b.wanted", "b.code", F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"))


def codes(found: DataFrame, rules: DataFrame, readings_: DataFrame) -> DataFrame:
    """found with code: another code printed where the expected one should stand. It takes the place of the expected one's absence among the differences."""
    said = F.transform(F.arrays_zip("read", "confidences"), lambda x: F.struct(x["read"].alias("text"), x["confidences"].alias("confidence")))
    other = code_evidence(rules.filter("route = 'text'"), readings_.withColumn("said", said))
    weak = found.filter(~F.col("exact") & (F.col("coverage") >= 35)).select(*_KEY)
    other = other.join(weak, _KEY, "left_semi").select(*_KEY, "wanted", "code", F.col("confidence").alias("_c"))
    rows = found.join(other, _KEY, "left")
    figures = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    kept_ = F.filter("diff", lambda d: ~((d["kind"].isin("missing", "replace")) & (figures(d["expected"]) == figures(F.col("wanted"))) & (figures(d["expected"]) != "")))
    none = F.lit(None).cast("int")
    new = F.struct(F.lit("replace").alias("kind"), F.col("wanted").alias("expected"), F.col("code").alias("actual"), F.col("_c").alias("confidence"), F.lit(False).alias("anchored"), none.alias("first"), none.alias("last"))
    diff = F.when(F.col("code").isNull(), F.col("diff")).otherwise(F.concat(kept_, F.array(new)).cast(found.schema["diff"].dataType))
    return rows.withColumn("diff", diff).drop("wanted", "_c")


def dates_of(found: DataFrame, rules: DataFrame, words: DataFrame) -> DataFrame:
    """sheet_id, rule_id, date: the digits printed at the caption of each rule about a date."""
    asked = found.join(rules.filter(F.col("title").rlike(DATE)).select(*_KEY), _KEY, "left_semi").filter(F.size(_boxed()) > 0)
    turn = F.coalesce(F.get(F.transform("steps", lambda s: s["turn"]), F.lit(0)), F.lit(0))
    captions = asked.select(*_KEY, turn.alias("rotation"), G.bounds_of(_boxed()).alias("box"))
    return layout.dates(captions, words.filter("box IS NOT NULL")).select(*_KEY, F.col("text").alias("date"))
