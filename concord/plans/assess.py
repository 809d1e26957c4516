"""The engine's core plan: rules and word readings of many sheets to one verdict row per rule.

Everything meets by sheet. A sheet's words become one reading per pass. A rule is located by the cheapest stage that finds
it: as a whole, in another notation of its unit, by the best alignment of its readings. Then what its differences mean is settled by the
print around them: another reading of the place, gaps that are not blank, places examined again at the edges, words right
beside an exact phrase, a second engine. Rules without text, of signs or graphics wait for a person; automatic evidence never
passes a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import fixed as X
from concord.functions import geometry as G
from concord.functions import quantity as Q
from concord.functions import text as T
from concord.operators import align, layout, measure, places, readings, verdict
from concord.sources.shared import kept

from . import evidence

SIGNS = "(?iu)знаки|мебиус|рюмка"
LEAST_COVERAGE = 50
BOX = "struct<x:double,y:double,w:double,h:double>"
DIFF = "array<struct<kind:string,expected:string,actual:string,confidence:double,anchored:boolean,first:int,last:int>>"
STEPS = f"array<struct<kind:string,expected:string,actual:string,confidence:double,box:{BOX},turn:int>>"


def expected_texts(rules: DataFrame, volume: str) -> DataFrame:
    """rules with expected (of the volume), its tokens and route: text, manual or na."""
    e = Q.variant_text(F.col("title"), F.col("original"), F.col("text"), F.lit(volume))
    rows = rules.withColumn("expected", F.coalesce(e, F.lit("")))
    route = F.when(F.col("expected") == "-", "na").when(F.col("title").rlike(SIGNS) | (F.trim("expected") == ""), "manual").otherwise("text")
    return rows.withColumn("route", route).withColumn("tokens", T.phrase_tokens(F.col("expected")))


def placed(words: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """Words with box (null where there is none), rotation and aspect; inside the label alone where its sheet has a contour."""
    for name, kind, value in (("box", BOX, None), ("rotation", "int", 0), ("aspect", "double", 1.0)):
        if name not in words.columns:
            words = words.withColumn(name, F.lit(value).cast(kind))
    if label is not None:
        words = words.join(label.select("sheet_id", F.col("box").alias("_l")), "sheet_id", "left").filter(F.col("_l").isNull() | G.inside(F.col("box"), F.col("_l"))).drop("_l")
    rows = words.withColumn("text", F.trim("text")).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)).cast("double")).withColumn("rotation", F.coalesce("rotation", F.lit(0)))
    return rows.filter("text <> ''").select("sheet_id", "pass", "word_ix", "text", "confidence", "box", "rotation", "aspect")


def pass_readings(words: DataFrame) -> DataFrame:
    """sheet_id, pass, reading, read, confidences, boxes, turns, spans, aspect: a sheet's words by pass in order; tokens word by word, each with its word's confidence, box and rotation."""
    rows = words.withColumn("t", T.phrase_tokens(F.col("text")))
    item = F.struct("word_ix", "text", "confidence", "t", "box", "rotation", G.turned(F.col("box"), F.col("rotation"), F.col("aspect")).alias("r"))
    sets = rows.groupBy("sheet_id", "pass").agg(F.sort_array(F.collect_list(item)).alias("w"), F.max("aspect").alias("aspect"))
    each = lambda f: F.flatten(F.transform("w", lambda x: F.transform(x["t"], lambda _: f(x))))
    spans = F.flatten(each(lambda x: F.when(x["box"].isNotNull(), F.array(x["r"]["x"], x["r"]["x"] + x["r"]["w"], x["r"]["y"], x["r"]["y"] + x["r"]["h"])).otherwise(F.array().cast("array<double>"))))
    return sets.select("sheet_id", "pass", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("reading"), F.flatten(F.transform("w", lambda x: x["t"])).alias("read"), each(lambda x: x["confidence"]).alias("confidences"), each(lambda x: x["box"]).alias("boxes"), each(lambda x: x["rotation"]).alias("turns"), spans.alias("spans"), "aspect")


def _line(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def _whole(rules: DataFrame, readings_: DataFrame, tokens: str) -> DataFrame:
    """sheet_id, rule_id, pass, boxes, steps, aspect: the first pass in which a rule's tokens stand in one run, and the places of that run."""
    pairs = rules.filter(F.size(tokens) > 0).select("sheet_id", "rule_id", F.col(tokens).alias("t")).join(readings_.select("sheet_id", "pass", "read", "boxes", "confidences", "turns", "aspect"), "sheet_id").filter(_line(F.col("read")).contains(_line(F.col("t"))))
    start = F.greatest(F.size(F.split(F.split_part(_line(F.col("read")), _line(F.col("t")), F.lit(1)), " ")) - 1, F.lit(0))
    at = lambda c, i: F.get(c, F.col("_start") + i)
    steps = F.transform("t", lambda t, i: F.struct(F.lit("same").alias("kind"), t.alias("expected"), t.alias("actual"), at("confidences", i).alias("confidence"), at("boxes", i).alias("box"), at("turns", i).alias("turn"))).cast(STEPS)
    best = pairs.withColumn("_start", start).groupBy("sheet_id", "rule_id").agg(F.min(F.struct("pass", steps.alias("steps"), "aspect")).alias("b"))
    return best.select("sheet_id", "rule_id", "b.pass", F.transform("b.steps", lambda o: o["box"]).alias("boxes"), "b.steps", "b.aspect")


def located(rules: DataFrame, readings_: DataFrame, words: DataFrame) -> DataFrame:
    """sheet_id, rule_id, pass, exact, notation, coverage, similarity, diff, boxes, steps, aspect: the best place of each rule of route text.

    As a whole; in another notation of a unit (notation); by the best alignment: most tokens read, then quality, then pass. Differences are
    settled by other readings of the same place and by what stands in the gaps.
    """
    r = rules.filter("route = 'text'").select("sheet_id", "rule_id", "tokens", "expected")
    none = F.array().cast(DIFF)
    found = lambda d, notation: d.select("sheet_id", "rule_id", "pass", F.lit(True).alias("exact"), F.lit(notation).alias("notation"), F.lit(100).alias("coverage"), F.lit(1.0).alias("similarity"), none.alias("diff"), "boxes", "steps", "aspect")
    whole = _whole(r, readings_, "tokens")
    left = r.join(whole.select("sheet_id", "rule_id"), ["sheet_id", "rule_id"], "left_anti")
    other = left.select("sheet_id", "rule_id", F.explode(Q.notations(F.col("expected"))).alias("n")).select("sheet_id", "rule_id", T.phrase_tokens(F.col("n.text")).alias("tokens"))
    noted = _whole(other, readings_, "tokens")
    left = left.join(noted.select("sheet_id", "rule_id"), ["sheet_id", "rule_id"], "left_anti")
    # only readings that hold two of the rule's tokens, or all of fewer
    pairs = left.join(readings_.select("sheet_id", "pass", "read", "confidences", "spans"), "sheet_id").filter(F.size(F.array_intersect("tokens", "read")) >= F.least(F.lit(2), F.size(F.array_distinct("tokens"))))
    # no more can be read than what the reading holds, with or without its spaces
    held = T.let(F.array_join("read", ""), lambda x: F.size(F.filter("tokens", lambda t: F.contains(x, t))))
    pairs = pairs.filter(100 * held >= (LEAST_COVERAGE - 0.5) * F.size("tokens"))
    done = align.aligned(pairs, ["sheet_id", "rule_id", "pass"], "tokens", "read", "confidences", "spans").filter(F.col("coverage") >= LEAST_COVERAGE)
    order = F.struct((-F.col("n_same")).alias("n"), (-F.col("quality")).alias("q"), "pass", "coverage", "quality", "ops", F.col("diff").alias("d"))
    best = done.groupBy("sheet_id", "rule_id").agg(F.min(order).alias("b")).select("sheet_id", "rule_id", "b.pass", "b.coverage", F.col("b.quality").alias("similarity"), "b.ops", F.col("b.d").alias("d"))
    best = best.join(readings_.select("sheet_id", "pass", "boxes", "confidences", "turns", "aspect"), ["sheet_id", "pass"])
    best = settled(kept(best, "aligned"), words)
    same = F.transform(F.filter("ops", lambda o: o["kind"] == "same"), lambda o: F.get("boxes", o["at"]))
    steps = F.transform("ops", lambda o: F.struct(o["kind"], o["expected"], o["actual"], F.get("confidences", o["at"]), F.get("boxes", o["at"]), F.get("turns", o["at"]))).cast(STEPS)
    aligned = best.select("sheet_id", "rule_id", "pass", F.lit(False).alias("exact"), F.lit(False).alias("notation"), "coverage", "similarity", "diff", same.alias("boxes"), steps.alias("steps"), "aspect")
    return found(whole, False).unionByName(found(noted, True)).unionByName(aligned)


def settled(best: DataFrame, words: DataFrame) -> DataFrame:
    """best (sheet_id, rule_id, d, boxes) with diff: a replacement is uncertain where another sure reading of that place has the expected token;
    a missing word is not absent where the gap between its neighbours holds other print; weak replacements and additions are uncertain."""
    at = lambda i: F.get("boxes", i)
    items = best.select("sheet_id", "rule_id", F.posexplode("d").alias("k", "c"), "boxes")
    gaps = items.filter("c.kind = 'missing' AND c.anchored").select("sheet_id", F.struct("rule_id", "k").alias("gap_ix"), at(F.col("c.before")).alias("before"), at(F.col("c.after")).alias("after")).filter("before IS NOT NULL AND after IS NOT NULL").join(words.groupBy("sheet_id").agg(F.min("rotation").alias("rotation")), "sheet_id")
    held = layout.unread_gaps(gaps, words.filter(F.col("box").isNotNull())).select("sheet_id", F.col("gap_ix.rule_id").alias("rule_id"), F.col("gap_ix.k").alias("k"))
    swaps = items.filter("c.kind = 'replace' AND NOT contains(c.expected, ' ')").select("sheet_id", "rule_id", "k", F.col("c.expected").alias("_e"), at(F.col("c.at")).alias("_b")).filter("_b IS NOT NULL")
    again = words.filter((F.col("confidence") >= X.FLOOR_USABLE) & F.col("box").isNotNull()).select(F.col("sheet_id").alias("_s"), "box", T.phrase_tokens(F.col("text")).alias("_t"))
    doubted = swaps.join(again, (F.col("sheet_id") == F.col("_s")) & F.array_contains("_t", F.col("_e")) & G.same_place(F.col("box"), F.col("_b")), "left_semi").select("sheet_id", "rule_id", "k")
    marks = held.withColumn("mark", F.lit("held")).unionByName(doubted.withColumn("mark", F.lit("doubted"))).groupBy("sheet_id", "rule_id").agg(F.collect_set(F.concat_ws(":", "mark", F.col("k").cast("string"))).alias("marks"))
    rows = best.join(marks, ["sheet_id", "rule_id"], "left")
    marked = lambda m, k: F.coalesce(F.array_contains("marks", F.concat(F.lit(m + ":"), k.cast("string"))), F.lit(False))
    weak = lambda c: c["kind"].isin("replace", "extra") & (c["confidence"] < X.FLOOR_USABLE)
    diff = F.transform("d", lambda c, k: F.struct(F.when(marked("doubted", k) | weak(c), "uncertain").otherwise(c["kind"]).alias("kind"), c["expected"].alias("expected"), c["actual"].alias("actual"), F.when(marked("doubted", k), 0.0).otherwise(c["confidence"]).alias("confidence"), (c["anchored"] & ~marked("held", k)).alias("anchored"), c["first"].alias("first"), c["last"].alias("last")))
    return rows.withColumn("diff", diff).drop("marks", "d")


def beside(found: DataFrame, words: DataFrame, rules: DataFrame) -> DataFrame:
    """found with the words right beside an exact phrase that no rule accounts for: these make it uncertain, not different.
    Amounts stand by their captions and are left alone; captions of the signs that a sheet's rules name are accounted for."""
    boxed = F.filter("boxes", lambda b: b.isNotNull())
    texts = rules.filter(~Q.is_quantity_title(F.col("title"))).select("sheet_id", "rule_id")
    ends = found.filter("exact").join(texts, ["sheet_id", "rule_id"], "left_semi").select("sheet_id", "rule_id", F.lit(0).alias("rotation"), boxed.alias("b")).filter(F.size("b") > 0).select("sheet_id", "rule_id", "rotation", F.get("b", F.lit(0)).alias("first"), F.element_at("b", -1).alias("last"))
    taken = found.select("sheet_id", F.explode(boxed).alias("box"))
    signs = rules.filter(F.col("title").rlike(SIGNS)).select("sheet_id", F.explode(F.transform(T.phrase_tokens(F.col("text")), T.fold)).alias("t")).groupBy("sheet_id").agg(F.collect_set("t").alias("_signs"))
    others = words.filter("box IS NOT NULL AND rotation = 0 AND pass <> 'barcode'").join(signs, "sheet_id", "left")
    own = F.transform(T.phrase_tokens(F.col("text")), T.fold)
    others = others.filter(F.col("_signs").isNull() | (F.size(F.array_except(own, F.col("_signs"))) > 0)).drop("_signs")
    near = layout.beside(ends, others, taken)
    added = near.groupBy("sheet_id", "rule_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("side", "text"))), lambda x: F.struct(F.lit("uncertain").alias("kind"), F.lit(None).cast("string").alias("expected"), x["text"].alias("actual"), F.lit(0.0).alias("confidence"), F.lit(False).alias("anchored"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))).cast(DIFF).alias("_n"))
    rows = found.join(added, ["sheet_id", "rule_id"], "left")
    return rows.withColumn("exact", F.col("exact") & F.col("_n").isNull()).withColumn("diff", F.concat("diff", F.coalesce("_n", F.array().cast(DIFF)))).drop("_n")


def confirmed(first: DataFrame, second: DataFrame) -> DataFrame:
    """first where a second engine's whole phrase at the same place (half of both together) confirms what the first read weakly:
    coverage of 90 and nothing surely different."""
    b = F.filter("boxes", lambda x: x.isNotNull())
    s = second.filter("exact").select("sheet_id", "rule_id", G.bounds_of(b).alias("_s"), F.size(b).alias("_n"))
    rows = first.join(s, ["sheet_id", "rule_id"], "left").withColumn("_f", G.bounds_of(b))
    sure = F.size(F.filter("diff", lambda d: d["confidence"] >= X.FLOOR_USABLE))
    yes = F.coalesce((F.col("_n") > 0) & F.col("_f.x").isNotNull() & readings.whole_confirms(F.col("coverage"), sure, G.iou(F.col("_f"), F.col("_s"))), F.lit(False))
    rows = rows.withColumn("_yes", yes & ~F.col("exact"))
    rows = rows.withColumn("exact", F.col("exact") | F.col("_yes")).withColumn("diff", F.when(F.col("_yes"), F.array().cast(first.schema["diff"].dataType)).otherwise(F.col("diff"))).withColumn("coverage", F.when(F.col("_yes"), 100).otherwise(F.col("coverage")))
    return rows.drop("_s", "_n", "_f", "_yes")


def quantities_of(rules: DataFrame, words: DataFrame, readings_: DataFrame) -> DataFrame:
    """sheet_id, rule_id, quantity: how the best amount of the sheet compares with the one a rule expects.

    Where words have boxes, amounts are neighbouring words by place: those beside a caption if there are any, none of a nutrition table or a
    concentration. Else all surely read amounts of the expected kind count. Several different credible ones are ambiguous.
    """
    r = rules.filter(Q.is_quantity_title(F.col("title")) & (F.col("route") == "text")).select("sheet_id", "rule_id", Q.expected_quantity(F.col("expected")).alias("e"))
    again = words.groupBy("sheet_id", "text", "box").agg(F.count_distinct("pass").alias("n"))
    boxed = words.filter("box IS NOT NULL").join(again.withColumnRenamed("text", "_t").withColumnRenamed("box", "_b").withColumnRenamed("sheet_id", "_s"), (F.col("sheet_id") == F.col("_s")) & (F.col("text") == F.col("_t")) & (F.col("box") == F.col("_b")), "left")
    placed_ = boxed.select("sheet_id", "pass", F.row_number().over(W.partitionBy("sheet_id", "pass").orderBy("word_ix")).alias("ix"), "text", measure.trust(F.col("confidence"), F.coalesce("n", F.lit(1))).alias("trust"), G.turned(F.col("box"), F.col("rotation"), F.col("aspect")).alias("box"))
    found = places.amounts(placed_)
    best = measure.quantity_evidence(found.withColumn("o", F.concat_ws(":", "pass", F.format_string("%09d", "ix"))), ["sheet_id"], "o")
    best = best.select("sheet_id", F.struct("kind", "base_value", "unit").alias("a"), "conflict")
    sure = readings_.filter(F.size("spans") == 0).select("sheet_id", F.array_join(F.filter(F.arrays_zip(F.col("read").alias("t"), F.col("confidences").alias("c")), lambda x: x["c"] >= X.FLOOR_NUMBER)["t"], " ").alias("s"))
    plain = sure.select("sheet_id", F.explode(Q.quantities(F.col("s"))).alias("q")).groupBy("sheet_id").agg(F.collect_set(F.struct("q.kind", "q.base_value", "q.unit")).alias("all"))
    rows = r.join(best, "sheet_id", "left").join(plain, "sheet_id", "left")
    rows = rows.withColumn("all", F.filter(F.coalesce("all", F.array().cast("array<struct<kind:string,base_value:double,unit:string>>")), lambda q: q["kind"] == F.col("e.kind")))
    status = F.when(F.coalesce("conflict", F.lit(False)), "ambiguous").when(F.col("a").isNotNull(), Q.quantity_comparison(F.col("e"), F.col("a"))).when(F.size("all") > 1, "ambiguous").otherwise(Q.quantity_comparison(F.col("e"), F.get("all", F.lit(0))))
    return rows.select("sheet_id", "rule_id", status.alias("quantity"))


def assess(
    rules: DataFrame, words: DataFrame, *, volume: str = "0,7", margin: float = 0.0, label: DataFrame | None = None, second: DataFrame | None = None, measured: DataFrame | None = None,
    reviews: DataFrame | None = None, heights_affect_status: bool = False, probes: DataFrame | None = None, stated: DataFrame | None = None,
) -> DataFrame:
    """sheet_id, rule_id, expected, comparison, coverage, sure, quantity, n_diff, sizes_missed, verdict, status, status_label; then what
    decided: code (another code printed in the place of the expected one), date (digits at a date's caption), declared (sizes taken from
    statements on the sheet), contradicted_sizes (measured ones that statements contradict), resolved, contradicted and disputed (steps that the second
    engine read otherwise), edges (missing ends that a second look did not find).

    rules: sheet_id, rule_id, title, constraint, original, text. words, and second (another engine's): sheet_id, word_ix, pass, text, confidence, and
    box, rotation and aspect where known. measured: sheet_id, rule_id, check_ix, value, step, and by_hand where a person measured. reviews: sheet_id,
    rule_id, text_confirmed, rejected, not_applicable, note. probes: what was seen when the places of `to_read_again` were examined: sheet_id, probe_ix, box,
    rotation, blank, text, confidence. stated: sheet_id, rule_id, check_ix, value, level: sizes that the sheet itself declares. A sheet without words has all its texts pending; letter heights move the status only
    with heights_affect_status. A size a person measured too small is an error; one the engine measured is a matter to look at.
    """
    rules = expected_texts(rules, volume)
    # read by several stages
    words = kept(placed(words, label), "words")
    readings_ = kept(pass_readings(words), "readings")
    every = readings_.groupBy("sheet_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pass", "reading"))), lambda x: x["reading"]), "\n").alias("all"))
    found = kept(located(rules, readings_, words), "located")
    if second is not None:
        others = kept(placed(second, label), "words")
        again = kept(located(rules, kept(pass_readings(others), "readings"), others), "located")
        found = kept(evidence.fused(confirmed(found, again), again, rules), "fused")
    else:
        found = evidence.unfused(found)
    found = evidence.edges_settled(found, probes, words) if probes is not None else found.withColumn("edges", F.lit(0))
    found = kept(evidence.codes(found, rules, readings_), "coded")
    found = beside(found, words, rules)
    rows = rules.join(every, "sheet_id", "left").join(found, ["sheet_id", "rule_id"], "left").join(quantities_of(rules, words, readings_), ["sheet_id", "rule_id"], "left")
    sizes = _sizes(rules, measured, margin, heights_affect_status, stated)
    rows = rows.join(sizes, ["sheet_id", "rule_id"], "left").join(evidence.dates_of(found, rules, words), ["sheet_id", "rule_id"], "left")
    if reviews is not None:
        rows = rows.join(reviews.select("sheet_id", "rule_id", "text_confirmed", "rejected", F.col("not_applicable").alias("exempt"), "note"), ["sheet_id", "rule_id"], "left")
    else:
        no = F.lit(False)
        rows = rows.select("*", no.alias("text_confirmed"), no.alias("rejected"), no.alias("exempt"), F.lit(None).cast("string").alias("note"))
    plain = T.compare(F.col("expected"), F.coalesce("all", F.lit("")))
    rows = rows.withColumn("diff", F.coalesce("diff", F.array().cast(DIFF))).withColumn("plain", plain)
    sure = F.exists("diff", lambda d: verdict.sure_difference(d["kind"], d["confidence"], d["anchored"]))
    comparison = (
        F.when(F.col("route") != "text", F.col("route")).when(F.col("exact"), "found").when(F.size("diff") > 0, F.when(sure, "partial").otherwise("uncertain"))
        .when(F.col("plain.status") == "found", "all_words").otherwise(F.col("plain.status"))
    )
    rows = rows.withColumn("comparison", comparison).withColumn("sure", sure & (F.size("diff") > 0))
    has_text = F.coalesce(F.col("all") != "", F.lit(False))
    issue = F.coalesce(F.col("quantity").isNotNull() & (F.col("quantity") != "match"), F.lit(False))
    missed, border = F.coalesce(F.col("missed") > 0, F.lit(False)), F.coalesce(F.col("border") > 0, F.lit(False))
    notation = F.coalesce(F.col("exact") & F.col("notation"), F.lit(False))
    exempt = (F.trim("expected") == "") & F.col("exempt") & (F.trim(F.coalesce("note", F.lit(""))) != "")
    status = verdict.row_status(F.col("comparison"), rejected=F.col("rejected"), failed=F.coalesce(F.col("failed") > 0, F.lit(False)), exempt=exempt, confirmed=F.col("text_confirmed"), sizes_pass=F.coalesce(F.col("open") == 0, F.lit(True)), conditions=F.coalesce(F.col("constraint"), F.lit("")) == "", quantity_issue=issue, notation=notation, size_issue=missed | border, has_text=has_text)
    number = F.exists("diff", lambda d: verdict.numeric_difference(d["kind"], d["expected"], d["actual"], d["confidence"]))
    tag = verdict.status_label(issue, notation, number, missed, F.col("sure"), F.lit(False), border, F.col("comparison") == "uncertain")
    return rows.select(
        "sheet_id", "rule_id", "expected", "comparison", F.coalesce("coverage", "plain.coverage").cast("int").alias("coverage"), "sure", "quantity", F.size("diff").alias("n_diff"),
        F.coalesce("missed", F.lit(0)).cast("int").alias("sizes_missed"), verdict.text_verdict(F.col("comparison"), F.col("sure")).alias("verdict"), status.alias("status"), F.when(status == "issue", tag).alias("status_label"),
        "code", "date", *(F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("declared", "contradicted_sizes", "resolved", "contradicted", "disputed", "edges")),
    )


def to_read_again(rules: DataFrame, words: DataFrame, *, volume: str = "0,7", label: DataFrame | None = None) -> DataFrame:
    """sheet_id, rule_id, side, rotation, expected, areas: where words missing at a phrase's end would stand. The first of two steps: whoever examines these
    places hands what was seen there to assess as probes."""
    rules = expected_texts(rules, volume)
    words = kept(placed(words, label), "words")
    return evidence.edges(located(rules, kept(pass_readings(words), "readings"), words))


def _sizes(rules: DataFrame, measured: DataFrame | None, margin: float, heights: bool, stated: DataFrame | None = None) -> DataFrame:
    """sheet_id, rule_id, failed, missed, border, open, declared, contradicted_sizes: deciding size conditions that a person measured too small, that the engine did, within two
    raster steps of the least, those not yet settled by a person, those whose size only a statement gives, and those where measure and statement differ."""
    checks = rules.select("sheet_id", "rule_id", F.posexplode(Q.dimension_checks(F.col("title"), F.col("constraint"), margin)).alias("check_ix", "c"))
    if not heights:
        checks = checks.filter(~verdict.is_text_height(F.col("c.unit"), F.col("c.target"), F.col("c.label")))
    if measured is None:
        checks = checks.select("*", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("step"), F.lit(False).alias("by_hand"))
    else:
        hand = F.coalesce("by_hand", F.lit(False)) if "by_hand" in measured.columns else F.lit(False)
        checks = checks.join(measured.select("sheet_id", "rule_id", "check_ix", "value", "step", hand.alias("by_hand")), ["sheet_id", "rule_id", "check_ix"], "left")
    if stated is None:
        checks = checks.withColumn("_stated", F.lit(None).cast("double"))
    else:  # the least usable statement; it fills in what was not measured, and never overrules a measure
        said = measure.declared_least(stated.withColumn("scope", F.lit("section")).withColumn("_o", F.col("value")), ["sheet_id", "rule_id", "check_ix"], "value", "level", "scope", "_o")
        checks = checks.join(said.select("sheet_id", "rule_id", "check_ix", F.col("declared").alias("_stated")), ["sheet_id", "rule_id", "check_ix"], "left")
    filled = F.col("value").isNull() & F.col("_stated").isNotNull()
    # as callouts.confirmed: a quarter of a millimetre, a fifth, or three raster steps
    slack = F.greatest(F.lit(0.25), 0.2 * F.col("_stated"), 3 * F.coalesce("step", F.lit(0.0)))
    differ = F.coalesce(F.abs(F.col("value") - F.col("_stated")) > slack, F.lit(False))
    checks = checks.withColumns({"filled": filled, "differ": differ}).withColumn("value", F.coalesce("value", "_stated"))
    hand, low = F.coalesce("by_hand", F.lit(False)), F.col("value") < F.col("c.min")
    near = ~hand & measure.borderline(F.col("value"), F.col("c.min"), F.col("step"))
    return checks.groupBy("sheet_id", "rule_id").agg(F.count_if(hand & low).alias("failed"), F.count_if(~hand & low).alias("missed"), F.count_if(near).alias("border"), F.count_if(F.col("value").isNull() | low | ~hand).alias("open"), F.count_if("filled").alias("declared"), F.count_if("differ").alias("contradicted_sizes"))


def first_volume(rules: DataFrame) -> DataFrame:
    """sheet_id, volume: the first volume that a sheet's quantity rules offer."""
    q = rules.filter(Q.is_quantity_title(F.col("title"))).select("sheet_id", "rule_id", F.get(F.filter(Q.quantities(F.col("original")), lambda x: x["kind"] == "volume"), F.lit(0))["base_value"].alias("v")).filter("v IS NOT NULL")
    return q.withColumn("_k", F.row_number().over(W.partitionBy("sheet_id").orderBy("rule_id"))).filter("_k = 1").select("sheet_id", F.col("v").alias("volume"))


def ready(rows: DataFrame, geometry_confirmed: Column | None = None) -> DataFrame:
    """sheet_id with counts of passed, issues and pending rules, and whether all is done."""
    done = F.col("status").isin("pass", "na")
    out = rows.groupBy("sheet_id").agg(F.count_if(done | F.col("status").isin("detected", "words")).alias("passed"), F.count_if(F.col("status").isin("error", "issue")).alias("issues"), F.count_if(F.col("status") == "pending").alias("pending"), F.bool_and(done).alias("done"))
    return out if geometry_confirmed is None else out.withColumn("done", F.col("done") & geometry_confirmed)
