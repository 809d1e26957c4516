"""Readings of label sheets: engine trees, interchange files, truth, saved runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import geometry as G

BOX = "struct<x:double,y:double,w:double,h:double>"
#: The tag of interchange results: any producer, kind and version as stated.
SCHEMA_TAG = r"^[a-z-]+\.ocr-result/1$"
WORD = f"struct<text:string,box:{BOX},rotation:int,confidence:double,source:string,engine:string,pass:string,line:string>"
INTERCHANGE = f"schema string, method string, engine struct<det:string,rec:string,runtime:string>, page struct<width:double,height:double>, scale struct<mmPerPixel:double,level:string,origin:string,sourcePixelMm:double>, words array<{WORD}>"
TRUTH = f"schema string, sheet string, kind string, sourceDpi int, page int, annotator string, status string, statusNote string, label {BOX}, tags array<string>, excluded string, lines array<struct<text:string,rotation:int,tags:array<string>>>, sections array<struct<rule:string,title:string,truth:string,differences:array<string>>>"
RULE = "struct<id:string,title:string,constraint:string,original:string,text:string,extra:boolean,sourceReview:boolean>"
SYMBOL = "struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"
TREE = f"array<struct<paragraphs:array<struct<lines:array<struct<words:array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>,symbols:array<{SYMBOL}>>>>>>>>>"
SOURCES = ("recognition", "pdf-text", "barcode", "edge-probe")


def read_interchange(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INTERCHANGE).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH).option("multiLine", True).json(path)


def truth_lines(truth: DataFrame) -> DataFrame:
    return truth.select("sheet", F.posexplode("lines").alias("line_ix", "l")).select("sheet", "line_ix", "l.text", F.coalesce("l.rotation", F.lit(0)).alias("rotation"), F.coalesce("l.tags", F.array().cast("array<string>")).alias("tags"))


def truth_sections(truth: DataFrame) -> DataFrame:
    return truth.select("sheet", F.explode("sections").alias("s")).select("sheet", "s.*")


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved runs, one row per sheet; a sheet without its file is simply not there (inner joins skip it)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def manifest(spark: SparkSession, path: str, repo: str, corpus: str) -> DataFrame:
    """Sheets of a corpus manifest with repo: and corpus: prefixes resolved."""
    raw = spark.read.option("multiLine", True).schema("note string, sheets array<struct<id:string,title:string,artwork:string,requirements:string,volume:string,truth:string>>").json(path)
    at = lambda c: F.when(c.startswith("repo:"), F.concat(F.lit(repo + "/"), F.substring(c, 6, 10_000))).when(c.startswith("corpus:"), F.concat(F.lit(corpus + "/"), F.substring(c, 8, 10_000))).otherwise(c)
    rows = raw.select(F.explode("sheets").alias("s")).select("s.*")
    return rows.select("id", "title", *(at(F.col(c)).alias(c) for c in ("artwork", "requirements", "truth")), "volume")


def words_from_tree(df: DataFrame, key: str, blocks: str, region: Column, width: Column, height: Column, rotation: Column, mm_per_pixel: Column, name: Column) -> DataFrame:
    """One row per word of an engine's tree: box in page fractions, line id, and the heights of surely read letters and digits."""
    rows = df.select(key, F.posexplode(blocks).alias("bi", "b"), region.alias("_r"), width.alias("_w"), height.alias("_h"), rotation.alias("rotation"), mm_per_pixel.alias("_mm"), name.alias("pass"))
    rows = rows.select("*", F.posexplode("b.paragraphs").alias("pi", "p")).select("*", F.posexplode("p.lines").alias("li", "l")).select("*", F.posexplode("l.words").alias("wi", "w"))
    rows = rows.filter(F.trim("w.text") != "")
    flat = G.box(F.col("w.bbox.x0"), F.col("w.bbox.y0"), F.col("w.bbox.x1") - F.col("w.bbox.x0"), F.col("w.bbox.y1") - F.col("w.bbox.y0"))
    sure = F.filter(F.coalesce("w.symbols", F.array().cast(f"array<{SYMBOL}>")), lambda s: (s["confidence"] >= 80) & s["text"].rlike(r"[\p{L}\p{N}]"))
    glyphs = F.transform(sure, lambda s: F.struct(s["text"].alias("text"), ((s["bbox"]["y1"] - s["bbox"]["y0"]) * F.col("_mm")).alias("height")))
    return rows.select(key, "pass", F.concat_ws(":", "bi", "pi", "li").alias("line"), "wi", F.trim("w.text").alias("text"), "w.confidence", "rotation", G.mapped(flat, F.col("_r"), F.col("_w"), F.col("_h"), F.col("rotation")).alias("box"), glyphs.alias("glyphs"))


def words_from_polygons(df: DataFrame, key: str, items: str, width: Column, height: Column) -> DataFrame:
    """Words of a second engine: polygons to clamped boxes in fractions, empty or flat ones left out, score to 0..100."""
    rows = df.select(key, width.alias("_w"), height.alias("_h"), F.posexplode(items).alias("word_ix", "i"))
    side = lambda k, n: F.transform("i.poly", lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p[k] / n)))
    xs, ys = side(0, F.col("_w")), side(1, F.col("_h"))
    box = G.box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    rows = rows.select(key, "word_ix", F.trim("i.text").alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("i.score") * 100)).alias("confidence"), box.alias("box"))
    return rows.filter("text <> '' AND box.w > 0 AND box.h > 0")


def to_fractions(result: DataFrame) -> DataFrame:
    """Words of interchange results in page fractions; a text layer is fully trusted."""
    rows = result.select("path", "page", F.posexplode("words").alias("word_ix", "w"))
    w, h = F.col("page.width"), F.col("page.height")
    return rows.select("path", "word_ix", "w.text", F.when(F.col("w.source") == "pdf-text", 100.0).otherwise(F.col("w.confidence")).alias("confidence"), "w.rotation", "w.source", "w.engine", "w.pass", "w.line", G.box(F.col("w.box.x") / w, F.col("w.box.y") / h, F.col("w.box.w") / w, F.col("w.box.h") / h).alias("box"))


def to_pixels(words: DataFrame, width: Column, height: Column) -> DataFrame:
    """The inverse, with the source told by the pass."""
    b = F.col("box")
    source = F.when(F.col("pass") == "pdf", "pdf-text").when(F.col("pass") == "barcode", "barcode").otherwise("recognition")
    return words.withColumn("source", source).withColumn("box", G.box(b["x"] * width, b["y"] * height, b["w"] * width, b["h"] * height))


def problems(result: DataFrame, most: int = 20) -> DataFrame:
    """path and problems of each interchange result: wrong tag, page or words; at most `most` + 1 are listed."""
    bad = lambda w, i: F.concat(
        F.when(F.coalesce(F.trim(w["text"]), F.lit("")) == "", F.array(F.format_string("word %d: text", i))).otherwise(F.array().cast("array<string>")),
        F.when((w["box"]["w"] > 0) & (w["box"]["h"] > 0), F.array().cast("array<string>")).otherwise(F.array(F.format_string("word %d: box", i))),
        F.when(w["rotation"].isin(0, 90, 180, 270), F.array().cast("array<string>")).otherwise(F.array(F.format_string("word %d: rotation", i))),
        F.when(w["confidence"].between(0, 100), F.array().cast("array<string>")).otherwise(F.array(F.format_string("word %d: confidence", i))),
        F.when(w["source"].isin(*SOURCES), F.array().cast("array<string>")).otherwise(F.array(F.format_string("word %d: source", i))),
    )
    head = F.array_compact(F.array(F.when(~F.coalesce(F.col("schema").rlike(SCHEMA_TAG), F.lit(False)), "schema"), F.when(~F.coalesce((F.col("page.width") > 0) & (F.col("page.height") > 0), F.lit(False)), "page"), F.when(F.col("words").isNull(), "words")))
    words = F.flatten(F.transform(F.coalesce("words", F.array().cast(f"array<{WORD}>")), bad))
    return result.select("path", F.slice(F.concat(head, words), 1, most + 1).alias("problems"))
