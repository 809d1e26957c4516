"""Requirement documents to rules: table roles by their heads, and marked paragraphs as a fold in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import fixed as X


def _head(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "ё", "е")


def table_roles(cells: DataFrame) -> DataFrame:
    """doc, table_ix, first_row, title, constraint, text (columns, -1 for none), known: from the first of three rows that
    names a text and a constraint or title column and holds no size; else columns 0, 1, 2 of a table of three; else known is false."""
    rows = cells.groupBy("doc", "table_ix", "row_ix").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_ix", "text"))), lambda x: x["text"]).alias("r"))
    h = rows.filter("row_ix < 3").select("doc", "table_ix", "row_ix", F.transform("r", _head).alias("h"))
    spot = lambda want, without=None: F.array_position(F.transform("h", lambda s: s.rlike(want) & (~s.rlike(without) if without else F.lit(True))), F.lit(True)).cast("int") - 1
    h = h.select("doc", "table_ix", "row_ix", "h", spot(X.TEXT_HEAD, X.NOT_TEXT_HEAD).alias("text"), spot(X.CONSTRAINT_HEAD).alias("constraint"), spot(X.TITLE_HEAD).alias("title"))
    good = h.filter((F.col("text") >= 0) & ((F.col("constraint") >= 0) | (F.col("title") >= 0)) & (F.col("text") != F.col("constraint")) & ~F.exists("h", lambda s: s.rlike(X.SIZE_LITERAL)))
    found = good.groupBy("doc", "table_ix").agg(F.min(F.struct("row_ix", "title", "constraint", "text")).alias("g"))
    wide = rows.groupBy("doc", "table_ix").agg((F.max(F.size("r")) >= 3).alias("wide"))
    role = lambda c, i: F.coalesce(F.col(f"g.{c}"), F.when(F.col("wide"), i)).alias(c)
    return wide.join(found, ["doc", "table_ix"], "left").select("doc", "table_ix", F.coalesce(F.col("g.row_ix") + 1, F.lit(0)).alias("first_row"), role("title", 0), role("constraint", 1), role("text", 2), (F.col("g").isNotNull()).alias("headed"), (F.col("g").isNotNull() | F.col("wide")).alias("known"))


def table_rules(cells: DataFrame) -> DataFrame:
    """doc, table_ix, row_ix, title, constraint, text, source_review of each row that is a rule. Empty rows, the row 1|2|3 and
    rows of single letters are none; a row without text, or of a table of unknown shape, is for review."""
    rows = cells.groupBy("doc", "table_ix", "row_ix").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_ix", "text"))), lambda x: F.trim(x["text"])).alias("r"))
    rows = rows.join(table_roles(cells), ["doc", "table_ix"]).filter(F.col("row_ix") >= F.col("first_row"))
    at = lambda c: F.coalesce(F.when(F.col(c) >= 0, F.get("r", F.col(c))), F.lit(""))
    no = F.forall("r", lambda s: s == "") | (F.col("known") & ((F.array_join(F.slice("r", 1, 3), "|") == "1|2|3") | F.forall("r", lambda s: s.rlike("(?i)^[a-z]$"))))
    title = F.when(~F.col("known"), "Неразобранная строка таблицы").when(F.col("title") >= 0, at("title")).otherwise(F.substring(at("text"), 1, 65))
    out = rows.filter(~no).select("doc", "table_ix", "row_ix", title.alias("title"), F.when(F.col("known"), at("constraint")).otherwise(F.array_join("r", " · ")).alias("constraint"), F.when(F.col("known"), at("text")).otherwise("").alias("text"))
    return out.withColumn("source_review", F.col("text") == "")


def paragraph_rules(blocks: DataFrame, key: str = "doc", order: str = "ord", text: str = "text", heading: str = "heading") -> DataFrame:
    """key, section_ord, title, constraint, text, extra, source_review of each section, and conditions before any section as
    rows with title null. A paragraph's place is told by the last marker before it: windows over one document's paragraphs."""
    b = blocks.select(key, order, F.posexplode(F.split(text, "\n")).alias("_i", "s"), F.coalesce(F.col(heading), F.lit(False)).alias("h")).select(key, order, "_i", F.trim("s").alias("s"), "h").filter("s <> ''")
    at = W.partitionBy(key).orderBy(order, "_i")
    past = at.rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("star", F.max(F.col("s").contains("***").cast("int")).over(past) == 1)
    section, bare, mark, cond, quoted = (F.regexp_extract("s", p, 1) for p in (X.SECTION_MARK, X.BARE_SECTION, X.TEXT_MARK, X.CONSTRAINT_MARK, X.QUOTED_MARK))
    has = lambda p: F.col("s").rlike(p)
    marked, bounded = has(X.TEXT_MARK), has(X.CONSTRAINT_MARK)
    opens = ~F.col("star") & (has(X.SECTION_MARK) | F.col("h") | (has(X.BARE_SECTION) & ~marked & ~bounded))
    quote = ~F.col("star") & ~opens & ~marked & ~bounded & has(X.QUOTED_MARK)
    title = F.when(has(X.SECTION_MARK), section).when(has(X.BARE_SECTION), bare).otherwise(F.col("s"))
    b = b.withColumn("opens", opens).withColumn("quote", quote).withColumn("mark", ~F.col("star") & ~F.col("opens") & marked).withColumn("cond", ~F.col("star") & ~F.col("opens") & ~F.col("mark") & bounded)
    # a mark without a section begins one; a quoted inscription ends the section before it
    b = b.withColumn("state", F.last(F.when(F.col("opens") | F.col("mark") | F.col("cond"), F.lit(1)).when(F.col("quote"), F.lit(0)), ignorenulls=True).over(past))
    before = F.coalesce(F.lag("state").over(at), F.lit(0))
    b = b.withColumn("begins", F.col("opens") | F.col("quote") | ((F.col("mark") | F.col("cond")) & (before == 0)))
    b = b.withColumn("section", F.when(F.col("star"), -1).when(F.coalesce(F.col("state"), F.lit(0)) == 0, F.when(F.col("quote"), F.sum(F.col("begins").cast("int")).over(past)).otherwise(0)).otherwise(F.sum(F.col("begins").cast("int")).over(past)))
    size = F.col("s").rlike(X.SIZE_SENTENCE[0]) & F.col("s").rlike(X.SIZE_SENTENCE[1])
    order_ = F.col("s").rlike(X.INSTRUCTION)
    # the mode in force is the last one set inside the section; plain prose sets text unless it instructs
    sets = F.when(F.col("mark"), "text").when(F.col("cond") | size, "constraint").when(F.col("begins"), "none").when(~order_, "text?")
    inside = W.partitionBy(key, "section").orderBy(order, "_i")
    b = b.withColumn("sets", sets).withColumn("mode", F.last(F.when(F.col("sets").isin("text", "constraint", "none"), F.col("sets")), ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    prose = F.max(F.when(F.col("sets") == "text?", 1)).over(inside.rowsBetween(W.unboundedPreceding, 0)) == 1
    kind = (
        F.when(F.col("section") <= 0, "text").when(F.col("opens"), "title").when(F.col("quote"), "text").when(F.col("mark"), "text").when(F.col("cond") | size, "constraint")
        .when(F.col("mode").isin("text", "constraint"), F.col("mode")).when(prose & ~order_, "text").when(prose, "text").otherwise("constraint")
    )
    value = F.when(F.col("quote"), quoted).when(F.col("mark"), mark).when(F.col("cond"), cond).when(F.col("star"), F.trim(F.regexp_replace(F.regexp_replace("s", r"^.*\*\*\*", ""), r"(?iu)^\s*Добавить информацию\s*:\s*", ""))).otherwise(F.col("s"))
    head = F.when(F.col("opens"), title).when(F.col("quote"), "Надпись").when(F.col("begins") & F.col("mark"), "Текст этикетки").when(F.col("begins") & F.col("cond"), "Условия маркировки")
    b = b.select(key, "section", order, "_i", kind.alias("kind"), value.alias("value"), head.alias("head"))
    lines = lambda k: F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct(order, "_i", "value")))), lambda x: x["value"]), lambda v: v != ""), "\n")
    out = b.groupBy(key, "section").agg(F.min(F.struct(order, "_i")).alias("_o"), F.min(F.when(F.col("head").isNotNull(), F.struct(order, "_i", "head"))).alias("_h"), lines("constraint").alias("constraint"), lines("text").alias("text"))
    extra = F.col("section") == -1
    return out.filter((F.col("section") != -1) | (F.col("text") != "")).select(
        key, F.col("section").alias("section_ord"), F.when(extra, "Дополнительная информация под ***").when(F.col("section") > 0, F.col("_h.head")).alias("title"),
        F.when(extra, "Обязательное наличие текста").otherwise(F.col("constraint")).alias("constraint"), "text", extra.alias("extra"), ((F.col("section") > 0) & (F.col("text") == "")).alias("source_review"),
    )


def suggested_margin(conditions: Column) -> Column:
    """Millimetres that the first condition on a reserve of heights asks for, above 0 and at most 1."""
    amount = lambda s: F.translate(F.nullif(F.regexp_extract(s, r"(?iu)(?:на|плюс|\+)\s*(\d+(?:[,.]\d+)?)\s*мм", 1), F.lit("")), ",", ".").cast("double")
    fit = F.filter(conditions, lambda s: s.rlike(r"(?iu)увеличива\w*|запас") & s.rlike("(?iu)высот|шрифт|размер") & (amount(s) > 0) & (amount(s) <= 1))
    return F.get(F.transform(fit, amount), F.lit(0))


def section_fold(rows: DataFrame, keys: list[str], order: str, marker: Column, text: str) -> DataFrame:
    """keys, section, n_rows, section_text: rows after the last marker belong to its section; those before any to section 0."""
    w = W.partitionBy(*keys).orderBy(order)
    s = rows.withColumn("section", F.sum(marker.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return s.groupBy(*keys, "section").agg(F.count("*").alias("n_rows"), joined.alias("section_text"))
