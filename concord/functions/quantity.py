"""Quantities, sizes, stated dimensions, codes and scale as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .text import compact, fold, let, words

_UNIT = "|".join(X.UNIT_ORDER)
_QUANTITY = rf"(?<![\p{{L}}\p{{N}}.,+-])(\d+(?:[.,]\d+)?)\s*({_UNIT})(?![\p{{L}}\p{{N}}])(?!\s*/)"


def number(s: Column) -> Column:
    return F.translate(s, ",", ".").cast("double")


def _lookup(unit: Column, i: int, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for u, v in X.UNITS.items():
        out = F.when(unit == u, F.lit(v[i])).otherwise(out)
    return out


def quantities(text: Column) -> Column:
    """array<struct<value, unit, kind, base_value, text>> of all amounts with a unit of volume or mass, concentrations left out."""
    source = F.translate(F.lower(text), "³", "3")
    take = lambda i: F.regexp_extract_all(source, F.lit(_QUANTITY), F.lit(i))
    rows = F.arrays_zip(take(1).alias("n"), take(2).alias("u"), take(0).alias("t"))

    def one(r: Column) -> Column:
        v = number(r["n"])
        return F.struct(v.alias("value"), _lookup(r["u"], 2, "string").alias("unit"), _lookup(r["u"], 0, "string").alias("kind"), (v * _lookup(r["u"], 1, "double")).alias("base_value"), r["t"].alias("text"))

    return F.transform(rows, one)


def is_quantity_title(title: Column) -> Column:
    return F.trim(title).rlike(X.QUANTITY_TITLE)


def expected_quantity(text: Column) -> Column:
    q = quantities(text)
    return F.when(F.size(q) == 1, F.get(q, F.lit(0)))


def quantity_comparison(e: Column, a: Column) -> Column:
    off = F.abs(e["base_value"] - a["base_value"]) > F.greatest(F.lit(1e-9), F.abs(e["base_value"]) * 1e-9)
    same = e["unit"] == a["unit"]
    return (
        F.when(e.isNull(), "ambiguous").when(a.isNull(), "unreadable").when(e["kind"] != a["kind"], "wrong_unit")
        .when(off & same, "wrong_value").when(off, "wrong_quantity").when(same, "match").otherwise("equivalent")
    )


def notations(text: Column) -> Column:
    """array<struct<text, from, to>>: the text with one unit in another spelling, where that changes it."""
    all_ = [F.struct(F.regexp_replace(text, p, f"$1{r}").alias("text"), F.lit(a).alias("from"), F.lit(b).alias("to")) for p, r, a, b in X.NOTATIONS]
    return F.filter(F.array(*all_), lambda x: x["text"] != text)


def variant_text(title: Column, original: Column, text: Column, volume: Column) -> Column:
    """The text a rule expects for one volume: the fitting quantity with its caption, or the code on the volume's line."""
    v = F.translate(volume, ".", ",")
    q = quantities(original)
    fit = F.get(F.filter(q, lambda x: (x["kind"] == "volume") & (F.abs(x["base_value"] - number(v)) < 1e-9)), F.lit(0))
    first = F.position(F.get(q, F.lit(0))["text"], F.translate(F.lower(original), "³", "3"))
    caption = F.trim(F.substring(original, F.lit(1), first - 1))
    chosen = F.when((F.size(q) > 1) & fit.isNotNull(), F.concat(caption, F.lit(" "), fit["text"])).otherwise(text)
    line = F.get(F.filter(F.split(original, "\n"), lambda s: s.rlike(r"\d") & F.regexp_like(F.translate(s, ".", ","), F.concat(v, F.lit(r"\s*л")))), F.lit(0))
    code = F.regexp_extract(line, r"\d{8,14}", 0)
    return F.when(is_quantity_title(title), chosen).when(title.rlike("(?iu)штриховой код") & line.isNotNull(), F.when(code == "", line).otherwise(code)).otherwise(text)


_SIZE = r"(?iu)(\d+(?:[,.]\d+)?)\s*(мм|см|mm|cm)(?!\p{L})"


def _sizes(constraint: Column) -> Column:
    """array<struct<min, context, after>> of all lengths in mm, maxima left out."""
    part = F.regexp_extract(constraint, r"(?isu)^(.*?)(?:формат\s*:|размер(?:ы)?\s+окна\s*:|$)", 1)

    def rows(p: Column, texts: Column) -> Column:
        values = F.zip_with(F.regexp_extract_all(p, F.lit(_SIZE), F.lit(1)), F.regexp_extract_all(p, F.lit(_SIZE), F.lit(2)), lambda n, u: number(n) * F.when(u.rlike("(?iu)см|cm"), 10.0).otherwise(1.0))
        every = F.transform(values, lambda v, i: F.struct(v.alias("min"), F.element_at(F.split(F.get(texts, i), "[;\n]"), -1).alias("context"), F.substring(F.coalesce(F.get(texts, i + 1), F.lit("")), 1, 45).alias("after")))
        return F.filter(every, lambda r: ~r["context"].rlike("(?iu)(?:не более|максимальн)[^;]*$"))

    return let(part, lambda p: let(F.split(p, _SIZE), lambda texts: rows(p, texts)))


_CHECK = "array<struct<label:string,min:double,unit:string,target:string,scope:string>>"


def dimension_checks(title: Column, constraint: Column, margin: float = 0.0) -> Column:
    """The size conditions of a rule; margin is added to all in mm but those of the conformity sign."""
    # the lengths are found once for all kinds of rules
    return let(_sizes(F.coalesce(constraint, F.lit(""))), lambda sizes: _checks(F.lower(title), title, F.coalesce(constraint, F.lit("")), sizes, margin))


def _checks(t: Column, title: Column, c: Column, sizes: Column, margin: float) -> Column:
    n = F.size(sizes)

    def check(label, least, unit="мм", target="letters", scope="") -> Column:
        col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(col(label).alias("label"), col(least).cast("double").alias("min"), col(unit).alias("unit"), col(target).alias("target"), F.nullif(col(scope), F.lit("")).alias("scope"))

    percent = F.regexp_extract(c, r"(?iu)не менее\s*(\d+(?:[,.]\d+)?)\s*%", 1)
    first = F.get(sizes, F.lit(0))["min"]

    def quantity(r: Column, i: Column) -> Column:
        label = r["context"].rlike("(?iu)термин|букв|подпис") & ~r["context"].rlike("(?iu)количество[^;]*$")
        kind = F.when(label, "quantity_label").when(r["context"].rlike("(?iu)количество|цифр|значени"), "quantity").when((n > 1) & (i == 0), "quantity_label").otherwise("quantity")
        return check(F.when(kind == "quantity_label", F.concat(F.lit("Буквы «"), title, F.lit("»"))).otherwise("Количество товара"), r["min"], "мм", kind)

    def date(r: Column, i: Column) -> Column:
        kind = F.when(r["context"].rlike("(?iu)цифр") | r["after"].rlike("(?iu)шрифт самих цифр"), "date_digits").when(r["context"].rlike("(?iu)букв|подпис") | r["after"].rlike("(?iu)шрифт букв"), "date_label").when(i == 0, "date_label").otherwise("date_digits")
        return check(F.when(kind == "date_digits", "Цифры даты / партии").otherwise("Буквы подписи даты"), r["min"], "мм", kind)

    def letters(r: Column, i: Column) -> Column:
        near = F.translate(F.lower(F.concat_ws(" ", r["context"], r["after"])), "ё", "е")
        subject = F.trim(F.regexp_extract(r["context"], r"(?iu)(?:^|\s)для\s+(?:указания\s+)?([^–—:;\n-]{3,60}?)\s*[–—-]?\s*(?:не\s+менее)?\s*$", 1))
        life = near.rlike("срок.*годност")
        label = F.when(life, "Срок годности").when(near.rlike("остальн.*текст"), "Остальной текст").when(subject != "", F.concat(F.lit("Для "), F.lower(subject))).otherwise(F.concat(F.lit("Высота букв · условие "), (i + 1).cast("string")))
        scope = F.when(subject != "", subject).when(life, "срок годности").otherwise("")
        return F.when(n == 1, check("Высота букв", r["min"])).otherwise(check(label, r["min"], "мм", "partitioned_letters", scope))

    out = (
        F.when(percent != "", F.array(check("Площадь предупреждения", number(percent), "%")).cast(_CHECK))
        .when(t.rlike("еас") & (n > 0), F.array(check("Высота ЕАС", first), check("Ширина ЕАС", first)).cast(_CHECK))
        .when(is_quantity_title(title) & (n > 0), F.transform(sizes, quantity).cast(_CHECK))
        .when(t.rlike("окно.*дат") & (n > 0), F.transform(sizes, date).cast(_CHECK))
        .when(c.rlike("(?iu)не менее") & (n > 0), F.transform(sizes, letters).cast(_CHECK))
        .otherwise(F.array().cast(_CHECK))
    )
    if not margin:
        return out
    more = lambda x: F.when((x["unit"] == "мм") & ~x["label"].contains("ЕАС"), F.floor((x["min"] + margin) * 100 + 0.5) / 100).otherwise(x["min"])
    return F.transform(out, lambda x: F.struct(x["label"].alias("label"), more(x).alias("min"), x["unit"].alias("unit"), x["target"].alias("target"), x["scope"].alias("scope")))


def scope_index(scopes: Column, text: Column) -> Column:
    """Index of the minimum whose subject stems stand earliest in the text; the rest condition if undecided; -1 without one."""
    rest_of = lambda s: s.rlike("(?iu)остальн")

    def rank(flat: Column, s: Column, i: Column) -> Column:
        at = F.filter(F.transform(F.filter(words(s), lambda w: F.char_length(w) > 3), lambda w: F.position(F.substring(fold(w), 1, 4), flat) - 1), lambda p: p >= 0)
        return let(at, lambda at: F.struct(F.array_min(at).alias("first"), (-F.size(at)).alias("hits"), i.alias("index")))

    def ranks(flat: Column) -> Column:
        every = F.transform(scopes, lambda s, i: F.when(s.isNotNull() & ~rest_of(s), rank(flat, s, i)))
        return F.sort_array(F.filter(every, lambda r: r.isNotNull() & r["first"].isNotNull()))

    def chosen(ranked: Column) -> Column:
        rest = F.coalesce(F.array_max(F.transform(scopes, lambda s, i: F.when(rest_of(s), i))), F.lit(-1))
        clear = (F.size(ranked) == 1) | (F.get(ranked, F.lit(0))["first"] < F.get(ranked, F.lit(1))["first"])
        return F.when(F.size(ranked) == 0, rest).when(clear, F.get(ranked, F.lit(0))["index"]).otherwise(rest)

    # the text is taken apart once, not for each word of each scope
    return let(let(fold(compact(text)), ranks), chosen)


_EDGE = r"[^\p{L}\p{N}]*"
_BOX = rf"(?iu)^{_EDGE}{X.NUMBER}\s*{X.MILLIMETRE}?\s*[xх×*]\s*{X.NUMBER}\s*{X.MILLIMETRE}[^\p{{L}}\p{{N}}²]*$"
_HEIGHT = rf"(?iu)^{_EDGE}{X.NUMBER}\s*{X.MILLIMETRE}[^\p{{L}}\p{{N}}²]*$"
_CLAIM = "struct<kind:string,value:double,values:array<double>,comparator:string,areas:array<double>,inscription:double,threshold:double,exclusion:string,raw:string>"


def parse_claim(text: Column) -> Column:
    """What a callout states: a share of the area, a box, a height, or that it can't be read; null if it is none."""
    c = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{X.WS}+", " "), r"(\d)\s*([.,])\s*(?=\d)", "$1$2"))
    mark, share = F.regexp_extract(c, X.PERCENT, 1), F.regexp_extract(c, X.PERCENT, 2)
    sign = F.when(mark == "", "=").when(mark.rlike("[<≤]"), "<").when(mark.rlike(r"(?iu)не\s+менее|≥"), "≥").otherwise(">")
    areas = F.zip_with(F.regexp_extract_all(c, F.lit(X.AREA), F.lit(1)), F.regexp_extract_all(c, F.lit(X.AREA), F.lit(2)), lambda b, v: F.struct((b == "(").alias("in_brackets"), number(v).alias("value")))
    pick = lambda flag: F.get(F.filter(areas, lambda a: a["in_brackets"] == flag), F.lit(0))["value"]
    nothing = F.lit(None)

    def claim(kind, value=nothing, values=nothing, comparator=nothing, of=nothing, inscription=nothing, threshold=nothing, exclusion=nothing) -> Column:
        return F.struct(F.lit(kind), value, values, comparator, of, inscription, threshold, exclusion, c).cast(_CLAIM)

    plausible = lambda s, most: ~s.rlike(r"^0\d") & (number(s) > 0) & (number(s) <= most)
    one, two, height = F.regexp_extract(c, _BOX, 1), F.regexp_extract(c, _BOX, 2), F.regexp_extract(c, _HEIGHT, 1)
    unreadable = claim("unreadable")
    wordy = F.char_length(F.regexp_replace(F.regexp_replace(c, f"(?iu){X.MILLIMETRE}", ""), r"[^\p{L}]", "")) > 4
    return (
        F.when(c == "", F.lit(None).cast(_CLAIM))
        .when((share != "") & c.rlike(r"(?iu)площад|этикетк|(?:^|\s)S(?:\s|$)"), claim("percent", number(share), comparator=sign, of=F.transform(areas, lambda a: a["value"]), inscription=pick(False), threshold=pick(True), exclusion=F.nullif(F.trim(F.regexp_extract(c, X.EXCLUDED, 1)), F.lit(""))))
        .when(one != "", F.when(plausible(one, 400) & plausible(two, 400), claim("box", values=F.array(number(one), number(two)))).otherwise(unreadable))
        .when(c.rlike(r"(?iu)\d\s*[xх×*]\s*\d") & c.rlike(f"(?iu){X.MILLIMETRE}"), unreadable)
        .when(height != "", F.when(plausible(height, 60), claim("height", number(height))).otherwise(unreadable))
        .when(share != "", claim("percent", number(share), comparator=sign, of=F.array().cast("array<double>")))
        .when(~wordy & c.rlike(r"\d") & c.rlike(rf"(?iu){X.MILLIMETRE}(?![\p{{L}}\p{{N}}])"), unreadable)
    )


def claim_marks(claim: Column) -> Column:
    return F.when(claim["kind"].isin("box", "height"), F.regexp_count(claim["raw"], F.lit(r"\d[.,]\d"))).otherwise(0)


def recover_number(text: Column, least_symbol: Column, digits: Column, separators: Column, mark_after: Column) -> Column:
    """A number read from digits, confirmed by ink: as many digits, at most one separator, each symbol sure; a mark only ink shows is put in."""
    clean = F.regexp_replace(text, r"[^\d.,]", "")
    n, marks = F.char_length(F.regexp_replace(clean, r"[.,]", "")), F.regexp_count(clean, F.lit("[.,]"))
    put = F.concat(F.substring(clean, F.lit(1), mark_after), F.lit(","), F.substring(clean, mark_after + 1, n))
    good = (least_symbol >= 85) & (n > 0) & (n == digits) & (separators <= 1) & (marks <= 1)
    return F.when(good & (marks == separators), F.translate(clean, ".", ",")).when(good & (marks == 0) & (separators == 1) & (mark_after > 0) & (mark_after < n), put)


def ean13(bits: Column) -> Column:
    """The code of 95 modules, null unless guards, digit patterns and check digit are right."""
    odd = X.EAN_LEFT
    right = ["".join("10"[int(b)] for b in p) for p in odd]
    even = [p[::-1] for p in right]
    chunk = lambda start: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(bits, i * 7 + start, F.lit(7)))
    at = lambda table, c: F.array_position(F.array(*map(F.lit, table)), c).cast("int") - 1
    left = F.transform(chunk(4), lambda c: F.struct(F.greatest(at(odd, c), at(even, c)).alias("digit"), F.when(at(odd, c) >= 0, "L").otherwise("G").alias("code")))
    rest = F.transform(chunk(51), lambda c: at(right, c))
    first = at(X.EAN_PARITY, F.array_join(F.transform(left, lambda x: x["code"]), ""))
    every = F.concat(F.array(first), F.transform(left, lambda x: x["digit"]), rest)
    total = F.aggregate(F.transform(F.slice(every, 1, 12), lambda d, i: d * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda s, x: s + x)
    good = (F.char_length(bits) == 95) & bits.startswith("101") & bits.endswith("101") & (F.substring(bits, 46, 5) == "01010") & F.forall(every, lambda d: d >= 0)
    return F.when(good & ((10 - total % 10) % 10 == F.element_at(every, 13)), F.array_join(F.transform(every, lambda d: d.cast("string")), ""))


def ean13_check_digit(twelve: Column) -> Column:
    total = F.aggregate(F.transform(F.split(twelve, ""), lambda d, i: F.when(d == "", 0).otherwise(d.try_cast("int")) * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return (10 - total % 10) % 10


def near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.greatest(a, b) * tolerance


def resolve_scale(dx: Column, dy: Column, w: Column, h: Column, one: Column, two: Column) -> Column:
    """struct<source, mm_per_pixel, level, width, height>: from file density (dpi), contour (pixels) and declared sides (mm)."""
    long, short = F.greatest(one, two) / F.greatest(w, h), F.least(one, two) / F.least(w, h)
    file = 25.4 / dx
    both = w.isNotNull() & h.isNotNull() & one.isNotNull() & two.isNotNull()
    high = both & dx.isNotNull() & near(dx, dy, 0.01) & near(file, long, 0.02) & near(file, short, 0.03)
    medium = both & near(long, short, 0.03)
    f = F.when(high, file).when(medium, (long + short) / 2)
    return F.struct(F.when(high, "density+declared").when(medium, "declared").alias("source"), f.alias("mm_per_pixel"), F.when(high, "high").when(medium, "medium").otherwise("none").alias("level"), (w * f).alias("width"), (h * f).alias("height"))


def declared_sides(text: Column) -> Column:
    """Both sides of a label from running text with a caption; null unless each is 8..600 mm."""
    pattern = X.SIDES_TEXT + X.SIDES.replace("(?iu)", "")
    flat = F.regexp_replace(text, rf"{X.WS}+", " ")
    a, b = (number(F.nullif(F.regexp_extract(flat, pattern, i), F.lit(""))) for i in (1, 2))
    return F.when(a.between(8, 600) & b.between(8, 600), F.array(a, b))


