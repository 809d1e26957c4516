"""Image files: stated density, and line sheets for a second engine."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 30.0, 4800.0


def density(data: bytes) -> tuple[float, float] | None:
    """Dots per inch across and down that a PNG or JPEG states; Exif goes before JFIF; None outside 30..4800."""
    found = None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 12 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"pHYs" and size >= 9:
                x, y, unit = struct.unpack(">IIB", data[at + 8 : at + 17])
                found = (x * 0.0254, y * 0.0254) if unit == 1 else None
            if kind == b"IDAT":
                break
            at += 12 + size
    elif data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            part = data[at + 4 : at + 2 + size]
            if part[:5] == b"JFIF\0" and len(part) >= 12 and not found:
                unit, x, y = struct.unpack(">BHH", part[7:12])
                by = {1: 1.0, 2: 2.54}.get(unit)
                found = (x * by, y * by) if by else None
            if part[:6] == b"Exif\0\0":
                found = _exif(part[6:]) or found
            at += 2 + size
    return found if found and all(LOW <= v <= HIGH for v in found) else None


def _exif(t: bytes) -> tuple[float, float] | None:
    try:
        order = {b"II": "<", b"MM": ">"}[t[:2]]
        ifd = struct.unpack(order + "I", t[4:8])[0]
        got = {}
        for i in range(struct.unpack(order + "H", t[ifd : ifd + 2])[0]):
            e = ifd + 2 + 12 * i
            tag, _, _, value = struct.unpack(order + "HHII", t[e : e + 12])
            if tag in (0x011A, 0x011B):
                a, b = struct.unpack(order + "II", t[value : value + 8])
                got[tag] = a / b
            elif tag == 0x0128:
                got[tag] = struct.unpack(order + "H", t[e + 8 : e + 10])[0]
        by = 2.54 if got.get(0x0128) == 3 else 1.0
        return got[0x011A] * by, got[0x011B] * by
    except (KeyError, struct.error, ZeroDivisionError):
        return None


def densities(files: DataFrame, content: str = "content") -> DataFrame:
    """files with dpi_x and dpi_y (null where none is stated) instead of their content."""
    keep = [f for f in files.schema.fields if f.name != content]
    names = [f.name for f in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = [density(bytes(c)) if c is not None else None for c in b[content]]
            yield b[names].assign(dpi_x=pd.array([x and x[0] for x in d], "Float64"), dpi_y=pd.array([x and x[1] for x in d], "Float64"))

    return files.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", dpi_x double, dpi_y double")


def packed(lines: DataFrame, keys: list[str], order: str, width: str, *, gap: int = 30, margin: int = 24, height: int = 48, most_width: int = 2400, most_height: int = 1900) -> DataFrame:
    """sheet, slot_x and slot_y of each line crop, packed into rows of sheets in order: a fold over each group's own lines."""
    state = "struct<sheet:int,x:int,y:int,out:array<struct<o:bigint,sheet:int,x:int,y:int>>>"

    def place(s: Column, item: Column) -> Column:
        new_row = s["x"] + item["w"] > most_width - margin
        y = F.when(new_row, s["y"] + height + gap).otherwise(s["y"])
        x = F.when(new_row, F.lit(margin)).otherwise(s["x"])
        new_sheet = y + height > most_height - margin
        sheet, x, y = s["sheet"] + F.when(new_sheet, 1).otherwise(0), F.when(new_sheet, F.lit(margin)).otherwise(x), F.when(new_sheet, F.lit(margin)).otherwise(y)
        slot = F.struct(item["o"].cast("bigint").alias("o"), sheet.alias("sheet"), x.alias("x"), y.alias("y"))
        return F.struct(sheet.alias("sheet"), (x + item["w"] + gap).alias("x"), y.alias("y"), F.concat(s["out"], F.array(slot)).alias("out")).cast(state)

    start = F.struct(F.lit(0).alias("sheet"), F.lit(margin).alias("x"), F.lit(margin).alias("y"), F.array().cast("array<struct<o:bigint,sheet:int,x:int,y:int>>").alias("out")).cast(state)
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.least(F.col(width), F.lit(most_width - 2 * margin)).cast("int").alias("w"))))
    sheets = lines.groupBy(*keys).agg(F.aggregate(items, start, place)["out"].alias("out"))
    return sheets.select(*keys, F.explode("out").alias("s")).select(*keys, F.col("s.o").alias(order), "s.sheet", F.col("s.x").alias("slot_x"), F.col("s.y").alias("slot_y"))


#: Largest artwork taken; what the first bytes of each kind are.
MAX_ARTWORK = 30 << 20
MAGIC = {"pdf": "25504446", "png": "89504E470D0A1A0A", "jpeg": "FFD8FF"}


def artwork(files: DataFrame, content: str = "content", length: str = "length") -> DataFrame:
    """files with kind (pdf, png, jpeg, webp) and error instead of their content: others, and those over 30 MB, are rejected; dpi of pictures where stated."""
    head = F.hex(F.substring(F.col(content), 1, 16))
    kind = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        kind = F.when(head.startswith(magic), name).otherwise(kind)
    # RIFF, four bytes of size, WEBP
    kind = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").otherwise(kind)
    large = F.col(length) > MAX_ARTWORK
    rows = files.withColumn("error", F.when(large, "too large").when(kind.isNull(), "unknown kind")).withColumn("kind", F.when(F.col("error").isNull(), kind))
    return densities(rows.withColumn(content, F.when(F.col("kind").isin("png", "jpeg"), F.col(content))), content)
