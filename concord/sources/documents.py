"""Requirement documents: DOCX and plain text to ordered blocks and table cells."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.fixed import WS
from concord.functions.text import raised  # noqa: F401  (the Column form of _raised)

MAX_BYTES = 25 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SIGNS = str.maketrans("0oOоО23", "°°°°°²³")
PARTS = "path string, ord int, kind string, heading boolean, table_ix int, row_ix int, col_ix int, text string, error string"


def _runs(p) -> str:
    out = []
    for r in p.iter(f"{_W}r"):
        props = r.find(f"{_W}rPr")
        align = props.find(f"{_W}vertAlign") if props is not None else None
        up = align is not None and align.get(f"{_W}val") == "superscript"
        for e in r:
            if e.tag == f"{_W}t":
                out.append((e.text or "").translate(_SIGNS) if up else e.text or "")
            elif e.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
            elif e.tag == f"{_W}tab":
                out.append("\t")
    return "".join(out)


def _heading(p) -> bool:
    props = p.find(f"{_W}pPr")
    if props is None:
        return False
    style = props.find(f"{_W}pStyle")
    return props.find(f"{_W}outlineLvl") is not None or (style is not None and any(x in (style.get(f"{_W}val") or "").lower() for x in ("heading", "заголов")))


def docx_parts(content: bytes) -> list[tuple]:
    """(ord, kind, heading, table, row, column, text) of body paragraphs and table cells in order."""
    body = ElementTree.parse(io.BytesIO(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))).getroot().find(f"{_W}body")
    out, tables = [], 0
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            out.append((len(out), "paragraph", _heading(e), None, None, None, _runs(e)))
        elif e.tag == f"{_W}tbl":
            for i, row in enumerate(e.findall(f"{_W}tr")):
                for j, cell in enumerate(row.findall(f"{_W}tc")):
                    out.append((len(out), "cell", False, tables, i, j, "\n".join(_runs(p) for p in cell.findall(f"{_W}p"))))
            tables += 1
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Parts of each DOCX under path; a file that is too large or broken is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, n, c in zip(b["path"], b["length"], b["content"]):
                try:
                    if n > MAX_BYTES:
                        raise ValueError(f"{n} bytes")
                    rows += [(p, *x, None) for x in docx_parts(c)]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((p, 0, "error", False, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PARTS.split(", ")]).astype({k: "Int32" for k in ("table_ix", "row_ix", "col_ix")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "length", "content").mapInPandas(run, PARTS)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, ord, text: the paragraphs of each text file, byte-order mark and line ends removed."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("ord", "text"))


def markup_blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, ord, text: text blocks of simple markup by patterns alone: a block ends at each block tag."""
    x = F.regexp_replace(F.col(html), r"(?is)<(script|style|title)\b.*?</\1\s*>|<!--.*?-->", "")
    blocks = F.split(F.regexp_replace(x, r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|nav|article|footer|header|body|html|head|tr|td|table|section)\b[^>]*>", "\u0001"), "\u0001")
    clean = F.transform(blocks, lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, r"<[^>]*>", ""), rf"{WS}+", " ")))
    return df.select(key, F.posexplode(F.filter(clean, lambda b: b != "")).alias("ord", "text"))
