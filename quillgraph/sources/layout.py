"""Layout of documents as JSON, as PDF readers give it: text blocks with their spans, and tables with their cells.

A document is {"name": ..., "pages": [{"blocks": [{"type", "bbox", "lines": [{"spans": [{"text", "size", "flags"}]}]}], "tables": [[[cell, ...], ...], ...]}]}: one on each line
of a file, or (whole=True) one to a file. Spark reads the files, wherever they are, and parses in the JVM; what a query does not use of a document is not parsed.

Defined results: a document that is no JSON object, or lacks a name, is a row of malformed() and gives no block or cell; unknown fields are passed over; a missing list is empty;
blocks that are no text (type other than 0) or hold none go; a missing box is at (0, 0), a missing size is 0; cells that are null or blank go, numbers in cells count as their text;
an empty folder of files gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import sanitize

SPAN = "struct<text:string,size:double,flags:int>"
BLOCK = f"struct<type:int,bbox:array<double>,lines:array<struct<spans:array<{SPAN}>>>>"
DOCUMENT = f"struct<name:string,pages:array<struct<blocks:array<{BLOCK}>,tables:array<array<array<string>>>>>>"
#: Fixed value: the flag of a bold span.
BOLD = 2


def documents(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """file, raw, doc (null of one that is malformed)."""
    raw = spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).filter(F.trim("raw") != "")
    parsed = F.from_json("raw", DOCUMENT)
    return raw.select("file", "raw", F.when(parsed["name"].isNotNull(), parsed).alias("doc"))


def malformed(docs: DataFrame) -> DataFrame:
    return docs.filter("doc IS NULL").select("file", F.sha2("raw", 256).alias("sha256"))


def _pages(docs: DataFrame) -> DataFrame:
    return docs.filter("doc IS NOT NULL").select(F.col("doc.name").alias("name"), F.posexplode("doc.pages").alias("page", "content"))


def _joined(parts: Column, by: str) -> Column:
    return F.array_join(F.filter(parts, lambda p: p != ""), by)


def _read(blocks: Column) -> Column:
    """The text blocks of a page in reading order."""

    def opened(b: Column, listed: Column) -> Column:
        lines = F.coalesce(b["lines"], F.array())
        spans = F.flatten(F.transform(lines, lambda line: F.coalesce(line["spans"], F.array())))
        text = F.transform(lines, lambda line: F.array_join(F.transform(line["spans"], lambda s: s["text"]), ""))
        at = [F.coalesce(F.get(b["bbox"], F.lit(i)), F.lit(0.0)).alias(c) for i, c in enumerate(("x0", "y0"))]
        return F.struct(listed.alias("listed"), F.coalesce(b["type"], F.lit(0)).alias("type"), F.filter(spans, lambda s: s["text"] != "").alias("spans"), sanitize(_joined(text, "\n")).alias("text"), *at)

    def measured(b: Column) -> Column:
        sizes = F.filter(F.transform(b["spans"], lambda s: s["size"]), lambda x: x > 0)
        mean = F.coalesce(F.try_divide(F.aggregate(sizes, F.lit(0.0), lambda total, x: total + x), F.size(sizes)), F.lit(0.0))
        bold = F.exists(b["spans"], lambda s: F.coalesce(s["flags"], F.lit(0)).bitwiseAND(BOLD) != 0)
        return F.struct(F.round(b["y0"], 2).alias("top"), F.round(b["x0"], 2).alias("left"), b["listed"].alias("listed"), b["text"].alias("text"), mean.alias("font"), F.coalesce(F.array_max(sizes), F.lit(0.0)).alias("largest"), bold.alias("bold"), b["x0"].alias("x0"), b["y0"].alias("y0"))

    texts = F.filter(F.transform(blocks, opened), lambda b: (b["type"] == 0) & b["text"].isNotNull())
    return F.array_sort(F.transform(texts, measured))


def blocks(docs: DataFrame) -> DataFrame:
    """name, page (from 0), block (place in the reading order of its page: by top, then left, in hundredths, then as listed), text, font (mean size of its spans), largest, bold, x0, y0.
    A page is put in order within its row: no shuffle."""
    read = _pages(docs).select("name", "page", F.posexplode(_read(F.col("content.blocks"))).alias("block", "b"))
    return read.select("name", "page", "block", *[F.col(f"b.{c}").alias(c) for c in ("text", "font", "largest", "bold", "x0", "y0")])


def cells(docs: DataFrame) -> DataFrame:
    """name, table_id (table_<page>_<number>, both from 1), page_number, row, column (from 0), text. Explodes alone: no shuffle."""
    tables = _pages(docs).select("name", "page", F.posexplode("content.tables").alias("number", "rows"))
    rows = tables.select("name", (F.col("page") + 1).alias("page_number"), F.concat_ws("_", F.lit("table"), F.col("page") + 1, F.col("number") + 1).alias("table_id"), F.posexplode("rows").alias("row", "cells"))
    return rows.select("name", "table_id", "page_number", "row", F.posexplode("cells").alias("column", "cell")).select("name", "table_id", "page_number", "row", "column", sanitize(F.col("cell")).alias("text")).filter("text IS NOT NULL")
