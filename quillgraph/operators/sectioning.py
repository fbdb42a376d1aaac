"""Sections of documents from layout blocks, the choice among ways to cut a document, and sentence windows for a reader of bounded input."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Titles that are headings in any type face.
HEADINGS = ["abstract", "introduction", "related work", "background", "method", "methods", "methodology", "experiments", "results", "discussion", "conclusion", "conclusions", "future work", "acknowledgements", "acknowledgments", "references"]
#: A sentence in a window takes "[0] x" and a line break at least.
LEAST_LINE = 6


def is_heading(text: Column, font: Column, largest: Column, bold: Column, median: Column) -> Column:
    """A short block with three letters that is a usual title, numbered, in capitals, larger than the document's median font, or bold. Null counts as empty, plain and of size 0."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    font, largest, median = (F.coalesce(c, F.lit(0.0)) for c in (font, largest, median))
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    capitals = F.regexp_count(t, F.lit(r"\p{Lu}"))
    # a title in capitals: nothing but capitals, figures and the signs that titles have, a capital first
    capital, signs = string.ascii_uppercase, string.digits + " -:,"
    titled = (F.length(t) >= 3) & F.left(t, F.lit(1)).isin(*capital) & (F.translate(t, capital + signs, "") == "")
    named = F.lower(t).isin(HEADINGS) | t.rlike(r"^[0-9]+(\.[0-9]+)* ") | titled
    large = (median > 0) & ((font >= median * 1.2) | (largest >= median * 1.25))
    strong = F.coalesce(bold, F.lit(False)) & ((median == 0) | (font >= median * 1.05) | (capitals * 10 >= letters * 6))
    shouted = (capitals * 4 >= letters * 3) & (F.size(F.split(t, " ")) <= 10)
    return (F.length(t) <= 160) & (letters >= 3) & (named | large | strong | shouted)


def marked_headings(blocks: DataFrame, doc: str) -> DataFrame:
    """blocks (text, font, largest, bold) with is_heading; the median font is one row for each document, joined back."""
    median = blocks.groupBy(F.col(doc).alias("_doc")).agg(F.median("font").alias("_median"))
    rows = blocks.join(median, F.col(doc).eqNullSafe(F.col("_doc")))
    return rows.withColumn("is_heading", is_heading(F.col("text"), F.col("font"), F.col("largest"), F.col("bold"), F.col("_median"))).drop("_doc", "_median")


def block_sections(blocks: DataFrame, doc: str, order: str) -> DataFrame:
    """section, title, content: the blocks from a heading to the next one; those before the first are section 0 without a title. Sections without a text are left out."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = blocks.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w).cast("int"))
    body = F.array_sort(F.collect_list(F.when(~F.col("is_heading") & (F.trim("text") != ""), F.struct(F.col(order).alias("at"), "text"))))
    g = s.groupBy(doc, "section").agg(F.max(F.when(F.col("is_heading"), F.left(F.trim("text"), F.lit(255)))).alias("title"), F.array_join(F.transform(body, lambda b: b["text"]), "\n").alias("content"))
    return g.filter("content <> ''")


def choose_sections(candidates: DataFrame, totals: DataFrame, doc: str) -> DataFrame:
    """Of several ways to cut a document the first (least `strategy`) that is viable: two sections or more with 40 % of the text, or three with 25 %; else the last one.

    candidates: doc, strategy, section, content. totals: doc, total. One row for each document and strategy decides; the sections meet it in a semi join.
    """
    cut = candidates.groupBy(doc, "strategy").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("covered")).join(totals, doc)
    viable = (F.col("n") >= 2) & (F.col("total") > 0) & ((F.col("covered") * 5 >= F.col("total") * 2) | ((F.col("n") >= 3) & (F.col("covered") * 4 >= F.col("total"))))
    pick = cut.groupBy(doc).agg(F.coalesce(F.min(F.when(viable, F.col("strategy"))), F.max("strategy")).alias("strategy"))
    return candidates.join(pick, [doc, "strategy"], "left_semi")


def sentence_windows(sentences: DataFrame, section: str, order: str, text: str = "sentence", budget: int = 3500, overlap: int = 1, most: int = 3) -> DataFrame:
    """chunk, first, last, n, chars: a section's sentences packed greedily into at most `most` windows of `budget` characters, each written "[order] sentence" and a line break.

    A window holds one sentence at least and begins `overlap` sentences before the end of the one before it. Only as many sentences as `most` windows can
    hold are gathered for a section, so a very long section does not become a long array; the windows are the same as from all of them.
    """
    budget = max(120, budget)
    w = Window.partitionBy(section).orderBy(order)
    size = F.length(F.concat(F.lit("["), F.col(order).cast("string"), F.lit("] "), F.col(text))) + 1
    s = sentences.select(section, F.col(order).alias("at"), F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.row_number().over(w).alias("k"))
    g = s.filter(F.col("k") <= most * (budget // LEAST_LINE + 1)).groupBy(section).agg(F.array_sort(F.collect_list(F.struct("at", "cum"))).alias("l"))
    g = g.select(section, F.transform("l", lambda x: x["at"]).alias("ids"), F.transform("l", lambda x: x["cum"]).alias("cum"), F.lit(0).alias("s0"))
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("cum", i - 1))
    within = lambda most: F.size(F.filter("cum", lambda c: c <= most))
    found = []
    for i in range(most):
        start = F.col(f"s{i}")
        g = g.withColumn(f"b{i}", before(start)).withColumn(f"e{i}", F.greatest(start, within(F.col(f"b{i}") + budget) - 1))
        end = F.col(f"e{i}")
        row = F.struct(F.lit(i + 1).alias("chunk"), F.get("ids", start).alias("first"), F.get("ids", end).alias("last"), (end - start + 1).alias("n"), (F.get("cum", end) - F.col(f"b{i}")).alias("chars"))
        found.append(F.when(start.isNotNull(), row))
        g = g.withColumn(f"s{i + 1}", F.when(start.isNotNull() & (end + 1 < F.size("cum")), F.when(end + 1 - overlap > start, end + 1 - overlap).otherwise(end + 1)))
    return g.select(section, F.inline(F.array_compact(F.array(*found))))


def first_windows(windows: DataFrame, paper: str, order: list[str], most: int = 24) -> DataFrame:
    """The first `most` windows of each paper."""
    k = F.row_number().over(Window.partitionBy(paper).orderBy(*order))
    return windows.withColumn("place", k).filter(F.col("place") <= most)
