"""Structure of documents: HTML trees, sections below headings, paragraphs, offsets, summaries.

The Arrow UDFs here see one row's text at a time and make one pass over it; a null text has no parts.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillgraph.sources.readers import byte_batches

#: Elements that have no content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PARAGRAPH_CHARS = 350
NODE = {"ordinal": pa.int32(), "parent": pa.int32(), "depth": pa.int32(), "tag": pa.string(), "text": pa.string()}
#: What a node takes in Python besides its text, and what rows are handed on at.
NODE_BYTES, OUT_BYTES = 400, 4 << 20


class _Tree(HTMLParser):
    """Nodes in document order; a text belongs to the innermost open element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.path: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.nodes.append({"ordinal": len(self.nodes), "parent": self.path[-1] if self.path else -1, "depth": len(self.path), "tag": tag, "text": []})
        if tag not in VOID:
            self.path.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.path) - 1, -1, -1) if self.nodes[self.path[i]]["tag"] == tag), None)
        if at is not None:
            del self.path[at:]

    def handle_data(self, data):
        if self.path:
            self.nodes[self.path[-1]]["text"].append(data)


def html_tree(html: str | None) -> list[dict]:
    p = _Tree()
    p.feed(html or "")
    p.close()
    return [{**n, "text": re.sub(r"\s+", " ", "".join(n["text"])).strip()} for n in p.nodes]


def paragraph_spans(text: str | None, least: int = PARAGRAPH_CHARS) -> list[dict]:
    """Paragraphs between blank lines; one shorter than `least` takes in those that follow until it is not."""
    spans, at = [], 0
    for gap in [*re.finditer(r"\n\s*\n+", text or ""), None]:
        raw = (text or "")[at : gap.start() if gap else None]
        if raw.strip():
            begin = at + len(raw) - len(raw.lstrip())
            end = begin + len(raw.strip())
            if spans and spans[-1][1] - spans[-1][0] < least:
                spans[-1][1] = end
            else:
                spans.append([begin, end])
        at = gap.end() if gap else at
    return [{"start": a, "end": b, "content": text[a:b]} for a, b in spans]


def html_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each element: ordinal in document order, its parent's, depth, tag and own text. A worker holds one page's tree and OUT_BYTES of finished rows besides its batch."""
    byte_batches(pages.sparkSession)
    source = pages.select(id_col, html_col)

    def walk(batches):
        for batch in batches:
            ids, html = batch.column(0), batch.column(1)
            at, rows, size = [], [], 0

            def finished():
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array([n[c] for n in rows], t) for c, t in NODE.items())], [id_col, *NODE])

            for k in range(len(html)):
                for n in html_tree(html[k].as_py()):
                    at.append(k)
                    rows.append(n)
                    size += NODE_BYTES + len(n["text"])
                    if size >= OUT_BYTES:
                        yield finished()
                        at, rows, size = [], [], 0
            if at:
                yield finished()

    return source.mapInArrow(walk, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, ordinal int, parent int, depth int, tag string, text string")


def heading_sections(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Texts below each heading up to the next; what stands before the first is section 0 without a title. Scripts, styles and heads are left out.

    One aggregate by (page, section): the section of a node is the count of headings up to it, a running sum within the page.
    """
    shown = nodes.filter("tag NOT IN ('script', 'style', 'head', 'title', 'meta', 'noscript')").withColumn("is_heading", F.col("tag").rlike("^h[1-6]$"))
    w = Window.partitionBy(id_col).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    s = shown.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w)).filter("text <> ''")
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("ordinal", "text")))), lambda x: x["text"])
    g = s.groupBy(id_col, "section").agg(F.max(F.when(F.col("is_heading"), F.col("text"))).alias("title"), F.max(F.when(F.col("is_heading"), F.substring("tag", 2, 1).cast("int"))).alias("level"), F.array_join(body, "\n").alias("content"))
    return g.select(id_col, F.col("section").cast("int").alias("section"), "title", "level", "content")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = PARAGRAPH_CHARS) -> DataFrame:

    def cut(text: pd.Series) -> pd.Series:
        return pd.Series([paragraph_spans(x, least) for x in text], dtype=object)

    return docs.select(id_col, F.posexplode(pandas_udf(cut, "array<struct<start:int,end:int,content:string>>")(text_col)).alias("paragraph", "p")).select(id_col, "paragraph", "p.start", "p.end", "p.content")


def running_offsets(blocks: DataFrame, doc: str, order: list[str], length: Column, gap: int = 1) -> DataFrame:
    """start and end of each block when the blocks of a document are joined with `gap` characters between them."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length + gap).over(w), F.lit(0)).cast("long")
    return blocks.withColumn("start", start).withColumn("end", start + length)


def block_of_offsets(offsets: DataFrame, blocks: DataFrame, doc: str, block: str) -> DataFrame:
    """For each (doc, at) the last block that starts at or before it: an as-of join as one union and a running last value, so no pairs arise."""
    rows = blocks.select(doc, F.col("start").alias("at"), F.col(block).alias("_b"), F.lit(0).alias("_q")).unionByName(offsets.select(doc, "at", F.lit(None).cast(blocks.schema[block].dataType).alias("_b"), F.lit(1).alias("_q")))
    w = Window.partitionBy(doc).orderBy("at", "_q").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(block, F.last("_b", ignorenulls=True).over(w)).filter("_q = 1").select(doc, "at", block)


def structural_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of sentences, bracket citations, definitions and table references of each text: expressions on the row, no shuffle."""
    n = lambda p: F.coalesce(F.regexp_count(text_col, F.lit(p)), F.lit(0))
    return docs.select(
        id_col, n(r"[^.!?\s][^.!?]*").alias("sentences"), n(r"\[[^\]]+\]").alias("citations"), n(r"(?i)\b(?:is|are)\s+defined\s+as\b").alias("definitions"), n(r"(?i)\btable\s+[0-9]+").alias("table_refs"),
    )
