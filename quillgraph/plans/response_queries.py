"""Queries for what the edges of a graph show, and for layouts of documents, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import graph as K
from quillgraph.operators import insights as I
from quillgraph.plans.adapt import AS_OF_YEAR, RESULTS_SQL, results
from quillgraph.plans.collect import collector
from quillgraph.sources import layout
from quillgraph.sources.readers import table
from quillgraph.sources.store import scratch_folder

QUERIES, query = collector()

#: The order in which results count as first.
ORDER = ["paper_id", "dataset_id", "metric_id", "task_id", "value_cents", "conf", "verified", "is_sota"]
UNIT = "c"


def _with_texts(rows: DataFrame) -> DataFrame:
    paper = F.col("paper_id").cast("string")
    return rows.withColumns({
        "claim": F.when(F.col("conf") >= 95, F.concat(F.lit("Claim of paper "), paper)),
        "statement": F.when(F.col("is_sota"), F.concat(F.lit("State of the art for "), F.col("task_id"))),
        "snippets": F.array(F.concat(F.col("metric_id"), F.lit(" reaches "), F.col("value_cents").cast("string")), F.concat(F.lit("Seen in paper "), paper)),
    })


_FIRST = ", ".join(f"{c} NULLS FIRST" for c in ORDER)
_EDGE = "relation, source, target"
#: i: the instances; ins, ev, st: items of each kind within the cap; ef: effect sizes.
DETAIL_SQL = f"""x AS (SELECT *, CASE WHEN conf >= 95 THEN 'Claim of paper ' || paper_id END AS claim FROM res WHERE method_id IS NOT NULL),
i AS (SELECT 'evaluates_on' AS relation, method_id::VARCHAR AS source, dataset_id AS target, *, 'Evaluated on ' || dataset_id AS said FROM x WHERE dataset_id IS NOT NULL
  UNION ALL SELECT 'reports', method_id::VARCHAR, metric_id, *, metric_id || ' ' || value_cents || '{UNIT}' || coalesce(' on ' || dataset_id, ' for ' || task_id, '') FROM x WHERE metric_id IS NOT NULL
  UNION ALL SELECT 'proposes', method_id::VARCHAR, task_id, *, 'Targets ' || task_id FROM x WHERE task_id IS NOT NULL),
once AS (SELECT *, coalesce(claim || ' - ', '') || said AS text FROM i WHERE verified QUALIFY row_number() OVER (PARTITION BY {_EDGE}, paper_id, text ORDER BY {_FIRST}) = 1),
ins AS (SELECT *, row_number() OVER (PARTITION BY {_EDGE} ORDER BY {_FIRST}) AS k FROM once QUALIFY k <= 12),
sn AS (SELECT *, 0 AS part, metric_id || ' reaches ' || value_cents AS text FROM i UNION ALL SELECT *, 1, 'Seen in paper ' || paper_id FROM i),
ev AS (SELECT *, row_number() OVER (PARTITION BY {_EDGE} ORDER BY {_FIRST}, part) AS k FROM sn QUALIFY k <= 12),
st AS (SELECT *, 'State of the art for ' || task_id AS text, row_number() OVER (PARTITION BY {_EDGE} ORDER BY {_FIRST}) AS k FROM i WHERE is_sota AND task_id IS NOT NULL QUALIFY k <= 12),
items AS (SELECT {_EDGE}, 1 AS kind, k, paper_id, text, conf FROM ins UNION ALL SELECT {_EDGE}, 2, k, paper_id, text, conf FROM ev UNION ALL SELECT {_EDGE}, 3, k, paper_id, text, conf FROM st),
lists AS (SELECT {_EDGE}, """ + ", ".join(f"coalesce(string_agg(paper_id || ':' || conf || ':' || text, ' | ' ORDER BY k) FILTER (kind = {n}), '') AS {kind}" for n, kind in enumerate(I.KINDS, 1)) + f""" FROM items GROUP BY ALL),
ef AS (SELECT {_EDGE}, max(value_cents) AS best, min(value_cents) AS worst, best - worst AS delta, arg_min(paper_id, (-value_cents, paper_id)) AS best_paper, arg_min(paper_id, (value_cents, paper_id)) AS worst_paper FROM i GROUP BY ALL),
det AS (SELECT {_EDGE}, insights, evidence, statements, CASE WHEN delta > 0 THEN best_paper END AS best_paper, CASE WHEN delta > 0 THEN worst_paper END AS worst_paper,
  CASE WHEN delta > 0 THEN 'Effect size delta ' || delta || '{UNIT} between best (' || best || '{UNIT}) and worst (' || worst || '{UNIT})' END AS effect FROM ef JOIN lists USING ({_EDGE}))"""  # fmt: skip


def _texts(kind: str):
    return F.array_join(F.transform(kind, lambda x: F.concat_ws(":", x["paper_id"].cast("string"), x["conf"].cast("string"), x["text"])), " | ").alias(kind)


@query(f"WITH {RESULTS_SQL}, {DETAIL_SQL} SELECT * FROM det")
def edge_insights(spark, sf):
    """What each edge shows: insights, evidence and statements, twelve of each at most, and its effect size."""
    return I.details_of_results(results(spark, sf), _with_texts, ORDER, scratch_folder(spark, "insights"), UNIT).select(*I.EDGE, *map(_texts, I.KINDS), "best_paper", "worst_paper", "effect")


WEIGHT_SQL = f"""bp AS (SELECT {_EDGE}, paper_id, sum(conf) * 10000 // count(*) AS mean, count(*) AS n, count(*) FILTER (verified) AS v, count(*) FILTER (is_sota) AS s, min(yr) AS lo, max(yr) AS hi FROM i GROUP BY ALL),
e AS (SELECT {_EDGE}, count(*)::BIGINT AS papers, sum(mean)::BIGINT // count(*) AS mean_conf, sum(n) AS n, sum(v) AS v, sum(s) AS s, min(lo) AS lo, max(hi) AS hi FROM bp GROUP BY ALL HAVING mean_conf >= 600000),
w AS (SELECT *, (papers * mean_conf * (100 + least(greatest(5 - ({AS_OF_YEAR} - hi), 0), 5) * 5 + least(20, (hi - lo) * 2)) * (1000 + least(300, n * 30) + v * 300 // n + least(100, s * 50)))::DOUBLE / 1e11 AS weight,
  CASE relation WHEN 'evaluates_on' THEN 'dataset' WHEN 'reports' THEN 'metric' ELSE 'task' END AS kind FROM e),
nd AS (SELECT type, node, sum(papers)::BIGINT AS papers, count(*)::BIGINT AS degree FROM (SELECT 'method' AS type, source AS node, papers FROM w UNION ALL SELECT kind, target, papers FROM w) GROUP BY 1, 2 ORDER BY papers DESC, lower(node), type LIMIT 30),
sh AS (SELECT * FROM w WHERE ('method', source) IN (SELECT (type, node) FROM nd) AND (kind, target) IN (SELECT (type, node) FROM nd) ORDER BY weight DESC, {_EDGE} LIMIT 40)"""


@query(
    f"""WITH {RESULTS_SQL}, {DETAIL_SQL}, {WEIGHT_SQL} SELECT 'node' AS part, type || ':' || node AS id, papers, degree AS count, NULL::DOUBLE AS weight, node AS text FROM nd
UNION ALL SELECT 'edge', relation || ':' || source || '->' || target, papers, n::BIGINT, weight, insights || ' # ' || evidence || ' # ' || statements || ' # ' || coalesce(effect, '') FROM sh JOIN det USING ({_EDGE})
UNION ALL SELECT 'meta', 'meta', (SELECT count(*) FROM nd)::BIGINT, (SELECT count(*) FROM sh)::BIGINT, NULL, (SELECT count(*) FROM w) || ' edges, more: ' || ((SELECT count(*) FROM w) > (SELECT count(*) FROM sh))::VARCHAR || ', limits 30 40, from 60'"""
)
def graph_response(spark, sf):
    """The response of an overview of 30 nodes and 40 edges: nodes, edges with all that they show, and one row about it."""
    path = scratch_folder(spark, "response")
    instances = K.edge_instances(_with_texts(I.dealt_by_paper(results(spark, sf), f"{path}/results")))
    r = I.response(instances, ORDER, AS_OF_YEAR, f"{path}/edges", nodes=30, edges=40, unit=UNIT)
    none = F.lit(None).cast("double").alias("weight")
    s = lambda c: F.col(c).cast("string")
    nodes = r["nodes"].select(F.lit("node").alias("part"), "id", "papers", F.col("degree").alias("count"), none, F.col("label").alias("text"))
    shown = F.concat_ws(" # ", *map(_texts, I.KINDS), F.coalesce("effect", F.lit("")))
    edges = r["edges"].select(F.lit("edge").alias("part"), "id", F.col("paper_count").alias("papers"), F.col("n_results").alias("count"), "weight", shown.alias("text"))
    said = F.concat(s("edge_total"), F.lit(" edges, more: "), s("has_more"), F.lit(", limits "), s("node_limit"), F.lit(" "), s("edge_limit"), F.lit(", from "), s("min_conf"))
    meta = r["meta"].select(F.lit("meta").alias("part"), F.lit("meta").alias("id"), F.col("node_count").alias("papers"), F.col("edge_count").alias("count"), none, said.alias("text"))
    return nodes.unionByName(edges).unionByName(meta)


# ---- layouts: the sentences of each document as blocks, twelve to a page, the last listed first; their words as a table's cells

PAGE = 12


def _layouts(spark, sf) -> DataFrame:
    """Documents written as JSON lines in the form that layout readers give, and read back."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    span = lambda text, size, flags: F.struct(text.alias("text"), size.alias("size"), flags.alias("flags"))

    def block(piece, i):
        spans = F.array(span(piece, F.lit(10) + i % 3, F.when(i % 5 == 0, 2).otherwise(0)), span(F.lit("."), F.lit(12), F.lit(0)))
        return F.struct(F.when(i % 7 == 6, 1).otherwise(0).alias("type"), F.array(50 + i % 2 * 200, F.floor(i / 2) * 20).alias("bbox"), F.array(F.struct(spans.alias("spans"))).alias("lines"))

    pieces = F.split("text", r"\. ")
    d = d.select("doc_id", pieces.alias("pieces"), F.transform(pieces, block).alias("blocks"))
    part = lambda c, p: F.slice(c, p * PAGE + 1, F.lit(PAGE))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / PAGE).cast("int")), lambda p: F.struct(F.reverse(part("blocks", p)).alias("blocks"), F.array(F.transform(part("pieces", p), lambda s: F.split(s, " "))).alias("tables")))
    path = scratch_folder(spark, "layouts")
    d.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("name"), pages.alias("pages"))).alias("value")).write.text(path)
    return layout.documents(spark, path)


_PIECES = "p AS (SELECT doc_id, string_split(text, '. ') AS s FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id::VARCHAR AS name, (i - 1)::INTEGER AS i, s[i] AS piece FROM p, unnest(range(1, len(s) + 1)) AS t(i))"
_CLEAN = r"nullif(regexp_replace(regexp_replace({}, '[\x00-\x08\x0B-\x1F]', '', 'g'), '^\s+|\s+$', '', 'g'), '')"


@query(
    f"""WITH {_PIECES} SELECT name, (i // {PAGE})::INTEGER AS page, (row_number() OVER (PARTITION BY name, i // {PAGE} ORDER BY i) - 1)::INTEGER AS block, {_CLEAN.format("piece || '.'")} AS text,
  CASE WHEN piece = '' THEN 12 ELSE (22 + i % 3) / 2.0 END::DOUBLE AS font, CASE WHEN piece = '' THEN 12 ELSE greatest(10 + i % 3, 12) END::DOUBLE AS largest, piece <> '' AND i % 5 = 0 AS bold, (50 + i % 2 * 200)::DOUBLE AS x0, (i // 2 * 20)::DOUBLE AS y0 FROM u WHERE i % 7 <> 6"""
)
def layout_blocks(spark, sf):
    """The text blocks of all documents in reading order, from layout files."""
    return layout.blocks(_layouts(spark, sf))


@query(
    f"""WITH {_PIECES}, c AS (SELECT name, i, string_split(piece, ' ') AS c FROM u) SELECT name, 'table_' || (i // {PAGE} + 1) || '_1' AS table_id, (i // {PAGE} + 1)::INTEGER AS page_number, (i % {PAGE})::INTEGER AS row, (k - 1)::INTEGER AS "column", {_CLEAN.format("c[k]")} AS text
FROM c, unnest(range(1, len(c) + 1)) AS t(k) WHERE {_CLEAN.format("c[k]")} IS NOT NULL"""
)
def table_cells(spark, sf):
    """The cells of all tables, from layout files."""
    return layout.cells(_layouts(spark, sf))
