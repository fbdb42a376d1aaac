"""What the edges of a graph show: insights, evidence and statements under caps, effect sizes, and a response with its nodes and counts.

Instances are rows of operators.graph.edge_instances() with the columns claim and statement (texts or null) and snippets (a list of texts or null) besides.
"First" is by the columns that the caller names, nulls before values; rows that agree in all of them may stand for each other.
Items are ranked within their edge. Spark cuts each task's share of an edge at the cap before the shuffle, so an edge of any number of results moves at most `most` items of
a kind for each task, and no list is longer than the cap. An empty table gives no edges; an edge without items has empty lists.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.labels import edge_summary
from quillgraph.operators import graph as K

EDGE = ["relation", "source", "target"]
#: Fixed value: as many items of a kind an edge shows.
CAP = 12
KINDS = ["insights", "evidence", "statements"]
#: Results of a method beyond which its edges are cut by each task before they are shuffled, so that no task holds all of them.
CROWDED = 400_000
#: Results that a task takes on average when they are dealt by method.
DEALT = 200_000


def _place(order: list[str]) -> Column:
    return F.struct(*order).alias("at")


def _capped(items: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy(*EDGE, "kind").orderBy("at", "part")
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select(*EDGE, "kind", "rank", "paper_id", "text", "conf")


def _said(unit: str | None) -> Column:
    return edge_summary(F.col("relation"), F.col("metric_id"), F.col("value_cents").cast("string"), F.lit(unit or ""), F.col("dataset_id"), F.col("task_id"), F.col("claim"), F.col("verified"))


def insights(instances: DataFrame, order: list[str], unit: str | None = None, most: int = CAP) -> DataFrame:
    """A sentence about each result that was not refuted; of equal sentences of a paper the first. Repeats are removed by an aggregate, whose rows are then ranked."""
    rows = instances.select(*EDGE, "paper_id", _said(unit).alias("text"), F.struct(_place(order), "conf").alias("item")).filter("text <> ''")
    first = rows.groupBy(*EDGE, "paper_id", "text").agg(F.min("item").alias("item"))
    return _capped(first.select(*EDGE, "paper_id", "text", "item.at", "item.conf", F.lit("insights").alias("kind"), F.lit(0).alias("part")), most)


def shown_texts(instances: DataFrame, order: list[str], most: int = CAP) -> DataFrame:
    """evidence: the snippets of all results, repeats too, those of one result in its own order; statements: one at most of a result. Both in one pass."""
    item = lambda kind, part, text: F.struct(F.lit(kind).alias("kind"), part.alias("part"), text.alias("text"))
    snippets = F.transform(F.coalesce("snippets", F.array()), lambda s, i: item("evidence", i, s))
    said = F.filter(F.array(item("statements", F.lit(0), F.col("statement"))), lambda x: x["text"].isNotNull())
    return _capped(instances.select(*EDGE, "paper_id", _place(order), "conf", F.inline(F.concat(snippets, said))), most)


def _ends(at: Column) -> list[Column]:
    """Aggregates: the largest value and the smallest, each where it is first."""
    value = F.col("value_cents")
    end = lambda v: F.min(F.when(value.isNotNull(), F.struct(v.alias("v"), at, "paper_id")))
    return [end(-value).alias("hi"), end(value).alias("lo")]


def _effect(unit: str | None) -> list[Column]:
    """Columns of an effect size out of hi and lo."""
    two, u = -F.col("hi.v") > F.col("lo.v"), F.lit(unit or "")
    found = {"best": -F.col("hi.v"), "best_paper": F.col("hi.paper_id"), "worst": F.col("lo.v"), "worst_paper": F.col("lo.paper_id"), "delta": -F.col("hi.v") - F.col("lo.v")}
    spelled = lambda c: F.concat(found[c].cast("string"), u)
    said = F.concat(F.lit("Effect size delta "), spelled("delta"), F.lit(" between best ("), spelled("best"), F.lit(") and worst ("), spelled("worst"), F.lit(")"))
    return [*[F.when(two, c).alias(n) for n, c in found.items()], F.when(two, said).alias("effect")]


def effects(instances: DataFrame, order: list[str], unit: str | None = None) -> DataFrame:
    """Every edge, with delta, best and worst value, their papers and a sentence where it has two different values."""
    return instances.groupBy(*EDGE).agg(*_ends(_place(order))).select(*EDGE, *_effect(unit))


def edge_details(instances: DataFrame, order: list[str], unit: str | None = None, most: int = CAP) -> DataFrame:
    """A row for each edge: lists of (paper_id, text, conf) of each kind, and the effect size (null without two different values). Reads the instances three times: for
    insights, texts and effects."""
    items = insights(instances, order, unit, most).unionByName(shown_texts(instances, order, most))
    own = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "paper_id", "text", "conf"))))
    lists = items.groupBy(*EDGE).agg(*[F.transform(own(k), lambda x: x.dropFields("rank")).alias(k) for k in KINDS])
    both = effects(instances, order, unit).join(lists, EDGE, "left")
    return both.withColumns({k: F.coalesce(k, F.array()) for k in KINDS})


def _details_in_place(instances: DataFrame, texts: Callable[[DataFrame], DataFrame], order: list[str], unit: str | None, most: int) -> DataFrame:
    """edge_details() of instances that are dealt by their source: windows and aggregate find an edge's rows in one task, so nothing is shuffled. Rows are counted in order;
    those within the cap of a kind become its items. Of the texts only sentences are sorted, the others are made anew behind."""
    own = instances.columns
    rows = texts(instances).withColumns({"said": _said(unit), "has_evidence": F.size(F.coalesce("snippets", F.array())) > 0, "has_statements": F.col("statement").isNotNull()})
    kept = list(dict.fromkeys([*EDGE, "paper_id", "conf", "value_cents", *own]))
    rows = rows.select(*kept, "said", "has_evidence", "has_statements")
    once = F.row_number().over(Window.partitionBy(*EDGE, "paper_id", "said").orderBy(*order, "conf"))
    rows = rows.withColumn("has_insights", (F.col("said") != "") & (once == 1))
    w = Window.partitionBy(*EDGE).orderBy(*order)
    # a result with snippets has one in the first place, so the first `most` such results hold the first `most` snippets
    within = {f"in_{k}": F.col(f"has_{k}") & (F.count_if(F.col(f"has_{k}")).over(w.rowsBetween(Window.unboundedPreceding, 0)) <= most) for k in KINDS}
    rows = texts(rows.withColumns({**within, "place": F.rank().over(w)}))
    item = lambda part, text: F.struct(F.col("place"), part.alias("part"), F.col("paper_id"), text.alias("text"), F.col("conf"))
    items = {
        "insights": F.array(item(F.lit(0), F.col("said"))), "statements": F.array(item(F.lit(0), F.col("statement"))),
        "evidence": F.transform(F.slice("snippets", 1, most), lambda s, i: item(i, s)),
    }
    lists = [F.collect_list(F.when(F.col(f"in_{k}"), items[k])).alias(k) for k in KINDS]
    shown = lambda k: F.transform(F.slice(F.array_sort(F.flatten(k)), 1, most), lambda x: x.dropFields("place", "part")).alias(k)
    return rows.groupBy(*EDGE).agg(*_ends(F.col("place")), *lists).select(*EDGE, *_effect(unit), *map(shown, KINDS))


def dealt_by_paper(results: DataFrame, path: str) -> DataFrame:
    """results, written once to path, a new folder that executors share, and dealt by method and paper in parts by their number: edges are then aggregated by paper within a task, whose groups are
    those of some DEALT results, whatever a split holds; a method of many papers is spread."""
    results.write.parquet(path)
    written = results.sparkSession.read.schema(results.schema).parquet(path)
    return written.repartition(written.count() // DEALT + 1, F.col("method_id").cast("string"), "paper_id")


def _dealt_by_method(results: DataFrame, path: str, crowded: int) -> tuple[DataFrame, DataFrame]:
    """results with a method, written once to path: those of methods of up to `crowded` results dealt by method in parts by their number, and those of the others (their ids, at most one for so many
    results, are broadcast)."""
    results.filter("method_id IS NOT NULL").write.parquet(path)
    written = results.sparkSession.read.schema(results.schema).parquet(path)
    hot = F.broadcast(written.groupBy("method_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded).select("method_id"))
    few, many = written.join(hot, "method_id", "left_anti"), written.join(hot, "method_id", "left_semi")
    return few.repartition(written.count() // DEALT + 1, F.col("method_id").cast("string")), many


def edges_of_results(results: DataFrame, as_of_year: int, path: str, min_conf: int = 60, crowded: int = CROWDED) -> DataFrame:
    """graph.weighted_edges() of all relations. An edge belongs to one method, so results are shuffled once, by method, before they become three edges each, and are aggregated by paper and edge in place;
    only those of crowded methods are shuffled by edge and paper. path: a new folder that executors share, to which results are written once."""
    few, many = (K.weighted_edges(K.edge_instances(own), as_of_year, min_conf) for own in _dealt_by_method(results.drop("value_cents"), path, crowded))
    return few.unionByName(many)


def details_of_results(results: DataFrame, texts: Callable[[DataFrame], DataFrame], order: list[str], path: str, unit: str | None = None, most: int = CAP, crowded: int = CROWDED) -> DataFrame:
    """edge_details() of all edges of results. texts adds the columns claim, statement and snippets.

    An edge belongs to one method, so results are shuffled once, by method, before they become edges and texts, in parts by their number. They are written once to path, a new folder that executors share,
    and read from there. Methods of more than `crowded` results go by edge_details(), which cuts hot edges before a shuffle.
    """
    few, many = _dealt_by_method(results, path, crowded)
    return _details_in_place(K.edge_instances(few), texts, order, unit, most).unionByName(edge_details(K.edge_instances(texts(many)), order, unit, most))


def response(instances: DataFrame, order: list[str], as_of_year: int, path: str, min_conf: int = 60, nodes: int = 100, edges: int = 500, unit: str | None = None) -> dict[str, DataFrame]:
    """What a view of the graph gets: `nodes` (the most connected ones, as in overview()), `edges` (the heaviest between them, with details) and `meta` (one row: counts, whether
    there is more, and the limits and threshold in force, so that a caller who left them out sees the defaults).

    Both limits are those of a view. All edges are written once to path, a new folder that executors share, and read from there. Details are made for the edges shown
    only: their keys, at most `edges` rows, thin the instances before any item is made.
    """
    nodes, edges = K.limit_of(nodes, 100, 500), K.limit_of(edges, 500, 500)
    weighted = K.weighted_edges(instances, as_of_year, min_conf)
    weighted.write.parquet(path)
    weighted = instances.sparkSession.read.schema(weighted.schema).parquet(path)
    shown_nodes, between = K.overview(weighted, nodes)
    shown = K.ranked_edges(between, edges)
    keys = F.broadcast(shown.select(*EDGE))  # at most `edges` rows
    details = edge_details(instances.join(keys, EDGE, "left_semi"), order, unit)
    out_nodes = shown_nodes.select(F.concat_ws(":", "type", "node").alias("id"), "type", F.col("node").alias("label"), "papers", "degree")
    out_edges = shown.join(details, EDGE).withColumn("id", F.concat(F.concat_ws(":", "relation", "source"), F.lit("->"), F.col("target")))
    parts = {"node_count": shown_nodes, "edge_count": shown, "edge_total": weighted}
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("what")) for name, df in parts.items()])
    meta = rows.agg(*[F.count_if(F.col("what") == name).alias(name) for name in parts])
    meta = meta.withColumn("has_more", F.col("edge_total") > F.col("edge_count")).withColumns({"node_limit": F.lit(nodes), "edge_limit": F.lit(edges), "min_conf": F.lit(min_conf)})
    return {"nodes": out_nodes, "edges": out_edges, "meta": meta}
