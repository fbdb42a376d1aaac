"""Graph aggregates over result rows: paper_id, yr, method_id, dataset_id, metric_id, task_id, value_cents, conf, verified, is_sota.

Confidences are whole hundredths and means whole millionths, so sums do not depend on their order; a double is made once, at the end.
All aggregates have a map-side part; the widest key is (edge, paper).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edge kinds: relation, column of the source, column of the target.
RELATIONS = {"evaluates_on": "dataset_id", "reports": "metric_id", "proposes": "task_id"}
SCALE = 10_000


def edge_instances(results: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """A row for each edge of the relations (all if not given) that a result supports, endpoints as strings."""
    node = lambda c: F.col(c).cast("string")
    wanted = {r: c for r, c in RELATIONS.items() if relations is None or r in relations}
    kinds = [F.when(F.col(c).isNotNull(), F.struct(F.lit(r).alias("relation"), node(c).alias("target"))) for r, c in wanted.items()]
    return results.filter("method_id IS NOT NULL").select("*", node("method_id").alias("source"), F.explode(F.array_compact(F.array(*kinds))).alias("e")).select("*", "e.relation", "e.target").drop("e")


def recency(as_of_year: int, newest: Column, oldest: Column) -> Column:
    """In hundredths: newer and longer-lived edges weigh more."""
    fresh = F.least(F.greatest(F.lit(5) - (F.lit(as_of_year) - newest), F.lit(0)), F.lit(5))
    return F.lit(100) + fresh * 5 + F.least(F.lit(20), (newest - oldest) * 2)


def evidence_weight(n: Column, verified: Column, statements: Column) -> Column:
    """In thousandths: snippets, the verified share and statements."""
    return F.lit(1000) + F.least(F.lit(300), n * 30) + F.floor(verified * 300 / n) + F.least(F.lit(100), statements * 50)


def weighted_edges(instances: DataFrame, as_of_year: int, min_conf: int = 60) -> DataFrame:
    """Edges by (relation, source, target): mean over papers of the papers' own means, its bounds, counts and weight."""
    key = ["relation", "source", "target"]
    by_paper = instances.groupBy(*key, "paper_id").agg(
        F.expr(f"sum(conf) * {SCALE} div count(*)").alias("mean"), F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("v"), F.count_if("is_sota").alias("s"),
        F.min("yr").alias("lo_yr"), F.max("yr").alias("hi_yr"), F.min("conf").alias("lo"), F.max("conf").alias("hi"),
    )
    edges = by_paper.groupBy(*key).agg(
        F.count(F.lit(1)).alias("paper_count"), F.expr("sum(mean) div count(*)").alias("mean_conf"), F.sum("n").alias("n_results"), F.sum("v").alias("n_verified"), F.sum("s").alias("n_statements"),
        F.min("lo_yr").alias("first_year"), F.max("hi_yr").alias("last_year"), F.min("lo").alias("min_conf"), F.max("hi").alias("max_conf"),
    )
    score = F.col("paper_count") * F.col("mean_conf") * recency(as_of_year, F.col("last_year"), F.col("first_year")).cast("long") * evidence_weight(F.col("n_results"), F.col("n_verified"), F.col("n_statements"))
    return edges.filter(F.col("mean_conf") >= min_conf * SCALE).withColumn("weight", score.cast("double") / 1e11)


def compares(results: DataFrame) -> DataFrame:
    """Pairs of methods with results in one paper, dataset and metric: papers and mean confidence of all row pairs.

    Pairs come from counts by method, not from rows, so a group of many rows of few methods stays small.
    """
    key = ["paper_id", "dataset_id", "metric_id"]
    m = results.filter("dataset_id IS NOT NULL AND metric_id IS NOT NULL").groupBy(*key, "method_id").agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("s"))
    a, b = m.select(*key, F.col("method_id").alias("left_id"), F.col("n").alias("n1"), F.col("s").alias("s1")), m.select(*key, F.col("method_id").alias("right_id"), F.col("n").alias("n2"), F.col("s").alias("s2"))
    pairs = a.join(b, key).filter("left_id < right_id")
    # the mean of both confidences over n1 * n2 row pairs
    return pairs.groupBy("left_id", "right_id").agg(
        F.countDistinct("paper_id").alias("paper_count"), F.sum(F.col("n1") * F.col("n2")).alias("row_pairs"), F.expr(f"sum(s1 * n2 + s2 * n1) * {SCALE} div (2 * sum(n1 * n2))").alias("mean_conf")
    )


def overview(edges: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The limit nodes of most edge papers (then by name), and the edges between them."""
    target_type = F.when(F.col("relation") == "evaluates_on", "dataset").when(F.col("relation") == "reports", "metric").otherwise("task")
    both = F.array(F.struct(F.col("source").alias("node"), F.lit("method").alias("type")), F.struct(F.col("target").alias("node"), target_type.alias("type")))
    ends = edges.select(F.explode(both).alias("end"), "paper_count").select("end.*", "paper_count")
    nodes = ends.groupBy("type", "node").agg(F.sum("paper_count").alias("papers"), F.count(F.lit(1)).alias("degree")).orderBy(F.desc("papers"), F.lower("node"), "type").limit(limit)
    kept = F.broadcast(nodes.select("type", "node"))  # at most `limit` rows
    e = edges.withColumn("target_type", target_type)
    e = e.join(kept.filter("type = 'method'").select(F.col("node").alias("source")), "source", "left_semi").join(kept.select(F.col("type").alias("target_type"), F.col("node").alias("target")), ["target_type", "target"], "left_semi")
    return nodes, e


def neighborhood(results: DataFrame, column: str, value) -> DataFrame:
    """All results of the papers that touch a node."""
    papers = results.filter(F.col(column) == value).select("paper_id").distinct()
    return results.join(papers, "paper_id", "left_semi")


def outcome_bounds(results: DataFrame, key: list[str]) -> DataFrame:
    """Best and worst value of a node, of verified results if it has any, and their distance over all (null below two results)."""
    pool = lambda f: F.coalesce(f(F.when(F.col("verified"), F.col("value_cents"))), f("value_cents"))
    spread = F.when((F.count("value_cents") >= 2) & (F.max("value_cents") > F.min("value_cents")), F.max("value_cents") - F.min("value_cents"))
    return results.groupBy(*key).agg(pool(F.max).alias("best_cents"), pool(F.min).alias("worst_cents"), spread.alias("effect_cents"))


def best_by_context(results: DataFrame, node: str, context: list[str], top: int = 5) -> DataFrame:
    """Each node's best value in every context, and of these the top ones. max() replaces a sort of rows; the window ranks one row a context."""
    best = results.groupBy(node, *context).agg(F.max(F.struct("value_cents", F.col("is_sota").cast("int").alias("sota"))).alias("b"))
    w = Window.partitionBy(node).orderBy(F.desc("b.value_cents"), F.desc("b.sota"), *context)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(node, *context, "rank", F.col("b.value_cents").alias("value_cents"), F.col("b.sota").alias("sota"))


def top_links(edges: DataFrame, k: int = 6) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("weight"), "relation", "target")
    return edges.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def only_papers(rows: DataFrame, papers: list | None) -> DataFrame:
    """The rows of the given papers; no papers given means no filter."""
    return rows.filter(F.col("paper_id").isin(list(papers))) if papers else rows


def selection(given: str | None, allowed: list[str], default: list[str]) -> list[str]:
    """The names of a comma-separated list, in any case and in the order given; the default where it has none. An unknown name is an error."""
    names = list(dict.fromkeys(x.strip().lower() for x in (given or "").split(",") if x.strip()))
    if unknown := [x for x in names if x not in allowed]:
        raise ValueError(f"unknown: {', '.join(unknown)}; choose of {', '.join(allowed)}")
    return names or list(default)


def limit_of(given: int | None, default: int, most: int) -> int:
    return max(1, min(most, default if given is None else given))


TARGET_TYPES = {"evaluates_on": "dataset", "reports": "metric", "proposes": "task"}


def allowed_edges(results: DataFrame, as_of_year: int, relations: list[str], types: list[str], min_conf: int) -> DataFrame:
    """Edges of the relations, both of whose ends are of the types. Neither kind of edge is made first and dropped later."""
    wanted = [r for r in relations if "method" in types and TARGET_TYPES.get(r) in types]
    return weighted_edges(edge_instances(results, wanted) if wanted else edge_instances(results).limit(0), as_of_year, min_conf)


def ranked_edges(edges: DataFrame, limit: int = 500) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "relation", "source", "target").limit(limit)


def edge_metadata(instances: DataFrame, most: int = 12) -> DataFrame:
    """Papers, contexts and results of each edge, and the first `most` of them in order: what an edge shows. The lists are cut after a count over all."""
    key = ["relation", "source", "target"]
    contexts = instances.groupBy(*key, "paper_id", "dataset_id", "metric_id", "task_id").agg(F.count(F.lit(1)).alias("n"), F.max("value_cents").alias("best"))
    w = Window.partitionBy(*key).orderBy(F.desc("best"), "paper_id", "dataset_id", "metric_id", "task_id")
    top = contexts.withColumn("rank", F.row_number().over(w))
    shown = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "paper_id", "best"))))
    return top.groupBy(*key).agg(
        F.countDistinct("paper_id").alias("papers"), F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("results"),
        F.array_join(F.transform(shown, lambda x: F.concat_ws(":", x["paper_id"].cast("string"), x["best"].cast("string"))), " ").alias("shown"),
    )


def effect_sizes(results: DataFrame, key: list[str], context: list[str]) -> DataFrame:
    """Largest and smallest value of a key with the context where each was first reached, and their distance; keys of two values or more only."""
    first = lambda v: F.struct(v.alias("v"), *context)
    agg = results.filter("value_cents IS NOT NULL").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(first(-F.col("value_cents"))).alias("hi"), F.min(first(F.col("value_cents"))).alias("lo"))
    agg = agg.filter((F.col("n") >= 2) & (-F.col("hi.v") > F.col("lo.v")))
    return agg.select(*key, (-F.col("hi.v") - F.col("lo.v")).alias("effect_cents"), *[F.col(f"hi.{c}").alias(f"best_{c}") for c in context], *[F.col(f"lo.{c}").alias(f"worst_{c}") for c in context])


def else_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """primary, or fallback where primary has no row: an anti join on a constant, with one row at most on its right, in place of a look from the driver."""
    some = primary.limit(1).select(F.lit(1).alias("some"))
    return primary.unionByName(fallback.join(F.broadcast(some), F.lit(1) == F.col("some"), "left_anti"))


def latest_of(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """One row of each key, of the last part that has it."""
    rows = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    value = [c for c in parts[0].columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*value), "part").alias("v")).select(*key, *[F.col(f"v.{c}").alias(c) for c in value])
