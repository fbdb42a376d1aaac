"""Queries that write tables, change them, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import persist as W
from quillgraph.plans.collect import collector
from quillgraph.sources.readers import table
from quillgraph.sources.store import Store, clear_in_order, scratch_folder, written

QUERIES, query = collector()

RESULT = "paper bigint, line int, method_id string, dataset_id string, value double"
NAMES = "key string, id string, name string"


def _stores(spark, name):
    path = scratch_folder(spark, name)
    return Store(spark, f"{path}/results", "paper", RESULT), {k: Store(spark, f"{path}/{k}", "key", NAMES) for k in ("method", "dataset")}, path


def _extracted(spark, sf):
    """Results with names in place of ids; names of suppliers and parts' types, in two spellings."""
    li, p, s = table(spark, sf, "lineitem"), table(spark, sf, "part"), table(spark, sf, "supplier")
    rows = li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    method = F.when(F.col("l_linenumber") % 2 == 0, F.upper("s_name")).otherwise(F.concat(F.lit(" "), "s_name"))
    return rows.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").cast("int").alias("line"), method.alias("method"), F.col("p_type").alias("dataset"), F.col("l_quantity").cast("double").alias("value"))


@query(
    """WITH r AS (SELECT l_orderkey AS paper, l_linenumber::INTEGER AS line, lower(s_name) AS method, lower(p_type) AS dataset, l_quantity::DOUBLE AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT paper, line, method, dataset, value + CASE WHEN paper % 3 = 0 THEN 1000 ELSE 0 END AS value FROM r WHERE NOT (paper % 3 = 0 AND line > 2) AND paper % 5 <> 4"""
)
def extraction_stored(spark, sf):
    """All papers are stored; a third of them again, with other values and at most two results; then a fifth with none."""
    results, dimensions, path = _stores(spark, "extraction")
    rows = written(_extracted(spark, sf), f"{path}/given")
    W.store_results(results, dimensions, rows)
    again = rows.filter("paper % 3 = 0 AND line <= 2").withColumn("value", F.col("value") + 1000)
    W.store_results(results, dimensions, again, rows.filter("paper % 3 = 0").select("paper"))
    none = rows.filter("paper % 5 = 4").select("paper").distinct()
    results.replace(results.read().limit(0), none)
    named = lambda k: dimensions[k].read().select(F.col("id").alias(f"{k}_id"), F.col("key").alias(k))
    return results.read().join(named("method"), "method_id").join(named("dataset"), "dataset_id").select("paper", "line", "method", "dataset", "value")


@query(
    """WITH m AS (SELECT s.s_suppkey, lower(coalesce(x.s_name, s.s_name)) AS method FROM supplier s LEFT JOIN supplier x ON s.s_suppkey % 4 = 1 AND x.s_suppkey = s.s_suppkey - 1)
SELECT method, count(*)::BIGINT AS results, min(l_orderkey) AS first_paper FROM lineitem JOIN m ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1"""
)
def resolutions_stored(spark, sf):
    """Of the suppliers' names every fourth pair is merged; the stored results name the canonical one."""
    results, dimensions, path = _stores(spark, "resolutions")
    W.store_results(results, dimensions, _extracted(spark, sf))
    s = table(spark, sf, "supplier").select("s_suppkey", W.name_key(F.col("s_name")).alias("key")).join(dimensions["method"].read().select("key", "id"), "key")
    pairs = s.filter("s_suppkey % 4 = 1").select((F.col("s_suppkey") - 1).alias("to"), F.col("id")).join(s.select(F.col("s_suppkey").alias("to"), F.col("id").alias("canonical_id")), "to")
    kept = Store(spark, f"{path}/resolutions", "id", "id string, canonical_id string, kind string, score double")
    W.store_resolutions(results, dimensions, kept, pairs.select("id", "canonical_id", F.lit(0.9).alias("score")), "method")
    named = dimensions["method"].read().select(F.col("id").alias("method_id"), F.col("key").alias("method"))
    # counted by id before names are looked up
    own = results.read().groupBy("method_id").agg(F.count(F.lit(1)).alias("n"), F.min("paper").alias("first"))
    return own.join(named, "method_id").groupBy("method").agg(F.sum("n").alias("results"), F.min("first").alias("first_paper"))


@query(
    """WITH e AS (SELECT user_id, max(event_id) AS id, max_by(event_type, event_id) AS status FROM events GROUP BY 1)
SELECT user_id AS paper, id, CASE WHEN user_id = (SELECT min(user_id) FROM e WHERE status <> 'error') THEN 'parsed' ELSE status END AS status FROM e WHERE status <> 'error'"""
)
def papers_upserted(spark, sf):
    """The status of each paper: written, brought up to date by later events, one set by hand, those of one status deleted."""
    store = Store(spark, f"{scratch_folder(spark, 'papers')}/papers", "paper", "paper bigint, id bigint, status string")
    e = table(spark, sf, "events").select(F.col("user_id").alias("paper"), F.col("event_id").alias("id"), F.col("event_type").alias("status"))
    half = e.agg(F.floor(F.max("id") / 2)).first()[0]
    store.upsert(e.filter(F.col("id") <= half), [F.desc("id")])
    store.upsert(e.filter(F.col("id") > half), [F.desc("id")])
    store.delete(F.col("status") == "error")
    first = store.read().agg(F.min("paper")).first()[0]
    store.update(first, status="parsed")
    return store.read()


@query("""SELECT 'results' AS name, 1 AS place, 0::BIGINT AS n UNION ALL SELECT 'dataset', 2, 0 UNION ALL SELECT 'method', 3, 0 ORDER BY ALL""")
def graph_tables_cleared(spark, sf):
    """The stored graph is cleared, results before the names that they refer to."""
    results, dimensions, _ = _stores(spark, "cleared")
    W.store_results(results, dimensions, _extracted(spark, sf))
    stores = {"results": results, "dataset": dimensions["dataset"], "method": dimensions["method"]}
    order = clear_in_order(stores, {"results": ["method", "dataset"]})
    out = None
    for k, n in enumerate(order):
        own = stores[n].read().agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), F.lit(k + 1).alias("place"), "n")
        out = own if out is None else out.unionByName(own)
    return out
