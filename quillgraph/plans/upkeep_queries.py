"""Queries over tables that are kept up: aggregates from changes, statuses from a stream, the index of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import vector_index as I
from quillgraph.operators.upkeep import KeptUp
from quillgraph.plans.adapt import RESULTS_SQL, results
from quillgraph.plans.collect import collector
from quillgraph.sources.readers import table
from quillgraph.sources.store import scratch_folder
from quillgraph.streaming.lifecycle import Lifecycle

QUERIES, query = collector()


@query(
    f"""WITH {RESULTS_SQL} SELECT method_id || '|' || dataset_id AS key, count(*)::BIGINT AS rows, count(DISTINCT paper_id)::BIGINT AS papers, max(value_cents) AS best, sum(conf)::BIGINT AS conf_sum,
  min(yr)::INTEGER AS first_year, max(yr)::INTEGER AS last_year FROM res WHERE dataset_id IS NOT NULL AND paper_id % 7 <> 3 GROUP BY 1"""
)
def edges_kept_up(spark, sf):
    """Best value, papers and degrees of each (method, dataset): papers come in two change sets, the second of which also retracts those of a seventh."""
    rows = results(spark, sf).filter("dataset_id IS NOT NULL")
    rows = rows.select(F.concat_ws("|", F.col("method_id").cast("string"), "dataset_id").alias("key"), F.col("paper_id").alias("paper"), F.col("value_cents").alias("value"), "conf", "yr")
    kept = KeptUp(spark, scratch_folder(spark, "edges"))
    early = F.col("paper") % 4 != 0
    kept.apply(rows.filter(early), F.lit(1), 1)
    late, gone = rows.filter(~early).withColumn("sign", F.lit(1)), rows.filter("paper % 7 = 3").withColumn("sign", F.lit(-1))
    kept.apply(late.unionByName(gone), F.col("sign"), 2)
    return kept.read()


@query(
    """SELECT user_id AS paper, arg_max(event_type, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS number, min(ts) AS first_at, max(ts) AS last_at, count(*)::BIGINT AS events, count(*) FILTER (event_type = 'error')::BIGINT AS failures FROM events GROUP BY 1"""
)
def upload_statuses(spark, sf):
    """The statuses of papers by a stream of four files out of order, a part of whose events comes twice."""
    path = scratch_folder(spark, "uploads")
    e = table(spark, sf, "events").select(F.col("user_id").alias("paper"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("number"), F.col("event_type").alias("status"))
    e.unionByName(e.filter("number % 5 = 0")).repartition(4, F.xxhash64("number", F.lit(1))).write.parquet(f"{path}/in")
    uploads = Lifecycle(spark, path, failed="error")
    uploads.run(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in"))
    return uploads.status.read()


@query()
def vector_index_topk(spark, sf):
    """The ten nearest of every vector whose id is divisible by 100, by the index over all; tests hold its recall against exact search."""
    e = table(spark, sf, "embeddings")
    sizes = e.select(F.size("embedding").alias("size")).filter("size > 0").groupBy("size").count().orderBy(F.desc("count"), "size").first()
    centres = I.Centres.fit(e, sizes["size"] if sizes else 1)
    path = scratch_folder(spark, "vector-index")
    I.build(e, centres).write.parquet(path)
    return I.search(spark.read.parquet(path), e.filter("vec_id % 100 = 0"), centres)
