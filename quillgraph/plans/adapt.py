"""The driver's tables as the engine's domain: papers, results, entities, mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.readers import table

AS_OF_YEAR = 2001

#: The same in SQL, for the oracles.
RESULTS_SQL = """res AS (
  SELECT o_orderkey AS paper_id, year(o_orderdate) AS yr, l_suppkey AS method_id, p_type AS dataset_id, l_returnflag AS metric_id, r_name AS task_id,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS value_cents, 100 - 5 * CAST(round(l_discount * 100) AS BIGINT) AS conf, l_linestatus = 'F' AS verified, l_returnflag = 'R' AS is_sota
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star join of result rows; dimension sides are broadcast by Spark where they are small, else joined by key."""
    t = lambda n: table(spark, sf_dir, n)
    tasks = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "r_name")
    rows = t("lineitem").join(t("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left").join(tasks, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("yr"), F.col("l_suppkey").alias("method_id"), F.col("p_type").alias("dataset_id"),
        F.col("l_returnflag").alias("metric_id"), F.col("r_name").alias("task_id"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("value_cents"),
        (F.lit(100) - F.round(F.col("l_discount") * 100).cast("long") * 5).alias("conf"), (F.col("l_linestatus") == "F").alias("verified"), (F.col("l_returnflag") == "R").alias("is_sota"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entity records; age follows the key."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("created_at"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each result, made of columns: what the extraction queries read."""
    li = table(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("We propose Model "), F.col("l_suppkey").cast("string"), F.lit(" for task "), F.col("l_returnflag"), F.lit(". BLEU improves to "), F.col("l_quantity").cast("int").cast("string"), F.lit("% on the test set."))
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("int").alias("qty"), text.alias("text"))


EVIDENCE_SQL = """ev AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS INTEGER) AS qty,
  'We propose Model ' || l_suppkey || ' for task ' || l_returnflag || '. BLEU improves to ' || CAST(l_quantity AS INTEGER) || '% on the test set.' AS text FROM lineitem)"""
