"""Queries for the tiers of extraction as compositions, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import tier1 as T
from quillgraph.plans.collect import collector
from quillgraph.sources.readers import table
from quillgraph.sources.store import scratch_folder

QUERIES, query = collector()

#: Corpora below this number and all tasks are in the lexicon; the others are known by patterns alone.
KNOWN = 10
#: Keeps what is proposed out of a result's window, and within reach of it.
BETWEEN = "The text in between says nothing of any kind and keeps the names far from all of the numbers. "
#: Lines that a task takes: what is made of a line costs far more than its bytes tell, so parts go by their number.
_LINES = 50_000


def _sections(spark, sf):
    """Lines as sections of papers, the lexicon, and a table in each fourth paper."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    # whole numbers as SQL casts them: to the nearest, halves to even
    dealt = li.withColumn("l_quantity", F.rint("l_quantity").cast("int")).repartition(li.count() // _LINES + 1, "l_orderkey")
    s = lambda c: F.col(c).cast("string")
    corpus = F.concat(F.lit("Corpus "), (F.col("l_partkey") % 50).cast("string"))
    text = F.concat(F.lit("We propose Model "), s("l_suppkey"), F.lit(" for task "), F.col("l_returnflag"), F.lit(f". {BETWEEN}It was evaluated on "), corpus, F.lit(". BLEU improves to "), s("l_quantity"), F.lit("% on "), corpus, F.lit("."))
    section = F.concat_ws(":", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_quantity"))
    sections = dealt.select(F.col("l_orderkey").alias("paper"), section.alias("section"), section.alias("place"), text.alias("text"))
    tables = li.filter("l_orderkey % 4 = 0").select(F.col("l_orderkey").alias("paper")).distinct().select("paper", F.concat(F.lit("table of "), s("paper")).alias("section"), F.lit("1").alias("place"), F.lit("task N on Corpus 3").alias("text"))
    corpora = spark.range(KNOWN).select(F.lit("dataset").alias("kind"), F.concat(F.lit("Corpus "), s("id")).alias("name")).withColumn("alias", F.col("name"))
    tasks = li.select("l_returnflag").distinct().select(F.lit("task").alias("kind"), F.concat(F.lit("Task "), "l_returnflag").alias("name")).withColumn("alias", F.lower("name"))
    return sections, corpora.unionByName(tasks), tables


SQL = """s AS (SELECT l_orderkey AS paper, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_quantity::INTEGER AS section, l_quantity::INTEGER AS qty, 'Model ' || l_suppkey || ' for task ' || l_returnflag AS method, l_returnflag AS flag,
  'Corpus ' || l_partkey % 50 AS corpus, l_partkey % 50 AS c, paper % 4 = 0 AS tabled FROM lineitem)"""


@query(
    f"""WITH {SQL}, n AS (SELECT paper, count(DISTINCT method) AS methods, count(DISTINCT flag) AS tasks FROM s GROUP BY 1)
SELECT paper, section, (length('We propose ' || method || '. {BETWEEN}It was evaluated on ' || corpus || '. '))::INTEGER AS pos, 'BLEU' AS metric, qty::DOUBLE AS value, '%' AS unit, method, CASE WHEN methods = 1 THEN 'only' ELSE 'near' END AS method_how, corpus AS dataset, 'named' AS dataset_how,
  'Task ' || CASE WHEN tabled THEN 'N' ELSE flag END AS task, CASE WHEN tabled THEN 'tabled' WHEN tasks = 1 THEN 'only' ELSE 'near' END AS task_how FROM s JOIN n USING (paper)"""
)
def tier1_results(spark, sf):
    """Results of all papers with the method, dataset and task that each is about."""
    return T.extract(*_sections(spark, sf), scratch_folder(spark, "tier1"))["results"]


@query(
    f"""WITH {SQL}, m AS (SELECT paper, 'method' AS kind, method AS name, false AS t, 1 AS n FROM s UNION ALL SELECT paper, 'dataset', corpus, false, CASE WHEN c < {KNOWN} THEN 3 ELSE 1 END FROM s UNION ALL SELECT paper, 'task', 'Task ' || flag, false, 1 FROM s
  UNION ALL SELECT DISTINCT paper, 'task', 'Task N', true, 1 FROM s WHERE tabled UNION ALL SELECT DISTINCT paper, 'dataset', 'Corpus 3', true, 1 FROM s WHERE tabled)
SELECT paper, kind, lower(name) AS key, name, sum(n)::BIGINT AS mentions, bool_or(t) AS in_table FROM m GROUP BY ALL"""
)
def tier1_entities(spark, sf):
    """The entities that papers name, by lexicon and patterns."""
    return T.paper_entities(*_sections(spark, sf)).drop("ordinal")
