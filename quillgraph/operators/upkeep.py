"""Aggregates that are kept up from changes: inserts and retractions, no recomputation from the rows.

The table of counts holds each distinct (key, paper, value, conf, yr) once with the number of rows that it stands for, so a distinct count loses a paper only with its last row,
and a greatest value comes back when a greater one is retracted. A change set adds to the counts of its keys; the aggregates of these keys are made anew from their
counts, those of all other keys stay. Bucket files of untouched keys are neither read nor written.

Change sets have ascending numbers. Each count remembers the number of its last change and what it was before, so a set that is applied again (a run that failed behind its
first write, say) gives the same table. A set of a lower number than the last is an error, and so is a retraction of a row that isn't there.
Nulls are values like others; a null change (neither insert nor retraction) does nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.store import Store

ITEM = ["paper", "value", "conf", "yr"]
COUNTS = "key string, paper long, value long, conf long, yr int, n long, before long, change long"
AGGREGATES = "key string, rows long, papers long, best long, conf_sum long, first_year int, last_year int"


def net(changes: DataFrame, sign: Column) -> DataFrame:
    """What a change set adds to each count: sign is 1 for an insert, -1 for a retraction."""
    return changes.groupBy("key", *ITEM).agg(F.sum(sign).alias("add")).filter("add <> 0")


def added(old: DataFrame, delta: DataFrame, number: int) -> DataFrame:
    """Counts after a change set, from those before it or from those that it has changed already. Counts of 0 stay until the next change, to know what was before."""
    base = F.when(F.col("change") == number, F.col("before")).otherwise(F.col("n"))
    both = old.select("key", *ITEM, base.alias("was"), F.lit(0).cast("long").alias("add"), F.col("change")).unionByName(delta.select("key", *ITEM, F.lit(0).cast("long").alias("was"), F.col("add").cast("long").alias("add"), F.lit(None).cast("long").alias("change")))
    one = both.groupBy("key", *ITEM).agg(F.sum("was").alias("was"), F.sum("add").alias("add"), F.max("change").alias("last"))
    bad = F.raise_error(F.concat(F.lit("more rows retracted than there are, of key "), F.coalesce("key", F.lit("null"))))
    n = F.when(F.col("was") + F.col("add") < 0, bad.cast("long")).otherwise(F.col("was") + F.col("add"))
    changed = F.col("add") != 0
    kept = one.select("key", *ITEM, n.alias("n"), F.when(changed, F.col("was")).otherwise(n).alias("before"), F.when(changed, F.lit(number)).otherwise(F.col("last")).cast("long").alias("change"))
    return kept.filter(f"n <> 0 OR change = {int(number)}")


def aggregates(counts: DataFrame) -> DataFrame:
    """Rows, distinct papers, greatest value, sum of confidences and years of each key that has rows."""
    return counts.filter("n > 0").groupBy("key").agg(
        F.sum("n").alias("rows"), F.countDistinct("paper").alias("papers"), F.max("value").alias("best"),
        F.sum(F.col("conf") * F.col("n")).alias("conf_sum"), F.min("yr").alias("first_year"), F.max("yr").alias("last_year"),
    )


class KeptUp:
    """The stored counts and the aggregates that are read."""

    def __init__(self, spark, path: str, buckets: int = 32):
        self.spark, self.path = spark, path
        self.counts = Store(spark, f"{path}/counts", "key", COUNTS, buckets)
        self.totals = Store(spark, f"{path}/totals", "key", AGGREGATES, buckets)

    def apply(self, changes: DataFrame, sign: Column, number: int) -> None:
        """changes: key, paper, value, conf, yr and what sign reads."""
        last = self.counts.read().agg(F.max("change")).first()[0]
        if last is not None and number < last:
            raise ValueError(f"change set {number} comes after {last}")
        delta = self._written(net(changes, sign), f"delta/{number}")
        keys = delta.select("key").distinct()
        self.counts.change(keys, lambda old: added(old, delta, number))
        self.totals.replace(self._written(aggregates(self.counts.of_keys(keys)), f"renewed/{number}"), keys)

    def _written(self, rows: DataFrame, name: str) -> DataFrame:
        """rows, computed once: they are read several times."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def read(self) -> DataFrame:
        return self.totals.read()
