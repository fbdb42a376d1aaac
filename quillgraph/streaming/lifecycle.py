"""The lifecycle of uploads as a stream: events of papers in, the status of each paper in a written table.

A batch is applied in three steps, each of which gives the same when it is done again: repeated events are dropped by their content's hash; events that the log lacks are appended
to it; the status of the papers of the batch is made anew from their part of the log. So files may come late, in any order, repeatedly or again after a failure, and the
tables are those of a single batch over all events. The log is bucketed by paper: a batch reads the buckets of its papers.

Equal events (equal in paper, time, number and status) are one. The status of a paper is that of its latest event, by time and then by number; events without a paper are left out,
events without a time come before all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.store import Store

LOG = "paper long, hash string, ts timestamp, number long, status string"
STATUS = "paper long, status string, number long, first_at timestamp, last_at timestamp, events long, failures long"


def hashed(events: DataFrame) -> DataFrame:
    """events (paper, ts, number, status) with the hash of their content; a null differs from every value."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return events.filter("paper IS NOT NULL").withColumn("hash", F.sha2(F.concat_ws("\x1f", part("paper"), F.coalesce(F.concat(F.lit("="), F.unix_micros(F.col("ts").cast("timestamp")).cast("string")), F.lit("-")), part("number"), part("status")), 256))


def statuses(log: DataFrame, failed: str = "failed") -> DataFrame:
    """The status of each paper of a log without repeated events; one map-side aggregate, no order of a paper's events is needed."""
    place = F.struct("ts", "number", "status")
    return log.groupBy("paper").agg(F.max(place).alias("m"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") == failed).alias("failures")).select(
        "paper", F.col("m.status").alias("status"), F.col("m.number").alias("number"), "first_at", "last_at", "events", "failures"
    )


class Lifecycle:
    def __init__(self, spark, path: str, failed: str = "failed", buckets: int = 32):
        self.spark, self.path, self.failed = spark, path, failed
        self.log = Store(spark, f"{path}/log", "paper", LOG, buckets)
        self.status = Store(spark, f"{path}/status", "paper", STATUS, buckets)

    def apply(self, events: DataFrame) -> None:
        new = hashed(events)
        papers = new.select("paper").distinct()
        self.log.append_absent(new, ["paper", "hash"])
        self.status.replace(statuses(self.log.of_keys(papers), self.failed))

    def run(self, stream: DataFrame) -> None:
        """All that the stream has now; what was read is kept beside the tables, so the next run goes on from there."""
        write = stream.writeStream.foreachBatch(lambda batch, _: self.apply(batch)).option("checkpointLocation", f"{self.path}/progress")
        write.trigger(availableNow=True).start().awaitTermination()
