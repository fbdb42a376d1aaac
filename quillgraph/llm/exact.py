"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes of the normalised text. The first digit is the byte length with the
leading bytes, so that the members of a group end together; the next digits are runs of bytes that grow
sixteenfold, so a text of n bytes takes about log16(n / 64) rounds. A group leaves when it is a singleton or when its
bytes have ended. Groups are found by comparing the bytes themselves; the SHA-256 column only reports, and tells
rows of one doc_id apart.

A digit is a run of bytes in place of a single one, so that a long text takes few rounds; runs split a group as the bytes in them would one after the other.

Every round counts before it shuffles (a hot group is one row of each task), and joins back on the digit, where salt deals a hot group's
rows to several tasks. Texts of rows that are already alone are not shuffled.

Defined results: null is the empty text; rows that repeat a doc_id with the same text share one verdict; very long texts are compared whole, in more
rounds; ids may have any type that can be ordered, and a null id is the smallest; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, materialize, read_table, salted_join, text_of, thin

FIRST_BYTES = 64
GROWTH = 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_bytes: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """A row for each of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    data = F.regexp_replace(text_of(text_col), WS + "+", " ").cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), data.alias("data"))
    digit = lambda col, start, n=None: F.expr(f"substring({col}, {start}" + (f", {n})" if n else ")"))
    light = materialize(
        base.select("doc_id", F.sha2("data", 256).alias("text_sha256"), F.octet_length("data").alias("n"), digit("data", 1, first_bytes).alias("digit")), "exact-heads"
    )
    # (doc_id, text_sha256) names a row; a group takes the name of its first row
    named = F.min(F.struct("doc_id", "text_sha256")).alias("group")
    heads = materialize(light.groupBy("n", "digit").agg(F.count(F.lit(1)).alias("group_size"), named).filter("group_size > 1"), "exact-groups")
    short = heads.filter(F.col("n") <= first_bytes)
    ended = [salted_join(light, short, ["n", "digit"]).select("doc_id", "text_sha256", "group", "group_size")]

    longer = heads.filter(F.col("n") > first_bytes).select("n", "digit", "group")
    texts = base.select("doc_id", "data", F.octet_length("data").alias("n"), digit("data", 1, first_bytes).alias("digit"))
    open_rows = salted_join(thin(texts, longer, ["n", "digit"]), longer, ["n", "digit"])
    open_rows = materialize(open_rows.select("doc_id", F.sha2("data", 256).alias("text_sha256"), "group", "n", digit("data", first_bytes + 1).alias("rest")), "exact-open")
    done = first_bytes
    while not open_rows.isEmpty():
        width = done * (growth - 1)
        cut = open_rows.withColumn("digit", digit("rest", 1, width))
        found = cut.groupBy("group", "n", "digit").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct("doc_id", "text_sha256")).alias("next")).filter("group_size > 1")
        done += width
        split = materialize(
            salted_join(cut, found, ["group", "n", "digit"]).select("doc_id", "text_sha256", F.col("next").alias("group"), "group_size", "n", digit("rest", width + 1).alias("rest")), "exact-round"
        )
        ended.append(split.filter(F.col("n") <= done).select("doc_id", "text_sha256", "group", "group_size"))
        open_rows = split.filter(F.col("n") > done).drop("group_size")

    groups = ended[0]
    for more in ended[1:]:
        groups = groups.unionByName(more)
    groups = groups.select("doc_id", "text_sha256", F.col("group.doc_id").alias("first_id"), "group_size").dropDuplicates(["doc_id", "text_sha256"])
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first_id"))
    return (
        light.select("doc_id", "text_sha256")
        .join(groups.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "first_id", "group_size"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")), "left")
        .select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
"""
