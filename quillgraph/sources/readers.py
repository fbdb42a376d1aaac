"""Sources: Parquet tables, JSON reference data, PDF blobs, and a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BLOB = 50 * 1024 * 1024

INITIAL_KEY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Parts that shuffles begin with. Spark merges neighbours up to its advisory size, so small tables get few tasks and large ones tasks of a bounded size.
INITIAL_PARTS = 512


def fine_shuffles(spark: SparkSession) -> None:
    """Has shuffles begin with INITIAL_PARTS parts, for Spark to merge by their sizes: with the fixed number of spark.sql.shuffle.partitions alone, what a task sorts or aggregates grows with the input.
    Spark has no such setting for one query, so it holds for the session; a number that the cluster or the caller has set stays."""
    if spark.conf.get(INITIAL_KEY, None) is None:
        spark.conf.set(INITIAL_KEY, INITIAL_PARTS)


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def byte_batches(spark: SparkSession) -> None:
    """Has Spark hand rows to Python in Arrow batches of BATCH_BYTES: a batch of 10,000 long texts would fill a worker. Held like fine_shuffles()."""
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    fine_shuffles(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(kind, phrase_key, name) from a JSON object of kind -> list of {name, aliases}; blank phrases dropped."""
    raw = spark.read.option("multiLine", True).json(path)
    kinds = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("entries")) for c in raw.columns]
    e = raw.select(F.explode(F.array(*kinds)).alias("k")).select("k.kind", F.explode("k.entries").alias("e"))
    names = e.select("kind", F.col("e.name").alias("name"), F.explode(F.array_union(F.array("e.name"), F.coalesce("e.aliases", F.array().cast("array<string>")))).alias("phrase"))
    return names.select("kind", F.lower(F.trim("phrase")).alias("phrase_key"), "name").filter("phrase_key <> ''").distinct()


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """PDF files of more than nothing and at most 50 MiB; sizes are filtered in the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.filter((F.col("length") > 0) & (F.col("length") <= MAX_BLOB))


def parsed(blob_rows: DataFrame, parser, schema: str) -> DataFrame:
    """parser: a function of batches (mapInPandas); the parsing library is the caller's choice."""
    return blob_rows.mapInPandas(parser, schema)


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
