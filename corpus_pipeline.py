"""A training-data pipeline over `documents`: quality rules, line dedup, n-gram Jaccard join, substring dedup, packing.

Each stage gets all that its predecessor kept, written as Parquet and read again; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import chunk_dedup, line_templates, packing, quality, shingle_join
from quillgraph.llm.common import materialize, read_table, scratch_scope


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(line_templates.drop_recurring_lines(docs, whole=True))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(chunk_dedup.cut_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.step_groups(packing.pack_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_copies", near_copies), ("substring_dedup", substring_dedup), ("packing", pack)]

#: The joins of chosen paths, chunking and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", stays=True)
    return STAGES[-1][1](spark, docs, sf_dir)
