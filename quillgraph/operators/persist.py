"""What an extraction leaves behind: names become dimension rows with ids that follow from the name, results refer to them and replace the paper's older ones.

Ids are name-based, so an extraction that runs again, or two that meet the same name, give the same rows; no id passes through the driver."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.sources.store import Store, _remove, written


def name_key(name: Column) -> Column:
    return F.lower(X.collapse(name))


def ensure_names(dimension: Store, names: DataFrame) -> DataFrame:
    """Adds the names that the dimension (keyed by key; id, key, name) lacks, without regard to case, and returns key and id of all of them. Blank names have none."""
    want = names.distinct().select(name_key(F.col("name")).alias("key"), "name").filter("key <> ''").groupBy("key").agg(F.min("name").alias("name"))
    dimension.append_absent(want.withColumn("id", X.uuid5(F.col("key"))), ["key"])
    stored = dimension.read().select("key", "id")
    return stored.join(want.select("key"), "key", "left_semi")


def store_results(results: Store, dimensions: dict[str, Store], rows: DataFrame, papers: DataFrame | None = None) -> None:
    """rows has a name column for each dimension (such as method) and the results' own columns; the table gets <dimension>_id in its place. papers: those whose results are replaced,
    also by none. Dimensions are written before the results that refer to them, so a run that fails in between leaves names without results, never results without names.

    rows and papers are made once, into a folder beside the table that is removed at the end. An id follows from its name, so a row's ids are computed, behind the last shuffle; only where
    a dimension holds ids that do not (rows that someone inserted), results are joined with it."""

    def own_ids(df: DataFrame, kind: str) -> DataFrame:
        return df.withColumn(f"{kind}_id", X.uuid5(F.nullif(name_key(F.col(kind)), F.lit(""))))

    def joined_ids(df: DataFrame, kind: str) -> DataFrame:
        ids = dimensions[kind].read().select(F.col("key").alias(f"_{kind}"), F.col("id").alias(f"{kind}_id"))
        return df.withColumn(f"_{kind}", name_key(F.col(kind))).join(ids, f"_{kind}", "left").drop(f"_{kind}", kind)

    folder = f"{results.path}-{uuid.uuid4().hex}"
    try:
        rows = written(rows, f"{folder}/rows")
        papers = None if papers is None else written(papers.select(results.key).distinct(), f"{folder}/papers")
        for kind, dimension in dimensions.items():
            ensure_names(dimension, rows.select(F.col(kind).alias("name")))
        joined = [k for k, d in dimensions.items() if not d.read().filter(~F.col("id").eqNullSafe(X.uuid5(F.col("key")))).isEmpty()]
        results.replace(reduce(joined_ids, joined, rows), papers, lambda df: reduce(own_ids, [k for k in dimensions if k not in joined], df))
    finally:
        _remove(results.spark, folder)


def store_resolutions(results: Store, dimensions: dict[str, Store], resolutions: Store, mapping: DataFrame, kind: str) -> None:
    """mapping: id, canonical_id, score. Merged ids are recorded, and results that name one get the canonical id; only buckets with such results are written, each row once."""
    folder = f"{results.path}-{uuid.uuid4().hex}"
    try:
        to = written(mapping.filter("id <> canonical_id").select("id", "canonical_id", "score"), f"{folder}/mapping")
        resolutions.replace(to.withColumn("kind", F.lit(kind)))
        merged = to.select(F.col("id").alias("_merged"), F.col("canonical_id").alias("_canonical"))
        column = f"{kind}_id"
        named = F.col(column) == F.col("_merged")
        results.change(results.read().join(merged, named, "left_semi"), lambda old: old.join(merged, named, "left").withColumn(column, F.coalesce("_canonical", column)).drop("_merged", "_canonical"))
    finally:
        _remove(results.spark, folder)
