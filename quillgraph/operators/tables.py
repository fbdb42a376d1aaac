"""Writes as set operations: append if absent, get-or-create, upsert, replace for a key. All are joins and unions, so they scale with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X


def append_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of new whose key is not in existing, one of each key; null keys compare as equal."""
    k = existing.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    on = F.lit(True)
    for c in key:
        on = on & new[c].eqNullSafe(k[f"_{c}"])
    return new.join(k, on, "left_anti").dropDuplicates(key)


def ensure_dimension(existing: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) of all names without regard to case: ids of existing rows stay, new ones follow from the name."""
    low = lambda c: F.lower(F.trim(F.col(c)))
    have = existing.groupBy(low("name").alias("k")).agg(F.min("id").alias("id"))
    want = names.groupBy(low("name").alias("k")).agg(F.min("name").alias("name")).filter("k <> ''")
    return want.join(have, "k", "left").select(F.coalesce("id", X.uuid5(F.col("k"))).alias("id"), "name", F.col("id").isNull().alias("is_new"))


def upsert_latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def replace_for_key(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing without the keys that new has, and new."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def filtered(df: DataFrame, **equals) -> DataFrame:
    """Conjunction of the given equalities; None means no filter. Reaches the scan as pushed filters."""
    for c, v in equals.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
