"""Entity resolution: blocking, pair scores, connected components, canonical members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators.fuzzy import similar_names


def name_key(name: Column) -> Column:
    return X.normalized(name)


def links_by_key(entities: DataFrame, key: Column) -> DataFrame:
    """(a, b): each entity linked to the smallest of its key. A chain for each block in place of all its pairs."""
    keyed = entities.select("id", key.alias("k")).filter("k <> ''")
    first = keyed.groupBy("k").agg(F.min("id").alias("b"))
    return keyed.join(first, "k").select(F.col("id").alias("a"), "b").filter("a <> b")


def scored_pairs(names: DataFrame, block: Column, threshold: float) -> DataFrame:
    """Pairs of distinct names of one block at or above the Jaro-Winkler threshold."""
    return similar_names(names.select("name", block.alias("block")), threshold)


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): smallest node of each component; rounds of smallest neighbours with pointer jumps, each checkpointed to the shared folder."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    for _ in range(max_rounds):
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("m"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = step.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")).checkpoint()
        label = step.select("node", "root")
        if step.filter("old <> root").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def canonical(entities: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, canonical_id): of each component the member that is oldest, then first by lower-case name, then by id; others stand for themselves."""
    e = entities.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = e.groupBy("root").agg(F.min(F.struct("created_at", F.lower("name").alias("n"), "id")).alias("c")).select("root", F.col("c.id").alias("canonical_id"))
    return e.join(first, "root").select("id", "name", "canonical_id")


def mention_scores(mentions: DataFrame) -> DataFrame:
    """left_id, right_id and score of entities that have a surface in common: 0.88, more for surfaces of no third entity, acronyms, figures and close years,
    less for years far apart. mentions: entity_id, surface, year, acronym, digit.

    Each entity's mentions of a surface are one row before the join, so that a pair of entities is made once for each common surface.
    """
    m = mentions.groupBy("surface", "entity_id").agg(F.max("acronym").alias("acronym"), F.max("digit").alias("digit"), F.min("year").alias("lo"), F.max("year").alias("hi"))
    m = m.join(m.groupBy("surface").agg(F.count(F.lit(1)).alias("owners")).filter("owners > 1"), "surface")
    side = lambda p: m.select("surface", "owners", *[F.col(c).alias(f"{p}_{c}") for c in ("entity_id", "acronym", "digit", "lo", "hi")])
    pairs = side("l").join(side("r").drop("owners"), "surface").filter("l_entity_id < r_entity_id")
    gap = F.greatest("l_hi", "r_hi") - F.least("l_lo", "r_lo")
    cents = (
        F.lit(88) + F.when(F.col("owners") == 2, 5).otherwise(0) + F.when(F.col("l_acronym") | F.col("r_acronym"), 2).otherwise(0) + F.when(F.col("l_digit") | F.col("r_digit"), 1).otherwise(0)
        + F.when(gap <= 1, 3).when(gap > 5, -5).otherwise(0)
    )
    return pairs.groupBy(F.col("l_entity_id").alias("left_id"), F.col("r_entity_id").alias("right_id")).agg((F.max(F.least(cents, F.lit(100))) / 100.0).alias("score"))


def remapped(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """rows whose column names the canonical entity in place of the merged one; mapping: id, canonical_id."""
    to = mapping.filter("id <> canonical_id").select(F.col("id").alias("merged"), F.col("canonical_id").alias("canonical"))
    return rows.join(to, F.col(column) == F.col("merged"), "left").withColumn(column, F.coalesce("canonical", column)).drop("merged", "canonical")
