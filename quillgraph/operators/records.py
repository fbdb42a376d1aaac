"""Records of entities, evidence and payloads: ordered unions, first-wins merges, look-back for terms, slices of texts, JSON coercions, audit versions.

Aggregates combine before the shuffle; a group's list holds distinct values only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.labels import low_info
from quillgraph.functions.text import EDGES

#: Relations that hold without a number.
QUALITATIVE = ["improves", "outperforms", "uses", "extends"]
_UUID = "^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def ordered_union(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The distinct values of a key in the order of their first appearance, ties by value; nulls are left out."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(order).alias("first_at"))
    listed = F.array_sort(F.collect_list(F.struct("first_at", value)))
    return first.groupBy(*key).agg(F.transform(listed, lambda x: x[value]).alias(value))


def first_known(rows: DataFrame, key: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """For each key and column the first value that is not null; null where all are."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("known"))))["known"].alias(c)
    return rows.groupBy(*key).agg(*[first(c) for c in columns])


def capped(rows: DataFrame, key: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each key, with their rank; Spark limits each group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= most)


def without(rows: DataFrame, **equals) -> DataFrame:
    """All rows but those that equal the given values in every column; rows with nulls there stay."""
    hit = F.lit(True)
    for c, v in equals.items():
        hit = hit & F.col(c).eqNullSafe(F.lit(v))
    return rows.filter(~hit)


def cleared(rows: DataFrame) -> DataFrame:
    """The table without rows, for an overwrite."""
    return rows.filter(F.lit(False))


def inserted(rows: DataFrame, **values) -> DataFrame:
    """The table and one more row; columns that are not given are null."""
    row = rows.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema])
    return rows.unionByName(row)


def with_optional(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """Tables of an older version have no such column: null then."""
    return rows if column in rows.columns else rows.withColumn(column, F.lit(None).cast(kind))


def terms_resolved(rows: DataFrame, group: str, order: list[str], term: str, reach: int = 5) -> DataFrame:
    """A term without information becomes the nearest earlier one of its group that has some, at most reach rows back; else it stays."""
    back = Window.partitionBy(group).orderBy(*order).rowsBetween(-reach, -1)
    told = F.when(~low_info(F.col(term)), F.col(term))
    return rows.withColumn("resolved", F.coalesce(told, F.last(told, ignorenulls=True).over(back), F.col(term)))


def routed(value: Column, relation: Column) -> Column:
    """Where a checked candidate goes: with a number to the results, with a qualitative relation to the method relations."""
    return F.when(value.isNotNull(), "result").when(relation.isin(QUALITATIVE), "method_relation").otherwise("dropped")


def next_versions(log: DataFrame, kind: str, version: str) -> DataFrame:
    """The log and for each kind one row with the next version."""
    new = log.groupBy(kind).agg((F.max(version) + 1).alias(version)).withColumn("state", F.lit("new"))
    return log.select(kind, version).withColumn("state", F.lit("stored")).unionByName(new)


def value_matrix(results: DataFrame, rows: list[str], column: str, values: list, measure: str) -> DataFrame:
    """The best measure of each row and of each of the given column values; the values are stated, so no job looks for them."""
    return results.groupBy(*rows).agg(*[F.max(F.when(F.col(column) == v, F.col(measure))).alias(f"{column}_{v}") for v in values])


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct neighbours of each node; both ends come from one pass over the edges."""
    pair = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    ends = edges.select(F.explode(F.array(pair(source, target), pair(target, source))).alias("e")).select("e.*").distinct()
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def claims_per_result(results: DataFrame, claims: DataFrame, paper: str) -> DataFrame:
    """Each result with the number of its paper's claims; claims are counted before the join."""
    counted = claims.groupBy(paper).agg(F.count(F.lit(1)).alias("claims"))
    return results.join(counted, paper, "left").withColumn("claims", F.coalesce("claims", F.lit(0)))


# ---- columns


def first_alias(text: Column, aliases: list[str], start: int, size: int) -> Column:
    """The first alias of the list that stands in text[start, start + size), and its place in the text; null if none does."""
    window = F.substring(text, start + 1, size)
    at = lambda a: F.position(F.lit(a), window)
    return F.coalesce(*[F.when(at(a) > 0, F.struct(F.lit(a).alias("alias"), (at(a) - 1 + start).alias("place"))) for a in aliases])


def trimmed_slice(text: Column, start: int, end: int) -> Column:
    """text[start, end) without white space at either end, and where it then lies; null if nothing is left."""
    piece = F.substring(text, start + 1, end - start)
    lead = F.length(piece) - F.length(F.regexp_replace(piece, r"^\s+", ""))
    kept = F.regexp_replace(piece, EDGES, "")
    return F.when(F.length(kept) > 0, F.struct(kept.alias("piece"), (lead + start).alias("start"), (lead + start + F.length(kept)).alias("end")))


def object_text(raw: Column) -> Column:
    """The text if it is a JSON object, else null."""
    return F.when(F.startswith(F.schema_of_variant(F.try_parse_json(raw)), F.lit("OBJECT")), raw)


def whole_number(t: Column) -> Column:
    return F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("long"))


def is_uuid(t: Column) -> Column:
    return F.coalesce(F.lower(t).rlike(_UUID), F.lit(False))


def without_number_citations(t: Column) -> Column:
    """Without citations such as [3] or [3, 4]; white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\[[0-9]+(?:, *[0-9]+)*\]", ""), r"\s+", " "))


def described(*parts: Column) -> Column:
    """The parts that say something, with a dot between them."""
    return F.concat_ws(" · ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def upload_name(key: Column, name: Column) -> Column:
    """An object name that no other upload has: the key before the name, signs that paths do not take as hyphens."""
    return F.concat(F.lit("papers/"), key.cast("string"), F.lit("-"), F.regexp_replace(F.lower(name), "[^a-z0-9.]+", "-"))


def is_pdf(name: Column, content_type: Column) -> Column:
    return F.coalesce(name.rlike(r"(?i)\.pdf$"), F.lit(False)) | F.coalesce(F.lower(content_type) == "application/pdf", F.lit(False))


def identifier(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), "^_|_$", "")


def hints_shown(rows: DataFrame, key: list[str], source: str, score: str, name: str) -> DataFrame:
    """A candidate's distinct hints by source, then by falling score, then by name."""
    best = rows.groupBy(*key, source, name).agg(F.max(score).alias("top"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(source).alias("s"), (-F.col("top")).alias("k"), F.col(name).alias("n"))))
    return best.groupBy(*key).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["s"], F.lit(":"), x["n"])), " ").alias("hints"))
