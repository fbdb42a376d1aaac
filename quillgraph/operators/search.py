"""Semantic search: exact cosine top-k and the partial re-rank of its head."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest by cosine: each task keeps k rows (TakeOrdered), ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(X.cosine(F.col(vec_col), q), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def partial_rerank(hits: DataFrame, query: str, head: int = 3, id_col: str = "vec_id", text_col: str = "snippet") -> DataFrame:
    """The first `head` hits by 0.7 score + 0.3 token overlap, the others as they were. hits is a top-k, so one partition orders it."""
    blended = F.round(F.col("score") * 0.7 + X.overlap_share(F.lit(query), F.col(text_col)) * 0.3, 6)
    r = hits.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), id_col))).withColumn("blended", blended)
    order = [F.col("r") > head, F.when(F.col("r") <= head, -F.col("blended")), "r"]
    return r.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("r")


def hash_features(t: Column, size: int = 64) -> Column:
    """A vector of a text without a model: the bytes of a chain of SHA-256 digests, as signed numbers. Equal texts have equal vectors, others about none in common."""
    digests = [F.sha2(t, 256)]
    while len(digests) * 32 < size:
        digests.append(F.sha2(digests[-1], 256))
    # the digests are bound once, not made again for each byte
    byte = lambda h, i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    signed = lambda b: F.when(b >= 128, b - 256).otherwise(b)
    return F.transform(F.array(F.concat(*digests)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: signed(byte(h, i))))[0]


def ingest(texts: DataFrame, stored: DataFrame, size: int = 64, clean_by: Callable[[Column], Column] = X.sanitize) -> DataFrame:
    """hash, vector and is_new of all stored vectors and of the texts that have none yet. Each distinct text is embedded once.

    texts: text. stored: hash, vector. clean_by: what a text is before it is hashed; where that is null, as by X.sanitize for empty texts, it is left out.
    """
    clean = texts.select(clean_by(F.col("text")).alias("text")).filter("text IS NOT NULL")
    new = clean.select(F.sha2("text", 256).alias("hash"), "text").join(stored.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
    return stored.select("hash", "vector", F.lit(False).alias("is_new")).unionByName(new.select("hash", hash_features(F.col("text"), size).alias("vector"), F.lit(True).alias("is_new")))


def search_text(rows: DataFrame, query: str, k: int, id_col: str, text_col: str, size: int = 64) -> DataFrame:
    """The k rows nearest to a text, with their snippets; rows without a text are dropped behind the cut. The query is one row, broadcast."""
    q = rows.sparkSession.range(1).select(hash_features(F.lit(query), size).alias("_q"))
    scored = rows.select(id_col, F.col(text_col).alias("_t"), hash_features(F.coalesce(F.col(text_col), F.lit("")), size).alias("_v")).crossJoin(F.broadcast(q))
    top = scored.select(id_col, F.round(X.cosine(F.col("_v"), F.col("_q")), 6).alias("score"), "_t").orderBy(F.desc("score"), id_col).limit(k)
    return top.select(id_col, "score", X.snippet(F.col("_t")).alias("snippet")).filter("snippet <> ''")
