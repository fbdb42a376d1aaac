"""The inverted file against exact search, and its edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import vector_index as I
from quillgraph.sources.readers import table


def stored(spark, tmp_path, vectors, centres):
    I.build(vectors, centres).write.parquet(f"file://{tmp_path}/index")
    return spark.read.parquet(f"file://{tmp_path}/index")


def exact(rows, queries, k):
    ids, x = np.array([i for i, _ in rows]), I.unit(np.array([v for _, v in rows], float))
    out = {}
    for q, v in queries:
        score = np.round(x @ I.unit(np.array([v], float))[0], 6)
        out[q] = [(int(ids[j]), float(score[j])) for j in np.lexsort((ids, -score))[:k]]
    return out


def hits(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


def test_recall_of_all_ids_divisible_by_100(spark, tmp_path):
    e = table(spark, "/root/testdata/sf0.1", "embeddings")
    centres = I.Centres.fit(e, 64)
    index = stored(spark, tmp_path, e, centres)
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    assert index.agg(F.sum("n")).first()[0] == len(rows)  # every row is in the index, once
    queries = [(i, v) for i, v in rows if i % 100 == 0]
    got, want = hits(I.search(index, e.filter("vec_id % 100 = 0"), centres)), exact(rows, queries, 10)
    share = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 10 for q in want]
    print("recall", sum(share) / len(share), "lists", len(centres.points), "read", centres.probes)
    assert sum(share) / len(share) >= 0.9


def test_all_lists_give_the_exact_result_with_ties_and_hot_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 16)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(150)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    centres = I.Centres.fit(e, 8, sample=200)
    centres.probes = len(centres.points)
    index = stored(spark, tmp_path, e, centres)
    assert index.agg(F.max("n")).first()[0] <= 16
    queries = rows[:5] + rows[-2:]
    got = hits(I.search(index, spark.createDataFrame(queries, e.schema), centres, k=7, refine=1000))
    assert got == exact(rows, queries, 7)


def test_vectors_that_cannot_be_compared_and_empty_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<double>, id string"
    rows = [(1, [1.0, 0.0], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [math.nan, 1.0], "x"), (5, [None, 1.0], "x"), (6, [1.0], "x"), (7, [math.inf, 1.0], "x"), (8, [1.0, 1.0], None)]
    e = spark.createDataFrame(rows, schema)
    centres = I.Centres.fit(e, 2)
    centres.probes = len(centres.points)
    got = hits(I.search(stored(spark, tmp_path, e, centres), e, centres, k=3))
    assert got == {1: [(1, 1.0), (8, pytest.approx(0.707107))], 8: [(8, 1.0), (1, pytest.approx(0.707107))]}
    empty = e.limit(0)
    none = I.Centres.fit(empty, 2)
    assert I.search(I.build(empty, none), e, none).count() == 0
    assert I.search(I.build(e, centres), empty, centres).count() == 0
