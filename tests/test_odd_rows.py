"""Queries against their SQL on tables with odd rows."""

import duckdb
import pytest

from quillgraph.plans import catalog

from .test_queries import _rows


def equals_sql(spark, folder, name, tables):
    """tables: name -> (rows, schema); written to folder, read by the query and by its SQL."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    f, sql = catalog.QUERIES[name]
    df = f(spark, str(folder))
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    assert _rows(df.columns, got) == _rows(rel.columns, rel.fetchall())
    return got


SPACED = ["a\x0bb", "a\r\nb", "ab", "\x0bab", " ab\x0b ", "ab  ", "ab \x85", " ab", "\x01x\x1f", "\t\n\f\r ab\t\n\f\r ", " ", "", "\n\n", "é \U0001f600 "]


@pytest.mark.parametrize("nulls", [[], [1001], [1002], [1001, 1002]])
def test_vectors_of_odd_texts(spark, tmp_path, nulls):
    """White space within texts and beyond ASCII stays, empty texts count, and a null text makes unknown what NOT IN makes unknown."""
    rows = [(i, t) for i, t in enumerate(SPACED)] + [(i + 101, t) for i, t in enumerate(SPACED[::3])] + [(n, None) for n in nulls]
    got = equals_sql(spark, tmp_path, "vectors_ingested", {"documents": (rows, "doc_id long, text string")})
    assert len(got) == len({t.strip(" \t\n\f\r") for t in SPACED}) + bool(nulls)


def test_vectors_without_stored_ones(spark, tmp_path):
    equals_sql(spark, tmp_path, "vectors_ingested", {"documents": ([(1, None), (3, "a"), (None, "b"), (5, " a")], "doc_id long, text string")})


LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"


@pytest.mark.parametrize("name", ["tier1_results", "tier1_entities"])
def test_tier_of_lines_that_repeat(spark, tmp_path, name):
    """Lines of one order, number, part and quantity are one section's id: equal ones stay two rows, others keep their own method and task. Quantities are whole to the nearest."""
    lines = [(1, 1, 7, 3, 5.0, "R"), (1, 1, 7, 3, 5.0, "R"), (1, 1, 7, 4, 5.0, "A"), (2, 1, 7, 3, 5.0, "R"), (2, 2, 57, 3, 2.5, "R"), (2, 3, 8, 3, 3.5, "R"), (4, 1, 12, 5, 9.0, "N"), (4, 1, 12, 5, 9.0, "N"), (4, 1, 12, 6, 9.0, "N")]
    got = equals_sql(spark, tmp_path, name, {"lineitem": (lines, LINE)})
    assert name != "tier1_results" or len(got) == len(lines)


PART = "p_partkey long, p_name string"
ORDERED = "l_partkey long, l_orderkey long"


def test_entities_of_every_shared_name_are_paired(spark, tmp_path):
    """Names of shared tasks bring their entities together as other names do; entities without a vector and of one order are paired, too, and no pair comes twice."""
    part = [(i, f"name {i % 3}" if i != 9 else "NAME 1") for i in range(200)]
    lines = [(i % 200, i % 23) for i in range(0, 400, 7)] + [(5, 1), (5, 1), (8, 1), (777, 1)]
    vectors = [(v, [float(v % 7), 1.0, float(v % 3) - 1]) for v in range(0, 150)]
    tables = {"part": (part, PART), "lineitem": (lines, ORDERED), "embeddings": (vectors, "vec_id long, embedding array<float>")}
    got = equals_sql(spark, tmp_path, "entity_pair_scores", tables)
    pairs = {r[:2] for r in got}
    assert len(pairs) == len(got) and {(0, 40), (40, 80), (2, 42), (1, 41)} <= pairs
