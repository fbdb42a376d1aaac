"""Every query of the catalogue against its SQL in DuckDB."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from quillgraph.plans import catalog


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    f, sql = catalog.QUERIES[name]
    df = f(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, got) == _rows(rel.columns, rel.fetchall())


def test_flagship_has_rows(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0
