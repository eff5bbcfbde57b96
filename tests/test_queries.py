"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from millcheck.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(round(v, 7) + 0.0)
    return str(v)


def compare(spark, duck, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    rel = duck.sql(sql)
    assert sorted(rel.columns) == names
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    assert [KINDS.get(t, theirs[c]) for c, t in sorted(df.dtypes)] == [theirs[c] for c in names]
    at = [rel.columns.index(c) for c in names]
    assert sorted(tuple(cell(r[c]) for c in names) for r in df.collect()) == sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    compare(spark, duck, QUERIES[name], SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(QUERIES) <= set(__spark_entry__.queries())


def test_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-W", "error", "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
