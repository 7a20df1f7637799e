"""Every grid query against its DuckDB SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from gridloom.plans.oracles import oracle_sql
from gridloom.plans.queries import QUERIES

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(row):
    return tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert name in ORACLES
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    got = sorted((plain(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted((plain(r) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert got == want
