"""Sweeps as table functions of SQL."""

from __future__ import annotations

import pytest
from gridloom.functions.table_functions import register_sweep
from gridloom.operators.grid import GridFrame
from gridloom.operators.march import march
from gridloom.operators.sweep import apply
from gridloom.plans import catalogue as cat
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def grid(spark):
    cells = spark.range(3 * 30 * 20).selectExpr("CAST(id div 600 AS INT) AS b", "id % 600 div 20 - 4 AS i", "CAST(id % 20 AS INT) AS j", "IF(id % 41 = 0, NULL, CAST(id * id % 101 AS DOUBLE)) AS u")
    return GridFrame(cells.where("(i * 7 + j) % 23 <> 0"), ("i", "j"), ("u",), ("b",))


def rows(df):
    return sorted(map(repr, df.select("b", "i", "j", "u").collect()))


def test_equals_the_frame(spark, grid):
    call = register_sweep(spark, "heat_by_sql", grid, {"u": cat.heat_2d}, side=7)
    assert rows(spark.sql(call)) == rows(apply(grid, cat.heat_2d).df)
    plan = spark.sql(call)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    want = apply(grid, cat.heat_2d).df.where("u > 50").groupBy("b").agg(F.count("u").alias("n"))
    got = spark.sql("SELECT b, count(*) AS n FROM heat_by_sql(TABLE(heat_by_sql_cells)) WHERE u > 50 GROUP BY b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_several_steps(spark, grid):
    call = register_sweep(spark, "heat3", grid, {"u": cat.heat_2d}, steps=3, side=8)
    assert rows(spark.sql(call)) == rows(march(grid, cat.heat_2d, 3).df)


def test_what_it_refuses(spark, grid):
    register_sweep(spark, "heat_odd", grid, {"u": cat.heat_2d})
    with pytest.raises(PySparkException, match="takes a table"):
        spark.sql("SELECT * FROM heat_odd(1)").collect()
    with pytest.raises(PySparkException, match="no column"):
        spark.sql("SELECT * FROM heat_odd(TABLE(SELECT b, i, j, u FROM heat_odd_cells))").collect()
    with pytest.raises(ValueError, match="outputs that are fields"):
        register_sweep(spark, "heat_w", grid, {"w": cat.heat_2d}, steps=2)
