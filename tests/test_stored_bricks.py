"""Stored bricks: the same cells, fewer files for a box, no shuffle of bricks for a sweep."""

from __future__ import annotations

import re

import pytest
from gridloom.operators.brickframe import Sweeps, march_bricks
from gridloom.operators.grid import GridFrame
from gridloom.operators.march import march
from gridloom.plans import catalogue as cat
from gridloom.sources.stored_bricks import open_bricks, write_bricks
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def grid(spark):
    cells = spark.range(96 * 80).selectExpr("1 AS b", "CAST(id div 80 AS INT) - 5 AS i", "id % 80 AS j", "CAST(id * id % 997 AS DOUBLE) AS u", "IF(id % 7 = 0, NULL, CAST(id AS FLOAT)) AS v")
    return GridFrame(cells.where("(i + j) % 11 <> 0"), ("i", "j"), ("u", "v"), ("b",))


@pytest.fixture(scope="module")
def path(grid, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('stored')}/grid"
    write_bricks(grid, path, sides=(8, 16), zone=2)
    return path


def rows(df):
    return sorted(map(repr, df.select("b", "i", "j", "u", "v").collect()))


def test_round_trip(spark, grid, path):
    g = open_bricks(spark, path).cells()
    assert (g.dims, g.fields, g.batch, g.extents) == (grid.dims, grid.fields, grid.batch, grid.extents) and g.df.dtypes == grid.df.dtypes
    assert rows(g.df) == rows(grid.df)


def test_a_box_reads_the_zones_it_meets(spark, grid, path):
    box = {"i": (10, 20), "j": (30, 33)}
    every, near = open_bricks(spark, path).df, open_bricks(spark, path, box, (1, 1))
    assert len(near.df.inputFiles()) <= 0.3 * len(every.inputFiles())  # 2 x 2 of 6 x 3 zones, of which those at the end hold fewer bricks
    plan = near.df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*z_i", plan) and re.search(r"PushedFilters: \[[^\]]*b_i", plan)
    got = near.cells().df.where(F.col("i").between(9, 21) & F.col("j").between(29, 34))
    assert rows(got) == rows(grid.df.where(F.col("i").between(9, 21) & F.col("j").between(29, 34)))


def test_sweeps_start_without_a_shuffle_of_bricks(spark, grid, path):
    bricks = open_bricks(spark, path)
    up = {"u": cat.heat_2d}
    sweeps = Sweeps({"u": cat.heat_2d.plain()}, (1, 1), 2, 1, None, (None, None), (2, 2))
    plan = bricks.advanced(sweeps)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "MapInArrow" in plan.split("Exchange hashpartitioning")[1]
    want = rows(march(grid, up, 4, bc="neumann").df)
    for _ in range(2):  # the stored bricks stay
        got, _, exchanges = march_bricks(bricks, up, 4, bc="neumann", per_exchange=2)
        assert rows(got.df) == want and exchanges == 2
    with pytest.raises(ValueError, match="too small"):
        march_bricks(bricks, up, 9, per_exchange=5)
