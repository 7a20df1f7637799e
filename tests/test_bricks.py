"""Bricks that stay bricks: the same as marching cell by cell, and what an exchange ships."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from gridloom.functions.frontend import from_text
from gridloom.operators.boundary import BoundarySpec, Side
from gridloom.operators.brickframe import BrickFrame, Sweeps, march_bricks
from gridloom.operators.decompose import diagnostics
from gridloom.operators.grid import GridFrame
from gridloom.operators.march import march
from gridloom.plans import catalogue as cat
from pyspark.sql import functions as F

WIDE = from_text("wide", "0.5 * u[i-2, j] + 0.25 * u[i+1, j+1] - 0.125 * u[i, j-1] + 0.1 * u[i, j]")
D, N, R, P = Side("dirichlet", 2.5), Side("neumann"), Side("reflecting"), Side("periodic")


def grid(spark, shape, seed=0, gaps=0.0, nulls=0.0, batches=0):
    rng = random.Random(seed)
    dims = "ijk"[: len(shape)]
    rows = []
    for b in range(max(1, batches)):
        for at in np.ndindex(*shape):
            edge = any(x in (0, n - 1) for x, n in zip(at, shape, strict=True))
            if rng.random() >= gaps or (edge and rng.random() < 0.5):
                v = [None if rng.random() < nulls else rng.uniform(-1, 1) for _ in "uv"]
                rows.append((*([b] if batches else []), *(x - 3 for x in at), *v))
    schema = ", ".join([*(["b int"] if batches else []), *[f"{d} int" for d in dims], "u double", "v double"])
    return GridFrame(spark.createDataFrame(rows, schema), tuple(dims), ("u", "v"), ("b",) if batches else (), tuple((-3, n - 4) for n in shape))


def rows(g):
    return sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in map(tuple, g.df.select(*g.keys, *sorted(g.fields)).na.fill(-9e99, list(g.fields)).collect()))


CASES = [
    (None, 0.0), ("dirichlet", 0.0), ("neumann", 0.0), ("reflecting", 0.0), ("periodic", 0.0), ("neumann", 0.2), ("reflecting", 0.2), (("dirichlet", 1.5), 0.3),
    (BoundarySpec(((D, N), (R, R))), 0.2), (BoundarySpec(((P, P), (N, D))), 0.0), (BoundarySpec(((R, N), (P, P))), 0.0), (BoundarySpec((None, (N, None))), 0.2),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_equals_marching_by_cells(spark, n):
    bc, gaps = CASES[n]
    g = grid(spark, (17, 11), n, gaps, 0.02)
    update = {"u": WIDE} if n % 2 else {"u": WIDE, "v": cat.from_text("v", "0.5 * v[i, j-1] + u[i, j]")}
    want = rows(march(g, update, 5, bc=bc))
    for depth in (1, 3):
        got, _, exchanges = march_bricks(g, update, 5, bc=bc, per_exchange=depth, sides=4)
        assert rows(got) == want
        wraps = bc == "periodic" or (isinstance(bc, BoundarySpec) and any(p and P in p for p in bc.sides))
        assert exchanges == (1 + math.ceil(4 / depth) if wraps else math.ceil(5 / depth))


@pytest.mark.parametrize("bc", [None, "periodic", "reflecting"])
@pytest.mark.parametrize("steps", [1, 4])
def test_other_shapes(spark, bc, steps):
    line = grid(spark, (29,), 3, batches=2)
    up = {"u": cat.lap_1d_4th}
    assert rows(march_bricks(line, up, steps, bc=bc, per_exchange=2, sides=5)[0]) == rows(march(line, up, steps, bc=bc))
    cube = grid(spark, (9, 6, 5), 4)
    up = {"u": cat.mean_3d}
    assert rows(march_bricks(cube, up, steps, bc=bc, per_exchange=2, sides=(4, 6, 2))[0]) == rows(march(cube, up, steps, bc=bc))


def test_float_fields_stay_floats(spark):
    g = grid(spark, (9, 9), 5)
    g = GridFrame(g.df.selectExpr("i", "j", "CAST(u AS FLOAT) AS u"), g.dims, ("u",), bounds=g.extents)
    up = from_text("f", "0.1 * (u[i-1, j] + u[i, j+1]) + u[i, j] / 3.0", dtype="float32")
    got, _, _ = march_bricks(g, up, 3, sides=4)
    assert dict(got.df.dtypes) == dict(g.df.dtypes) and rows(got) == rows(march(g, up, 3))


def test_what_it_does_not_do(spark):
    g = grid(spark, (9, 9), 6, gaps=0.3)
    with pytest.raises(ValueError, match="one side only"):
        march_bricks(g, cat.heat_2d, 2, bc=BoundarySpec(((P, N), None)))
    with pytest.raises(ValueError, match="without gaps"):
        march_bricks(g, cat.heat_2d, 2, bc="periodic")
    with pytest.raises(ValueError, match="outputs that are fields"):
        march_bricks(g, {"w": cat.heat_2d}, 2)


def test_an_exchange_shuffles_faces_alone(spark):
    g = GridFrame(spark.range(64 * 64).selectExpr("id div 64 AS i", "id % 64 AS j", "CAST(id AS DOUBLE) AS u"), ("i", "j"), ("u",))
    bricks = BrickFrame.of(g, 32)
    sweeps = Sweeps({"u": cat.heat_2d.plain()}, (1, 1), 2, 1, None, (None, None), (2, 2))
    plan = bricks.advanced(sweeps)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the bricks are read bucket by bucket
    left, right = plan.split("Exchange hashpartitioning")
    assert "Bucketed: true" in left and "MapInArrow" in right
    shipped = bricks.slabs(sweeps).agg(F.sum(F.length("u"))).first()[0]
    assert shipped == 8 * 4 * (2 * 32 * 2 + 2 * 2)  # of four bricks: two faces and a corner each
    bricks.forget()


def test_measures_equal_those_of_each_state(spark):
    g = grid(spark, (17, 11), 7, gaps=0.02)
    up = {"u": cat.heat_2d, "v": cat.from_text("v", "0.5 * v[i, j-1] + u[i, j]")}
    bc = BoundarySpec(((R, N), (D, D)))
    _, got, _ = march_bricks(g, up, 4, bc=bc, per_exchange=3, sides=4, measure=True)
    got = {(r["step"], r["field"]): r for r in got.collect()}
    before = g
    for step in range(1, 5):
        now = march(before, up, 1, bc=bc)
        inner = now.df.where(now.interior((1, 1))).select("i", "j", "u", "v")
        old = before.df.selectExpr("i", "j", "u AS ou", "v AS ov")
        values = inner.join(old, ["i", "j"]).collect()
        for f in "uv":
            x = [r[f] for r in values if r[f] is not None]
            r = got[step, f]
            assert r["mass"] == math.fsum(x) and r["energy"] == math.fsum(v * v for v in x) and r["n_cells"] == len(x)
            assert r["change"] == max(abs(v[f] - v["o" + f]) for v in values if v[f] is not None and v["o" + f] is not None), (step, f)
        before = now
    assert len(got) == 8


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_marching_until_it_stands_still(spark, depth):
    g = grid(spark, (13, 9), 8)
    g = GridFrame(g.df.select("i", "j", "u"), g.dims, ("u",), bounds=g.extents)
    _, all_, _ = march_bricks(g, cat.heat_2d, 12, bc="neumann", sides=4, measure=True)
    changes = {r["step"]: r["change"] for r in all_.collect()}
    stop = min(s for s, c in changes.items() if c <= 0.1)
    got, measured, _ = march_bricks(g, cat.heat_2d, 12, bc="neumann", per_exchange=depth, sides=4, tolerance=0.1)
    assert 1 < stop < 12 and measured.agg(F.max("step")).first()[0] == stop
    assert rows(got) == rows(march(g, cat.heat_2d, stop, bc="neumann"))


def test_diagnostics_do_not_follow_the_partitions(spark):
    g = grid(spark, (40, 30), 9)
    values = [r["u"] for r in g.df.select("u").collect()]
    want = math.fsum(values), math.fsum(v * v for v in values)
    for n in (1, 4, 60):
        r = diagnostics(g.with_df(g.df.repartition(n, "j"))).first()
        assert (r["mass"], r["energy"]) == want
