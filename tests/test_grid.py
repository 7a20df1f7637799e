"""The grid engine: NumPy oracle, strategies against each other, boundaries, marching, errors."""

from __future__ import annotations

import json
import random
from dataclasses import replace

import numpy as np
import pytest

import gridloom
from gridloom.functions.elementwise import interior_values
from gridloom.functions.elementwise import swept as swept_by_function
from gridloom.functions.expr import evaluate
from gridloom.functions.frontend import Stencil, StencilError, from_text, stencil
from gridloom.operators.boundary import BoundarySpec, Side, apply_boundary
from gridloom.operators.bricks import from_bricks, to_bricks
from gridloom.operators.decompose import chunks, decompose, exchange_halos, gather, march_parts
from gridloom.operators.grid import GridFrame
from gridloom.operators.march import RungeKutta, march, march_blocked
from gridloom.operators.sweep import apply, fused
from gridloom.plans import catalogue as cat
from gridloom.plans.analysis import describe, fused_name, fusion_groups, temporal_depth
from gridloom.plans.report import as_json, as_table, measure, scaling
from gridloom.sources.tables import random_grid
from gridloom.streaming.advance import StreamedGrid

DIMS = ("i", "j", "k")


def frame(spark, arrays, dtype="double"):
    """Arrays by field to a grid."""
    first = next(iter(arrays.values()))
    rows = [(*map(int, at), *[float(a[at]) for a in arrays.values()]) for at in np.ndindex(first.shape)]
    dims = DIMS[: first.ndim]
    schema = ", ".join([f"{d} int" for d in dims] + [f"{f} {dtype}" for f in arrays])
    return GridFrame(spark.createDataFrame(rows, schema), dims, tuple(arrays))


def dense(grid, field, shape, dtype=float):
    out = np.full(shape, np.nan, dtype)
    for r in grid.df.select(*grid.dims, field).collect():
        out[tuple(r[d] for d in grid.dims)] = np.nan if r[field] is None else r[field]
    return out


def swept(s, arrays, halo="keep"):
    """One sweep with NumPy slices: interior written, the rest from the first field."""
    first = arrays[s.fields[0]]
    n, h = first.ndim, s.halo

    def read(a):
        return arrays[a.field][tuple(slice(h[x] + a.offset[x], first.shape[x] - h[x] + a.offset[x]) for x in range(n))]

    out = first.copy() if halo == "keep" else np.zeros_like(first)
    inner = tuple(slice(h[x], first.shape[x] - h[x]) for x in range(n))
    out[inner] = evaluate(s.body, read)
    return out


def random_text(rng, fields, ndim, radius, terms):
    names = "ijk"[:ndim]

    def access():
        offs = [rng.randint(-radius, radius) for _ in names]
        return f"{rng.choice(fields)}[{', '.join(n + (f'{o:+d}' if o else '') for n, o in zip(names, offs))}]"

    def term(depth=0):
        kind = rng.choice(["lin", "prod", "div", "max", "min", "abs", "where", "neg", "nest"])
        a, b, c = access(), access(), round(rng.uniform(0.1, 2), 3)
        if kind == "nest" and depth < 2:
            return f"({term(depth + 1)} - ({term(depth + 1)} * {c}))"
        return {
            "prod": f"{a} * {b}", "div": f"{a} / ({c} + abs({b}))", "max": f"max({a}, {c} * {b})", "min": f"min({a}, {b})",
            "abs": f"abs({a} - {b})", "where": f"where({a} > {b}, {c}, {a})", "neg": f"-{a}",
        }.get(kind, f"{c} * {a}")

    return " + ".join(term() for _ in range(terms))


@pytest.mark.parametrize("seed", range(8))
def test_random_expressions_bit_for_bit_in_every_plan(spark, seed):
    rng = random.Random(seed)
    ndim = rng.randint(1, 3)
    fields = list("abc"[: rng.randint(1, 3)])
    s = from_text("r", random_text(rng, fields, ndim, rng.randint(1, 2), 4))
    shape = {1: (40,), 2: (9, 11), 3: (6, 7, 6)}[ndim]
    data = np.random.default_rng(seed)
    arrays = {f: data.standard_normal(shape) for f in s.fields}
    grid = frame(spark, arrays)
    expected = swept(s, arrays)
    for plan in ("scatter", "join", "brick", "auto"):
        got = dense(apply(grid, s, "out", plan=plan), "out", shape)
        assert np.array_equal(got, expected, equal_nan=True), (plan, s.source)


def test_window_plan_in_blocks(spark, monkeypatch):
    from gridloom.operators import shift

    monkeypatch.setattr(shift, "BLOCK", 8)
    u = np.random.default_rng(1).standard_normal(100)
    got = dense(apply(frame(spark, {"u": u}), cat.lap_1d_4th, plan="window"), "u", u.shape)
    assert np.array_equal(got, swept(cat.lap_1d_4th, {"u": u}))


def test_ieee_rules(spark):
    u = np.array([1.0, -1.0, 0.0, np.nan, 2.0, -0.0, 5.0, np.inf])
    v = np.array([0.0, 0.0, 0.0, 1.0, -0.0, 3.0, np.nan, np.inf])
    grid = frame(spark, {"u": u, "v": v})
    for text in ("u[i] / v[i]", "max(u[i], v[i])", "min(u[i], v[i])", "where(u[i] > v[i], 1.0, 2.0)", "where(u[i] != v[i], 1.0, 2.0)", "where(u[i] == u[i], 1.0, 2.0)"):
        s = from_text("x", text)
        expected = evaluate(s.body, lambda a: {"u": u, "v": v}[a.field])
        for plan in ("auto", "brick"):
            got = dense(apply(grid, s, "o", plan=plan), "o", u.shape)
            assert np.array_equal(got, np.asarray(expected), equal_nan=True), (text, plan, got, expected)


def test_float32_is_bit_exact(spark):
    u = np.random.default_rng(2).standard_normal((8, 9)).astype(np.float32)
    s = from_text("f", "0.1 * (u[i-1, j] + u[i+1, j]) + 0.3 * u[i, j] / 3.0", dtype="fp32")
    c = [np.float32(x) for x in (0.1, 0.3, 3.0)]
    expected = u.copy()
    expected[1:-1] = c[0] * (u[:-2] + u[2:]) + c[1] * u[1:-1] / c[2]
    for plan in ("auto", "brick"):
        assert np.array_equal(dense(apply(frame(spark, {"u": u}, "float"), s, plan=plan), "u", u.shape, np.float32), expected)


def test_gaps_and_nulls_give_null(spark):
    rows = [(i, float(i)) for i in range(10) if i != 4] + [(11, None), (12, 1.0), (10, 1.0)]
    grid = GridFrame(spark.createDataFrame(rows, "i int, u double"), ("i",), ("u",))
    for plan in ("window", "scatter", "join", "brick"):
        got = {r["i"]: r["u"] for r in apply(grid, cat.laplacian_1d, plan=plan).df.collect()}
        assert [k for k, v in got.items() if v is None] and sorted(k for k, v in got.items() if v is None) == [3, 5, 10, 11]
        assert 4 not in got and got[0] == 0.0 and got[2] == 0.0


def test_halo_keep_zero_drop_and_box(spark):
    u = np.arange(12.0) ** 2
    grid = frame(spark, {"u": u})
    assert dense(apply(grid, cat.laplacian_1d, halo="zero"), "u", u.shape)[0] == 0
    assert apply(grid, cat.laplacian_1d, halo="drop").df.count() == 10
    part = apply(grid, cat.laplacian_1d, box={"i": (3, 5)})
    assert sorted(r["i"] for r in part.df.collect()) == [3, 4, 5]
    assert all(r["u"] == 2.0 for r in part.df.collect())


def boundary_numpy(u, spec, halo, there=True):
    """Axis by axis; cells that are not there are NaN before and after each axis."""
    out = np.where(there, u, np.nan)
    for d, (h, pair) in enumerate(zip(halo, spec.sides, strict=True)):
        if not h or pair is None:
            continue
        a = np.moveaxis(out, d, 0)
        n = len(a)
        for high, side in enumerate(pair):
            if side is None:
                continue
            for q in range(h):
                to = n - h + q if high else q
                a[to] = {
                    "dirichlet": side.value,
                    "neumann": a[n - h - 1 if high else h],
                    "periodic": a[h + q if high else n - 2 * h + q],
                    "reflecting": a[n - h - 1 - q if high else 2 * h - 1 - q],
                }[side.kind]
        out[~np.broadcast_to(there, u.shape)] = np.nan
    return out


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_compose_in_corners(spark, seed):
    rng = random.Random(seed)
    ndim = rng.choice([1, 2, 3])
    shape = tuple(rng.randint(7, 9) for _ in range(ndim))
    u = np.random.default_rng(seed).standard_normal(shape)
    side = lambda: rng.choice([None, Side("dirichlet", 2.5), Side("neumann"), Side("periodic"), Side("reflecting")])
    spec = BoundarySpec(tuple(rng.choice([None, (side(), side()), (side(), side())]) for _ in range(ndim)))
    halo = tuple(rng.randint(0, 2) for _ in range(ndim))
    got = dense(apply_boundary(frame(spark, {"u": u}), spec, halo), "u", shape)
    assert np.array_equal(got, boundary_numpy(u, spec, halo))


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_over_gaps(spark, seed):
    rng = random.Random(100 + seed)
    ndim = rng.choice([2, 3])
    shape = tuple(rng.randint(7, 8) for _ in range(ndim))
    data = np.random.default_rng(seed)
    u, there = data.standard_normal(shape), data.random(shape) < 0.7
    side = lambda: rng.choice([None, Side("dirichlet", 2.5), Side("neumann"), Side("periodic"), Side("reflecting")])
    spec = BoundarySpec(tuple((side(), side()) for _ in range(ndim)))
    halo = tuple(rng.randint(1, 2) for _ in range(ndim))
    whole = frame(spark, {"u": u})
    some = whole.df.where(" OR ".join(f"({' AND '.join(f'{d} = {x}' for d, x in zip(whole.dims, at))})" for at in np.argwhere(there)))
    grid = GridFrame(some, whole.dims, ("u",), bounds=tuple((0, n - 1) for n in shape))
    out = apply_boundary(grid, spec, halo)
    assert out.df.count() == there.sum()
    assert np.array_equal(dense(out, "u", shape), boundary_numpy(u, spec, halo, there), equal_nan=True)


def test_marching_with_a_boundary_grows_in_proportion(spark):
    grid = frame(spark, {"u": np.random.default_rng(7).standard_normal(40)})
    for steps in (1, 3, 6):
        out = march(grid, cat.advection_upwind, steps, bc="periodic")
        # Every step but the last is written, and the last one reads it three times.
        assert out.df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") + out.df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 3


def test_boundary_forms_and_errors(spark):
    assert BoundarySpec.of("periodic", 2) == BoundarySpec.periodic(2)
    assert BoundarySpec.of({0: ("dirichlet", 3.0)}, 2).sides == ((Side("dirichlet", 3.0),) * 2, None)
    assert BoundarySpec.of({0: ("neumann", "periodic")}, 1).sides == ((Side("neumann"), Side("periodic")),)
    with pytest.raises(ValueError):
        Side("open")
    with pytest.raises(ValueError):
        apply_boundary(frame(spark, {"u": np.zeros(5)}), "periodic", (2,))


def test_march_history_and_blocked(spark):
    u = np.random.default_rng(4).standard_normal(60)
    grid = frame(spark, {"u": u})
    now = u
    for _ in range(4):
        now = swept(cat.heat_1d, {"u": now})
    assert np.array_equal(dense(march(grid, cat.heat_1d, 4), "u", u.shape), now)
    assert np.array_equal(dense(march_blocked(grid, cat.heat_1d, 4, per_exchange=3, side=10), "u", u.shape), now)
    history = march(grid, cat.heat_1d, 2, keep="history")
    assert history.df.count() == 180 and history.batch == ("step",)


def test_runge_kutta(spark):
    u = np.random.default_rng(5).standard_normal(30)
    lap = lambda x: np.concatenate(([0], x[:-2] - 2.0 * x[1:-1] + x[2:], [0]))
    dt = 0.1
    k1 = lap(u)
    k2 = lap(u + 0.5 * dt * k1)
    k3 = lap(u + 0.5 * dt * k2)
    k4 = lap(u + dt * k3)
    s1 = u + dt * k1
    s2 = 0.75 * u + 0.25 * (s1 + dt * lap(s1))
    expected = {
        "euler": u + dt * k1, "rk2": u + dt * k2, "rk4": u + dt / 6.0 * (k1 + 2.0 * k2 + 2.0 * k3 + k4),
        "SSPRK3": 1.0 / 3.0 * u + 2.0 / 3.0 * (s2 + dt * lap(s2)),
    }
    grid = frame(spark, {"u": u})
    for method, e in expected.items():
        assert np.allclose(dense(RungeKutta(cat.laplacian_1d, method).step(grid, dt), "u", u.shape), e, atol=1e-13)
    with pytest.raises(ValueError):
        RungeKutta(cat.laplacian_1d, "rk9")


def test_fused_needs_agreeing_stencils(spark):
    grid = frame(spark, {"u": np.zeros((5, 5)), "v": np.ones((5, 5))})
    out = fused(grid, {"u": cat.gray_scott_u, "v": cat.gray_scott_v})
    assert out.fields == ("u", "v")
    with pytest.raises(ValueError):
        fused(grid, {"u": cat.heat_1d})
    with pytest.raises(ValueError):
        fused(grid, {"u": cat.heat_2d, "f": from_text("f", "u[i, j]", dtype="float32")})


def test_bricks_and_parts_round_trip(spark):
    u = np.random.default_rng(6).standard_normal((7, 10))
    grid = frame(spark, {"u": u})
    assert np.array_equal(dense(from_bricks(to_bricks(grid, 4), grid, 4), "u", u.shape), u)
    parts = decompose(grid, 3, axis=1, halo=1)
    assert np.array_equal(dense(gather(parts, grid, axis=1, halo=1), "u", u.shape), u)
    assert exchange_halos(parts, grid, axis=1, halo=1).count() == parts.count()
    assert chunks(0, 9, 4) == [(0, 2), (3, 5), (6, 7), (8, 9)]


def test_empty_grid(spark):
    grid = GridFrame(spark.createDataFrame([], "i int, u double"), ("i",), ("u",))
    assert apply(grid, cat.heat_1d).df.collect() == []
    assert grid.densify().df.collect() == []


def test_clashing_columns_are_left_out(spark):
    df = spark.createDataFrame([(i, float(i), "x", 1) for i in range(6)], "i int, u double, _r0 string, _block int")
    assert apply(GridFrame(df, ("i",), ("u",)), cat.heat_1d).df.columns == ["i", "u"]


@pytest.mark.parametrize(
    "text",
    ["u[i] ** 2", "u[i] % 2", "u[i + 1.5]", "u[1 - i]", "u[i] if u[i] > 0 else 1", "foo(u[i])", "max(u[i])", "u[i] > 1", "where(u[i], 1, 2)", "u[i] * q", "1 < u[i] < 2", "u[i] + i", "'a'", "u[i, j] + u[i]"],
)
def test_bodies_that_are_no_stencils(text):
    with pytest.raises(StencilError):
        from_text("bad", text)


def test_errors_name_file_and_line():
    with pytest.raises(StencilError, match=r"test_grid\.py:\d+:\d+: .*'q'"):

        @stencil
        def bad(u, i):
            return u[i] * q  # noqa: F821


def test_frontend_forms():
    n = 3.0

    @stencil(boundary="periodic")
    def f(u, v, i):
        """Doc."""
        a = n * u[i - 1]
        return a + v[2 + i] * 2 * 4

    assert f.fields == ("u", "v") and f.halo == (2,) and f.order == 4 and f.boundary == "periodic"
    assert describe(cat.laplacian_2d_9pt)["unique_loads"] == 9
    assert from_text("e", "sqrt(u[i]) + i", extended=True).extended
    with pytest.raises(StencilError):
        from_text("d", "u[i]", dtype="int8")
    assert fused_name(["a", "b"]) == "a_b" and fused_name(list("abcd")) == "a_and_3_others"
    assert sorted(map(sorted, fusion_groups([cat.update_e, cat.update_h, cat.heat_1d]))) == [["heat_1d"], ["update_e", "update_h"]]
    assert sorted(map(sorted, fusion_groups([cat.update_e, cat.heat_1d, cat.heat_2d], one_domain=True))) == [["heat_1d", "update_e"], ["heat_2d"]]

    @stencil(constants={"n": 5.0})
    def g(u, i):
        return n * u[i]

    assert g.body == from_text("g", "5.0 * u[i]").body  # explicit constants come first
    # (100 + 2 T) cells twice, of 8 bytes: 8 sweeps need 1,856 bytes, 3 need 1,696 and 2 need 1,664.
    assert [temporal_depth((1,), (100,), b) for b in (10_000, 1_700, 1_670, 100)] == [8, 3, 2, 1]
    assert temporal_depth((2, 2), (16, 16), 2 * 8 * 32 * 32) == 4


NAMED = [s for s in vars(cat).values() if isinstance(s, Stencil)] + [cat.box(1, 2), cat.star(2, 3), cat.iso_wave(2), cat.rectified(), cat.sided(), *cat.random_expressions().values()]


@pytest.mark.parametrize("s", NAMED, ids=lambda s: s.name)
def test_trees_equal_the_original_functions(s):
    """The parsed tree against the Python function itself, run on arrays."""
    shape = tuple(2 * h + 5 for h in s.halo)
    data = np.random.default_rng(3)
    arrays = {f: data.standard_normal(shape) * 10 for f in s.fields}
    if s.extended:
        lines = [np.arange(h, n - h).reshape([-1 if y == x else 1 for y in range(s.ndim)]).astype(float) for x, (h, n) in enumerate(zip(s.halo, shape))]
        read = lambda a: arrays[a.field][tuple(slice(h + o, n - h + o) for h, o, n in zip(s.halo, a.offset, shape))]
        assert np.array_equal(interior_values(s, arrays), evaluate(s.body, read, lines.__getitem__))
    else:
        assert np.array_equal(swept_by_function(s, arrays), swept(s, arrays), equal_nan=True)


@pytest.mark.parametrize("seed", range(20))
def test_random_trees_equal_the_original_functions(seed):
    rng = random.Random(1000 + seed)
    ndim, fields = rng.randint(1, 3), list("abc"[: rng.randint(1, 3)])
    s = from_text("r", random_text(rng, fields, ndim, rng.randint(1, 3), 8))
    data = np.random.default_rng(seed)
    arrays = {f: data.standard_normal(tuple(2 * h + 4 for h in s.halo)) for f in s.fields}
    assert np.array_equal(swept_by_function(s, arrays), swept(s, arrays), equal_nan=True)


def test_compiled_plans(spark, tmp_path):
    one = gridloom.compile(cat.heat_2d)
    both = gridloom.compile_fused([cat.flux_and_divergence()[n] for n in ("flux", "div")])
    assert both.inputs == ("a", "b", "c", "d") and both.name == "flux_div" and both.width == (1, 0, 1)
    assert one.validate(spark) and both.validate(spark, shape=(8, 5, 7))
    for plan in ("window", "scatter", "join", "brick"):
        assert gridloom.compile(cat.laplacian_2d_5pt, plan=plan, steps=2).validate(spark, shape=(9, 10))
    assert gridloom.compile(cat.heat_1d, steps=3, parts=3).validate(spark, shape=(30,))
    assert not gridloom.StencilPlan("x", {"u": replace(cat.heat_1d, fn=lambda u, i: u[i])}).validate(spark)
    grid = frame(spark, {"u": np.random.default_rng(1).standard_normal((12, 9))})
    notes = gridloom.compile(cat.heat_2d, steps=2, parts=2).annotations(grid)
    assert notes["plan"] == "window" and notes["halo"] == (1, 1) and notes["expanded_halo"] == (2, 2) and notes["exchange_layers"] == 1
    assert gridloom.compile(cat.box(1, 3)).annotations(frame(spark, {"u": np.zeros((4, 4, 4))}))["plan"] == "brick"
    assert gridloom.compile(cat.box(1, 2)).annotations(grid)["plan"] == "scatter"
    assert "Window" in one.explain(grid) and "LEFT JOIN cells" in one.sql("cells")
    one.write_sql(str(tmp_path / "heat.sql"))
    assert "-- halo: (1, 1)" in (tmp_path / "heat.sql").read_text()
    rows = measure([one], [grid], warmup=0, iters=1)
    assert rows[0]["cells"] == 70 and rows[0]["gpoints_per_s"] > 0 and "heat_2d" in as_table(rows) and json.loads(as_json(rows))[0]["shape"] == "12x9"
    assert scaling([rows[0], {**rows[0], "cells": 140.0, "time_ms": rows[0]["time_ms"] * 3}])[0]["cells_x"] == 2
    assert [p.name for p in gridloom.compile_groups([cat.update_e, cat.heat_1d, cat.update_h])] == ["heat_1d", "update_e_update_h"]
    with pytest.raises(ValueError):
        gridloom.compile(cat.heat_2d, out="other", steps=2)
    with pytest.raises(ValueError):
        march_blocked(grid, {"other": cat.heat_2d}, 2)
    with pytest.raises(ValueError):
        gridloom.compile_fused([cat.heat_1d, cat.heat_1d])
    twice = gridloom.Pipeline.standard().add(lambda s: replace(s, name=s.name + "_2"))
    assert gridloom.compile(cat.heat_1d, pipeline=twice).name == "heat_1d_2"


def test_public_names():
    assert all(getattr(gridloom, n) is not None for n in gridloom.__all__)
    assert gridloom.maximum(1.0, 2.0) == 2.0 and gridloom.minimum(1.0, np.nan) != gridloom.minimum(1.0, np.nan) and gridloom.where(True, 1, 2) == 1
    with pytest.raises(AttributeError):
        gridloom.nothing  # noqa: B018


def test_repeated_cells(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 5.0), (2, 3.0), (3, None), (3, 4.0)], "i int, u double")
    grid = GridFrame(df, ("i",), ("u",))
    with pytest.raises(ValueError, match="stands 2 times"):
        grid.checked()
    one = grid.unique("max")
    assert sorted(map(tuple, one.checked().df.collect())) == [(0, 1.0), (1, 5.0), (2, 3.0), (3, 4.0)]
    assert sorted(map(tuple, grid.unique("min").df.collect()))[1] == (1, 2.0)
    for plan in ("window", "scatter", "join", "brick"):
        assert dense(apply(one, cat.laplacian_1d, plan=plan), "u", (4,)).tolist() == [1.0, -6.0, 3.0, 4.0]


def test_parts_and_coupled_bricks_equal_marching(spark):
    data = np.random.default_rng(11)
    grid = frame(spark, {"u": data.random((9, 14)), "v": data.random((9, 14))})
    both = {"u": cat.gray_scott_u, "v": cat.gray_scott_v}
    for f in "uv":
        want = dense(march(grid, both, 3), f, (9, 14))
        assert np.array_equal(dense(march_parts(grid, both, 3, 3, axis=1), f, (9, 14)), want)
        assert np.array_equal(dense(march_blocked(grid, both, 3, side=5), f, (9, 14)), want)
    with pytest.raises(ValueError):
        march_parts(grid, both, 1, 2, halo=0)


def test_exchange_finds_every_copy_among_cells_near_the_ends(spark):
    grid = frame(spark, {"u": np.arange(40.0)})
    parts = decompose(grid, 4, halo=2)
    out = exchange_halos(parts, grid, halo=2, n=4)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, parts.collect()))


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    u = np.random.default_rng(12).standard_normal(30)
    state = StreamedGrid(frame(spark, {"u": u}), cat.heat_1d, f"file://{tmp_path}/states")
    request = spark.range(1)
    for batch in (0, 1, 1, 2, 2):
        state.on_batch(request, batch)
    again = StreamedGrid(frame(spark, {"u": u}), cat.heat_1d, f"file://{tmp_path}/states")  # another process goes on
    again.on_batch(request, 2)
    want = u
    for _ in range(3):
        want = swept(cat.heat_1d, {"u": want})
    for s in (state, again):
        assert np.array_equal(dense(s.state(2), "u", u.shape), want)


def test_random_grid_does_not_depend_on_partitions(spark):
    a = random_grid(spark, (6, 5), seed=3)
    b = GridFrame(random_grid(spark, (6, 5), seed=3).df.repartition(7), a.dims, a.fields)
    assert np.array_equal(dense(a, "u", (6, 5)), dense(b, "u", (6, 5)))
    assert not np.array_equal(dense(a, "u", (6, 5)), dense(random_grid(spark, (6, 5), seed=4), "u", (6, 5)))
