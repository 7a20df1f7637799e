"""The registered grid queries: each has its Spark plan here and its SQL in ``oracles``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frontend import Stencil
from ..functions.table_functions import register_sweep
from ..operators.boundary import BoundarySpec, Side, apply_boundary
from ..operators.brickframe import march_bricks
from ..operators.bricks import from_bricks, to_bricks
from ..operators.decompose import decompose, diagnostics, exchange_halos, gather, march_parts, max_difference
from ..operators.grid import GridFrame
from ..operators.incremental import resweep
from ..operators.march import RungeKutta, inject, march, march_blocked, zero_edge
from ..operators.sweep import apply, fused
from ..sources import tables as src
from ..sources.stored_bricks import open_bricks, write_bricks
from . import catalogue as cat
from .analysis import describe_frame
from .compiled import compile_fused
from .lineage import shared_dir
from .separable import sweep_separable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: (query, grid, outputs, halo, plan): one sweep each.
BOX9, BOX27, BOX125 = cat.box(1, 2), cat.box(1, 3), cat.box(2, 3)
DIAGONAL = cat.from_text("diagonal", "u[i-1, j-1] - u[i+1, j+1] + 0.5 * u[i, j]")
FLOAT = cat.from_text("float_heat", "0.1 * (u[i-1, j] + u[i+1, j]) + 0.3 * u[i, j] / 3.0", dtype="float32")
RANDOM = cat.random_expressions()
SWEEPS: list[tuple[str, str, dict[str, Stencil], str, str]] = [
    ("heat_1d", "O1", {"u": cat.heat_1d}, "keep", "auto"),
    ("advection_1d", "O1", {"u": cat.advection_upwind}, "keep", "auto"),
    ("laplacian_1d_4th", "O1", {"u": cat.lap_1d_4th}, "keep", "auto"),
    ("laplacian_1d_scatter", "O1", {"u": cat.laplacian_1d}, "keep", "scatter"),
    ("heat_1d_drop_halo", "O1", {"u": cat.heat_1d}, "drop", "auto"),
    ("heat_2d", "E2", {"u": cat.heat_2d}, "keep", "auto"),
    ("laplacian_2d_5pt", "E2", {"u": cat.laplacian_2d_5pt}, "drop", "auto"),
    ("laplacian_2d_9pt", "E2", {"u": cat.laplacian_2d_9pt}, "keep", "auto"),
    ("wave_2d", "E2", {"u": cat.wave_2d(0.1)}, "keep", "auto"),
    ("box9_2d", "E2", {"u": BOX9}, "keep", "auto"),
    ("diagonal_2d_join", "E2", {"u": DIAGONAL}, "keep", "auto"),
    ("heat_2d_float32", "E2f", {"u": FLOAT}, "keep", "auto"),
    ("heat_2d_brick", "E2", {"u": cat.heat_2d}, "keep", "brick"),
    ("box9_2d_brick", "E2", {"u": BOX9}, "drop", "brick"),
    ("laplacian_3d_7pt", "L3", {"u": cat.laplacian_3d_7pt}, "drop", "auto"),
    ("mean_3d", "L3", {"u": cat.mean_3d}, "keep", "auto"),
    ("laplacian_3d_brick", "L3", {"u": cat.laplacian_3d_7pt}, "keep", "brick"),
    ("star13_3d", "L3", {"u": cat.star(2, 3)}, "keep", "auto"),
    ("star19_3d", "L3", {"u": cat.star(3, 3)}, "keep", "scatter"),
    ("star25_3d", "L3", {"u": cat.star(4, 3)}, "keep", "auto"),
    ("box27_3d", "L3", {"u": BOX27}, "keep", "auto"),
    ("box27_3d_scatter", "L3", {"u": BOX27}, "keep", "scatter"),
    ("box125_3d", "L3", {"u": BOX125}, "drop", "auto"),
    ("rectified_3d", "L3", {"u": cat.rectified()}, "keep", "auto"),
    ("sided_1d", "C1", {"u": cat.sided()}, "keep", "auto"),
    ("extended_1d", "C1", {"u": cat.EXTENDED}, "keep", "auto"),
    ("flux_div_fused", "L8", cat.flux_and_divergence(), "drop", "auto"),
    ("iso_wave_3d", "L3", {"u": cat.iso_wave(4)}, "keep", "auto"),
    ("cond_1d", "C1", {"u": cat.cond_1d}, "keep", "auto"),
    ("cond_3d", "L3", {"u": cat.cond_3d}, "keep", "auto"),
    ("clip_1d", "C1", {"u": cat.clip}, "keep", "auto"),
    ("comparisons_1d", "C1", {"u": cat.comparisons}, "keep", "auto"),
    ("product_3d", "L3", {"u": cat.product_flux}, "keep", "auto"),
    ("divide_1d", "C1", {"u": cat.divide}, "keep", "auto"),
    ("wave_two_fields_2d", "V2", {"u": cat.wave_two_fields}, "keep", "auto"),
    ("gray_scott_fused", "V2", {"u": cat.gray_scott_u, "v": cat.gray_scott_v}, "keep", "auto"),
    ("shallow_water_fused", "S2", {"h": cat.shallow_h, "p": cat.shallow_p, "q": cat.shallow_q}, "keep", "auto"),
    ("advection_terms_fused", "L8", cat.advection_terms(), "drop", "auto"),
    ("random_expressions_fused", "C1", RANDOM, "keep", "auto"),
    ("random_expressions_brick", "C1", RANDOM, "keep", "brick"),
    ("sparse_2d", "V2s", {"u": cat.heat_2d}, "keep", "auto"),
    ("batch_heat_1d", "B1", {"u": cat.heat_1d}, "keep", "auto"),
    ("batch_heat_1d_brick", "B1", {"u": cat.heat_1d}, "keep", "brick"),
]
GRIDS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {  # dims, fields, batch
    "O1": (("i",), ("u",), ()), "C1": (("i",), ("u",), ()), "E2": (("i", "j"), ("u",), ()), "E2f": (("i", "j"), ("u",), ()),
    "L3": (("i", "j", "k"), ("u", "v", "w"), ()), "L8": (("i", "j", "k"), tuple("abcdefgh"), ()), "V2": (("i", "j"), ("u", "v"), ()),
    "V2s": (("i", "j"), ("u", "v"), ()), "S2": (("i", "j"), ("h", "p", "q"), ()), "B1": (("i",), ("u",), ("b",)),
}


def grid(spark: SparkSession, sf_dir: str, name: str) -> GridFrame:
    if name == "O1":
        return src.orders(spark, sf_dir)
    if name == "C1":
        return src.customers(spark, sf_dir)
    if name == "E2":
        return src.embeddings(spark, sf_dir)
    if name == "E2f":
        return src.embeddings(spark, sf_dir, "float")
    if name == "L3":
        return src.lineitem_box(spark, sf_dir)
    if name == "L8":
        g = src.lineitem_box(spark, sf_dir)
        made = {"a": "u", "b": "v", "c": "w", "d": "u + 1", "e": "v * 0.5", "f": "w * 0.25", "g": "v - w", "h": "u * 2"}
        return GridFrame(g.df.selectExpr("i", "j", "k", *[f"{x} AS {n}" for n, x in made.items()]), g.dims, tuple(made))
    if name == "V2":
        return src.user_days(spark, sf_dir).densify(0.0)
    if name == "V2s":
        return src.user_days(spark, sf_dir)
    if name == "S2":
        g = src.user_days(spark, sf_dir).densify(0.0)
        return GridFrame(g.df.selectExpr("i", "j", "u + 1 AS h", "v AS p", "v * 0.5 AS q"), g.dims, ("h", "p", "q"), bounds=g.extents)
    return src.lines_by_quantity(spark, sf_dir)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _sweep_query(name: str, of: str, outputs: dict[str, Stencil], halo: str, plan: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fused(grid(spark, sf_dir, of), outputs, halo=halo, plan=plan).df

    run.__name__ = name
    query(run)


for _spec in SWEEPS:
    _sweep_query(*_spec)


@query
def divide_by_zero_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = apply(grid(spark, sf_dir, "C1"), cat.divide_by_zero, halo="drop")
    inf = F.lit(float("inf"))
    return g.df.select("i", (F.col("u") == inf).alias("plus"), (F.col("u") == -inf).alias("minus"), F.isnan("u").alias("nan"))


@query
def domain_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(grid(spark, sf_dir, "O1"), cat.lap_1d_4th, box={"i": (100, 900)}).df


#: Boundary queries: the conditions, and the halo that is filled.
MARCHED = BoundarySpec(((Side("neumann"), Side("neumann")), (Side("periodic"), Side("periodic"))))
MIXED = BoundarySpec(((Side("dirichlet", 7.5), Side("neumann")), (Side("periodic"), Side("periodic"))))
BOUNDARIES = {
    "boundary_dirichlet": ("C1", BoundarySpec.dirichlet(1, 3.25), (2,)),
    "boundary_neumann": ("C1", BoundarySpec.neumann(1), (2,)),
    "boundary_periodic": ("C1", BoundarySpec.periodic(1), (3,)),
    "boundary_reflecting": ("C1", BoundarySpec.reflecting(1), (3,)),
    "boundary_mixed_2d": ("V2", MIXED, (2, 1)),
    "boundary_gaps_2d": ("V2s", BoundarySpec(((Side("neumann"), Side("dirichlet", 2.5)), (Side("reflecting"), Side("periodic")))), (2, 2)),
    "boundary_corners_3d": ("L3", BoundarySpec(((Side("reflecting"), Side("dirichlet", -1.0)), None, (Side("neumann"), Side("dirichlet", 4.0)))), (1, 1, 2)),
}


def _boundary_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        of, spec, halo = BOUNDARIES[name]
        return apply_boundary(grid(spark, sf_dir, of), spec, halo).df

    run.__name__ = name
    query(run)


for _name in BOUNDARIES:
    _boundary_query(_name)


@query
def march_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return march(grid(spark, sf_dir, "C1"), cat.heat_1d, 5).df


@query
def march_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return march(grid(spark, sf_dir, "C1"), cat.heat_1d, 3, keep="history").df


@query
def march_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return march(grid(spark, sf_dir, "C1"), cat.advection_upwind, 4, bc="periodic").df


@query
def march_neumann_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return march(grid(spark, sf_dir, "V2"), cat.heat_2d, 3, bc=MARCHED).df


#: Reacting species over three sweeps: in bricks that exchange once, and as a compiled plan.
SPECIES = {"u": cat.gray_scott_u, "v": cat.gray_scott_v}


@query
def march_blocked_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return march_blocked(grid(spark, sf_dir, "V2"), SPECIES, 3, side=16).df


@query
def compiled_fused_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_fused(SPECIES, steps=3).apply(grid(spark, sf_dir, "V2")).df


@query
def march_bricks_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return march_bricks(grid(spark, sf_dir, "E2"), cat.heat_2d, 5, per_exchange=2)[0].df


@query
def march_bricks_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return march_bricks(grid(spark, sf_dir, "V2"), SPECIES, 4, bc=MARCHED, per_exchange=2, sides=64)[0].df


#: Conditions of a march over a grid with gaps.
GAPPED = BoundarySpec(((Side("reflecting"), Side("dirichlet", 2.5)), (Side("neumann"), Side("reflecting"))))


@query
def march_bricks_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return march_bricks(grid(spark, sf_dir, "V2s"), cat.heat_2d, 3, bc=GAPPED, per_exchange=3, sides=64)[0].df


@query
def march_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass, energy and largest change of each step, which the bricks measure as they go."""
    return march_bricks(grid(spark, sf_dir, "O1"), cat.heat_1d, 4, bc="neumann", per_exchange=2, sides=4096, measure=True)[1]


#: Largest change at which a march ends, and its most steps.
STILL, MOST_STEPS = 1500.0, 6


@query
def march_until_still(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, measures, _ = march_bricks(grid(spark, sf_dir, "C1"), cat.heat_1d, MOST_STEPS, bc="reflecting", per_exchange=4, sides=256, tolerance=STILL)
    return g.df.join(F.broadcast(measures.agg(F.max("step").alias("step"))), how="left")  # one row


@query
def stored_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of a grid that is stored in bricks: only the zones that it meets are read."""
    path, box = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}", {"i": (100, 180), "j": (5, 40)}
    write_bricks(grid(spark, sf_dir, "E2"), path, sides=(32, 32), zone=2)
    near = open_bricks(spark, path, box, cat.laplacian_2d_9pt.halo).cells()
    return apply(near, cat.laplacian_2d_9pt, box=box).df


@query
def stored_march(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marching from stored bricks, which no shuffle moves."""
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    write_bricks(grid(spark, sf_dir, "V2"), path, sides=(64, 16))
    return march_bricks(open_bricks(spark, path), SPECIES, 3, bc="reflecting", per_exchange=2)[0].df


#: Orders whose price changes, and cells of a block.
CHANGED, RESWEPT = "i % 5000 BETWEEN 100 AND 103", 1024


@query
def incremental_resweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sweeps after a few prices have changed: from the earlier result, in the blocks that they reach."""
    g = grid(spark, sf_dir, "O1")
    before = march_bricks(g, cat.heat_1d, 3)[0].df
    now = g.with_df(g.df.withColumn("u", F.when(F.expr(CHANGED), F.col("u") + 1000.0).otherwise(F.col("u"))))
    return resweep(before, now, g.df.where(CHANGED), {"u": cat.heat_1d}, 3, RESWEPT).df


#: Digits to which passes along the axes agree with the whole box.
PASS_DIGITS = 9


@query
def bell_in_passes_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sweep_separable(grid(spark, sf_dir, "L3"), cat.bell(2, 3), halo="drop")
    return g.df.select("i", "j", "k", F.round("u", PASS_DIGITS).alias("u"))


@query
def march_parts_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return march_parts(grid(spark, sf_dir, "E2"), {"u": cat.heat_2d}, 3, n=4, axis=1).df


@query
def stored_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    src.write_grid(apply(grid(spark, sf_dir, "O1"), cat.heat_1d), path)
    return apply(src.read_grid(spark, path, ("i",), ("u",)), cat.advection_upwind).df


@query
def sql_over_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply(grid(spark, sf_dir, "C1"), cat.heat_1d).view("swept_customers")
    return spark.sql("SELECT i % 10 AS digit, max(u) AS most, count(*) AS n FROM swept_customers WHERE u > 0 GROUP BY 1")


@query
def sql_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep as a table function of a SQL query."""
    g = grid(spark, sf_dir, "E2")
    name = f"nine_{uuid.uuid4().hex}"
    call = register_sweep(spark, name, g, {"u": cat.laplacian_2d_9pt}, side=64)
    return spark.sql(f"SELECT j, max(u) AS most, min(u) AS least, count(*) AS n FROM ({call}) WHERE u <> 0 GROUP BY j")


@query
def random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").count()  # one row of the field for each customer
    return apply(src.random_grid(spark, (rows, 15), seed=7), cat.heat_2d).df


@query
def unique_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("CAST(l_quantity AS INT) AS i", "l_extendedprice AS u")
    return apply(GridFrame(lines, ("i",), ("u",)).unique("max"), cat.heat_1d).df


@query
def march_blocked_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return march_blocked(grid(spark, sf_dir, "V2"), cat.heat_2d, 3, per_exchange=3, side=16).df.select("i", "j", "u")


@query
def leapfrog_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = cat.from_text("old", "u[i, j]")
    return march(grid(spark, sf_dir, "V2"), {"u": cat.leapfrog, "v": old}, 2, source=zero_edge("u", (1, 1))).df


@query
def fdtd_staggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir, "C1")
    both = GridFrame(g.df.selectExpr("i", "u AS e", "u * 0.5 AS h"), g.dims, ("e", "h"), bounds=g.extents)
    return march(both, [{"h": cat.update_h}, {"e": cat.update_e}], 2, source=inject("e", {"i": 40}, lambda n: 10.0 * n)).df


def _rk_query(method: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return RungeKutta(cat.laplacian_1d, method).solve(grid(spark, sf_dir, "C1"), 0.1, 2).df

    run.__name__ = method if method.startswith("rk") else f"rk_{method}"
    query(run)


for _m in ("euler", "rk2", "rk4", "ssprk3"):
    _rk_query(_m)


@query
def brick_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = to_bricks(grid(spark, sf_dir, "V2"), 8)
    return b.select("b_i", "b_j", F.posexplode("data").alias("pos", "u"))


@query
def brick_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir, "E2")
    return from_bricks(to_bricks(g, 32), g, 32).df


@query
def decompose_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose(grid(spark, sf_dir, "C1"), 7, halo=2)


@query
def exchange_halos_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir, "C1")
    parts = decompose(g, 5, halo=1).withColumn("u", F.when(F.col("owned"), F.col("u") + 1.0).otherwise(F.col("u")))
    return exchange_halos(parts, g, halo=1)


@query
def gather_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir, "E2")
    return gather(decompose(g, 4, axis=1, halo=1), g, axis=1, halo=1).df


@query
def densify_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir, "V2").df


@query
def densify_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir, "L3").densify(-1.0).df


@query
def diagnostics_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(grid(spark, sf_dir, "B1"))


@query
def max_difference_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir, "E2")
    return max_difference(apply(g, cat.heat_2d), apply(g, cat.heat_2d, plan="brick"))


@query
def made_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("i") * 100 + F.col("j") * 10 + F.col("k")
    layers = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()  # one layer for each vector
    return apply(src.make_grid(spark, (layers, 9, 7), value), cat.mean_3d).df


@query
def describe_stencils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stencils read and cost, and what a sweep over the tables' grids comes to."""
    described = describe_frame(spark, [cat.heat_1d, cat.laplacian_2d_9pt, cat.cond_3d, BOX27, BOX125, FLOAT])
    grids = [grid(spark, sf_dir, of).df.agg(F.lit(n).alias("ndim"), F.count(F.lit(1)).alias("cells")) for n, of in ((1, "O1"), (2, "E2"), (3, "L3"))]
    sizes = grids[0].union(grids[1]).union(grids[2])  # a row for each number of dimensions
    return described.join(F.broadcast(sizes), "ndim").withColumn("work", F.col("cells") * F.col("flops"))


#: Smoothing of live activity along the days.
LIVE = {"u": cat.from_text("live", "0.25 * u[i, j-1] + 0.5 * u[i, j] + 0.25 * u[i, j+1]")}


@query
def streaming_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, counted by user and day in its state, and the smoothed surface that it leaves."""
    from ..streaming.cells import LiveGrid

    extents = src.user_days(spark, sf_dir).extents
    live = LiveGrid(spark, f"{shared_dir(spark)}/live-{uuid.uuid4().hex}", extents, LIVE, steps=2, side=32)
    events = spark.readStream.schema("user_id bigint, ts timestamp_ntz").parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be one file
    utc = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")  # the table's times have no zone
    live.run(events.select("user_id", utc.alias("ts")), "user_id", "ts")
    return live.surface().select("i", "j", "n", "u")


@query
def streaming_march(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.advance import march_by_stream

    return march_by_stream(grid(spark, sf_dir, "C1"), cat.heat_1d, steps=3).df
