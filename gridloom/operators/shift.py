"""Neighbour values as columns: three plans for the same result.

window   Offsets along one axis each: range frames, exact on grids with gaps.  A long axis is cut
         into blocks, whose edge cells are copied to the neighbour block, so a one-dimensional grid
         does not become one task.
scatter  Any offsets: every cell is sent to the cells that read it, and one grouped aggregation
         pivots what arrives.  One shuffle, rows times reads.
join     Few offsets: one equi-join each.

``with_reads`` returns the grid's rows with one more column per read; a read of a missing cell is
null.  Bodies with more reads than these plans can bear run in bricks (``bricks.brick_sweep``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import Access
from ..plans.analysis import NARROW
from .grid import GridFrame

#: Cells of an axis in one window block.
BLOCK = 1 << 16
#: Reads off the axes up to which joins beat a scatter.
FEW = 2


def read_name(k: int) -> str:
    return f"_r{k}"


def choose(grid: GridFrame, loads: list[Access], exact: bool = True) -> str:
    """Window for star shapes along up to two axes, brick along three; else join for few offsets,
    scatter for a narrow body, brick beyond.

    Windows sort the grid once for each axis, a brick ships it once with its margin: on 128^3 cells
    bricks took 0.61 to 0.88 of the windows' time, on one and two axes 1.17 to 1.21.  A scatter sends each cell once for each offset and keeps a column for each read, so its cost
    follows the reads; a brick ships a cell once, and its margin.  ``exact`` tells whether NumPy
    gives the same bits as Spark for the body.
    """
    off_axis = {a.offset for a in loads if sum(o != 0 for o in a.offset) > 1}
    if not off_axis:
        axes = {x for a in loads for x, o in enumerate(a.offset) if o}
        return "brick" if exact and len(axes) > 2 else "window"
    if len({a.offset for a in loads if any(a.offset)}) <= FEW:
        return "join"
    return "brick" if exact and len(loads) > NARROW else "scatter"


def chosen(grid: GridFrame, loads: list[Access], plan: str = "auto", exact: bool = True) -> str:
    """The plan that will run."""
    return choose(grid, loads, exact) if plan == "auto" else plan


def with_reads(grid: GridFrame, loads: list[Access], plan: str) -> DataFrame:
    return {"window": _windows, "scatter": _scatter, "join": _joins}[plan](grid, loads)


def _windows(grid: GridFrame, loads: list[Access]) -> DataFrame:
    df = grid.df
    for k, a in enumerate(loads):
        if not any(a.offset):
            df = df.withColumn(read_name(k), F.col(a.field))
        elif sum(o != 0 for o in a.offset) > 1:
            raise ValueError("the window plan takes offsets along one axis at a time")
    for x, d in enumerate(grid.dims):
        own = [(k, a) for k, a in enumerate(loads) if a.offset[x]]
        if not own:
            continue
        lo, hi = grid.extents[x]
        rest = [*grid.batch, *(e for e in grid.dims if e != d)]
        reach = max(abs(a.offset[x]) for _, a in own)
        block = max(BLOCK, 4 * reach)
        blocked = hi - lo + 1 > 2 * block
        if blocked:
            df = _blocks(df, d, lo, block, reach)
            rest.append("_block")
        over = Window.partitionBy(*rest) if rest else Window.partitionBy(F.lit(0))
        over = over.orderBy(d)
        # A frame of one row: max passes its value on unchanged.
        df = df.withColumns({read_name(k): F.max(a.field).over(over.rangeBetween(a.offset[x], a.offset[x])) for k, a in own})
        if blocked:
            df = df.where(F.col("_block") == F.floor((F.col(d) - lo) / block)).drop("_block")
    return df


def _blocks(df: DataFrame, d: str, lo: int, block: int, reach: int) -> DataFrame:
    """Each row in its block, and rows within ``reach`` of an edge in the next block as well."""
    at = F.col(d) - lo
    b, inner = F.floor(at / block), F.pmod(at, F.lit(block))
    copies = F.array(b, F.when(inner < reach, b - 1), F.when(inner >= block - reach, b + 1))
    return df.withColumn("_block", F.explode(F.filter(copies, lambda x: x.isNotNull())))


def _scatter(grid: GridFrame, loads: list[Access]) -> DataFrame:
    kinds = dict(grid.df.dtypes)
    centre = tuple(0 for _ in grid.dims)
    offsets = list(dict.fromkeys([centre, *(a.offset for a in loads)]))
    need = {o: {a.field for a in loads if a.offset == o} | (set(grid.fields) if o == centre else set()) for o in offsets}
    fields = [f for f in grid.fields if any(f in n for n in need.values())]

    def sent(slot: int, offset: tuple[int, ...]) -> Column:
        where = [(F.col(d) - o).cast(kinds[d]).alias(d) for d, o in zip(grid.dims, offset, strict=True)]
        what = [(F.col(f) if f in need[offset] else F.lit(None).cast(kinds[f])).alias(f) for f in fields]
        return F.struct(F.lit(slot).alias("_slot"), *where, *what)

    rows = grid.df.select(*grid.batch, F.explode(F.array(*[sent(s, o) for s, o in enumerate(offsets)])).alias("_m"))
    rows = rows.select(*grid.batch, "_m.*")
    for d, (lo, hi) in zip(grid.dims, grid.extents, strict=True):
        rows = rows.where(F.col(d).between(lo, hi))
    slot = {o: s for s, o in enumerate(offsets)}

    def picked(f: str, o: tuple[int, ...]) -> Column:
        return F.max(F.when(F.col("_slot") == slot[o], F.col(f)))

    out = rows.groupBy(*grid.keys).agg(
        F.max(F.when(F.col("_slot") == 0, F.lit(1))).alias("_here"),
        *[picked(f, centre).alias(f) for f in grid.fields],
        *[picked(a.field, a.offset).alias(read_name(k)) for k, a in enumerate(loads)],
    )
    return out.where("_here = 1").drop("_here")


def _joins(grid: GridFrame, loads: list[Access]) -> DataFrame:
    df = grid.df
    kinds = dict(grid.df.dtypes)
    for offset in dict.fromkeys(a.offset for a in loads):
        own = [(k, a) for k, a in enumerate(loads) if a.offset == offset]
        if not any(offset):
            df = df.withColumns({read_name(k): F.col(a.field) for k, a in own})
            continue
        other = grid.df.select(
            *grid.batch,
            *[(F.col(d) - o).cast(kinds[d]).alias(d) for d, o in zip(grid.dims, offset, strict=True)],
            *[F.col(a.field).alias(read_name(k)) for k, a in own],
        )
        df = df.join(other, list(grid.keys), "left")
    return df
