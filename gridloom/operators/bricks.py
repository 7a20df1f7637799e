"""Bricks: blocks of a grid as dense arrays, and sweeps that run inside them with NumPy.

A sweep ships each block's cells with a margin of ``steps`` halos copied from its neighbours, so one
shuffle serves several sweeps.  Values and presence travel apart: NaN is a value.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Access, accesses, evaluate
from ..functions.frontend import Stencil
from .grid import GridFrame

#: Cells per axis of a block, by number of dimensions.
SIDES = {1: 1 << 16, 2: 256, 3: 48}


def block_names(grid: GridFrame) -> list[str]:
    return [f"_b{x}" for x in range(len(grid.dims))]


def sides_of(grid: GridFrame, side: int) -> tuple[int, ...]:
    """The cells of a block along each axis: ``side``, or the whole axis if that is shorter."""
    return tuple(max(1, min(side, hi - lo + 1)) for lo, hi in grid.extents)


def with_blocks(df: DataFrame, grid: GridFrame, side: int, reach: tuple[int, ...]) -> DataFrame:
    """Rows with the block (``_b0`` ...) that owns them, or each block of the grid within ``reach``."""
    for x, (d, r, side) in enumerate(zip(grid.dims, reach, sides_of(grid, side), strict=True)):
        lo, hi = grid.extents[x]
        at = F.col(d).cast("long") - lo
        if r:
            df = df.withColumn(f"_b{x}", F.explode(F.sequence(F.floor((at - r) / side), F.floor((at + r) / side))))
            df = df.where(F.col(f"_b{x}").between(0, (hi - lo) // side))
        else:
            df = df.withColumn(f"_b{x}", F.floor(at / side))
    return df


def brick_sweep(
    grid: GridFrame, outputs: Mapping[str, Stencil], width: tuple[int, ...], halo: str = "keep",
    steps: int = 1, side: int | None = None, keep_fields: bool = False, blocks: DataFrame | None = None,
) -> DataFrame:
    """``steps`` sweeps (more than one only if the outputs are the fields they read).

    ``blocks`` (batch, ``_b0`` ...) names the blocks that are computed, else all are.
    """
    side = max(side or SIDES[len(grid.dims)], 2 * steps * max((*width, 1)))
    names = block_names(grid)
    copied = with_blocks(grid.df, grid, side, tuple(steps * w for w in width))
    if blocks is not None:
        copied = copied.join(blocks, [*grid.batch, *names], "left_semi")
    kinds = dict(grid.df.dtypes)
    kept = [f for f in grid.fields if f not in outputs] if keep_fields else []
    schema = ", ".join(
        [f"`{k}` {kinds[k]}" for k in grid.keys] + [f"`{f}` {kinds[f]}" for f in kept] + [f"`{n}` {s.dtype}" for n, s in outputs.items()]
    )
    run = block_function(grid, {n: s.plain() for n, s in outputs.items()}, width, halo, steps, side, kept)
    return copied.groupBy(*grid.batch, *names).applyInArrow(run, schema)


def block_function(
    grid: GridFrame, outputs: Mapping[str, Stencil], width: tuple[int, ...], halo: str = "keep", steps: int = 1, side: int = 1, kept: Sequence[str] = (),
) -> Callable[[tuple, pa.Table], pa.Table]:
    """What sweeps one block: from its key (batch and place) and its cells with their margin to its own cells."""
    sides = sides_of(grid, side)
    reach = tuple(steps * w for w in width)
    dims, keys, n_dims = grid.dims, grid.keys, len(grid.dims)
    kinds = dict(grid.df.dtypes)
    extents, batch, fields = grid.extents, grid.batch, grid.fields  # the closure takes no frame along

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first = [extents[x][0] + key[len(batch) + x].as_py() * sides[x] for x in range(n_dims)]
        low = [f - r for f, r in zip(first, reach, strict=True)]
        shape = tuple(s + 2 * r for s, r in zip(sides, reach, strict=True))
        at = tuple(table.column(d).to_numpy().astype(np.int64) - lo for d, lo in zip(dims, low, strict=True))
        here = np.zeros(shape, bool)
        here[at] = True
        values, known = {}, {}
        for f in fields:
            column = table.column(f).combine_chunks()
            dtype = np.float64 if kinds[f] == "double" else np.float32
            ok = np.asarray(column.is_valid())
            values[f], known[f] = np.zeros(shape, dtype), np.zeros(shape, bool)
            values[f][at] = np.asarray(column.fill_null(0.0), dtype)
            known[f][at] = ok
        inside = np.ones(shape, bool)
        for x, (lo, hi) in enumerate(extents):
            index = np.arange(shape[x]) + low[x]
            line = (index >= lo + width[x]) & (index <= hi - width[x])
            inside &= line.reshape([-1 if y == x else 1 for y in range(n_dims)])

        def shifted(array: np.ndarray, offset: tuple[int, ...], empty: float) -> np.ndarray:
            if not any(offset):
                return array
            out = np.full_like(array, empty)
            pairs = list(zip(offset, shape, strict=True))  # an offset may be longer than a short axis
            to = tuple(slice(max(0, min(n, -o)), max(0, n - max(0, o))) for o, n in pairs)
            of = tuple(slice(max(0, min(n, o)), max(0, n - max(0, -o))) for o, n in pairs)
            out[to] = array[of]
            return out

        results: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for _ in range(steps):
            now = {}
            for name, s in outputs.items():
                dtype = np.float64 if s.dtype == "double" else np.float32

                def read(a: Access) -> np.ndarray:
                    return shifted(values[a.field], a.offset, 0.0)

                def coordinate(x: int) -> np.ndarray:
                    index = (np.arange(shape[x]) + low[x]).astype(float)
                    return index.reshape([-1 if y == x else 1 for y in range(n_dims)])

                body = np.broadcast_to(np.asarray(evaluate(_typed(s), read, coordinate), dtype), shape)
                good = np.ones(shape, bool)
                for a in accesses(s.body):
                    good &= shifted(known[a.field], a.offset, False)
                edge = (values[s.fields[0]], known[s.fields[0]]) if halo != "zero" else (np.zeros(shape, dtype), here)
                now[name] = (np.where(inside, body, edge[0]).astype(dtype), np.where(inside, good, edge[1]) & here)
            results = now
            for name, (v, k) in now.items():
                if name in values:
                    values[name], known[name] = v, k
        own = np.ones(len(at[0]), bool)
        for x in range(n_dims):
            own &= (at[x] >= reach[x]) & (at[x] < reach[x] + sides[x])
        if halo == "drop":
            own &= inside[at]
        where = tuple(a[own] for a in at)
        mask = pa.array(own)
        columns = [table.column(k).filter(mask) for k in (*keys, *kept)]
        for v, k in results.values():
            columns.append(pa.array(v[where], mask=~k[where]))
        return pa.table(columns, names=[*keys, *kept, *results])

    return run


def _typed(s: Stencil):
    """The body with constants of the stencil's own width."""
    if s.dtype == "double":
        return s.body
    from ..functions.expr import Const, rebuild

    return rebuild(s.body, lambda n: Const(np.float32(n.value)) if isinstance(n, Const) else n)


def to_bricks(grid: GridFrame, side: int, field: str | None = None) -> DataFrame:
    """One row per brick: ``b_<dim>`` and ``data``, row-major, 0 where there is no cell."""
    field = field or grid.fields[0]
    n = len(grid.dims)
    at = [F.col(d).cast("long") - lo for d, (lo, _) in zip(grid.dims, grid.extents, strict=True)]
    slot: Column = F.lit(0)
    for a in at:
        slot = slot * side + F.pmod(a, F.lit(side))
    bricks = [F.floor(a / side).alias(f"b_{d}") for d, a in zip(grid.dims, at, strict=True)]
    cells = grid.df.select(*grid.batch, *bricks, slot.cast("int").alias("_s"), F.col(field).alias("_v"))
    names = [*grid.batch, *[f"b_{d}" for d in grid.dims]]
    kinds = dict(cells.dtypes)
    dtype = np.float64 if kinds["_v"] == "double" else np.float32

    def run(table: pa.Table) -> pa.Table:  # side^n cells at most: a brick is bounded by its own size
        data = np.zeros(side**n, dtype)
        data[table.column("_s").to_numpy()] = np.asarray(table.column("_v").combine_chunks().fill_null(0.0), dtype)
        return pa.table([*[table.column(k).slice(0, 1) for k in names], pa.array([data])], names=[*names, "data"])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in names] + [f"data array<{kinds['_v']}>"])
    return cells.groupBy(*names).applyInArrow(run, schema)


def from_bricks(bricks: DataFrame, like: GridFrame, side: int, field: str | None = None) -> GridFrame:
    """Cells within the extents of ``like`` again."""
    field = field or like.fields[0]
    rows = bricks.select(*like.batch, *[f"b_{d}" for d in like.dims], F.posexplode("data").alias("_s", "_v"))
    kinds = dict(like.df.dtypes)
    out, n = [], len(like.dims)
    for x, (d, (lo, hi)) in enumerate(zip(like.dims, like.extents, strict=True)):
        inner = F.pmod(F.floor(F.col("_s") / side ** (n - 1 - x)), F.lit(side))
        out.append((F.col(f"b_{d}") * side + inner + lo).cast(kinds[d]).alias(d))
    cells = rows.select(*like.batch, *out, F.col("_v").alias(field))
    for d, (_, hi) in zip(like.dims, like.extents, strict=True):
        cells = cells.where(F.col(d) <= hi)
    return like.with_df(cells, (field,))


__all__ = ["block_function", "block_names", "brick_sweep", "from_bricks", "sides_of", "to_bricks", "with_blocks"]
