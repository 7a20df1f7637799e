"""Sweeps after few changes: only the blocks that a change can reach are computed again."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frontend import Stencil
from ..plans.analysis import check_fusable
from .bricks import block_names, brick_sweep, sides_of, with_blocks
from .grid import GridFrame
from .sweep import renamed_to


def reach_of(update: Mapping[str, Stencil], steps: int) -> tuple[int, ...]:
    """How far a change spreads in some sweeps, per axis."""
    return tuple(steps * w for w in check_fusable([renamed_to(n, s) for n, s in update.items()]))


def touched_blocks(changed: DataFrame, grid: GridFrame, update: Mapping[str, Stencil], steps: int, side: int) -> DataFrame:
    """Blocks (batch, ``_b0`` ...) that hold a cell whose value after ``steps`` sweeps may differ.

    ``changed`` has the keys of the cells that differ; cells outside the extents touch what they reach.
    """
    blocks = with_blocks(changed.select(*grid.keys), grid, side, reach_of(update, steps))
    return blocks.select(*grid.batch, *block_names(grid)).distinct()


def dense_blocks(grid: GridFrame, blocks: DataFrame, side: int, fill: float = 0.0) -> GridFrame:
    """Every cell of some blocks and of those beside them, with ``fill`` where the grid has none."""
    near, names, kinds = blocks, block_names(grid), dict(grid.df.dtypes)
    for b in names:
        near = near.withColumn("_by", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(b, F.col(b) + F.col("_by")).drop("_by")
    near = near.distinct()
    for b, d, s, (lo, hi) in zip(names, grid.dims, sides_of(grid, side), grid.extents, strict=True):
        first = F.col(b) * s + lo
        cells = F.sequence(first, first + (s - 1)).cast(f"array<{kinds[d]}>")
        near = near.withColumn(d, F.explode(cells)).where(F.col(d).between(lo, hi))
    full = near.select(*grid.keys).join(grid.df, list(grid.keys), "left")
    return grid.with_df(full.select(*grid.keys, *[F.coalesce(F.col(f), F.lit(fill).cast(kinds[f])).alias(f) for f in grid.fields]))


def swept_blocks(grid: GridFrame, update: Mapping[str, Stencil], steps: int, blocks: DataFrame, side: int) -> DataFrame:
    """The cells of some blocks after ``steps`` sweeps, with the blocks' columns.

    Only cells within reach of these blocks are shuffled.
    """
    width = check_fusable([renamed_to(n, s) for n, s in update.items()])
    if side < 2 * steps * max((*width, 1)):
        raise ValueError(f"blocks of {side} cells are too small for {steps} sweeps of a halo of {max(width)}")
    swept = brick_sweep(grid, update, width, steps=steps, side=side, keep_fields=True, blocks=blocks)
    return with_blocks(swept, grid, side, (0,) * len(grid.dims))


def resweep(before: DataFrame, grid: GridFrame, changed: DataFrame, update: Mapping[str, Stencil], steps: int, side: int) -> GridFrame:
    """The grid after ``steps`` sweeps, from the result ``before`` the changes and the cells that ``changed``.

    ``grid`` is the state with the changes (new cells among them); cells that it has lost go.
    """
    blocks = touched_blocks(changed, grid, update, steps, side)
    fresh = swept_blocks(grid, update, steps, blocks, side)
    names = block_names(grid)
    kept = with_blocks(before, grid, side, (0,) * len(grid.dims)).join(blocks, [*grid.batch, *names], "left_anti")
    columns = [c for c in fresh.columns if c not in names]
    return grid.with_df(kept.select(*columns).unionByName(fresh.select(*columns)), tuple(c for c in columns if c not in grid.keys))


__all__ = ["dense_blocks", "reach_of", "resweep", "swept_blocks", "touched_blocks"]
