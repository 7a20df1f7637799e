"""Domain decomposition along one axis: parts with halos, their exchange, and diagnostics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frontend import Stencil, halo_of
from ..plans.lineage import cut
from .exact import exact_sums
from .grid import GridFrame


def chunks(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """``n`` contiguous ranges over [lo, hi]; the remainder goes to the first ones."""
    size, extra = divmod(hi - lo + 1, n)
    out, at = [], lo
    for p in range(n):
        width = size + (p < extra)
        out.append((at, at + width - 1))
        at += width
    return out


def _part_of(at: Column, ranges: list[tuple[int, int]]) -> Column:
    """The part that owns a coordinate, by arithmetic: parts have one of two widths."""
    wide = ranges[0][1] - ranges[0][0] + 1
    n_wide = sum(b - a + 1 == wide for a, b in ranges)
    split = ranges[0][0] + n_wide * wide
    lo = ranges[0][0]
    first = F.floor((at - lo) / wide)
    if n_wide == len(ranges):
        return first.cast("int")
    return F.when(at < split, first).otherwise(n_wide + F.floor((at - split) / (wide - 1))).cast("int")


def _ranges(grid: GridFrame, n: int, axis: int, halo: int) -> list[tuple[int, int]]:
    """The parts' own ranges; raises if one would be thinner than the halo."""
    lo, hi = grid.extents[axis]
    ranges = chunks(lo + halo, hi - halo, n)
    if min(b - a + 1 for a, b in ranges) < max(1, halo):
        raise ValueError("a part would be thinner than the halo")
    return ranges


def _own(grid: GridFrame, ranges: list[tuple[int, int]], axis: int) -> Column:
    """The part that a cell belongs to; the outer halo goes with the nearest part."""
    inner = F.least(F.greatest(F.col(grid.dims[axis]), F.lit(ranges[0][0])), F.lit(ranges[-1][1]))
    return _part_of(inner.cast("long"), ranges)


def _near_ends(grid: GridFrame, ranges: list[tuple[int, int]], axis: int, halo: int, own: Column) -> tuple[Column, Column]:
    """Whether a cell lies within ``halo`` of its range's start, and of its end."""
    d = F.col(grid.dims[axis])
    starts, ends = F.array(*[F.lit(a) for a, _ in ranges]), F.array(*[F.lit(b) for _, b in ranges])
    return d - F.get(starts, own) < halo, F.get(ends, own) - d < halo


def _inside(grid: GridFrame, axis: int, halo: int) -> Column:
    lo, hi = grid.extents[axis]
    return F.col(grid.dims[axis]).between(lo + halo, hi - halo)


def decompose(grid: GridFrame, n: int, axis: int = 0, halo: int = 1) -> DataFrame:
    """Cells with ``part`` and ``owned``; the interior of the axis is dealt out, and each part also
    holds the ``halo`` layers on both sides of its own range."""
    ranges = _ranges(grid, n, axis, halo)
    own = _own(grid, ranges, axis)
    first, last = _near_ends(grid, ranges, axis, halo, own)
    inside = _inside(grid, axis, halo)
    before, after = F.when((own > 0) & first, own - 1), F.when((own < n - 1) & last, own + 1)
    parts = F.filter(F.array(own, F.when(inside, before), F.when(inside, after)), lambda x: x.isNotNull())
    out = grid.df.withColumn("part", F.explode(parts))
    return out.withColumn("owned", inside & (F.col("part") == own)).select("part", *grid.keys, *grid.fields, "owned")


def exchange_halos(parts: DataFrame, grid: GridFrame, axis: int = 0, halo: int = 1, n: int | None = None) -> DataFrame:
    """Each part's copies of neighbour cells, taken anew from the parts that own them.

    Only owned cells within ``halo`` of a range's end travel, and meet the copies in one equi-join;
    the parts' own cells stay where they are.  ``n``, the number of parts, is counted unless given.
    """
    if n is None:
        n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    keys, inside = list(grid.keys), _inside(grid, axis, halo)
    own = _own(grid, _ranges(grid, n, axis, halo), axis)
    first, last = _near_ends(grid, _ranges(grid, n, axis, halo), axis, halo, own)
    copies = parts.where(~F.col("owned") & inside).select("part", *keys)
    kept = parts.where(F.col("owned") | ~inside)
    owners = parts.where(F.col("owned") & (first | last)).select(*keys, *grid.fields)
    fresh = copies.join(owners, keys).withColumn("owned", F.lit(False))
    return kept.unionByName(fresh.select("part", *keys, *grid.fields, "owned"))


def march_parts(grid: GridFrame, update: Mapping[str, Stencil], steps: int, n: int, axis: int = 0, halo: int | None = None) -> GridFrame:
    """``steps`` sweeps over a grid in ``n`` parts: each part sweeps its own cells, then the halos
    are exchanged; at the end the parts are gathered.  The same result as ``march`` without a
    boundary condition.

    ``update``: fields to stencils that all read the old state.  ``halo``: the layers that a part
    holds of its neighbours, the stencils' own halo on the axis unless given.
    """
    from .sweep import fused

    width = halo_of([s.body for s in update.values()], len(grid.dims))[axis]
    halo = max(1, width) if halo is None else halo
    if halo < width:
        raise ValueError(f"a halo of {halo} is thinner than the stencils' {width}")
    ranges, inside = _ranges(grid, n, axis, halo), _inside(grid, axis, halo)
    parts = cut(decompose(grid, n, axis, halo))
    for step in range(1, steps + 1):
        # Copies of neighbour cells lack some neighbours of their own; the exchange makes them anew.
        own = GridFrame(parts, grid.dims, grid.fields, ("part", *grid.batch), grid.extents)
        swept = fused(own, update, keep_fields=True).df.select("part", *grid.keys, *grid.fields)
        swept = cut(swept.withColumn("owned", inside & (F.col("part") == _own(grid, ranges, axis))))
        parts = swept if step == steps else cut(exchange_halos(swept, grid, axis, halo, n))
    return gather(parts, grid, axis, halo)


def gather(parts: DataFrame, grid: GridFrame, axis: int = 0, halo: int = 1) -> GridFrame:
    """The grid again: owned cells and the outer halo."""
    inside = _inside(grid, axis, halo)
    return grid.with_df(parts.where(F.col("owned") | ~inside).select(*grid.keys, *grid.fields))


def diagnostics(grid: GridFrame, field: str | None = None) -> DataFrame:
    """Mass, energy, extrema and counts of a field, per batch; the sums are exact and rounded once, so
    they do not depend on how the rows are partitioned."""
    u = F.col(field or grid.fields[0])
    keys = list(grid.batch)
    others = grid.df.groupBy(*keys).agg(
        F.max(F.abs(u)).alias("max_abs"),
        F.min(u).alias("least"),
        F.max(u).alias("most"),
        F.count(u).alias("n_cells"),
        F.count(F.when(u.isNull(), 1)).alias("n_null"),
    )
    # A sum of zeros has no digits: without batches an empty grid still gives its one row.
    sums = exact_sums(grid.df, keys, {"mass": u, "energy": u * u})
    out = others.join(sums, keys) if keys else others.join(F.broadcast(sums), how="left")
    return out.select(*keys, F.coalesce("mass", F.lit(0.0)).alias("mass"), F.coalesce("energy", F.lit(0.0)).alias("energy"), "max_abs", "least", "most", "n_cells", "n_null")


def max_difference(a: GridFrame, b: GridFrame, field: str | None = None) -> DataFrame:
    """One row: the largest absolute difference of a field, and the cells that only one side has."""
    f = field or a.fields[0]
    left = a.df.select(*a.keys, F.col(f).alias("_a"), F.lit(1).alias("_ha"))
    right = b.df.select(*b.keys, F.col(f).alias("_b"), F.lit(1).alias("_hb"))
    both = left.join(right, list(a.keys), "full_outer")
    return both.agg(
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"),
        F.count(F.when(F.col("_ha").isNull() | F.col("_hb").isNull(), 1)).alias("n_unmatched"),
    )
