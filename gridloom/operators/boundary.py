"""Boundary conditions: what the halo cells hold.

Axes are treated in ascending order, low side then high, each over the full cross-section, so a
corner's value composes: what an axis writes is what the axes before it have left in the cell that
it reads.  Seen from a halo cell, that is a walk from the highest axis down.  On each axis whose
halo holds the cell, a Dirichlet side ends the walk with its value, and any other side moves on to
the cell that it reads.  The cell at the end of the walk gives the value.

Grids may have gaps, and rows are neither made nor dropped.  A cell that is missing has no value to
pass on, so a walk that meets one, at its end or on its way, gives null.

The walks of all halo cells go together: one equi-join of the halo cells with the cells near the
boundary for the values, and one more for each axis with corners below it, which asks only whether
a cell is there.  The interior is untouched.  Where all sides are Dirichlet, nothing is joined.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grid import GridFrame

KINDS = ("dirichlet", "neumann", "periodic", "reflecting")


@dataclass(frozen=True)
class Side:
    kind: str
    value: float = 0.0

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"boundary kind {self.kind!r} is not one of {KINDS}")


def _side(spec: Any) -> Side | None:
    if spec is None or isinstance(spec, Side):
        return spec
    if isinstance(spec, str):
        return Side(spec)
    kind, value = spec
    return Side(getattr(kind, "value", kind), float(value or 0.0))


@dataclass(frozen=True)
class BoundarySpec:
    """For each axis a (low, high) pair of sides, or None to leave it as it is."""

    sides: tuple[tuple[Side | None, Side | None] | None, ...]

    @classmethod
    def of(cls, spec: Any, ndim: int) -> BoundarySpec:
        """From a kind, a (kind, value), a mapping of axis to a side or a pair, or a BoundarySpec."""
        if isinstance(spec, BoundarySpec):
            return spec
        if isinstance(spec, Mapping):
            pairs = []
            for axis in range(ndim):
                own = spec.get(axis)
                two = isinstance(own, tuple | list) and len(own) == 2 and not isinstance(own[1], int | float)
                pairs.append(None if own is None else (_side(own[0]), _side(own[1])) if two else (_side(own), _side(own)))
            return cls(tuple(pairs))
        return cls(((_side(spec), _side(spec)),) * ndim)

    @classmethod
    def uniform(cls, kind: str, ndim: int, value: float = 0.0) -> BoundarySpec:
        return cls(((Side(kind, value), Side(kind, value)),) * ndim)

    @classmethod
    def periodic(cls, ndim: int) -> BoundarySpec:
        return cls.uniform("periodic", ndim)

    @classmethod
    def dirichlet(cls, ndim: int, value: float = 0.0) -> BoundarySpec:
        return cls.uniform("dirichlet", ndim, value)

    @classmethod
    def neumann(cls, ndim: int) -> BoundarySpec:
        return cls.uniform("neumann", ndim)

    @classmethod
    def reflecting(cls, ndim: int) -> BoundarySpec:
        return cls.uniform("reflecting", ndim)


def _source(side: Side, high: bool, at: Column, lo: int, hi: int, h: int) -> Column:
    """The coordinate that a halo cell of one side reads."""
    if side.kind == "neumann":
        return F.lit(hi - h if high else lo + h)
    if side.kind == "periodic":
        n = hi - lo + 1 - 2 * h
        return at - n if high else at + n
    if side.kind == "reflecting":  # edge-inclusive mirror
        return 2 * (hi - h) + 1 - at if high else 2 * (lo + h) - 1 - at
    return at


def _fixed(grid: GridFrame, axes: list[tuple[str, list[tuple[Side, bool, int, int, int]]]]) -> GridFrame:
    """The grid where all sides have values: the highest axis whose halo holds a cell decides, and no cell is read."""
    kinds = dict(grid.df.dtypes)

    def value(f: str) -> Column:
        out = F.when(F.lit(False), F.col(f))
        for d, sides in reversed(axes):
            # Of a cell in both halos of an axis the low side is met first on the walk.
            for side, high, lo, hi, h in sides:
                out = out.when(F.col(d) > hi - h if high else F.col(d) < lo + h, F.lit(side.value).cast(kinds[f]))
        return out.otherwise(F.col(f)).alias(f)

    return grid.with_df(grid.df.select(*grid.keys, *[value(f) for f in grid.fields]))


def apply_boundary(grid: GridFrame, spec: Any, halo: tuple[int, ...]) -> GridFrame:
    """The grid with its halo cells filled; a halo of 0 leaves an axis alone.

    Raises where an axis has fewer interior cells than its halo: its sources would be halo cells.
    A walk over a missing cell gives null.
    """
    spec = BoundarySpec.of(spec, len(grid.dims))
    kinds = dict(grid.df.dtypes)
    axes: list[tuple[str, list[tuple[Side, bool, int, int, int]]]] = []
    in_halo, near = F.lit(False), F.lit(False)
    for d, h, (lo, hi), pair in zip(grid.dims, halo, grid.extents, spec.sides, strict=True):
        if not h or pair is None or pair == (None, None):
            continue
        if hi - lo + 1 - 2 * h < h:
            raise ValueError(f"axis {d} has fewer interior cells than its halo of {h}")
        axes.append((d, [(side, bool(high), lo, hi, h) for high, side in enumerate(pair) if side is not None]))
        for _, high, *_ in axes[-1][1]:
            in_halo = in_halo | (F.col(d) > hi - h if high else F.col(d) < lo + h)
        near = near | (F.col(d) < lo + 2 * h) | (F.col(d) > hi - 2 * h)

    def inside(d: str, high: bool, lo: int, hi: int, h: int) -> Column:
        return F.col(f"_{d}") > hi - h if high else F.col(f"_{d}") < lo + h

    if all(side.kind == "dirichlet" for _, sides in axes for side, *_ in sides):
        return _fixed(grid, axes)
    here = [F.col(d).alias(f"_{d}") for d in grid.dims]
    at = [*grid.batch, *[f"_{d}" for d in grid.dims]]
    edge = grid.df.where(in_halo).select(*grid.keys, *here, F.lit(None).cast("double").alias("_fixed"), F.lit(False).alias("_lost"))
    for n in range(len(axes) - 1, -1, -1):
        d, sides = axes[n]
        fixed, moved, to = F.col("_fixed"), F.lit(False), F.col(f"_{d}")
        for side, *where in sides:
            open_ = F.col("_fixed").isNull() & inside(d, *where)
            if side.kind == "dirichlet":
                fixed = F.when(open_, F.lit(side.value)).otherwise(fixed)
            else:
                moved, to = moved | open_, F.when(open_, _source(side, where[0], F.col(f"_{d}"), *where[1:])).otherwise(to)
        edge = edge.withColumns({"_fixed": fixed, "_moved": moved, f"_{d}": to.cast(kinds[d])})
        if n and any(side.kind != "dirichlet" for side, *_ in sides):
            corner = F.lit(False)
            for e, others in axes[:n]:
                for _, *where in others:
                    corner = corner | inside(e, *where)
            there = grid.df.where(near).select(*grid.batch, *here, F.lit(True).alias("_there"))
            edge = edge.join(there, at, "left").withColumn("_lost", F.col("_lost") | (F.col("_moved") & corner & F.col("_there").isNull())).drop("_there")
    source = grid.df.where(near).select(*grid.batch, *here, *[F.col(f).alias(f"_v_{f}") for f in grid.fields])
    joined = edge.join(source, at, "left")

    def value(f: str) -> Column:
        found = F.when(F.col("_fixed").isNotNull(), F.col("_fixed").cast(kinds[f])).otherwise(F.col(f"_v_{f}"))
        return F.when(~F.col("_lost"), found).alias(f)

    filled = joined.select(*grid.keys, *[value(f) for f in grid.fields])
    return grid.with_df(grid.df.where(~in_halo).unionByName(filled))
