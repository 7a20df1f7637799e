"""Grids in cell form: one row per cell, with index columns and value columns."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridFrame:
    """``df`` holds ``batch`` (which grid), ``dims`` (where) and ``fields`` (what).

    ``bounds`` gives each axis's first and last index, halo included; without it one small
    aggregate finds them.  Cells may be missing: coordinates alone decide what is interior.  A cell
    stands once: the plans differ on repeated cells, so a table that may hold some goes through
    ``unique`` (one row of each cell) or ``checked`` (an error) first.
    """

    df: DataFrame
    dims: tuple[str, ...]
    fields: tuple[str, ...]
    batch: tuple[str, ...] = ()
    bounds: tuple[tuple[int, int], ...] | None = None

    def __post_init__(self):
        object.__setattr__(self, "df", self.df.select(*self.batch, *self.dims, *self.fields))
        kinds = dict(self.df.dtypes)
        for d in self.dims:
            if kinds[d] not in ("tinyint", "smallint", "int", "bigint"):
                raise TypeError(f"index column {d} is {kinds[d]}, not an integer")
        for f in self.fields:
            if kinds[f] not in ("double", "float"):
                raise TypeError(f"value column {f} is {kinds[f]}, not float or double")

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.batch, *self.dims)

    @cached_property
    def extents(self) -> tuple[tuple[int, int], ...]:
        if self.bounds is not None:
            return self.bounds
        r = self.df.agg(*[f(d).alias(f"{n}{d}") for d in self.dims for n, f in (("a", F.min), ("z", F.max))]).first()
        return tuple((r[f"a{d}"], r[f"z{d}"]) if r[f"a{d}"] is not None else (0, -1) for d in self.dims)

    def with_df(self, df: DataFrame, fields: tuple[str, ...] | None = None) -> GridFrame:
        return replace(self, df=df, fields=fields or self.fields, bounds=self.extents)

    def unique(self, how: str = "max") -> GridFrame:
        """One row for each cell; repeated cells are reduced by ``min``, ``max`` or ``sum`` of each field.

        Nulls give way to values; sums are over few rows in no fixed order.
        """
        if how not in ("min", "max", "sum"):
            raise ValueError(f"{how!r} is not one of min, max, sum")
        kinds = dict(self.df.dtypes)
        reduced = [getattr(F, how)(f).cast(kinds[f]).alias(f) for f in self.fields]
        return self.with_df(self.df.groupBy(*self.keys).agg(*reduced))

    def checked(self) -> GridFrame:
        """The grid itself; raises if some cell stands more than once (one aggregation finds out)."""
        found = self.df.groupBy(*self.keys).count().where("count > 1").first()
        if found is not None:
            raise ValueError(f"cell {tuple(found[k] for k in self.keys)} stands {found['count']} times")
        return self

    def view(self, name: str) -> GridFrame:
        """The grid itself, registered as a view for SQL."""
        self.df.createOrReplaceTempView(name)
        return self

    def interior(self, halo: tuple[int, ...]) -> Column:
        """True where every read within ``halo`` stays inside the extents."""
        tests = [
            (F.col(d) >= lo + h) & (F.col(d) <= hi - h)
            for d, h, (lo, hi) in zip(self.dims, halo, self.extents, strict=True)
            if h
        ]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def restricted(self, box: dict[str, tuple[int, int]], halo: tuple[int, ...]) -> GridFrame:
        """Only the cells that a sweep over ``box`` reads: the box widened by the halo.

        The filter is on index columns, so it reaches the scan; the extents stay the grid's own.
        """
        df = self.df
        for d, h in zip(self.dims, halo, strict=True):
            if d in box:
                df = df.where((F.col(d) >= box[d][0] - h) & (F.col(d) <= box[d][1] + h))
        return self.with_df(df)

    def densify(self, fill: float = 0.0) -> GridFrame:
        """Every cell of the extents, for each batch, with ``fill`` where there was none.

        The missing cells come from sequences, not from a join of tables; the shuffle is one
        equi-join on the cell keys.
        """
        cells = self.df.select(*self.batch).distinct() if self.batch else self.df.sparkSession.range(1).select()
        for d, (lo, hi) in zip(self.dims, self.extents, strict=True):
            kind = dict(self.df.dtypes)[d]
            seq = F.sequence(F.lit(lo), F.lit(hi)) if hi >= lo else F.array().cast("array<bigint>")
            cells = cells.withColumn(d, F.explode(seq.cast(f"array<{kind}>")))
        out = cells.join(self.df, list(self.keys), "left")
        kinds = dict(self.df.dtypes)
        return self.with_df(out.select(*self.keys, *[F.coalesce(F.col(f), F.lit(fill).cast(kinds[f])).alias(f) for f in self.fields]))
