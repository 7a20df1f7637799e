"""A grid that stays in bricks from step to step, whose neighbours exchange only their faces.

A brick is a row: its place, and its cells as packed arrays.  Bricks are stored bucketed by their
place.  An exchange reads them, cuts the slabs that other bricks need, and shuffles those slabs
alone; the bricks meet them where they are, bucket by bucket.  One exchange serves several sweeps:
a brick is widened by as many halos.

Boundary conditions are made inside the widened brick after each sweep.  A side that is no periodic
one has its sources near by, so the margin is wider by two halos less one.  A periodic axis is
continued: beyond its interior the margin holds the cells from the other end, which change as those
do.  The halo that a grid starts with may differ from its boundary condition, so with periodic axes
the first sweep has an exchange to itself.

Each brick may also measure itself after each sweep: mass and energy as digits of an exact sum, and
the largest change.  These columns are read on their own, without the cells.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, replace
from itertools import product
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Access, accesses, evaluate
from ..functions.frontend import Stencil
from ..plans.analysis import check_fusable, temporal_depth
from ..plans.lineage import remove, shared_dir
from .boundary import BoundarySpec
from .bricks import SIDES, _typed
from .exact import PARTS, digits_of, rounded, summed
from .grid import GridFrame
from .sweep import renamed_to

#: Bytes of a brick and its copy, widened for several sweeps.
BRICK_BYTES = 64 << 20


@dataclass(frozen=True)
class Layout:
    """What a worker needs to know of the grid."""

    dims: tuple[str, ...]
    fields: tuple[str, ...]
    batch: tuple[str, ...]
    extents: tuple[tuple[int, int], ...]
    kinds: Mapping[str, str]
    sides: tuple[int, ...]

    @property
    def keys(self) -> list[str]:
        return [*self.batch, *[f"b_{d}" for d in self.dims]]

    @property
    def counts(self) -> list[int]:
        """Bricks along each axis."""
        return [-(-(hi - lo + 1) // s) for (lo, hi), s in zip(self.extents, self.sides, strict=True)]

    def dtype(self, f: str) -> type:
        return np.float64 if self.kinds[f] == "double" else np.float32

    def schema(self, measured: bool) -> str:
        cells = [f"`{k}` {self.kinds[k] if k in self.batch else 'bigint'}" for k in self.keys]
        cells += ["here binary", *[f"`{f}` binary, `known_{f}` binary" for f in self.fields]]
        return ", ".join([*cells, *([f"measured {MEASURED}"] if measured else [])])

    def span(self, axis: int, brick: int, reach: int) -> np.ndarray:
        """The coordinates of a widened brick along an axis."""
        lo = self.extents[axis][0] + brick * self.sides[axis] - reach
        return np.arange(lo, lo + self.sides[axis] + 2 * reach)

    def origin(self, axis: int, brick: int, reach: int, around: int | None) -> tuple[np.ndarray, np.ndarray]:
        """For each place of a widened brick the brick that its cell lies in (-1: none), and the slot there.

        ``around``: the halo of a periodic axis that is continued.
        """
        at, (lo, hi) = self.span(axis, brick, reach), self.extents[axis]
        if around is not None:
            first = lo + around
            at = np.where((at >= first) & (at <= hi - around), at, first + (at - first) % (hi - lo + 1 - 2 * around))
        inside = (at >= lo) & (at <= hi)
        return np.where(inside, (at - lo) // self.sides[axis], -1), (at - lo) % self.sides[axis]

    def readers(self, axis: int, brick: int, reach: int, around: int | None) -> list[int]:
        """Bricks along an axis that read cells of this one."""
        n = self.counts[axis]
        near = {b for b in (*range(brick - 2, brick + 3), 0, 1, n - 2, n - 1) if 0 <= b < n}
        return [b for b in sorted(near) if (self.origin(axis, b, reach, around)[0] == brick).any()]


MEASURED = f"array<struct<step:int,field:string,mass:{PARTS},energy:{PARTS},change:double,n:bigint>>"


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask.reshape(-1), bitorder="little").tobytes()


def _mask(data: bytes, shape: tuple[int, ...]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=math.prod(shape), bitorder="little").astype(bool).reshape(shape)


def _columns(layout: Layout, here: np.ndarray, values: Mapping[str, np.ndarray], known: Mapping[str, np.ndarray]) -> dict[str, bytes]:
    out = {"here": _bits(here)}
    for f in layout.fields:
        out |= {f: np.ascontiguousarray(values[f]).tobytes(), f"known_{f}": _bits(known[f])}
    return out


@dataclass(frozen=True)
class Sweeps:
    """What happens between two exchanges."""

    outputs: Mapping[str, Stencil]
    width: tuple[int, ...]
    steps: int
    first: int  # number of the first step
    spec: BoundarySpec | None
    around: tuple[int | None, ...]  # the halo of each periodic axis that is continued
    reach: tuple[int, ...]
    measure: tuple[str, ...] = ()
    bounded: tuple[str, ...] = ()  # the fields whose halo is filled


class _Block:
    """A widened brick in a task."""

    def __init__(self, layout: Layout, sweeps: Sweeps, brick: tuple[int, ...]):
        self.layout, self.sweeps, self.brick = layout, sweeps, brick
        self.spans = [layout.span(x, b, r) for x, (b, r) in enumerate(zip(brick, sweeps.reach, strict=True))]
        self.shape = tuple(len(s) for s in self.spans)
        self.origins = [layout.origin(x, b, r, a) for x, (b, r, a) in enumerate(zip(brick, sweeps.reach, sweeps.around, strict=True))]
        self.here = np.zeros(self.shape, bool)
        self.values = {f: np.zeros(self.shape, layout.dtype(f)) for f in layout.fields}
        self.known = {f: np.zeros(self.shape, bool) for f in layout.fields}
        self.own = tuple(slice(r, r + s) for r, s in zip(sweeps.reach, layout.sides, strict=True))
        self.inside = np.ones(self.shape, bool)  # where a sweep computes
        self.interior = np.ones(self.shape, bool)  # where the halo is not
        self.real = np.ones(self.shape, bool)  # where the grid is; a continued axis goes on beyond
        for x, ((lo, hi), w, a) in enumerate(zip(layout.extents, sweeps.width, sweeps.around, strict=True)):
            line = (self.spans[x] >= lo + w) & (self.spans[x] <= hi - w)
            self.interior &= self._along(line, x)
            self.real &= self._along((self.spans[x] >= lo) & (self.spans[x] <= hi), x)
            if a is None:
                self.inside &= self._along(line, x)

    def _along(self, line: np.ndarray, axis: int) -> np.ndarray:
        return line.reshape([-1 if x == axis else 1 for x in range(len(self.shape))])

    def put(self, source: tuple[int, ...], row: Mapping[str, Any], whole: bool) -> None:
        """Take over the cells of a brick, or of the slab that one has sent."""
        places = [np.flatnonzero(o[0] == s) for o, s in zip(self.origins, source, strict=True)]
        at = np.ix_(*places)
        slots = np.ix_(*[o[1][p] for o, p in zip(self.origins, places, strict=True)])
        shape = self.layout.sides if whole else tuple(len(p) for p in places)

        def taken(array: np.ndarray) -> np.ndarray:
            return array[slots] if whole else array

        self.here[at] = taken(_mask(row["here"], shape))
        for f in self.layout.fields:
            self.values[f][at] = taken(np.frombuffer(row[f], self.layout.dtype(f)).reshape(shape))
            self.known[f][at] = taken(_mask(row[f"known_{f}"], shape))

    def _shifted(self, array: np.ndarray, offset: tuple[int, ...], empty: Any) -> np.ndarray:
        if not any(offset):
            return array
        out = np.full_like(array, empty)
        pairs = list(zip(offset, self.shape, strict=True))
        to = tuple(slice(max(0, min(n, -o)), max(0, n - max(0, o))) for o, n in pairs)
        of = tuple(slice(max(0, min(n, o)), max(0, n - max(0, -o))) for o, n in pairs)
        out[to] = array[of]
        return out

    def sweep(self) -> None:
        """All outputs from the old state."""
        now = {}
        for name, s in self.sweeps.outputs.items():
            dtype = np.float64 if s.dtype == "double" else np.float32

            def read(a: Access) -> np.ndarray:
                return self._shifted(self.values[a.field], a.offset, 0.0)

            def coordinate(x: int) -> np.ndarray:
                return self._along(self.spans[x].astype(float), x)

            body = np.broadcast_to(np.asarray(evaluate(_typed(s), read, coordinate), dtype), self.shape)
            good = self.here.copy()
            for a in accesses(s.body):
                good &= self._shifted(self.known[a.field], a.offset, False)
            edge, edge_known = self.values[s.fields[0]], self.known[s.fields[0]]
            now[name] = np.where(self.inside, body, edge).astype(dtype), np.where(self.inside, good, edge_known) & self.here
        for name, (v, k) in now.items():
            self.values[name], self.known[name] = v, k

    def bound(self) -> None:
        """Fill the halo: axis by axis, low side then high, over the full cross-section."""
        for x, ((lo, hi), h, pair) in enumerate(zip(self.layout.extents, self.sweeps.width, self.sweeps.spec.sides, strict=True)):
            if not h or pair is None or self.sweeps.around[x] is not None:
                continue
            for high, side in enumerate(pair):
                if side is None or side.kind == "periodic":
                    continue
                at = np.arange(hi - h + 1, hi + 1) if high else np.arange(lo, lo + h)
                of = {
                    "dirichlet": at,
                    "neumann": np.full(h, hi - h if high else lo + h),
                    "reflecting": 2 * (hi - h) + 1 - at if high else 2 * (lo + h) - 1 - at,
                }[side.kind]
                start, n = self.spans[x][0], self.shape[x]
                some = (at >= start) & (at < start + n) & (of >= start) & (of < start + n)
                to = (slice(None),) * x + (at[some] - start,)
                src = (slice(None),) * x + (of[some] - start,)
                for f in self.sweeps.bounded:
                    if side.kind == "dirichlet":
                        self.values[f][to], self.known[f][to] = side.value, self.here[to]
                    else:
                        self.values[f][to], self.known[f][to] = self.values[f][src], self.known[f][src] & self.here[to]

    def run(self) -> dict[str, Any]:
        out: list[dict[str, Any]] = []
        for n in range(self.sweeps.steps):
            old = {f: (self.values[f], self.known[f]) for f in self.sweeps.measure}
            self.sweep()
            if self.sweeps.spec is not None:
                self.bound()
            out += [self.measured(self.sweeps.first + n, f, *old[f]) for f in self.sweeps.measure]
        own = self.own
        made = _columns(self.layout, (self.here & self.real)[own], {f: v[own] for f, v in self.values.items()}, {f: k[own] for f, k in self.known.items()})
        return made | ({"measured": out} if self.sweeps.measure else {})

    def measured(self, step: int, f: str, before: np.ndarray, was_known: np.ndarray) -> dict[str, Any]:
        some = (self.known[f] & self.interior)[self.own]
        u = self.values[f][self.own][some].astype(np.float64)
        both = some & was_known[self.own]
        with np.errstate(all="ignore"):
            change = np.abs(self.values[f][self.own][both].astype(np.float64) - before[self.own][both].astype(np.float64))
            energy = u * u
        parts = [[{"digit": d, "value": v} for d, v in digits_of(x).items()] for x in (u, energy)]
        return {"step": step, "field": f, "mass": parts[0], "energy": parts[1], "change": float(change.max()) if len(change) else None, "n": int(some.sum())}


def _pack(layout: Layout):
    """Cells of a brick to its row."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        place = [k.as_py() for k in key]
        n = len(layout.batch)
        first = [lo + b * s for (lo, _), b, s in zip(layout.extents, place[n:], layout.sides, strict=True)]
        at = tuple(table.column(d).to_numpy().astype(np.int64) - f for d, f in zip(layout.dims, first, strict=True))
        here = np.zeros(layout.sides, bool)
        here[at] = True
        values, known = {}, {}
        for f in layout.fields:
            column = table.column(f).combine_chunks()
            values[f], known[f] = np.zeros(layout.sides, layout.dtype(f)), np.zeros(layout.sides, bool)
            values[f][at] = np.asarray(column.fill_null(0.0), layout.dtype(f))
            known[f][at] = np.asarray(column.is_valid())
        row = _columns(layout, here, values, known)
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key], *[pa.array([v], pa.binary()) for v in row.values()]], names=[*layout.keys, *row])

    return run


def _unpack(layout: Layout, kinds: Mapping[str, pa.DataType]):
    """Bricks to cells."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                here = _mask(row["here"], layout.sides)
                at = np.nonzero(here)
                n = len(at[0])
                columns = [pa.array([row[b]] * n, batch.schema.field(b).type) for b in layout.batch]
                for x, d in enumerate(layout.dims):
                    columns.append(pa.array(at[x] + layout.extents[x][0] + row[f"b_{d}"] * layout.sides[x], kinds[d]))
                for f in layout.fields:
                    known = _mask(row[f"known_{f}"], layout.sides)[at]
                    columns.append(pa.array(np.frombuffer(row[f], layout.dtype(f)).reshape(layout.sides)[at], mask=~known))
                yield pa.RecordBatch.from_arrays(columns, names=[*layout.batch, *layout.dims, *layout.fields])

    return run


def _slabs(layout: Layout, sweeps: Sweeps):
    """Bricks to the slabs that others read: the reader's place, the sender's, and the cells."""
    senders = [f"s_{d}" for d in layout.dims]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                brick = tuple(row[f"b_{d}"] for d in layout.dims)
                near = [layout.readers(x, b, sweeps.reach[x], sweeps.around[x]) for x, b in enumerate(brick)]
                here = _mask(row["here"], layout.sides)
                values = {f: np.frombuffer(row[f], layout.dtype(f)).reshape(layout.sides) for f in layout.fields}
                known = {f: _mask(row[f"known_{f}"], layout.sides) for f in layout.fields}
                out = []
                for reader in product(*near):
                    if reader == brick:
                        continue
                    slots = []
                    for x, b in enumerate(reader):
                        of, slot = layout.origin(x, b, sweeps.reach[x], sweeps.around[x])
                        slots.append(slot[of == brick[x]])
                    cut = np.ix_(*slots)
                    made = _columns(layout, here[cut], {f: v[cut] for f, v in values.items()}, {f: k[cut] for f, k in known.items()})
                    out.append({b: row[b] for b in layout.batch} | dict(zip([*layout.keys[len(layout.batch) :], *senders], [*reader, *brick], strict=True)) | made)
                if out:
                    numbers = [pa.field(k, pa.int64()) for k in (*layout.keys[len(layout.batch) :], *senders)]
                    bytes_ = [pa.field(c, pa.binary()) for c in ("here", *[c for f in layout.fields for c in (f, f"known_{f}")])]
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*[batch.schema.field(b) for b in layout.batch], *numbers, *bytes_]))

    return run


def _advance(layout: Layout, sweeps: Sweeps):
    """A brick and the slabs of its neighbours to the brick after the sweeps."""
    senders = [f"s_{d}" for d in layout.dims]
    bytes_ = ["here", *[c for f in layout.fields for c in (f, f"known_{f}")]]
    part = pa.list_(pa.struct([("digit", pa.int32()), ("value", pa.int64())]))
    measured = pa.list_(pa.struct([("step", pa.int32()), ("field", pa.string()), ("mass", part), ("energy", part), ("change", pa.float64()), ("n", pa.int64())]))

    def run(key: tuple, bricks: pa.Table, slabs: pa.Table) -> pa.Table:
        kinds = [pa.field(k, v.type) for k, v in zip(layout.keys, key, strict=True)]
        schema = pa.schema([*kinds, *[pa.field(c, pa.binary()) for c in bytes_], *([pa.field("measured", measured)] if sweeps.measure else [])])
        if not len(bricks):  # slabs for a brick without cells
            return schema.empty_table()
        place = tuple(k.as_py() for k in key[len(layout.batch) :])
        block = _Block(layout, sweeps, place)
        block.put(place, bricks.select(bytes_).to_pylist()[0], True)
        for row in slabs.to_pylist():
            block.put(tuple(row[s] for s in senders), row, False)
        row = dict(zip(layout.keys, (k.as_py() for k in key), strict=True)) | block.run()
        return pa.Table.from_pylist([row], schema=schema)

    return run


@dataclass
class BrickFrame:
    """Bricks in a bucketed table."""

    df: DataFrame
    layout: Layout
    like: GridFrame
    table: str
    path: str
    exchanges: int = 0

    @classmethod
    def of(cls, grid: GridFrame, sides: tuple[int, ...] | int | None = None) -> BrickFrame:
        """Pack a grid; a side is at most as long as the grid."""
        return cls._stored(*cls.packed(grid, sides), grid)

    @staticmethod
    def packed(grid: GridFrame, sides: tuple[int, ...] | int | None = None) -> tuple[DataFrame, Layout]:
        """The bricks of a grid, not yet written."""
        n = len(grid.dims)
        asked = sides if isinstance(sides, tuple) else (sides or SIDES[n],) * n
        sides = tuple(max(1, min(s, hi - lo + 1)) for s, (lo, hi) in zip(asked, grid.extents, strict=True))
        layout = Layout(grid.dims, grid.fields, grid.batch, grid.extents, dict(grid.df.dtypes), sides)
        places = [F.floor((F.col(d).cast("long") - lo) / s).alias(f"b_{d}") for d, (lo, _), s in zip(grid.dims, grid.extents, sides, strict=True)]
        cells = grid.df.select("*", *places)
        return cells.groupBy(*layout.keys).applyInArrow(_pack(layout), layout.schema(False)), layout

    @classmethod
    def _stored(cls, df: DataFrame, layout: Layout, like: GridFrame, **more: Any) -> BrickFrame:
        spark = df.sparkSession
        name = f"gridloom_bricks_{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/{name}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").bucketBy(buckets, *layout.keys).option("path", path).saveAsTable(name)
        return cls(spark.table(name), layout, like, name, path, **more)

    def forget(self) -> None:
        """Delete the table and its files; only when nothing reads them any more."""
        spark = self.df.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(spark, self.path)

    def cells(self) -> GridFrame:
        """The grid again."""
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = {f.name: to_arrow_type(f.dataType) for f in self.like.df.schema.fields}
        g = self.like
        return g.with_df(self.df.drop("measured").mapInArrow(_unpack(self.layout, kinds), ", ".join(f"`{n}` {t}" for n, t in g.df.dtypes)))

    def dense(self) -> bool:
        """Whether every cell of the extents is there, in each batch; only the marks of presence are read."""
        batch = self.layout.batch

        def counted(batches):
            for x in batches:
                n = [int(np.bitwise_count(np.frombuffer(b, np.uint8)).sum()) for b in x.column("here").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[x.column(b) for b in batch], pa.array(n, pa.int64())], names=[*batch, "n"])

        schema = ", ".join([*[f"`{b}` {self.layout.kinds[b]}" for b in batch], "n bigint"])
        cells = self.df.select(*batch, "here").mapInArrow(counted, schema).groupBy(*batch).agg(F.sum("n").alias("n"))
        return cells.where(F.col("n") != math.prod(hi - lo + 1 for lo, hi in self.layout.extents)).isEmpty()

    def slabs(self, sweeps: Sweeps) -> DataFrame:
        """What one exchange ships."""
        layout = self.layout
        senders = ", ".join(f"`s_{d}` bigint" for d in layout.dims)
        first, _, rest = layout.schema(False).partition("here binary")
        bricks = self.df.drop("measured")
        return bricks.mapInArrow(_slabs(layout, sweeps), f"{first}{senders}, here binary{rest}")

    def advanced(self, sweeps: Sweeps) -> DataFrame:
        """The bricks after an exchange and its sweeps, not yet written."""
        bricks = self.df.drop("measured").groupBy(*self.layout.keys)
        slabs = self.slabs(sweeps).groupBy(*self.layout.keys)
        return bricks.cogroup(slabs).applyInArrow(_advance(self.layout, sweeps), self.layout.schema(bool(sweeps.measure)))

    def exchange(self, sweeps: Sweeps) -> BrickFrame:
        """The bricks after an exchange and its sweeps."""
        return self._stored(self.advanced(sweeps), self.layout, self.like, exchanges=self.exchanges + 1)


def _measures(bricks: BrickFrame) -> DataFrame:
    """Mass, energy, largest change and cells of each measured step of the last exchange, from the measures alone."""
    batch = list(bricks.layout.batch)
    rows = bricks.df.select(*batch, F.explode("measured").alias("m")).select(*batch, "m.*")
    keys = [*batch, "step", "field"]
    zero = F.array(F.struct(F.lit(0).alias("digit"), F.lit(0).cast("bigint").alias("value"))).cast(PARTS)
    parts = rows.withColumns({c: F.concat(zero, F.col(c)) for c in ("mass", "energy")})
    sums = rounded(summed(parts, keys, ["mass", "energy"]), keys, ["mass", "energy"])
    others = rows.groupBy(*keys).agg(F.max("change").alias("change"), F.sum("n").alias("n_cells"))
    return sums.join(others, keys)


def march_bricks(
    grid: GridFrame | BrickFrame,
    update: Stencil | Mapping[str, Stencil],
    steps: int,
    bc: Any = None,
    per_exchange: int | None = None,
    sides: tuple[int, ...] | int | None = None,
    measure: bool = False,
    tolerance: float | None = None,
    bounded: tuple[str, ...] | None = None,
) -> tuple[GridFrame, DataFrame | None, int]:
    """The grid after ``steps`` sweeps, each followed by the boundary condition: what ``march`` gives.

    Returns the grid, the measures of each step if asked for (batch, step, field, mass, energy,
    change, n_cells, over the interior), and the number of exchanges.  ``update``: a stencil of one
    field, or fields to stencils that all read the old state; each output must be a field.  A frame of
    bricks is taken as it is and stays; its sides are its own.

    ``tolerance`` ends the march after the first step in which no cell of any field changed by more;
    the grid is that of this step.  ``per_exchange``: sweeps for each exchange, by default as many as
    keep a widened brick within ``BRICK_BYTES``.  ``bounded``: the fields that the boundary condition
    holds for, all of them unless given; others keep the halo they have.

    Gaps stay gaps, and a missing neighbour gives null, as in ``march``.  A periodic axis must be
    periodic on both sides and the grid without gaps; else a ValueError says so, and ``march`` is
    the plan to take.
    """
    given = grid if isinstance(grid, BrickFrame) else None
    grid = given.like if given is not None else grid
    if isinstance(update, Stencil):
        update = {update.fields[0]: update}
    unknown = set(update) - set(grid.fields)
    if unknown:
        raise ValueError(f"several sweeps in one exchange need outputs that are fields; {sorted(unknown)} are none")
    n_dims = len(grid.dims)
    width = check_fusable([renamed_to(n, s) for n, s in update.items()])
    if len(width) != n_dims:
        raise ValueError("the stencil and the grid differ in dimensions")
    spec = None if bc is None else BoundarySpec.of(bc, n_dims)
    periodic: list[int | None] = [None] * n_dims
    near = [0] * n_dims  # what sides that are not periodic add to the margin
    for x, h in enumerate(width):
        pair = spec.sides[x] if spec is not None and h else None
        if pair is None or pair == (None, None):
            continue
        lo, hi = grid.extents[x]
        if hi - lo + 1 - 2 * h < h:
            raise ValueError(f"axis {grid.dims[x]} has fewer interior cells than its halo of {h}")
        kinds = [s.kind if s is not None else None for s in pair]
        if "periodic" in kinds:
            if kinds != ["periodic", "periodic"]:
                raise ValueError(f"axis {grid.dims[x]} is periodic on one side only: march() does that")
            periodic[x] = h
        else:
            near[x] = 2 * h - 1
    outputs = {n: s.plain() for n, s in update.items()}
    sides = given.layout.sides if given is not None else sides
    asked = sides if isinstance(sides, tuple) else (sides or SIDES[n_dims],) * n_dims
    depth = per_exchange or temporal_depth(width, asked, BRICK_BYTES)
    measure = measure or tolerance is not None
    names = tuple(outputs) if measure else ()
    wraps = any(h is not None for h in periodic)

    def planned(n: int, first: int, around: tuple[int | None, ...]) -> Sweeps:
        reach = tuple(n * w + more for w, more in zip(width, near, strict=True))
        # A continued axis is as wide as the margin even where no sweep reads it, for the halo's own cells.
        return Sweeps(outputs, width, n, first, spec, around, reach, names, grid.fields if bounded is None else bounded)

    most = tuple(depth * w + more for w, more in zip(width, near, strict=True))
    if given is None:
        bricks = BrickFrame.of(grid, tuple(max(s, 2 * r, 1) for s, r in zip(asked, most, strict=True)))
    elif any(s < 2 * r and n > 1 for s, r, n in zip(asked, most, given.layout.counts, strict=True)):
        raise ValueError(f"bricks of {asked} cells are too small for {depth} sweeps in one exchange")
    else:
        bricks = given
    if wraps and bounded is not None and set(bounded) != set(grid.fields):
        raise ValueError("a periodic axis holds for all fields")
    if wraps and not bricks.dense():
        if bricks is not given:
            bricks.forget()
        raise ValueError("a periodic axis needs a grid without gaps: march() fills those")
    done, metrics, stop = 0, [], False
    none: tuple[int | None, ...] = (None,) * n_dims
    while done < steps and not stop:
        now = planned(1, 1, none) if wraps and done == 0 else planned(min(depth, steps - done), done + 1, tuple(periodic))
        after = bricks.exchange(now)
        done += now.steps
        if measure:
            found = _measures(after)
            if tolerance is not None:
                still = found.groupBy("step").agg(F.max("change").alias("c")).where(F.col("c").isNull() | (F.col("c") <= tolerance))
                first = still.agg(F.min("step")).first()[0]
                if first is not None:
                    stop = True
                    if first < done:  # the sweeps of this exchange went too far
                        after.forget()
                        after = bricks.exchange(replace(now, steps=first - now.first + 1))
                        found, done = _measures(after), first
            keys = [*grid.batch, "step", "field"]
            path = f"{shared_dir(grid.df.sparkSession)}/measures-{uuid.uuid4().hex}"
            found.select(*keys, "mass", "energy", "change", "n_cells").coalesce(1).write.parquet(path)
            metrics.append(path)
        if bricks is not given:
            bricks.forget()
        bricks = after
    if wraps and done == 1:  # the halo after a first sweep is filled by the next exchange
        after = bricks.exchange(replace(planned(0, 2, tuple(periodic)), measure=(), reach=tuple(max(1, m) for m in near)))
        if bricks is not given:
            bricks.forget()
        bricks = after
    read = grid.df.sparkSession.read.parquet(*metrics) if metrics else None
    return bricks.cells(), read, bricks.exchanges


__all__ = ["BrickFrame", "Layout", "Sweeps", "march_bricks"]
