"""Time marching: iterated sweeps, coupled systems, leapfrog and Runge-Kutta steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import functions as F

from ..functions.expr import accesses
from ..functions.frontend import Stencil, halo_of
from ..plans.analysis import check_fusable, temporal_depth
from ..plans.lineage import cut
from .boundary import apply_boundary
from .bricks import SIDES, brick_sweep
from .grid import GridFrame
from .shift import chosen
from .sweep import fused, renamed_to

#: Sweeps between cuts of the lineage, and reads of one cut that a plan may hold.
CUT_EVERY, MOST_READS = 6, 4

#: Bytes of a brick and its copy, widened for several sweeps.
BRICK_BYTES = 64 << 20

Update = Mapping[str, Stencil]


def _history(snapshots: list[GridFrame], step_col: str) -> GridFrame:
    rows = [g.df.withColumn(step_col, F.lit(s)) for s, g in enumerate(snapshots)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    first = snapshots[0]
    return GridFrame(out, first.dims, first.fields, (*first.batch, step_col), first.extents)


def step_system(grid: GridFrame, stages: Sequence[Update], **options: Any) -> GridFrame:
    """One step: each stage computes its fields together from the state before it (Jacobi); later
    stages see what earlier ones have written (staggered)."""
    for update in stages:
        grid = fused(grid, update, keep_fields=True, **options)
    return grid


def _reads(grid: GridFrame, stages: Sequence[Update], plan: str, bc: Any) -> int:
    """How often one step reads the state before it: each join and each boundary multiplies."""
    out = 1
    for update in stages:
        loads = accesses(*[s.body for s in update.values()])
        if chosen(grid, loads, plan) == "join":
            out *= 1 + len({a.offset for a in loads if any(a.offset)})
    return out * (2 + len(grid.dims) if bc is not None else 1)


def march(
    grid: GridFrame,
    update: Stencil | Update | Sequence[Update],
    steps: int,
    bc: Any = None,
    keep: str = "last",
    step_col: str = "step",
    plan: str = "auto",
    source: Callable[[GridFrame, int], GridFrame] | None = None,
    strict: bool = True,
) -> GridFrame:
    """``steps`` sweeps, each followed by the boundary condition ``bc`` if there is one.

    ``update``: a stencil of one field, fields to stencils (all from the old state), or a sequence
    of such stages.  ``keep``: ``last`` or ``history`` (steps + 1 snapshots with ``step_col``).
    ``source`` may change the state after each step (the step's number is its second argument).
    The plan grows in proportion to the steps: where a step reads the state several times, and
    where every state is kept, each state is written before it is read again.
    """
    if isinstance(update, Stencil):
        update = {update.fields[0]: update}
    stages = [update] if isinstance(update, Mapping) else list(update)
    halo = halo_of([s.body for u in stages for s in u.values()], len(grid.dims))
    reads, held = _reads(grid, stages, plan, bc), 1
    snapshots = [grid]
    for n in range(1, steps + 1):
        held *= reads
        grid = step_system(grid, stages, plan=plan, strict=strict)
        if bc is not None:
            grid = apply_boundary(grid, bc, halo)
        if source is not None:
            grid = source(grid, n)
        if n < steps and (n % CUT_EVERY == 0 or held * reads > MOST_READS or keep == "history"):
            grid, held = grid.with_df(cut(grid.df)), 1
        snapshots.append(grid)
    return _history(snapshots, step_col) if keep == "history" else grid


def march_blocked(grid: GridFrame, update: Stencil | Update, steps: int, per_exchange: int | None = None, side: int | None = None) -> GridFrame:
    """The same as ``march`` without a boundary condition, with several sweeps for each shuffle:
    bricks carry a margin of that many halos.

    ``update`` is a stencil of one field, or fields to stencils that all read the old state; each
    output must be a field of the grid, since the next sweep reads it.  ``per_exchange`` is, unless
    given, the most sweeps whose widened bricks stay within ``BRICK_BYTES``.
    """
    if isinstance(update, Stencil):
        update = {update.fields[0]: update}
    unknown = set(update) - set(grid.fields)
    if unknown:
        raise ValueError(f"several sweeps in one exchange need outputs that are fields; {sorted(unknown)} are none")
    width = check_fusable([renamed_to(n, s) for n, s in update.items()])
    if per_exchange is None:
        brick = (side or SIDES[len(grid.dims)],) * len(grid.dims)
        per_exchange = temporal_depth(width, brick, BRICK_BYTES)
    while steps > 0:
        n = min(per_exchange, steps)
        grid = grid.with_df(brick_sweep(grid, update, width, steps=n, side=side, keep_fields=True))
        steps -= n
    return grid


def inject(field: str, at: Mapping[str, int], value: Callable[[int], float]) -> Callable[[GridFrame, int], GridFrame]:
    """A point source for ``march``: adds value(step) to one cell."""

    def change(grid: GridFrame, step: int) -> GridFrame:
        here = F.lit(True)
        for d, i in at.items():
            here = here & (F.col(d) == i)
        return grid.with_df(grid.df.withColumn(field, F.when(here, F.col(field) + F.lit(float(value(step)))).otherwise(F.col(field))))

    return change


def zero_edge(field: str, width: tuple[int, ...]) -> Callable[[GridFrame, int], GridFrame]:
    """A step hook that sets the outer cells of a field to 0."""

    def change(grid: GridFrame, step: int) -> GridFrame:
        return grid.with_df(grid.df.withColumn(field, F.when(grid.interior(width), F.col(field)).otherwise(F.lit(0.0))))

    return change


#: The methods by name.
METHODS = ("euler", "rk2", "rk4", "ssprk3")


class RungeKutta:
    """u' = L(u) for one field, L a stencil; the derivative is 0 in the halo, so the halo stays."""

    def __init__(self, stencil: Stencil, method: str = "rk4", plan: str = "auto"):
        if method.lower() not in METHODS:
            raise ValueError(f"method {method!r} is not one of {METHODS}")
        self.stencil, self.method, self.plan = stencil, method.lower(), plan
        self.field = stencil.fields[0]

    def _derivative(self, grid: GridFrame, name: str, of: str) -> GridFrame:
        """Add a column: L of one column."""
        from .sweep import renamed

        return fused(grid, {name: renamed(self.stencil, {self.field: of})}, halo="zero", plan=self.plan, keep_fields=True)

    @staticmethod
    def _add(grid: GridFrame, name: str, value: Any) -> GridFrame:
        fields = grid.fields if name in grid.fields else (*grid.fields, name)
        return grid.with_df(grid.df.withColumn(name, value), fields)

    def step(self, grid: GridFrame, dt: float) -> GridFrame:
        u, c, kept = self.field, F.col, grid.fields
        h = F.lit(float(dt))
        if self.method == "euler":
            g = self._derivative(grid, "_k1", u)
            g = self._add(g, u, c(u) + h * c("_k1"))
        elif self.method == "rk2":
            g = self._derivative(grid, "_k1", u)
            g = self._add(g, "_s", c(u) + F.lit(0.5 * dt) * c("_k1"))
            g = self._derivative(g, "_k2", "_s")
            g = self._add(g, u, c(u) + h * c("_k2"))
        elif self.method == "rk4":
            g = self._derivative(grid, "_k1", u)
            g = self._derivative(self._add(g, "_s", c(u) + F.lit(0.5 * dt) * c("_k1")), "_k2", "_s")
            g = self._derivative(self._add(g, "_s", c(u) + F.lit(0.5 * dt) * c("_k2")), "_k3", "_s")
            g = self._derivative(self._add(g, "_s", c(u) + h * c("_k3")), "_k4", "_s")
            total = ((c("_k1") + F.lit(2.0) * c("_k2")) + F.lit(2.0) * c("_k3")) + c("_k4")
            g = self._add(g, u, c(u) + F.lit(dt / 6.0) * total)
        else:
            g = self._derivative(grid, "_k1", u)
            g = self._add(g, "_s", c(u) + h * c("_k1"))
            g = self._derivative(g, "_k2", "_s")
            g = self._add(g, "_s", F.lit(0.75) * c(u) + F.lit(0.25) * (c("_s") + h * c("_k2")))
            g = self._derivative(g, "_k3", "_s")
            g = self._add(g, u, F.lit(1.0 / 3.0) * c(u) + F.lit(2.0 / 3.0) * (c("_s") + h * c("_k3")))
        return g.with_df(g.df.select(*g.keys, *kept), kept)

    def solve(self, grid: GridFrame, dt: float, steps: int, bc: Any = None) -> GridFrame:
        for n in range(1, steps + 1):
            grid = self.step(grid, dt)
            if bc is not None:
                grid = apply_boundary(grid, bc, self.stencil.halo)
            if n < steps:
                grid = grid.with_df(cut(grid.df))
        return grid
