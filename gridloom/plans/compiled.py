"""Plans that can be looked at: what a stencil reads and costs, how it will run, and how fast.

``compile`` and ``compile_fused`` pass stencils through a ``Pipeline`` of rewrites and give a
``StencilPlan``.  It is applied to grids, prints its SQL and Spark's plan, checks itself against the
original Python functions on random arrays, and times itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import SparkSession

from ..functions.elementwise import swept
from ..functions.expr import Access, accesses, fold
from ..functions.frontend import Stencil
from ..operators.boundary import BoundarySpec, apply_boundary
from ..operators.brickframe import march_bricks
from ..operators.bricks import SIDES
from ..operators.decompose import march_parts
from ..operators.grid import GridFrame
from ..operators.march import BRICK_BYTES, march, march_blocked
from ..operators.shift import chosen
from ..operators.sweep import fused
from .analysis import check_fusable, describe, fused_name, fusion_groups, temporal_depth
from .sql import sweep_sql

Rewrite = Callable[[Stencil], Stencil]
PLANS = ("auto", "window", "scatter", "join", "brick")


def folded(stencil: Stencil) -> Stencil:
    """Constant parts computed once."""
    return replace(stencil, body=fold(stencil.body))


@dataclass
class Pipeline:
    """Rewrites of stencils, in order."""

    passes: list[Rewrite] = field(default_factory=list)

    def add(self, rewrite: Rewrite) -> Pipeline:
        self.passes.append(rewrite)
        return self

    def run(self, stencil: Stencil) -> Stencil:
        for rewrite in self.passes:
            stencil = rewrite(stencil)
        return stencil

    @classmethod
    def standard(cls) -> Pipeline:
        return cls([folded])


@dataclass(frozen=True)
class StencilPlan:
    """Stencils by output column, and how they run.

    ``steps`` sweeps are one application; ``parts`` cuts the grid along ``axis`` into parts that
    exchange halos after each sweep; ``plan`` is auto, window, scatter, join or brick.
    """

    name: str
    outputs: Mapping[str, Stencil]
    plan: str = "auto"
    halo: str = "keep"
    steps: int = 1
    parts: int | None = None
    axis: int = 0
    side: int | None = None
    bc: Any = None
    strict: bool = True

    def __post_init__(self):
        check_fusable([replace(s, name=n) for n, s in self.outputs.items()])
        for what, value, known in (("plan", self.plan, PLANS), ("halo", self.halo, ("keep", "zero", "drop"))):
            if value not in known:
                raise ValueError(f"{self.name}: {what} {value!r} is not one of {known}")
        for what, value in (("steps", self.steps), ("parts", self.parts), ("side", self.side)):
            if value is not None and (not isinstance(value, int) or value < 1):
                raise ValueError(f"{self.name}: {what} is a whole number from 1 on, not {value!r}")
        if not 0 <= self.axis < self.ndim:
            raise ValueError(f"{self.name}: axis {self.axis} of {self.ndim}")
        if self.halo != "keep" and (self.steps > 1 or self.parts or self.bc is not None):
            raise ValueError(f"{self.name}: several steps, parts and boundary conditions keep the halo")
        if self.bc is not None:
            BoundarySpec.of(self.bc, self.ndim)  # raises where a kind is unknown
        unknown = set(self.outputs) - set(self.inputs)
        if (self.steps > 1 or self.parts) and unknown:
            raise ValueError(f"several sweeps need outputs that are fields; {sorted(unknown)} are none")
        if self.parts and self.bc is not None:
            raise ValueError("parts exchange halos without a boundary condition")

    @property
    def stencils(self) -> list[Stencil]:
        return list(self.outputs.values())

    @property
    def inputs(self) -> tuple[str, ...]:
        """The fields that are read, each once, in order."""
        return tuple(dict.fromkeys(f for s in self.stencils for f in s.fields))

    @property
    def ndim(self) -> int:
        return self.stencils[0].ndim

    @property
    def width(self) -> tuple[int, ...]:
        """The widest halo of the members, per axis."""
        return check_fusable([replace(s, name=n) for n, s in self.outputs.items()])

    @property
    def loads(self) -> list[Access]:
        return accesses(*[s.body for s in self.stencils])

    @property
    def depth(self) -> int:
        """The most sweeps that one exchange of bricks may serve."""
        return temporal_depth(self.width, (self.side or SIDES[self.ndim],) * self.ndim, BRICK_BYTES)

    def describe(self) -> list[dict[str, Any]]:
        """Footprint and cost of each member."""
        return [describe(s) for s in self.stencils]

    def annotations(self, grid: GridFrame | None = None) -> dict[str, Any]:
        """How the plan will run: strategy, halos of one exchange, parts and bricks."""
        exact = not any(s.extended for s in self.stencils)
        how = chosen(grid, self.loads, self.plan, exact) if grid is not None or self.plan != "auto" else "auto"
        return {
            "name": self.name,
            "plan": how,
            "halo": self.width,
            "steps": self.steps,
            "expanded_halo": tuple(self.steps * w for w in self.width),
            "loads": len(self.loads),
            "groups": fusion_groups(self.stencils, one_domain=True),
            "parts": self.parts,
            "part_axis": self.axis if self.parts else None,
            "exchange_layers": max(1, self.width[self.axis]) if self.parts else None,
            "brick_side": (self.side or SIDES[self.ndim]) if how == "brick" else None,
        }

    def apply(self, grid: GridFrame) -> GridFrame:
        if self.parts:
            return march_parts(grid, self.outputs, self.steps, self.parts, self.axis)
        if self.steps > 1 and self.plan == "brick" and self.bc is None:
            return march_blocked(grid, self.outputs, self.steps, side=self.side)
        if self.steps > 1 and self.plan == "brick":
            return march_bricks(grid, self.outputs, self.steps, bc=self.bc, sides=self.side)[0]
        if self.steps > 1:
            return march(grid, self.outputs, self.steps, bc=self.bc, plan=self.plan, strict=self.strict)
        out = fused(grid, self.outputs, halo=self.halo, plan=self.plan, strict=self.strict)
        return out if self.bc is None else apply_boundary(out, self.bc, self.width)

    __call__ = apply

    def sql(self, relation: str, dims: Sequence[str] = ("i", "j", "k"), batch: Sequence[str] = ()) -> str:
        """One sweep as a SELECT over a relation with the index and value columns."""
        return sweep_sql(relation, tuple(dims)[: self.ndim], self.inputs, tuple(batch), self.outputs, self.halo)

    def write_sql(self, path: str, relation: str = "cells", **options: Any) -> None:
        """The SELECT, with what it is as comments, to a file on the driver."""
        notes = "\n".join(f"-- {k}: {v}" for k, v in self.annotations().items())
        Path(path).write_text(f"{notes}\n{self.sql(relation, **options)}\n")

    def explain(self, grid: GridFrame, mode: str = "formatted") -> str:
        """Spark's plan for a grid."""
        df = self.apply(grid).df
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def _random(self, spark: SparkSession, shape: Sequence[int] | None, seed: int) -> tuple[GridFrame, dict[str, np.ndarray]]:
        base = {1: 128, 2: 32, 3: 12}[self.ndim]
        shape = tuple(shape or (base + 2 * self.steps * w for w in self.width))
        rng, kind = np.random.default_rng(seed), self.stencils[0].dtype
        arrays = {f: (rng.random(shape) + 0.5).astype(np.float64 if kind == "double" else np.float32) for f in self.inputs}
        dims = ("i", "j", "k")[: self.ndim]
        at = np.indices(shape).reshape(self.ndim, -1)
        rows = list(zip(*[a.tolist() for a in at], *[a.reshape(-1).tolist() for a in arrays.values()], strict=True))
        schema = ", ".join([f"{d} int" for d in dims] + [f"{f} {kind}" for f in arrays])
        return GridFrame(spark.createDataFrame(rows, schema), dims, self.inputs, bounds=tuple((0, n - 1) for n in shape)), arrays

    def difference(self, spark: SparkSession, shape: Sequence[int] | None = None, seed: int = 0) -> float:
        """The largest difference from the original functions, over cells that no halo has reached."""
        grid, now = self._random(spark, shape, seed)
        for _ in range(self.steps):
            now = {**now, **{n: swept(s, now, self.width) for n, s in self.outputs.items()}}
        margin = tuple(self.steps * w for w in self.width)
        got = {n: np.full(now[n].shape, np.nan, now[n].dtype) for n in self.outputs}
        for r in self.apply(grid).df.toLocalIterator():
            for n in self.outputs:
                got[n][tuple(r[d] for d in grid.dims)] = np.nan if r[n] is None else r[n]
        inner = tuple(slice(m, x - m) for m, x in zip(margin, next(iter(now.values())).shape, strict=True))
        # Equal infinities and NaNs differ by nothing.
        apart = [np.where((a == b) | (np.isnan(a) & np.isnan(b)), 0.0, np.abs(a - b)) for a, b in ((now[n][inner], got[n][inner]) for n in self.outputs)]
        return max(float(np.max(np.nan_to_num(x, nan=np.inf), initial=0.0)) for x in apart)

    def validate(self, spark: SparkSession, shape: Sequence[int] | None = None, seed: int = 0, atol: float = 0.0) -> bool:
        """Whether every output equals its original Python function, run on arrays, within ``atol``."""
        if self.bc is not None:
            raise ValueError("validation compares sweeps without a boundary condition")
        return self.difference(spark, shape, seed) <= atol

    def benchmark(self, grid: GridFrame, warmup: int = 1, iters: int = 3) -> dict[str, float]:
        """Milliseconds of one application with a sink that keeps nothing, and rates over interior cells."""
        took = []
        for n in range(warmup + iters):
            start = time.perf_counter()
            self.apply(grid).df.write.format("noop").mode("overwrite").save()
            if n >= warmup:
                took.append(time.perf_counter() - start)
        seconds = min(took)
        cells = float(np.prod([max(0, hi - lo + 1 - 2 * w) for (lo, hi), w in zip(grid.extents, self.width, strict=True)])) * self.steps
        size = 8 if self.stencils[0].dtype == "double" else 4
        moved = cells * size * (len(self.inputs) + len(self.outputs))
        return {"time_ms": 1e3 * seconds, "cells": cells, "gpoints_per_s": cells / seconds / 1e9, "gbytes_per_s": moved / seconds / 1e9}


def compile(stencil: Stencil, out: str | None = None, pipeline: Pipeline | None = None, **options: Any) -> StencilPlan:  # noqa: A001
    """A plan of one stencil; the output column is ``out`` or the stencil's first field."""
    stencil = (pipeline or Pipeline.standard()).run(stencil)
    return StencilPlan(stencil.name, {out or stencil.fields[0]: stencil}, **options)


def compile_fused(stencils: Iterable[Stencil] | Mapping[str, Stencil], name: str | None = None, pipeline: Pipeline | None = None, **options: Any) -> StencilPlan:
    """One plan for stencils on one domain; outputs are named by the mapping, or by the stencils."""
    if not isinstance(stencils, Mapping):
        listed = list(stencils)
        stencils = {s.name: s for s in listed}
        if len(stencils) != len(listed):
            raise ValueError("fused stencils need distinct names")
    rewritten = {n: (pipeline or Pipeline.standard()).run(s) for n, s in stencils.items()}
    return StencilPlan(name or fused_name(list(rewritten)), rewritten, **options)


def compile_groups(stencils: Sequence[Stencil], **options: Any) -> list[StencilPlan]:
    """One fused plan for each group of stencils that share fields."""
    by_name = {s.name: s for s in stencils}
    return [compile_fused([by_name[n] for n in names], **options) for names in fusion_groups(list(stencils))]


__all__ = ["Pipeline", "StencilPlan", "compile", "compile_fused", "compile_groups", "folded"]
