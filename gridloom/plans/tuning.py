"""The plan of a sweep by measurement: candidates run on boxes of the grid itself.

Each plan is timed on two boxes, one a few times the other.  The two times give what a plan costs
whatever the size, and what it costs for each cell; together with the grid's cells they foretell its
time on the whole.  The figures can be kept as a table beside the grid.
"""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.expr import accesses
from ..functions.frontend import Stencil
from ..operators.grid import GridFrame
from ..operators.shift import FEW
from ..operators.sweep import fused, renamed_to
from .analysis import check_fusable
from .lineage import cut, forget


@dataclass(frozen=True)
class TuneConfig:
    """What is timed, and how often."""

    plans: tuple[str, ...] = ("window", "scatter", "join", "brick")
    #: Cells of the larger box, and how many times as many it has as the smaller one.
    cells: int = 1 << 18
    ratio: int = 4
    warmup: int = 1
    iters: int = 2
    #: Reads off the centre beyond which joins, and reads beyond which a scatter is not tried.
    most_joins: int = 2 * FEW
    most_scattered: int = 64

    def __post_init__(self):
        if self.ratio < 2 or self.cells < self.ratio or self.iters < 1 or self.warmup < 0 or not self.plans:
            raise ValueError(f"no box or no run to time: {self}")


@dataclass(frozen=True)
class Timing:
    plan: str
    fixed_s: float
    cell_s: float
    #: Foretold seconds on the whole grid.
    whole_s: float


def candidates(outputs: Mapping[str, Stencil], config: TuneConfig | None = None) -> list[str]:
    """The plans that can run the stencils and are worth a try."""
    config = config or TuneConfig()
    loads = accesses(*[s.body for s in outputs.values()])
    moved = {a.offset for a in loads if any(a.offset)}
    fits = {
        "window": all(sum(o != 0 for o in offset) < 2 for offset in moved),
        "scatter": len(loads) <= config.most_scattered,
        "join": len(moved) <= config.most_joins,
        "brick": not any(s.extended for s in outputs.values()),
    }
    return [p for p in config.plans if fits[p]]


def sample_box(grid: GridFrame, cells: int) -> dict[str, tuple[int, int]]:
    """A box in the middle of the extents with about so many cells, of sides in proportion."""
    lengths = [max(1, hi - lo + 1) for lo, hi in grid.extents]
    total = 1
    for n in lengths:
        total *= n
    share = min(1.0, (cells / total) ** (1 / len(lengths)))
    box = {}
    for d, (lo, hi), n in zip(grid.dims, grid.extents, lengths, strict=True):
        own = max(1, round(n * share))
        first = lo + (n - own) // 2
        box[d] = (first, min(hi, first + own - 1))
    return box


def _part(grid: GridFrame, box: Mapping[str, tuple[int, int]]) -> GridFrame:
    """The cells of a box as a grid of its own, written once so that its source is not timed."""
    df = grid.df
    for d, (a, b) in box.items():
        df = df.where(df[d].between(a, b))
    return GridFrame(cut(df, "tuning"), grid.dims, grid.fields, grid.batch, tuple(box[d] for d in grid.dims))


def measured_plans(grid: GridFrame, outputs: Mapping[str, Stencil], config: TuneConfig | None = None) -> list[Timing]:
    """The candidates by what they are foretold to take on the whole grid, the fastest first."""
    config = config or TuneConfig()
    check_fusable([renamed_to(n, s) for n, s in outputs.items()])
    names = candidates(outputs, config)
    if not names:
        raise ValueError(f"none of {config.plans} can run these stencils")
    total = grid.df.count()
    parts = [_part(grid, sample_box(grid, n)) for n in (config.cells // config.ratio, config.cells)]
    rows = [p.df.count() for p in parts]

    def seconds(part: GridFrame, plan: str) -> float:
        best = float("inf")
        for n in range(config.warmup + config.iters):
            start = time.perf_counter()
            fused(part, outputs, plan=plan).df.write.format("noop").mode("overwrite").save()
            if n >= config.warmup:
                best = min(best, time.perf_counter() - start)
        return best

    out = []
    for plan in names:
        small, large = (seconds(p, plan) for p in parts)
        cell = max(0.0, large - small) / max(1, rows[1] - rows[0])
        fixed = max(0.0, small - cell * rows[0])
        out.append(Timing(plan, fixed, cell, fixed + cell * total))
    forget(*[p.df for p in parts])
    return sorted(out, key=lambda t: t.whole_s)


def keep(spark: SparkSession, timings: list[Timing], name: str, path: str) -> None:
    """Add the figures of a sweep to a table of figures."""
    rows = [(name, n, *asdict(t).values()) for n, t in enumerate(timings)]
    spark.createDataFrame(rows, "name string, place int, plan string, fixed_s double, cell_s double, whole_s double").write.mode("append").parquet(path)


def kept_plan(figures: DataFrame, name: str) -> str | None:
    """The plan that was fastest for a sweep in a table of figures, if it is there."""
    row = figures.where((figures["name"] == name) & (figures["place"] == 0)).orderBy("whole_s").first()
    return None if row is None else row["plan"]


def tuned(plan: Any, grid: GridFrame, config: TuneConfig | None = None) -> Any:
    """A ``StencilPlan`` with the measured plan in place of its own."""
    from dataclasses import replace

    return replace(plan, plan=measured_plans(grid, plan.outputs, config)[0].plan)


__all__ = ["Timing", "TuneConfig", "candidates", "keep", "kept_plan", "measured_plans", "sample_box", "tuned"]
