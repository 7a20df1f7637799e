"""Benchmark rows, and tables, JSON and scaling figures made from them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from ..operators.grid import GridFrame
from .compiled import StencilPlan

COLUMNS = ("name", "plan", "shape", "cells", "time_ms", "gpoints_per_s", "gbytes_per_s")


def measure(plans: Sequence[StencilPlan], grids: Sequence[GridFrame], warmup: int = 1, iters: int = 3) -> list[dict[str, Any]]:
    """A row for each plan and each grid of its number of dimensions that has its fields."""
    rows = []
    for p in plans:
        for g in grids:
            if len(g.dims) == p.ndim and set(p.inputs) <= set(g.fields):
                shape = "x".join(str(hi - lo + 1) for lo, hi in g.extents)
                rows.append({"name": p.name, "plan": p.annotations(g)["plan"], "shape": shape, **p.benchmark(g, warmup, iters)})
    return rows


def as_table(rows: Sequence[Mapping[str, Any]]) -> str:
    """Lines of columns, the numbers to four digits."""
    cells = [[f"{r[c]:.4g}" if isinstance(r[c], float) else str(r[c]) for c in COLUMNS] for r in rows]
    widths = [max(len(x) for x in column) for column in zip(COLUMNS, *cells, strict=True)]
    return "\n".join("  ".join(x.rjust(w) for x, w in zip(line, widths, strict=True)) for line in (COLUMNS, *cells))


def as_json(rows: Sequence[Mapping[str, Any]]) -> str:
    return json.dumps(list(rows))


def scaling(rows: Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """By stencil and plan, from one size to the next: how many more cells, and how much more time."""
    out, before = [], {}
    for r in sorted(rows, key=lambda r: (r["name"], r["plan"], r["cells"])):
        key = r["name"], r["plan"]
        if key in before and before[key]["cells"]:
            b = before[key]
            out.append({"name": r["name"], "plan": r["plan"], "shape": r["shape"], "cells_x": r["cells"] / b["cells"], "time_x": r["time_ms"] / b["time_ms"]})
        before[key] = r
    return out
