"""One sweep of a stencil, or of several at once, over a grid."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import functions as F

from ..functions.expr import accesses, rebuild
from ..functions.frontend import Stencil
from ..functions.lower import to_column
from ..plans.analysis import check_fusable
from .bricks import brick_sweep
from .grid import GridFrame
from .shift import chosen, read_name, with_reads


def renamed(stencil: Stencil, fields: Mapping[str, str]) -> Stencil:
    """The stencil over other field names."""
    from dataclasses import replace as changed

    from ..functions.expr import Access

    body = rebuild(stencil.body, lambda n: Access(fields.get(n.field, n.field), n.offset) if isinstance(n, Access) else n)
    return changed(stencil, body=body, fields=tuple(fields.get(f, f) for f in stencil.fields))


def fused(
    grid: GridFrame,
    outputs: Mapping[str, Stencil],
    halo: str = "keep",
    plan: str = "auto",
    box: dict[str, tuple[int, int]] | None = None,
    strict: bool = True,
    keep_fields: bool = False,
) -> GridFrame:
    """Evaluate several stencils (output column to stencil) over one set of neighbour columns.

    Cells outside the widest interior keep the value of each stencil's first field (``keep``), turn
    0 (``zero``) or are left out (``drop``).  An interior cell with a missing neighbour becomes
    null.  ``box`` limits the result and narrows the scan.  ``plan`` is auto, window, scatter, join
    or brick.  Extended bodies are left to Spark's own functions under ``auto``.
    """
    stencils = list(outputs.values())
    if any(s.ndim != len(grid.dims) for s in stencils):
        raise ValueError("the stencil and the grid differ in dimensions")
    width = check_fusable([renamed_to(n, s) for n, s in outputs.items()])
    missing = {f for s in stencils for f in s.fields} - set(grid.fields)
    if missing:
        raise ValueError(f"the grid has no field {sorted(missing)}")
    source = grid.restricted(box, width) if box else grid
    loads = accesses(*[s.body for s in stencils])
    plan = chosen(grid, loads, plan, exact=not any(s.extended for s in stencils))
    if plan == "brick":
        rows = brick_sweep(source, outputs, width, halo, keep_fields=keep_fields)
    else:
        df = with_reads(source, loads, plan)
        at = {a: F.col(read_name(k)) for k, a in enumerate(loads)}
        inside = grid.interior(width)
        if halo == "drop":
            df = df.where(inside)
        columns = []
        for name, s in outputs.items():
            value = to_column(s.body, at.__getitem__, lambda x: F.col(grid.dims[x]), s.dtype, strict).cast(s.dtype)
            if halo != "drop":
                edge = F.col(s.fields[0]) if halo == "keep" and s.fields else F.lit(0.0)
                value = F.when(inside, value).otherwise(edge.cast(s.dtype))
            columns.append(value.alias(name))
        kept = [f for f in grid.fields if f not in outputs] if keep_fields else []
        rows = df.select(*grid.keys, *kept, *columns)
    for d, (lo, hi) in (box or {}).items():
        rows = rows.where(F.col(d).between(lo, hi))
    kept = tuple(f for f in grid.fields if f not in outputs) if keep_fields else ()
    return grid.with_df(rows, (*kept, *outputs))


def renamed_to(name: str, s: Stencil) -> Stencil:
    """The stencil under another name."""
    from dataclasses import replace as changed

    return changed(s, name=name)


def apply(grid: GridFrame, stencil: Stencil, out: str | None = None, **options) -> GridFrame:
    """One sweep of one stencil; the output column is ``out`` or the stencil's first field."""
    return fused(grid, {out or stencil.fields[0]: stencil}, **options)
