"""Sweeps as SQL text: left joins of a grid with its shifted self."""

from __future__ import annotations

from collections.abc import Mapping

from ..functions.expr import accesses
from ..functions.frontend import Stencil, halo_of
from ..functions.lower import to_sql


def sweep_sql(source: str, dims: tuple[str, ...], fields: tuple[str, ...], batch: tuple[str, ...], outputs: Mapping[str, Stencil], halo: str = "keep", keep_fields: bool = False) -> str:
    """A SELECT over the relation ``source``."""
    stencils = list(outputs.values())
    width = halo_of([s.body for s in stencils], len(dims))
    offsets = list(dict.fromkeys(a.offset for a in accesses(*[s.body for s in stencils])))
    zero = tuple(0 for _ in dims)
    alias = {o: "c" if o == zero else f"s{n}" for n, o in enumerate(offsets)}
    joins = []
    for o, a in alias.items():
        if o != zero:
            on = [f"{a}.{b} = c.{b}" for b in batch] + [f"{a}.{d} = c.{d} + {x}" for d, x in zip(dims, o, strict=True)]
            joins.append(f"LEFT JOIN {source} {a} ON " + " AND ".join(on))
    extent = ", ".join(f"min({d}) AS lo_{d}, max({d}) AS hi_{d}" for d in dims)
    inside = " AND ".join(f"c.{d} >= e.lo_{d} + {h} AND c.{d} <= e.hi_{d} - {h}" for d, h in zip(dims, width, strict=True) if h) or "TRUE"
    columns = [f"c.{x}" for x in (*batch, *dims)]
    if keep_fields:
        columns += [f"c.{f}" for f in fields if f not in outputs]
    for name, s in outputs.items():
        kind = "DOUBLE" if s.dtype == "double" else "FLOAT"
        value = to_sql(s.body, lambda a: f"{alias[a.offset]}.{a.field}", lambda x: f"c.{dims[x]}", kind)
        edge = f"c.{s.fields[0]}" if halo == "keep" else "0.0"
        columns.append(f"CAST({value} AS {kind}) AS {name}" if halo == "drop" else f"CAST(CASE WHEN {inside} THEN {value} ELSE {edge} END AS {kind}) AS {name}")
    where = f" WHERE {inside}" if halo == "drop" else ""
    return f"SELECT {', '.join(columns)} FROM {source} c CROSS JOIN (SELECT {extent} FROM {source}) e {' '.join(joins)}{where}"
