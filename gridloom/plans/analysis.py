"""What a stencil reads and costs, worked out from its tree."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.expr import Bin, Call, Where, accesses, walk
from ..functions.frontend import Stencil, halo_of

# Loads up to which a body is narrow, and wide (beyond it is very wide), and the
# operations per byte from which a sweep is bound by arithmetic.
NARROW, WIDE = 16, 64
COMPUTE_BOUND = 10.0


def flops(stencil: Stencil) -> int:
    """Additions, multiplications, divisions, extrema, absolute values and selects; negation,
    comparison and constants are free."""
    count = 0
    for n in walk(stencil.body):
        if isinstance(n, Bin | Where) or (isinstance(n, Call) and n.name != "neg"):
            count += 1
    return count


def describe(stencil: Stencil) -> dict[str, Any]:
    loads = stencil.loads
    size = 8 if stencil.dtype == "double" else 4
    offsets = {a.offset for a in loads}
    n, work = len(loads), flops(stencil)
    intensity = work / ((len(offsets) + 1) * size)
    return {
        "name": stencil.name,
        "ndim": stencil.ndim,
        "order": stencil.order,
        "dtype": stencil.dtype,
        "halo": ",".join(map(str, stencil.halo)),
        "fields": ",".join(stencil.fields),
        "flops": work,
        "unique_loads": n,
        "unique_offsets": len(offsets),
        "intensity": round(intensity, 6),
        "bound": "compute" if intensity >= COMPUTE_BOUND else "memory",
        "tier": "narrow" if n <= NARROW else "wide" if n <= WIDE else "very wide",
    }


def describe_frame(spark: SparkSession, stencils: list[Stencil]) -> DataFrame:
    kinds = (
        "name string, ndim int, order int, dtype string, halo string, fields string, flops int, "
        "unique_loads int, unique_offsets int, intensity double, bound string, tier string"
    )
    return spark.createDataFrame([tuple(describe(s).values()) for s in stencils], kinds)


def temporal_depth(halo: tuple[int, ...], block: tuple[int, ...], budget_bytes: int, most: int = 8, dtype_bytes: int = 8) -> int:
    """The most sweeps T (1 at least) that one exchange may serve: a block widened by T halos on
    each side, held twice, stays within the budget."""
    for t in range(most, 1, -1):
        cells = 1
        for h, b in zip(halo, block, strict=True):
            cells *= b + 2 * t * h
        if 2 * cells * dtype_bytes <= budget_bytes:
            return t
    return 1


def fusion_groups(stencils: list[Stencil], one_domain: bool = False) -> list[list[str]]:
    """Stencils that share a field, directly or through others, by name.

    Stencils of ``one_domain`` may share a sweep even without a common field: all those of one
    number of dimensions and one dtype are a group.
    """
    groups: list[tuple[set[object], list[str]]] = []
    for s in stencils:
        # What ties stencils together: their fields, or else the domain itself.
        ties: set[object] = {(s.ndim, s.dtype)} if one_domain else {(s.ndim, s.dtype, f) for f in s.fields}
        names, rest = [s.name], []
        for t, n in groups:
            if t & ties:
                ties, names = ties | t, n + names
            else:
                rest.append((t, n))
        groups = [*rest, (ties, names)]
    return [n for _, n in groups]


def fused_name(names: list[str]) -> str:
    """Fixed rule: up to three names joined, else the first and how many others."""
    return "_".join(names) if len(names) <= 3 else f"{names[0]}_and_{len(names) - 1}_others"


def check_fusable(stencils: list[Stencil]) -> tuple[int, ...]:
    """The widest halo of stencils that may share a sweep; raises if they may not."""
    if len({s.name for s in stencils}) != len(stencils):
        raise ValueError("fused stencils need distinct names")
    if len({(s.ndim, s.dtype) for s in stencils}) != 1:
        raise ValueError("fused stencils need one number of dimensions and one dtype")
    return halo_of([s.body for s in stencils], stencils[0].ndim)


__all__ = ["accesses", "check_fusable", "describe", "describe_frame", "flops", "fused_name", "fusion_groups", "temporal_depth"]
