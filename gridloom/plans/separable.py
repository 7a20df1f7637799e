"""Wide linear stencils as sums of products of short ones: a pass along each axis in place of a box.

The weights of a linear body are an array over its offsets.  Singular values split it axis by axis
into a sum of products of vectors; where few are needed, a pass along the last axis makes the inner
sums, the next pass combines them along the axis before, and so on.  A box of 125 equal or bell-shaped
weights has one term, so 15 reads do instead of 125.

The sums are the same up to rounding, not bit for bit, so this is a plan to ask for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from ..functions.expr import Access, Bin, Call, Const, Node
from ..functions.frontend import Stencil, from_text
from ..operators.grid import GridFrame
from ..operators.sweep import fused


def linear_weights(body: Node) -> dict[tuple[str, tuple[int, ...]], float] | None:
    """The weight of each (field, offset) of a body that is linear without a constant part, else None."""

    def go(n: Node) -> tuple[dict, float] | None:
        if isinstance(n, Access):
            return {(n.field, n.offset): 1.0}, 0.0
        if isinstance(n, Const):
            return {}, n.value
        if isinstance(n, Call) and n.name == "neg":
            a = go(n.args[0])
            return a and ({k: -v for k, v in a[0].items()}, -a[1])
        if not isinstance(n, Bin):
            return None
        a, b = go(n.left), go(n.right)
        if a is None or b is None:
            return None
        if n.op in "+-":
            sign = 1.0 if n.op == "+" else -1.0
            return {k: a[0].get(k, 0.0) + sign * b[0].get(k, 0.0) for k in {**a[0], **b[0]}}, a[1] + sign * b[1]
        if n.op == "*" and (not a[0] or not b[0]):
            (of, _), c = (b, a[1]) if not a[0] else (a, b[1])
            return {k: v * c for k, v in of.items()}, a[1] * b[1]
        if n.op == "/" and not b[0] and b[1]:
            return {k: v / b[1] for k, v in a[0].items()}, a[1] / b[1]
        return None

    out = go(body)
    return None if out is None or out[1] else out[0]


@dataclass(frozen=True)
class Term:
    """A vector along one axis, times what is inside: terms along the axes behind it."""

    weights: tuple[float, ...]
    inner: tuple[Term, ...]


def terms_of(weights: np.ndarray, tolerance: float) -> tuple[Term, ...]:
    """An array as a sum of terms along its first axis; smaller singular values than the tolerance's share go."""
    if weights.ndim == 1:
        return (Term(tuple(weights.tolist()), ()),)
    u, s, v = np.linalg.svd(weights.reshape(len(weights), -1), full_matrices=False)
    kept = [k for k in range(len(s)) if s[k] > tolerance * max(s[0], 1e-300)]
    return tuple(Term(tuple((u[:, k] * s[k]).tolist()), terms_of(v[k].reshape(weights.shape[1:]), tolerance)) for k in kept)


def reads_of(terms: tuple[Term, ...]) -> int:
    return sum(np.count_nonzero(t.weights) + reads_of(t.inner) for t in terms)


@dataclass(frozen=True)
class Passes:
    """Stages of one-axis sweeps; the last one has the output."""

    field: str
    stages: list[dict[str, Stencil]]
    reads: int
    instead_of: int


def passes(stencil: Stencil, tolerance: float = 1e-13) -> Passes | None:
    """The passes of a stencil, or None: if it is not linear in one field, or if they read no less."""
    found = linear_weights(stencil.body)
    if not found or stencil.ndim < 2 or len({f for f, _ in found}) != 1:
        return None
    field = next(iter(found))[0]
    reach = stencil.halo
    weights = np.zeros([2 * h + 1 for h in reach])
    for (_, offset), w in found.items():
        weights[tuple(o + h for o, h in zip(offset, reach, strict=True))] = w
    terms = terms_of(weights, tolerance)
    reads = reads_of(terms)
    if reads >= len(found):
        return None
    dims = "ijk"[: stencil.ndim]
    stages: list[dict[str, Stencil]] = [{} for _ in dims]

    def text(name: str, axis: int, w: tuple[float, ...]) -> list[str]:
        at = [", ".join(f"{d}{o - reach[axis]:+d}" if x == axis and o != reach[axis] else d for x, d in enumerate(dims)) for o in range(len(w))]
        return [f"{c!r} * {name}[{a}]" for c, a in zip(w, at, strict=True) if c]

    def build(terms: tuple[Term, ...], axis: int, name: str) -> None:
        """The field ``name`` from the fields of what is inside."""
        parts = []
        for k, t in enumerate(terms):
            inner = field if not t.inner else f"{name}_{k}"
            if t.inner:
                build(t.inner, axis + 1, inner)
            parts += text(inner, axis, t.weights)
        stages[stencil.ndim - 1 - axis][name] = from_text(name, " + ".join(parts), dtype={"double": "float64", "float": "float32"}[stencil.dtype])

    build(terms, 0, "_part")
    return Passes(field, stages, reads, len(found))


def sweep_separable(grid: GridFrame, stencil: Stencil, out: str | None = None, halo: str = "keep", tolerance: float = 1e-13) -> GridFrame:
    """One sweep in passes along the axes; raises where the stencil has no shorter passes.

    Interior, halo and missing neighbours are as in ``fused``, but that a neighbour of weight 0 inside
    the box counts as read.
    """
    plan = passes(stencil, tolerance)
    if plan is None:
        raise ValueError(f"{stencil.name} has no passes with fewer reads")
    now, out = grid, out or stencil.fields[0]
    for stage in plan.stages:
        now = fused(now, stage, plan="window", keep_fields=True)
    inside, kind = grid.interior(stencil.halo), stencil.dtype
    value = F.col("_part").cast(kind)
    df = now.df.where(inside) if halo == "drop" else now.df
    if halo != "drop":
        value = F.when(inside, value).otherwise((F.col(plan.field) if halo == "keep" else F.lit(0.0)).cast(kind))
    return grid.with_df(df.select(*grid.keys, value.alias(out)), (out,))


__all__ = ["Passes", "linear_weights", "passes", "sweep_separable", "terms_of"]
