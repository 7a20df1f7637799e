"""Expression trees to Spark columns and to SQL text.

Arithmetic is IEEE, as NumPy does it: division by zero gives an infinity or NaN whatever the ANSI
setting, and max and min pass NaN on.  ``strict=False`` leaves the NaN guards out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Access, Bin, Call, Cmp, Const, Coord, Node, Where

SQL_NAMES = {"sqrt": "sqrt", "exp": "exp", "log": "ln", "sin": "sin", "cos": "cos", "pow": "pow"}


def _finite_divisor(node: Node) -> bool:
    return isinstance(node, Const) and node.value != 0


def to_column(node: Node, read: Callable[[Access], Column], coord: Callable[[int], Column] | None = None, dtype: str = "double", strict: bool = True) -> Column:
    """The Spark column of a tree; every literal has the stencil's own type."""
    nan = F.lit(math.nan).cast(dtype)

    def go(n: Node) -> Column:
        if isinstance(n, Access):
            return read(n)
        if isinstance(n, Const):
            return F.lit(n.value).cast(dtype)
        if isinstance(n, Coord):
            return coord(n.axis).cast(dtype)
        v = [go(p) for p in n.parts]
        if isinstance(n, Bin):
            a, b = v
            if n.op != "/":
                return {"+": a + b, "-": a - b, "*": a * b}[n.op]
            if _finite_divisor(n.right):
                return (a / b).cast(dtype)
            minus = b.cast("string").startswith("-")  # tells -0.0 from 0.0
            inf = F.when((a > 0) != minus, F.lit(math.inf)).otherwise(F.lit(-math.inf)).cast(dtype)
            by_zero = F.when(F.isnan(a) | (a == 0), nan).otherwise(inf)
            return F.when(a.isNull() | b.isNull(), None).when(b != 0, (a / F.when(b != 0, b)).cast(dtype)).otherwise(by_zero)
        if isinstance(n, Cmp):
            a, b = v
            plain = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b, "!=": a != b}[n.op]
            if not strict:
                return plain
            odd = F.isnan(a) | F.isnan(b)  # ordered comparisons of NaN are false, != is true
            return F.when(odd, F.lit(n.op == "!=")).otherwise(plain)
        if isinstance(n, Where):
            test, then, other = v
            return F.when(test.isNull(), None).when(test, then).otherwise(other)
        if n.name in ("max", "min"):
            a, b = v
            picked = (F.greatest if n.name == "max" else F.least)(a, b)
            none = a.isNull() | b.isNull()  # greatest and least skip nulls; a missing cell does not
            out = F.when(none, None)
            return (out.when(F.isnan(a) | F.isnan(b), nan) if strict else out).otherwise(picked)
        functions = {"neg": lambda x: -x, "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "sin": F.sin, "cos": F.cos, "pow": F.pow}
        return functions[n.name](*v).cast(dtype)

    return go(node)


def to_sql(node: Node, read: Callable[[Access], str], coord: Callable[[int], str] | None = None, dtype: str = "DOUBLE") -> str:
    """SQL text with the tree's own grouping, for engines whose division is IEEE (DuckDB)."""

    def go(n: Node) -> str:
        if isinstance(n, Access):
            return read(n)
        if isinstance(n, Const):
            return f"CAST({n.value!r} AS {dtype})" if math.isfinite(n.value) else f"CAST('{n.value}' AS {dtype})"
        if isinstance(n, Coord):
            return f"CAST({coord(n.axis)} AS {dtype})"
        v = [go(p) for p in n.parts]
        if isinstance(n, Bin | Cmp):
            return f"({v[0]} {'=' if n.op == '==' else '<>' if n.op == '!=' else n.op} {v[1]})"
        if isinstance(n, Where):
            return f"(CASE WHEN {v[0]} IS NULL THEN NULL WHEN {v[0]} THEN {v[1]} ELSE {v[2]} END)"
        if n.name in ("max", "min"):
            f = "greatest" if n.name == "max" else "least"
            return f"(CASE WHEN {v[0]} IS NULL OR {v[1]} IS NULL THEN NULL ELSE {f}({v[0]}, {v[1]}) END)"
        if n.name == "neg":
            return f"(-{v[0]})"
        return f"{SQL_NAMES.get(n.name, n.name)}({', '.join(v)})"

    return go(node)
