"""The expression tree of a stencil body, and its evaluation with NumPy."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Node:
    @property
    def parts(self) -> tuple[Node, ...]:
        return ()


@dataclass(frozen=True)
class Access(Node):
    """A field read at a constant offset from the current cell."""

    field: str
    offset: tuple[int, ...]


@dataclass(frozen=True)
class Const(Node):
    value: float


@dataclass(frozen=True)
class Coord(Node):
    """The current cell's coordinate along one axis (extended bodies only)."""

    axis: int


@dataclass(frozen=True)
class Bin(Node):
    op: str  # + - * /
    left: Node
    right: Node

    @property
    def parts(self) -> tuple[Node, ...]:
        return (self.left, self.right)


@dataclass(frozen=True)
class Call(Node):
    """neg, abs, max, min; also sqrt, exp, log, sin, cos, pow in extended bodies."""

    name: str
    args: tuple[Node, ...]

    @property
    def parts(self) -> tuple[Node, ...]:
        return self.args


@dataclass(frozen=True)
class Cmp(Node):
    op: str
    left: Node
    right: Node

    @property
    def parts(self) -> tuple[Node, ...]:
        return (self.left, self.right)


@dataclass(frozen=True)
class Where(Node):
    test: Node
    then: Node
    other: Node

    @property
    def parts(self) -> tuple[Node, ...]:
        return (self.test, self.then, self.other)


def walk(node: Node) -> Iterator[Node]:
    yield node
    for p in node.parts:
        yield from walk(p)


def rebuild(node: Node, change: Callable[[Node], Node]) -> Node:
    """``node`` with ``change`` applied to every node, children first."""
    if isinstance(node, Bin | Cmp):
        node = replace(node, left=rebuild(node.left, change), right=rebuild(node.right, change))
    elif isinstance(node, Call):
        node = replace(node, args=tuple(rebuild(a, change) for a in node.args))
    elif isinstance(node, Where):
        node = Where(*(rebuild(p, change) for p in node.parts))
    return change(node)


def _divide(a: float, b: float) -> float:
    if b:
        return a / b
    if a == 0 or math.isnan(a):
        return math.nan
    return math.copysign(math.inf, a) * math.copysign(1.0, b)


ARITHMETIC: dict[str, Callable[[float, float], float]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": _divide,
}


def fold(node: Node) -> Node:
    """Constant parts computed in double precision; the shape of the rest is kept."""

    def one(n: Node) -> Node:
        if not n.parts or not all(isinstance(p, Const) for p in n.parts):
            return n
        v = [p.value for p in n.parts]
        if isinstance(n, Bin):
            return Const(ARITHMETIC[n.op](*v))
        if isinstance(n, Call) and n.name in ("neg", "abs"):
            return Const(-v[0] if n.name == "neg" else abs(v[0]))
        if isinstance(n, Call) and n.name in ("max", "min"):
            return Const(math.nan if any(map(math.isnan, v)) else (max if n.name == "max" else min)(v))
        return n

    return rebuild(node, one)


def accesses(*nodes: Node) -> list[Access]:
    """Distinct reads, in order of first use."""
    return list(dict.fromkeys(n for node in nodes for n in walk(node) if isinstance(n, Access)))


def evaluate(node: Node, read: Callable[[Access], Any], coord: Callable[[int], Any] | None = None) -> Any:
    """The value of a tree over NumPy arrays; ``read`` gives each access's array."""
    import numpy as np

    known: dict[Node, Any] = {}

    def go(n: Node) -> Any:
        if n not in known:
            known[n] = compute(n)
        return known[n]

    def compute(n: Node) -> Any:
        if isinstance(n, Access):
            return read(n)
        if isinstance(n, Const):
            return n.value
        if isinstance(n, Coord):
            return coord(n.axis)
        v = [go(p) for p in n.parts]
        if isinstance(n, Bin):
            return {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide}[n.op](*v)
        if isinstance(n, Cmp):
            return {
                ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, "==": np.equal, "!=": np.not_equal,
            }[n.op](*v)
        if isinstance(n, Where):
            return np.where(*v)
        functions = {
            "neg": np.negative, "abs": np.abs, "max": np.maximum, "min": np.minimum,
            "sqrt": np.sqrt, "exp": np.exp, "log": np.log, "sin": np.sin, "cos": np.cos, "pow": np.power,
        }
        return functions[n.name](*v)

    with np.errstate(all="ignore"):
        return go(node)


__all__ = ["Access", "Bin", "Call", "Cmp", "Const", "Coord", "Node", "Where", "accesses", "evaluate", "fold", "rebuild", "walk"]
