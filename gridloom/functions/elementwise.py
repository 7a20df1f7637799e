"""Stencil functions run as they are, on NumPy arrays: an oracle that shares nothing with the parser.

``where``, ``maximum`` and ``minimum`` are the names that bodies use, for numbers and arrays alike.
"""

from __future__ import annotations

import inspect
import types
from collections.abc import Callable, Mapping
from typing import Any

import numpy as np

from .frontend import Stencil


def where(test: Any, then: Any, other: Any) -> Any:
    """``then`` where the test holds, else ``other``."""
    return np.where(test, then, other)


def maximum(a: Any, b: Any) -> Any:
    """The larger value; NaN passes on."""
    return np.maximum(a, b)


def minimum(a: Any, b: Any) -> Any:
    """The smaller value; NaN passes on."""
    return np.minimum(a, b)


#: What the names of a body mean on arrays.
ON_ARRAYS: dict[str, Callable] = {
    "where": where, "max": maximum, "maximum": maximum, "min": minimum, "minimum": minimum, "abs": np.abs, "fabs": np.abs,
    "sqrt": np.sqrt, "exp": np.exp, "log": np.log, "sin": np.sin, "cos": np.cos, "pow": np.power,
}


class _Index:
    """An index parameter: an offset inside subscripts, the cells' coordinates elsewhere."""

    __array_ufunc__ = None  # arrays leave mixed arithmetic to this class

    def __init__(self, offset: int, values: np.ndarray):
        self.offset, self.values = offset, values

    def _with(self, other: Any, op: Callable) -> Any:
        if type(other) is int and op in (np.add, np.subtract):
            return _Index(int(op(self.offset, other)), op(self.values, other))
        return op(self.values, other.values if isinstance(other, _Index) else other)

    def __add__(self, other: Any) -> Any:
        return self._with(other, np.add)

    __radd__ = __add__

    def __sub__(self, other: Any) -> Any:
        return self._with(other, np.subtract)

    def __mul__(self, other: Any) -> Any:
        return self._with(other, np.multiply)

    __rmul__ = __mul__

    def __truediv__(self, other: Any) -> Any:
        return self._with(other, np.divide)


class _Shifted:
    """An array whose subscripts are offsets; each gives the interior moved by so much."""

    def __init__(self, array: np.ndarray, width: tuple[int, ...]):
        self.array, self.width = array, width

    def __getitem__(self, key: Any) -> np.ndarray:
        offsets = [k.offset for k in (key if isinstance(key, tuple) else (key,))]
        return self.array[tuple(slice(w + o, n - w + o) for o, w, n in zip(offsets, self.width, self.array.shape, strict=True))]


def interior_values(stencil: Stencil, arrays: Mapping[str, np.ndarray], width: tuple[int, ...] | None = None) -> np.ndarray:
    """The original function's values over the interior of dense arrays, by field name."""
    if stencil.fn is None:
        raise ValueError(f"stencil {stencil.name} has no function to run")
    width = width or stencil.halo
    shape = next(iter(arrays.values())).shape
    inner = tuple(n - 2 * w for n, w in zip(shape, width, strict=True))
    names = list(inspect.signature(stencil.fn).parameters)
    fields = {f: _Shifted(arrays[f], width) for f in stencil.fields}
    lines = [(np.arange(n) + w).reshape([-1 if y == x else 1 for y in range(len(inner))]).astype(float) for x, (n, w) in enumerate(zip(inner, width, strict=True))]
    # Parameters end with the indices; a parameter that is never read gets 0.
    indices = {name: _Index(0, line) for name, line in zip(names[-len(inner) :], lines, strict=True)}
    fn = types.FunctionType(stencil.fn.__code__, {**stencil.fn.__globals__, **ON_ARRAYS}, stencil.name, stencil.fn.__defaults__, stencil.fn.__closure__)
    dtype = np.float64 if stencil.dtype == "double" else np.float32
    with np.errstate(all="ignore"):
        return np.broadcast_to(np.asarray(fn(**{n: fields.get(n, indices.get(n, 0.0)) for n in names}), dtype), inner)


def swept(stencil: Stencil, arrays: Mapping[str, np.ndarray], width: tuple[int, ...] | None = None) -> np.ndarray:
    """One sweep with NumPy: the interior is written, the halo keeps the first field's values."""
    width = width or stencil.halo
    out = arrays[stencil.fields[0]].astype(np.float64 if stencil.dtype == "double" else np.float32)
    out[tuple(slice(w, n - w) for w, n in zip(width, out.shape, strict=True))] = interior_values(stencil, arrays, width)
    return out


__all__ = ["interior_values", "maximum", "minimum", "swept", "where"]
