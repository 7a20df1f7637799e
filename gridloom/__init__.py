"""Grid, stencil and training-data analytics as Spark plans.

Names are loaded when they are first asked for, so that workers import only what they run.
"""

from __future__ import annotations

import importlib
from typing import Any

#: Public names and the modules that hold them.
EXPORTS = {
    "BoundarySpec": "operators.boundary", "GridFrame": "operators.grid", "Pipeline": "plans.compiled", "RungeKutta": "operators.march",
    "Side": "operators.boundary", "Stencil": "functions.frontend", "StencilError": "functions.frontend", "StencilPlan": "plans.compiled",
    "apply": "operators.sweep", "apply_boundary": "operators.boundary", "compile": "plans.compiled", "compile_fused": "plans.compiled",
    "compile_groups": "plans.compiled", "from_text": "functions.frontend", "fused": "operators.sweep", "make_grid": "sources.tables",
    "march": "operators.march", "march_blocked": "operators.march", "march_parts": "operators.decompose", "maximum": "functions.elementwise",
    "minimum": "functions.elementwise", "random_grid": "sources.tables", "read_grid": "sources.tables", "stencil": "functions.frontend",
    "where": "functions.elementwise", "write_grid": "sources.tables",
}
__all__ = sorted(EXPORTS)


def __getattr__(name: str) -> Any:
    if name not in EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{EXPORTS[name]}"), name)


def __dir__() -> list[str]:
    return [*globals(), *EXPORTS]
