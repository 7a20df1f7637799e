"""Stencils in SQL: a table function that sweeps a table of cells.

``register_sweep`` makes a view of a grid's cells with the blocks that they are in or border, and a
function over it.  In SQL a sweep is then a relation as any other:

    SELECT i, j, u FROM heat(TABLE(heat_cells)) WHERE u > 0

The function asks for its rows by block, so Spark shuffles the view once and calls it for each block;
what it gives is what the ``brick`` plan gives.  Views over such a query make results into tables.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, udtf
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from ..operators.bricks import SIDES, block_function, block_names, with_blocks
from ..operators.grid import GridFrame
from .frontend import Stencil

TYPES = {"int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "float": FloatType()}


def register_sweep(spark: SparkSession, name: str, grid: GridFrame, outputs: Mapping[str, Stencil], steps: int = 1, side: int | None = None) -> str:
    """Register the table function ``name`` and the view ``name``_cells; returns the SELECT of one call.

    ``outputs``: columns to stencils; several steps need outputs that are fields.  Batches and index
    columns are whole numbers.  The halo keeps the first field's value.
    """
    from ..plans.analysis import check_fusable
    from ..operators.sweep import renamed_to

    width = check_fusable([renamed_to(n, s) for n, s in outputs.items()])
    if steps > 1 and set(outputs) - set(grid.fields):
        raise ValueError("several steps need outputs that are fields")
    side = max(side or SIDES[len(grid.dims)], 2 * steps * max((*width, 1)))
    kinds = dict(grid.df.dtypes)
    unknown = {k: kinds[k] for k in grid.keys if kinds[k] not in ("int", "bigint")}
    if unknown:
        raise TypeError(f"batches and index columns are int or bigint here, not {unknown}")
    names = block_names(grid)
    with_blocks(grid.df, grid, side, tuple(steps * w for w in width)).createOrReplaceTempView(f"{name}_cells")
    schema = StructType([StructField(k, TYPES[kinds[k]]) for k in grid.keys] + [StructField(n, TYPES[s.dtype]) for n, s in outputs.items()])
    run = block_function(grid, {n: s.plain() for n, s in outputs.items()}, width, steps=steps, side=side)
    columns, places = [*grid.keys, *grid.fields], [*grid.batch, *names]
    arrow = {f.name: f.dataType for f in grid.df.schema.fields}

    class Sweep:
        @staticmethod
        def analyze(cells: AnalyzeArgument) -> AnalyzeResult:
            if not cells.isTable:
                raise ValueError(f"{name} takes a table: {name}(TABLE({name}_cells))")
            have = {f.name for f in cells.dataType.fields}
            if missing := [c for c in (*columns, *names) if c not in have]:
                raise ValueError(f"the table has no column {missing}; {name}_cells has them")
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(c) for c in places])

        def __init__(self) -> None:
            self.rows: dict[str, list[Any]] = {c: [] for c in (*columns, *names)}

        def eval(self, row: Any) -> None:
            for c, held in self.rows.items():
                held.append(row[c])

        def terminate(self):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type

            if self.rows[columns[0]]:
                key = tuple(pa.scalar(self.rows[c][0]) for c in places)
                table = pa.table({c: pa.array(self.rows[c], to_arrow_type(arrow[c])) for c in columns})
                yield from zip(*(c.to_pylist() for c in run(key, table).columns), strict=True)

    spark.udtf.register(name, udtf(Sweep))
    return f"SELECT * FROM {name}(TABLE({name}_cells))"


__all__ = ["register_sweep"]
