"""A grid that a stream of events fills: cells by key and event time, kept in the stream's state.

Each event adds to the cell of its key and its unit of time.  Spark holds the counts of the cells
that are still open as state, by key and time, and gives those that a micro-batch has changed.  The
batch writes them under its own number, and sweeps the blocks that they can reach; other blocks
stay as they are.  A batch that is run again writes the same.

An event is late if its whole unit of time lies before the watermark, which is the latest time seen
before the batch less the delay.  Late events change nothing; the stream's progress counts them
(as cells: events of one key and unit in one task count once).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frontend import Stencil
from ..operators.bricks import block_names
from ..operators.grid import GridFrame
from ..operators.incremental import dense_blocks, swept_blocks, touched_blocks


@dataclass
class LiveGrid:
    """Where a stream's cells and the swept surface are: ``folder``/cells and ``folder``/surface.

    ``extents``: first and last key, and first and last unit of time, counted from ``origin``; cells
    beyond them are kept but not swept.
    """

    spark: SparkSession
    folder: str
    extents: tuple[tuple[int, int], tuple[int, int]]
    update: Mapping[str, Stencil]
    steps: int = 1
    side: int = 64
    #: Cells that came too late, over the runs of this object.
    late: int = field(default=0, init=False)

    dims = ("i", "j")

    def meta(self, df: DataFrame) -> GridFrame:
        return GridFrame(df, self.dims, ("u",), bounds=self.extents)

    def cells(self, upto: int | None = None) -> DataFrame:
        """The latest count of each cell, as of a batch if given."""
        rows = self.spark.read.schema("i bigint, j int, u double, batch bigint").parquet(f"{self.folder}/cells")
        rows = rows if upto is None else rows.where(F.col("batch") <= upto)
        return rows.groupBy(*self.dims).agg(F.max_by("u", "batch").alias("u"))

    def surface(self) -> DataFrame:
        """The swept cells of all blocks that were ever reached."""
        return self.spark.read.schema("i bigint, j int, n double, u double, b_i bigint, b_j bigint").parquet(f"{self.folder}/surface")

    def on_batch(self, changes: DataFrame, number: int) -> None:
        """Store the changed cells, and sweep what they reach."""
        put = changes.select("i", "j", F.col("n").cast("double").alias("u"), F.lit(number).cast("bigint").alias("batch"))
        put.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.folder}/cells")
        rows = self.spark.read.schema("i bigint, j int, u double, batch bigint").parquet(f"{self.folder}/cells")
        changed = rows.where(F.col("batch") == number)
        if changed.isEmpty():
            return
        blocks = touched_blocks(changed, self.meta(changed.select("i", "j", "u")), self.update, self.steps, self.side)
        state = dense_blocks(self.meta(self.cells(number)), blocks, self.side)
        both = GridFrame(state.df.withColumn("n", F.col("u")), self.dims, ("n", "u"), bounds=self.extents)
        fresh = swept_blocks(both, self.update, self.steps, blocks, self.side)
        names = dict(zip(block_names(both), ("b_i", "b_j"), strict=True))
        fresh.withColumnsRenamed(names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("b_i", "b_j").parquet(f"{self.folder}/surface")

    def run(self, events: DataFrame, key: str, time: str, unit: int = 86_400, origin: int = 1_704_067_200, delay: str = "2 days") -> int:
        """Take what a stream of events has that is new, and end; the number of batches.

        ``unit``: the seconds of a unit of time; ``origin``: the second of the epoch at which unit 0
        begins (2024 in UTC unless given), a whole number of units.  The session's time zone plays no part.
        The stream's place and state are in ``folder``/checkpoint, from which a later run goes on.
        """
        open_ = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
        counts = open_.groupBy(F.window(time, f"{unit} seconds").alias("w"), F.col(key).alias("i")).agg(F.count(F.lit(1)).alias("n"))
        cells = counts.select("i", F.floor((F.unix_seconds("w.start") - origin) / unit).cast("int").alias("j"), "n")
        stream = cells.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint")
        query = stream.foreachBatch(self.on_batch).trigger(availableNow=True).start()
        query.awaitTermination()
        progress: list[Any] = list(query.recentProgress)
        self.late += sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
        return len(progress)


__all__ = ["LiveGrid"]
