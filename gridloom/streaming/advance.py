"""A grid that a stream of step requests advances, some sweeps for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.frontend import Stencil
from ..operators.boundary import apply_boundary
from ..operators.grid import GridFrame
from ..operators.sweep import apply
from ..plans.lineage import cut, remove, shared_dir


class StreamedGrid:
    """The state of a grid after each micro-batch, written under the batch's id in one folder.

    A batch starts from the state that the batch before it has written, and overwrites its own.  So
    a batch that is run again, in this process or in one that goes on from the checkpoint, gives the
    same state.  States older than the one before are deleted.
    """

    def __init__(self, grid: GridFrame, stencil: Stencil, folder: str, bc: object = None):
        self.grid, self.stencil, self.folder, self.bc = grid, stencil, folder.rstrip("/"), bc
        self.spark: SparkSession = grid.df.sparkSession
        self.schema, self.extents = grid.df.schema, grid.extents
        self.latest = -1

    def path(self, batch_id: int) -> str:
        return f"{self.folder}/state-{batch_id}"

    def state(self, batch_id: int) -> GridFrame:
        """The grid after a batch; -1 is the grid as it was given."""
        return self.grid if batch_id < 0 else self.grid.with_df(self.spark.read.schema(self.schema).parquet(self.path(batch_id)))

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """One sweep for each row of the batch."""
        now = self.state(batch_id - 1)
        steps = batch.count()
        for n in range(steps):
            now = apply(now, self.stencil)
            if self.bc is not None:
                now = apply_boundary(now, self.bc, self.stencil.halo)
            if n < steps - 1:
                now = now.with_df(cut(now.df))
        now.df.write.mode("overwrite").parquet(self.path(batch_id))
        self.latest = batch_id
        if batch_id >= 2:
            remove(self.spark, self.path(batch_id - 2))


def march_by_stream(grid: GridFrame, stencil: Stencil, steps: int, bc: object = None, folder: str | None = None) -> GridFrame:
    """``steps`` sweeps, driven by the micro-batches of a stream with one file for each step.

    States and the stream's checkpoint are in ``folder``, a new one in the shared folder unless given.
    """
    spark: SparkSession = grid.df.sparkSession
    requests = cut(spark.range(steps).repartition(max(1, steps), "id").selectExpr("id AS step"), "step-requests")
    path = requests.inputFiles()[0].rsplit("/", 1)[0] if steps else None
    if path is None:
        return grid
    state = StreamedGrid(grid, stencil, folder or f"{shared_dir(spark)}/stream-{path.rsplit('-', 1)[-1]}", bc)
    stream = spark.readStream.schema("step bigint").option("maxFilesPerTrigger", 1).parquet(path)
    query = stream.writeStream.option("checkpointLocation", f"{state.folder}/checkpoint").foreachBatch(state.on_batch).trigger(availableNow=True).start()
    query.awaitTermination()
    return state.state(state.latest)
