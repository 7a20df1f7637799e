"""Tables in the folder that driver and executors share, which cut the lineage of iterated plans."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _temporary() -> str:
    return "file://" + tempfile.mkdtemp(prefix="gridloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session has none and runs in one process (``local[...]``), as in tests, a temporary
    folder is made; on any cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _temporary()


def cut(df: DataFrame, name: str = "grid") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems hold it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*frames: DataFrame) -> None:
    """Delete the folders of frames that ``cut`` has returned.

    Only for frames that nothing reads any more: later tables are written, so no lost executor
    asks for them again.
    """
    for df in frames:
        files = df.inputFiles()
        if files:
            remove(df.sparkSession, files[0].rsplit("/", 1)[0])


__all__ = ["cut", "forget", "remove", "shared_dir"]
