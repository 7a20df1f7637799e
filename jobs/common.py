"""What the jobs share: config files, logging, sessions of the command line, tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

log = logging.getLogger("jobs")


def config_of(defaults: str, given: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The config file beside a job, with the given values in place of its own; unknown names are errors."""
    config = json.loads(Path(defaults).read_text())
    unknown = set(given or {}) - set(config)
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}; known are {sorted(config)}")
    return config | dict(given or {})


def table_at(spark: SparkSession, path: str, schema: str, *partitions: str) -> DataFrame:
    """A Parquet table, made empty if nothing has been written there."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*partitions).parquet(path)
    return spark.read.schema(schema).parquet(path)


def counted(seen: Observation, name: str) -> int:
    """What an observation has counted: 0 if the input was empty, since Spark then drops the observed plan."""
    try:
        return seen.get.get(name, 0)
    except Py4JJavaError as e:
        if "assertion failed" not in str(e.java_exception):
            raise
        return 0


def command(run: Callable[..., Any], defaults: str, paths: Mapping[str, str]) -> None:
    """Parse the paths and the config of a job, run it in a session of its own, and stop that."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    for name, what in paths.items():
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--config", help="JSON file of settings that differ from the job's own")
    parser.add_argument("--scratch", help="folder that driver and executors share (spark.checkpoint.dir)")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    config = config_of(defaults, json.loads(Path(args.config).read_text()) if args.config else None)
    builder = SparkSession.builder.appName(Path(defaults).stem)
    if args.scratch:
        builder = builder.config("spark.checkpoint.dir", args.scratch)
    spark = builder.getOrCreate()
    try:
        run(spark, **{n: getattr(args, n) for n in paths}, config=config)
    finally:
        spark.stop()
