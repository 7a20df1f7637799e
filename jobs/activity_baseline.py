"""Activity and its baseline: for each kind of event, user and day what happened and what was to be expected.

Events become a grid for each kind of event, user by day.  The days of each user are smoothed by
some sweeps along the time axis with a reflecting boundary; what is left over is the excess.  Each
step's total, energy and largest change are measured on the way.

Output: ``surface`` (user_id, day, n, expected, excess; one folder for each event_type) and
``measures`` (event_type, step, mass, energy, change, n_cells).  A run replaces both, so running it
again gives the same.

Events without user or time are left out and counted in the log; a kind of event that is null or
empty is ``unknown``.  An empty table gives empty output.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import Any

from gridloom.functions.frontend import from_text
from gridloom.operators.boundary import BoundarySpec
from gridloom.operators.brickframe import march_bricks
from gridloom.operators.grid import GridFrame
from gridloom.plans.lineage import shared_dir
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import command, config_of, counted, log

DEFAULTS = __file__.removesuffix(".py") + ".json"
SMOOTH = from_text("smooth", "0.25 * u[i, j-1] + 0.5 * u[i, j] + 0.25 * u[i, j+1]")
#: The days' boundary; users have no neighbours.
ENDS = BoundarySpec((None, BoundarySpec.reflecting(1).sides[0]))
SURFACE = "user_id bigint, day int, n bigint, expected double, excess double, event_type string"
MEASURES = "event_type string, step int, mass double, energy double, change double, n_cells bigint"


def activity(events: DataFrame, first_day: str) -> DataFrame:
    """Counts by event_type, i (user) and j (day), with every day of the table for each user who was active at all."""
    kind = F.coalesce(F.nullif("event_type", F.lit("")), F.lit("unknown"))
    day = F.datediff(F.col("ts").cast("date"), F.lit(first_day).cast("date"))
    counts = events.select(kind.alias("event_type"), F.col("user_id").alias("i"), day.alias("j")).where("i IS NOT NULL AND j IS NOT NULL")
    counts = counts.groupBy("event_type", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("j").alias("lo"), F.max("j").alias("hi"))  # one row
    users = counts.select("event_type", "i").distinct().join(F.broadcast(ends))
    cells = users.select("event_type", "i", F.explode(F.sequence("lo", "hi")).alias("j"))
    return cells.join(counts, ["event_type", "i", "j"], "left").na.fill(0, ["n"])


def run(spark: SparkSession, events: str, out: str, config: Mapping[str, Any] | None = None) -> dict[str, int]:
    """Write the activity of a table of events, its baseline and the excess."""
    c = config_of(DEFAULTS, config)
    read, wrote = Observation(f"read-{uuid.uuid4().hex}"), Observation(f"wrote-{uuid.uuid4().hex}")
    source = spark.read.parquet(events).select("event_type", "user_id", "ts")
    source = source.observe(read, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("user_id").isNull() | F.col("ts").isNull(), 1)).alias("left_out"))
    cells = activity(source, c["first_day"]).select("event_type", "i", "j", F.col("n").cast("double").alias("n"), F.col("n").cast("double").alias("u"))
    cells.write.parquet(held := f"{shared_dir(spark)}/activity-{uuid.uuid4().hex}")  # the events are read once
    grid = GridFrame(spark.read.schema(cells.schema).parquet(held), ("i", "j"), ("n", "u"), ("event_type",))
    log.info("read %s: %d rows, of which %d without user or time", events, counted(read, "rows"), counted(read, "left_out"))
    days = grid.extents[1][1] - grid.extents[1][0] + 1
    if days < 3:  # too few days to smooth
        after, measures = grid, None
    else:
        after, measures, exchanges = march_bricks(
            grid, {"u": SMOOTH}, c["steps"], bc=ENDS, per_exchange=c["per_exchange"], sides=(c["users_per_brick"], days), measure=True, tolerance=c["tolerance"], bounded=("u",)
        )
        log.info("smoothed over %d days in %d exchanges", days, exchanges)
    rows = after.df.select(
        F.col("i").cast("bigint").alias("user_id"), F.col("j").alias("day"), F.col("n").cast("bigint").alias("n"), F.col("u").alias("expected"),
        (F.col("n") - F.col("u")).alias("excess"), "event_type",
    ).observe(wrote, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").partitionBy("event_type").parquet(f"{out}/surface")
    steps = spark.createDataFrame([], MEASURES) if measures is None else measures.select("event_type", "step", "mass", "energy", "change", "n_cells")
    steps.write.mode("overwrite").parquet(f"{out}/measures")
    log.info("wrote %s/surface: %d rows, and %s/measures", out, counted(wrote, "rows"), out)
    return {"read": counted(read, "rows"), "left_out": counted(read, "left_out"), "wrote": counted(wrote, "rows")}


def output(spark: SparkSession, out: str) -> DataFrame:
    """All that a run has written: rows of the surface and, with the step, the measures."""
    surface = spark.read.schema(SURFACE).parquet(f"{out}/surface")
    return surface.unionByName(spark.read.schema(MEASURES).parquet(f"{out}/measures"), allowMissingColumns=True)


def job1_activity_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the whole table into one new folder, and what is there afterwards."""
    out = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, f"{sf_dir}/events.parquet", out)
    return output(spark, out)


def oracle_sql() -> str:
    """The output with the job's own settings, in DuckDB's SQL."""
    from gridloom.plans.oracles import exact_sum

    c = config_of(DEFAULTS)
    steps, named = [], []
    for n in range(1, c["steps"] + 1):
        old = f"g{n - 1}"
        steps.append(
            f"s{n} AS MATERIALIZED (SELECT c.* REPLACE (CASE WHEN c.j > e.lo AND c.j < e.hi THEN 0.25::DOUBLE * a.u + 0.5::DOUBLE * c.u + 0.25::DOUBLE * b.u ELSE c.u END AS u) "
            f"FROM {old} c CROSS JOIN e LEFT JOIN {old} a ON (a.event_type, a.i, a.j) = (c.event_type, c.i, c.j - 1) LEFT JOIN {old} b ON (b.event_type, b.i, b.j) = (c.event_type, c.i, c.j + 1))"
        )
        mirror = "CASE WHEN c.j = e.lo THEN e.lo + 1 WHEN c.j = e.hi THEN e.hi - 1 ELSE c.j END"
        steps.append(f"g{n} AS MATERIALIZED (SELECT c.* REPLACE (m.u AS u) FROM s{n} c CROSS JOIN e JOIN s{n} m ON (m.event_type, m.i) = (c.event_type, c.i) AND m.j = {mirror})")
        named.append(
            f"SELECT event_type, {n}::INTEGER AS step, {exact_sum('g.u', 50)} AS mass, {exact_sum('g.u * g.u', 50)} AS energy, max(abs(g.u - o.u)) AS change, count(*) AS n_cells "
            f"FROM g{n} g JOIN {old} o USING (event_type, i, j) CROSS JOIN e WHERE j > e.lo AND j < e.hi GROUP BY event_type"
        )
    return f"""
WITH counts AS MATERIALIZED (
  SELECT coalesce(nullif(event_type, ''), 'unknown') AS event_type, user_id AS i, CAST(CAST(ts AS DATE) - DATE '{c["first_day"]}' AS INTEGER) AS j, count(*) AS n
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
e AS (SELECT min(j) AS lo, max(j) AS hi FROM counts),
days AS (SELECT CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS j FROM e),
g0 AS MATERIALIZED (
  SELECT event_type, i, j, coalesce(n, 0) AS n, coalesce(n, 0)::DOUBLE AS u
  FROM (SELECT DISTINCT event_type, i FROM counts) CROSS JOIN days LEFT JOIN counts USING (event_type, i, j)),
{", ".join(steps)}
SELECT i AS user_id, j AS day, n, u AS expected, n - u AS excess, event_type FROM g{c["steps"]}
UNION ALL BY NAME {" UNION ALL BY NAME ".join(named)}
"""


if __name__ == "__main__":
    command(run, DEFAULTS, {"events": "table of events (Parquet)", "out": "folder of the output"})
