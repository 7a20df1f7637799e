"""Where a corpus lies in the plane of text length and word spacing: a smoothed density that grows with the corpus.

For each language the plane is a grid: the row follows a text's length (``chars_per_row`` code
points each; the last row holds all longer ones), the column the mean distance of its spaces in
quarters of a character (the last column holds all wider ones).  A few sweeps of heat smooth the
counts.  Odd corners of the plane are where junk is found.

The job is incremental.  A file stream takes the files that are new since the last run; each of its
batches adds its counts to ``deltas`` in a folder of its own, which a repeated batch overwrites.
Tiles of the plane that new counts can reach are swept again and replaced in ``surface`` (lang, i,
j, n, density; one folder for each language and tile).  Other tiles are not touched.  At the end the
last batch is noted in ``marks``; a run that fails before does its tiles again.

Running it again without new files changes nothing.  The stream's checkpoint belongs to the output:
keep or remove both.  Null texts count as empty, null and empty languages as ``unknown``.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import Any

from gridloom.functions.frontend import from_text
from gridloom.operators.bricks import block_names
from gridloom.operators.grid import GridFrame
from gridloom.operators.incremental import dense_blocks, reach_of, swept_blocks, touched_blocks
from gridloom.plans.lineage import shared_dir
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import command, config_of, counted, log, table_at

DEFAULTS = __file__.removesuffix(".py") + ".json"
HEAT = from_text("heat", "0.5 * density[i, j] + 0.125 * (density[i-1, j] + density[i+1, j] + density[i, j-1] + density[i, j+1])")
UPDATE = {"density": HEAT}
DELTAS = "lang string, i int, j int, n bigint, batch bigint"
SURFACE = "i int, j int, n bigint, density double, lang string, tile int"


def cells(docs: DataFrame, c: Mapping[str, Any]) -> DataFrame:
    """The counts (lang, i, j, n) of texts."""
    text = F.coalesce("text", F.lit(""))
    chars, gaps = F.length(text), F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    where = docs.select(F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown")).alias("lang"), chars.alias("chars"), gaps.alias("gaps"))
    i = F.expr(f"CAST(least(chars div {c['chars_per_row']}, {c['rows'] - 1}) AS INT)")
    j = F.expr(f"CAST(least(4 * chars div (gaps + 1), {c['columns'] - 1}) AS INT)")
    return where.groupBy("lang", i.alias("i"), j.alias("j")).agg(F.count(F.lit(1)).alias("n"))


def pattern(path: str) -> str:
    """A path as a pattern, which a file stream takes whether it is one file or a folder of files."""
    path = path.rstrip("/")
    return path if any(x in path for x in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def take(spark: SparkSession, documents: str, out: str, checkpoint: str, c: Mapping[str, Any]) -> int:
    """Add the counts of new files to the deltas; the number of documents that were new."""
    taken = 0

    def add(batch: DataFrame, number: int) -> None:
        nonlocal taken
        seen = Observation(f"taken-{uuid.uuid4().hex}")
        counts = cells(batch.observe(seen, F.count(F.lit(1)).alias("rows")), c).withColumn("batch", F.lit(number).cast("bigint"))
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/deltas")
        taken += counted(seen, "rows")

    stream = spark.readStream.schema("text string, lang string").option("maxFilesPerTrigger", c["files_per_batch"]).parquet(pattern(documents))
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()
    query.awaitTermination()
    return taken


def plane(deltas: DataFrame, c: Mapping[str, Any], blocks: DataFrame) -> GridFrame:
    """All cells of the blocks and of those next to them, with what is counted there."""
    totals = deltas.groupBy("lang", "i", "j").agg(F.sum("n").cast("double").alias("n")).withColumn("density", F.col("n"))
    extents = ((0, c["rows"] - 1), (0, c["columns"] - 1))
    return dense_blocks(GridFrame(totals, ("i", "j"), ("n", "density"), ("lang",), extents), blocks, c["tile"])


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: Mapping[str, Any] | None = None) -> dict[str, int]:
    """Bring the density of a growing corpus up to date."""
    c = config_of(DEFAULTS, config)
    taken = take(spark, documents, out, checkpoint, c)
    log.info("read %s: %d new documents", documents, taken)
    deltas = table_at(spark, f"{out}/deltas", DELTAS, "batch")
    last, done = (of.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0] for of in (deltas, table_at(spark, f"{out}/marks", "batch bigint")))
    if last <= done:
        log.info("nothing new since batch %d: %s/surface stays as it is", done, out)
        return {"read": taken, "wrote": 0}
    meta = GridFrame(deltas.selectExpr("lang", "i", "j", "CAST(n AS DOUBLE) AS density"), ("i", "j"), ("density",), ("lang",), ((0, c["rows"] - 1), (0, c["columns"] - 1)))
    changed = deltas.where(F.col("batch") > done)
    blocks = touched_blocks(changed, meta, UPDATE, c["steps"], c["tile"])
    fresh = swept_blocks(plane(deltas, c, blocks), UPDATE, c["steps"], blocks, c["tile"])
    across = -(-c["columns"] // c["tile"])
    tile = (F.col(block_names(meta)[0]) * across + F.col(block_names(meta)[1])).cast("int")
    wrote = Observation(f"wrote-{uuid.uuid4().hex}")
    rows = fresh.select("i", "j", F.col("n").cast("bigint").alias("n"), "density", "lang", tile.alias("tile"))
    rows = rows.observe(wrote, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang", "tile").parquet(f"{out}/surface")
    spark.range(1).select(F.lit(last).cast("bigint").alias("batch")).write.mode("append").parquet(f"{out}/marks")
    n = counted(wrote, "rows")
    log.info("wrote %s/surface: %d cells in the tiles that batches %d to %d reach", out, n, done + 1, last)
    return {"read": taken, "wrote": n}


def output(spark: SparkSession, out: str) -> DataFrame:
    """The surface as it stands."""
    return spark.read.schema(SURFACE).parquet(f"{out}/surface")


def job2_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the whole table with one new folder and checkpoint, and what is there afterwards."""
    at = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/checkpoint")
    return output(spark, f"{at}/out")


def oracle_sql() -> str:
    """The surface with the job's own settings, in DuckDB's SQL."""
    from gridloom.plans.sql import sweep_sql

    c = config_of(DEFAULTS)
    t, across, (reach, _) = c["tile"], -(-c["columns"] // c["tile"]), reach_of(UPDATE, c["steps"])
    steps = [f"g{n} AS MATERIALIZED ({sweep_sql(f'g{n - 1}', ('i', 'j'), ('n', 'density'), ('lang',), UPDATE, keep_fields=True)})" for n in range(1, c["steps"] + 1)]
    near = " AND ".join(f"k.{d} BETWEEN (g.{d} // {t}) * {t} - {reach} AND (g.{d} // {t}) * {t} + {t - 1 + reach}" for d in "ij")
    return f"""
WITH sizes AS (
  SELECT coalesce(nullif(lang, ''), 'unknown') AS lang, length(coalesce(text, '')) AS chars, length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS gaps
  FROM documents),
counts AS MATERIALIZED (
  SELECT lang, CAST(least(chars // {c["chars_per_row"]}, {c["rows"] - 1}) AS INTEGER) AS i, CAST(least(4 * chars // (gaps + 1), {c["columns"] - 1}) AS INTEGER) AS j, count(*) AS n
  FROM sizes GROUP BY ALL),
g0 AS MATERIALIZED (
  SELECT lang, i, j, coalesce(n, 0) AS n, coalesce(n, 0)::DOUBLE AS density FROM (SELECT DISTINCT lang FROM counts)
  CROSS JOIN (SELECT CAST(unnest(range({c["rows"]})) AS INTEGER) AS i) CROSS JOIN (SELECT CAST(unnest(range({c["columns"]})) AS INTEGER) AS j) LEFT JOIN counts USING (lang, i, j)),
{", ".join(steps)}
SELECT i, j, n, density, lang, CAST((i // {t}) * {across} + j // {t} AS INTEGER) AS tile FROM g{c["steps"]} g
WHERE EXISTS (SELECT 1 FROM counts k WHERE k.lang = g.lang AND {near})
"""


if __name__ == "__main__":
    command(run, DEFAULTS, {"documents": "documents (Parquet): a folder that grows by files, or a pattern", "out": "folder of the output", "checkpoint": "folder of the stream's checkpoint"})
