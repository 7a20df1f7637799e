"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each stratum (source) are shuffled by a seeded digest and ranked; a row's fractional rank
is (rank + 1/2) / stratum size.  Sorting all rows by it spreads every stratum evenly over the
order, and cutting the order into equal runs gives shards that each hold the corpus mixture.

Neither the rank within a stratum nor the global position may need one task for a hot stratum.
Both come from ``ranked``: rows fall into cells of a uniform key, the cells' counts (a small
table) give each cell's first rank, and only the rows of a cell are ranked together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one ranking cell should hold.
CELL_ROWS = 4096
#: Fractional ranks are integers below 2^FRAC_BITS; their products fit 64 bits up to 2^35 rows a stratum.
FRAC_BITS = 27


def ranked(df: DataFrame, group: list[str], cell: Column, order: list[Column], name: str) -> DataFrame:
    """Add the 0-based rank of each row within ``group``, ordered by (cell, order).

    ``cell`` must be monotone in the wanted order.  The cell table has one row per group and cell.
    """
    df = df.withColumn("_cell", cell)
    counts = df.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    # A coarse level above the cells, so that no single task meets all cells of a large group.
    block = F.shiftright("_cell", 8)
    blocks = counts.groupBy(*group, block.alias("_block")).agg(F.sum("_n").alias("_bn"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_b0", F.coalesce(F.sum("_bn").over(before), F.lit(0))).drop("_bn")
    inner = Window.partitionBy(*group, "_block").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("_block", block).withColumn(
        "_c0", F.coalesce(F.sum("_n").over(inner), F.lit(0))
    )
    firsts = firsts.join(blocks, [*group, "_block"]).select(
        *group, "_cell", (F.col("_c0") + F.col("_b0")).alias("_first")
    )
    within = Window.partitionBy(*group, "_cell").orderBy(*order)
    return (
        df.withColumn("_r", F.row_number().over(within))
        .join(firsts, [*group, "_cell"])
        .withColumn(name, F.col("_first") + F.col("_r") - 1)
        .drop("_cell", "_r", "_first")
    )


def assign_shards(
    docs: DataFrame,
    n_shards: int = 24,
    seed: str = "gridloom",
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "source",
    rows: int | None = None,
) -> DataFrame:
    """Deal every row to one of ``n_shards`` shards; counts differ by one at most (law ``rows``).

    Returns doc_id, source, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot
    (gapless from 0 in each shard) and grown_shard (null under this law).

    Null text: size 8 and CRC 0.  Null stratum: a stratum of its own.  Null ids and repeated rows:
    each row is dealt; rows equal in id, text and stratum are interchangeable.  Very long texts are
    dealt as any other row, whatever their size.  Empty table: empty
    result.  Other columns are ignored, whatever their names.  ``rows`` saves the count if known.
    """
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("source"),
        F.col(stratum_col).isNull().alias("_none"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    slim = slim.withColumn(
        "_key",
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_crc32").cast("binary")),
    )
    n = docs.count() if rows is None else rows
    bits = max(0, min(FRAC_BITS, math.ceil(math.log2(max(1, n) / CELL_ROWS)))) if n else 0
    u = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")  # uniform in [0, 2^32)
    group, order = ["source", "_none"], [F.col("_key"), F.col("doc_id"), F.col("size")]
    own = ranked(slim, group, F.shiftright(u, 32 - bits), order, "_rank")
    sizes = slim.groupBy(*group).agg(F.count(F.lit(1)).alias("_of"))
    # Fractional rank as an integer: exact, so every engine sorts it alike.
    frac = F.expr(f"(2 * _rank + 1) * {1 << (FRAC_BITS - 1)} div _of")
    fractional = own.join(sizes, group).withColumn("_frac", frac)
    every = ranked(
        fractional.withColumn("_all", F.lit(0)), ["_all"], F.shiftright(F.col("_frac"), FRAC_BITS - bits),
        [F.col("_frac"), F.col("source"), F.col("_none"), *order], "_pos",
    )
    shard = F.expr(f"_pos * {n_shards} div {max(1, n)}")
    first = F.expr(f"({max(1, n)} * _s + {n_shards - 1}) div {n_shards}")
    return every.withColumn("_s", shard).select(
        "doc_id",
        F.when(~F.col("_none"), F.col("source")).alias("source"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_s").cast("int").alias("shard"),
        (F.col("_pos") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
