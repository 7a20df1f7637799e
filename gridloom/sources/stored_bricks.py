"""Grids stored as bricks, in zones that a scan can leave out and buckets that a sweep can stay in.

A stored grid is a folder: ``bricks`` holds the bricks, one folder for each zone (a box of bricks)
and in it a file for each bucket of places; ``layout`` holds one row that says how.  A box of the
grid reads the files of the zones that it meets.  Sweeps over the stored bricks ship faces only,
since the bricks of a bucket are where their buckets' slabs go.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.brickframe import BrickFrame, Layout
from ..operators.grid import GridFrame


def _zones(layout: Layout, zone: int) -> list[str]:
    return [f"z_{d}" for d in layout.dims]


def write_bricks(grid: GridFrame, path: str, sides: tuple[int, ...] | int | None = None, zone: int = 4, buckets: int | None = None) -> None:
    """Write a grid as bricks; ``zone`` is how many bricks along each axis share a folder.

    The folder must be new.  ``buckets``: as many as there are shuffle partitions unless given.
    """
    spark = grid.df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bricks, layout = BrickFrame.packed(grid, sides)
    zones = _zones(layout, zone)
    df = bricks.withColumns({z: F.floor(F.col(f"b_{d}") / zone).cast("int") for z, d in zip(zones, layout.dims, strict=True)})
    name = f"gridloom_stored_{uuid.uuid4().hex}"
    df.write.format("parquet").partitionBy(*zones).bucketBy(buckets, *layout.keys).option("path", f"{path}/bricks").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table has a path of its own
    known = {"dims": layout.dims, "fields": layout.fields, "batch": layout.batch, "extents": layout.extents, "kinds": dict(layout.kinds), "sides": layout.sides}
    text = json.dumps(known | {"zone": zone, "buckets": buckets, "schema": grid.df.schema.jsonValue()})
    spark.range(1).select(F.lit(text).alias("layout")).write.parquet(f"{path}/layout")


def open_bricks(spark: SparkSession, path: str, box: Mapping[str, tuple[int, int]] | None = None, halo: tuple[int, ...] | None = None) -> BrickFrame:
    """A stored grid, or the bricks of it that a box widened by ``halo`` meets."""
    from pyspark.sql.types import StructType

    m = json.loads(spark.read.schema("layout string").parquet(f"{path}/layout").first()["layout"])
    dims = tuple(m["dims"])
    extents = tuple((lo, hi) for lo, hi in m["extents"])
    layout = Layout(dims, tuple(m["fields"]), tuple(m["batch"]), extents, m["kinds"], tuple(m["sides"]))
    zones = _zones(layout, m["zone"])
    name = f"gridloom_stored_{uuid.uuid4().hex}"
    columns = ", ".join([layout.schema(False), *[f"`{z}` int" for z in zones]])
    keys = ", ".join(f"`{k}`" for k in layout.keys)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}/bricks') PARTITIONED BY ({', '.join(f'`{z}`' for z in zones)}) "
        f"CLUSTERED BY ({keys}) INTO {m['buckets']} BUCKETS"
    )
    spark.catalog.recoverPartitions(name)
    df: DataFrame = spark.table(name)
    for x, d in enumerate(dims):
        if box and d in box:
            df = df.where(_within(d, box[d], (halo or (0,) * len(dims))[x], extents[x][0], layout.sides[x], m["zone"]))
    kept = [f.split("`")[1] if "`" in f else f.split()[0] for f in layout.schema(False).split(", ")]
    like = GridFrame(spark.createDataFrame([], StructType.fromJson(m["schema"])), dims, layout.fields, layout.batch, extents)
    return BrickFrame(df.select(*kept), layout, like, name, f"{path}/bricks")


def _within(d: str, box: tuple[int, int], halo: int, lo: int, side: int, zone: int) -> Column:
    """A test of the folders, and of the bricks in them."""
    first, last = (box[0] - halo - lo) // side, (box[1] + halo - lo) // side
    return F.col(f"z_{d}").between(first // zone, last // zone) & F.col(f"b_{d}").between(first, last)


__all__ = ["open_bricks", "write_bricks"]
