"""Grids from tables and from expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import GridFrame


def grid_of(df: DataFrame, dims: tuple[str, ...], fields: tuple[str, ...], batch: tuple[str, ...] = (), **kw) -> GridFrame:
    return GridFrame(df, dims, fields, batch, **kw)


def make_grid(spark: SparkSession, shape: tuple[int, ...], value: Column, dims: tuple[str, ...] = ("i", "j", "k"), field: str = "u") -> GridFrame:
    """A dense grid of the given shape; ``value`` is an expression over the index columns."""
    total = 1
    for n in shape:
        total *= n
    df, names = spark.range(total), dims[: len(shape)]
    rest = F.col("id")
    for n, d in zip(reversed(shape), reversed(names), strict=True):
        df = df.withColumn(d, F.pmod(rest, F.lit(n)))
        rest = F.floor(rest / n)
    # The index columns come from one id, innermost axis fastest.
    bounds = tuple((0, n - 1) for n in shape)
    return GridFrame(df.withColumn(field, value.cast("double")), names, (field,), bounds=bounds)


def random_grid(spark: SparkSession, shape: tuple[int, ...], seed: int = 0, dims: tuple[str, ...] = ("i", "j", "k"), fields: tuple[str, ...] = ("u",)) -> GridFrame:
    """A dense grid of uniform values in [0, 1) with 52 bits, which depend on the seed, the field and
    the cell only, however the rows are partitioned."""
    grid = make_grid(spark, shape, F.lit(0.0), dims)
    at = F.concat_ws(",", *[F.col(d).cast("string") for d in grid.dims])

    def value(f: str) -> Column:
        digest = F.md5(F.concat(F.lit(f"{seed}:{f}:"), at).cast("binary"))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))

    return grid.with_df(grid.df.select(*grid.dims, *[value(f).alias(f) for f in fields]), fields)


def read_grid(spark: SparkSession, path: str, dims: tuple[str, ...], fields: tuple[str, ...], batch: tuple[str, ...] = ()) -> GridFrame:
    """Cells from Parquet; only the named columns are read."""
    return GridFrame(spark.read.parquet(path).select(*batch, *dims, *fields), dims, fields, batch)


def write_grid(grid: GridFrame, path: str, mode: str = "errorifexists") -> None:
    grid.df.write.mode(mode).parquet(path)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> GridFrame:
    return GridFrame(_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS i", "o_totalprice AS u"), ("i",), ("u",))


def customers(spark: SparkSession, sf_dir: str) -> GridFrame:
    return GridFrame(_table(spark, sf_dir, "customer").selectExpr("c_custkey AS i", "c_acctbal AS u"), ("i",), ("u",))


def embeddings(spark: SparkSession, sf_dir: str, kind: str = "double") -> GridFrame:
    df = _table(spark, sf_dir, "embeddings").selectExpr("vec_id AS i", "posexplode(embedding) AS (j, u)")
    return GridFrame(df.selectExpr("i", "j", f"CAST(u AS {kind}) AS u"), ("i", "j"), ("u",))


def lineitem_box(spark: SparkSession, sf_dir: str) -> GridFrame:
    """Quantity by discount by tax; sparse at small sizes.  u: rows, v and w: price extrema."""
    df = _table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_quantity AS INT) - 1 AS i", "CAST(round(l_discount * 100) AS INT) AS j", "CAST(round(l_tax * 100) AS INT) AS k", "l_extendedprice AS p"
    )
    df = df.groupBy("i", "j", "k").agg(F.count(F.lit(1)).cast("double").alias("u"), F.max("p").alias("v"), F.min("p").alias("w"))
    return GridFrame(df, ("i", "j", "k"), ("u", "v", "w"))


def user_days(spark: SparkSession, sf_dir: str) -> GridFrame:
    """Events by user and day; sparse.  u: rows, v: the largest value."""
    df = _table(spark, sf_dir, "events").selectExpr("user_id AS i", "datediff(CAST(ts AS DATE), DATE'2024-01-01') AS j", "value")
    df = df.groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("u"), F.max("value").cast("double").alias("v"))
    return GridFrame(df, ("i", "j"), ("u", "v"))


def lines_by_quantity(spark: SparkSession, sf_dir: str) -> GridFrame:
    """A batch of one-dimensional grids: for each line number the largest price by quantity."""
    df = _table(spark, sf_dir, "lineitem").selectExpr("CAST(l_linenumber AS INT) AS b", "CAST(l_quantity AS INT) AS i", "l_extendedprice AS p")
    return GridFrame(df.groupBy("b", "i").agg(F.max("p").alias("u")), ("i",), ("u",), ("b",))
