"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    own = low.select("u", F.col("m").alias("v"))
    return down.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) of 64-bit ids to (id, root): the smallest id of each node's component.

    Only nodes with an edge appear; roots too.  Each round is written to the shared folder.  A
    minimum is taken by grouped aggregation, so a node with very many edges is no hot group.
    """
    now = saved(edges.where("u <> v").select("u", "v").distinct(), "cc-edges")
    state = None
    for _ in range(rounds):
        before, now = now, saved(_small(_large(now).where("u <> v").distinct()).where("u <> v").distinct(), "cc-edges")
        forget(before)
        # Order-free fingerprint of the edges: equal twice in a row means that nothing moved.
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return leaves.union(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
