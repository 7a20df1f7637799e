"""Sweeps after few changes equal full sweeps, and read only what the changes can reach."""

from __future__ import annotations

import random

import pytest
from gridloom.operators.bricks import with_blocks
from gridloom.operators.grid import GridFrame
from gridloom.operators.incremental import resweep, swept_blocks, touched_blocks
from gridloom.operators.march import march
from gridloom.plans import catalogue as cat
from pyspark.sql import functions as F

UP = {"u": cat.laplacian_2d_9pt}


def frame(spark, cells):
    return GridFrame(spark.createDataFrame([(b, i, j, v) for (b, i, j), v in cells.items()], "b int, i int, j int, u double"), ("i", "j"), ("u",), ("b",), ((0, 39), (0, 29)))


def rows(g):
    return sorted(map(tuple, g.df.select("b", "i", "j", "u").na.fill(-9e99, ["u"]).collect()))


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_full_sweep(spark, seed):
    rng = random.Random(seed)
    steps = 1 + seed % 3
    old = {(b, i, j): rng.uniform(-1, 1) for b in range(2) for i in range(40) for j in range(30) if rng.random() < 0.97}
    new = dict(old)
    changed = set()
    for _ in range(rng.choice([0, 1, 6])):
        at = (0, rng.randrange(40), rng.randrange(30))
        changed.add(at)
        if at in new and rng.random() < 0.3:
            del new[at]
        else:
            new[at] = rng.uniform(5, 6)
    before, after = frame(spark, old), frame(spark, new)
    keys = spark.createDataFrame(sorted(changed), "b int, i int, j int")
    full = march(before, UP, steps)
    got = resweep(full.df, after, keys, UP, steps, side=12)
    assert rows(got) == rows(march(after, UP, steps))


def test_the_work_follows_the_changes(spark):
    cells = {(0, i, j): 1.0 for i in range(40) for j in range(30)}
    g = frame(spark, cells)
    changed = spark.createDataFrame([(0, 20, 15)], "b int, i int, j int")
    blocks = touched_blocks(changed, g, UP, 1, 5)
    assert {(r["_b0"], r["_b1"]) for r in blocks.collect()} == {(x, y) for x in (3, 4) for y in (2, 3)}
    near = with_blocks(g.df, g, 5, (2, 2)).join(blocks, ["b", "_b0", "_b1"], "left_semi")
    assert near.count() == 4 * 9 * 9  # four blocks of 5 with two cells of margin, of 1,200 cells
    assert swept_blocks(g, UP, 1, blocks, 5).count() == 4 * 25
    with pytest.raises(ValueError, match="too small"):
        swept_blocks(g, UP, 2, blocks, 5)


def test_no_change_no_work(spark):
    g = frame(spark, {(0, i, j): float(i) for i in range(40) for j in range(30)})
    none = g.df.select("b", "i", "j").limit(0)
    assert touched_blocks(none, g, UP, 1, 8).isEmpty() and rows(resweep(g.df, g, none, UP, 1, 8)) == rows(g)
    assert g.df.where(F.col("u").isNull()).count() == 0
