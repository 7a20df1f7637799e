"""Passes along the axes against the whole box."""

from __future__ import annotations

import numpy as np
import pytest
from gridloom.functions.frontend import from_text
from gridloom.operators.grid import GridFrame
from gridloom.operators.sweep import apply
from gridloom.plans import catalogue as cat
from gridloom.plans.separable import linear_weights, passes, sweep_separable, terms_of
from pyspark.sql import functions as F


def test_weights_of_linear_bodies():
    s = from_text("s", "-(2.0 * u[i-1, j] - u[i, j] / 4.0) + 3.0 * (u[i, j] + 0.5 * u[i+1, j+1]) - u[i-1, j]")
    assert linear_weights(s.body) == {("u", (-1, 0)): -3.0, ("u", (0, 0)): 3.25, ("u", (1, 1)): 1.5}
    for text in ("u[i] * u[i+1]", "u[i] + 1.0", "max(u[i], 0.0)", "1.0 / u[i]"):
        assert linear_weights(from_text("t", text).body) is None


def test_terms_sum_up_to_the_weights():
    rng = np.random.default_rng(1)

    def total(terms):
        return sum(np.multiply.outer(np.array(t.weights), total(t.inner)) if t.inner else np.array(t.weights) for t in terms)

    for shape in ((5, 3), (3, 4, 5)):
        w = rng.standard_normal(shape)
        assert np.allclose(total(terms_of(w, 1e-13)), w, atol=1e-13)
    blur = np.array([1.0, 2, 3, 2, 1])
    (one,) = terms_of(np.multiply.outer(blur, np.multiply.outer(blur, blur)), 1e-13)
    assert len(one.inner) == 1 and len(one.inner[0].inner) == 1


def test_only_where_it_saves_reads():
    assert passes(cat.bell(2, 3)).reads == 15 and passes(cat.bell(2, 3)).instead_of == 125
    assert passes(cat.box(2, 3)) is None or passes(cat.box(2, 3)).reads < 125
    for s in (cat.heat_1d, cat.cond_3d, cat.product_flux, cat.laplacian_2d_5pt):
        assert passes(s) is None
    with pytest.raises(ValueError, match="no passes"):
        sweep_separable(None, cat.laplacian_2d_5pt)


@pytest.mark.parametrize("halo", ["keep", "zero", "drop"])
@pytest.mark.parametrize("gaps", [False, True])
def test_equals_the_whole_box_up_to_rounding(spark, halo, gaps):
    cells = spark.range(2 * 9 * 8 * 7).selectExpr("CAST(id div 504 AS INT) AS b", "id % 504 div 56 AS i", "id % 56 div 7 AS j", "CAST(id % 7 AS INT) AS k", "sin(id * 1.7) * 100 AS u")
    g = GridFrame(cells.where("id % 97 <> 5") if gaps else cells, ("i", "j", "k"), ("u",), ("b",))
    for s in (cat.bell(1, 3), cat.bell(2, 3)):
        a, b = apply(g, s, halo=halo).df, sweep_separable(g, s, halo=halo).df
        both = a.withColumnRenamed("u", "x").join(b.withColumnRenamed("u", "y"), ["b", "i", "j", "k"], "full_outer")
        r = both.agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("d"), F.count(F.when(F.col("x").isNull() != F.col("y").isNull(), 1)).alias("odd"), F.count("x").alias("n")).first()
        assert r["d"] <= 1e-12 and r["odd"] == 0 and a.count() == b.count() and r["n"] > 0


def test_fewer_exchanges_than_reads(spark):
    g = GridFrame(spark.range(1000).selectExpr("id div 100 AS i", "id % 100 div 10 AS j", "id % 10 AS k", "CAST(id AS DOUBLE) AS u"), ("i", "j", "k"), ("u",), bounds=((0, 9),) * 3)
    plan = sweep_separable(g, cat.bell(2, 3)).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Window") <= 6
