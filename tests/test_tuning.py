"""The measured choice of plan, and what a plan refuses."""

from __future__ import annotations

import gridloom
import pytest
from gridloom.operators.grid import GridFrame
from gridloom.plans import catalogue as cat
from gridloom.plans import tuning
from gridloom.plans.tuning import TuneConfig, candidates, measured_plans, sample_box, tuned

SMALL = TuneConfig(cells=2000, warmup=0, iters=1)


@pytest.fixture(scope="module")
def grid(spark):
    cells = spark.range(120 * 50).selectExpr("id div 50 + 7 AS i", "id % 50 AS j", "CAST(id % 97 AS DOUBLE) AS u")
    return GridFrame(cells, ("i", "j"), ("u",))


def test_candidates():
    assert candidates({"u": cat.heat_2d}) == ["window", "scatter", "join", "brick"]
    assert candidates({"u": cat.box(1, 2)}) == ["scatter", "brick"]
    assert candidates({"u": cat.box(2, 3)}) == ["brick"]
    assert candidates({"u": cat.EXTENDED}) == ["window", "scatter", "join"]
    with pytest.raises(ValueError, match="no box"):
        TuneConfig(ratio=1)


def test_boxes_lie_in_the_middle(grid):
    box = sample_box(grid, 1500)
    assert box == {"i": (37, 96), "j": (12, 36)}
    assert sample_box(grid, 10**9) == {"i": (7, 126), "j": (0, 49)}


def test_the_fastest_stands_first_and_is_kept(spark, grid, monkeypatch, tmp_path):
    cost = {"window": (0.5, 1e-5), "scatter": (0.1, 9e-4), "join": (3.0, 1e-6), "brick": (0.4, 5e-5)}
    clock = [0.0]
    monkeypatch.setattr(tuning.time, "perf_counter", lambda: clock[0])

    class Timed:
        """Stands for a sweep whose time follows its cells."""

        def __init__(self, part, plan):
            self.part, self.plan = part, plan

        df = property(lambda self: self)
        write = property(lambda self: self)

        def format(self, _):
            return self

        def mode(self, _):
            return self

        def save(self):
            fixed, cell = cost[self.plan]
            clock[0] += fixed + cell * self.part.df.count()

    monkeypatch.setattr(tuning, "fused", lambda part, outputs, plan: Timed(part, plan))
    got = measured_plans(grid, {"u": cat.heat_2d}, SMALL)
    assert [t.plan for t in got] == ["window", "brick", "join", "scatter"]  # of 6,000 cells; the sample alone has the scatter first
    for t in got:
        assert t.fixed_s == pytest.approx(cost[t.plan][0]) and t.cell_s == pytest.approx(cost[t.plan][1])
        assert t.whole_s == pytest.approx(cost[t.plan][0] + 6000 * cost[t.plan][1])
    assert tuned(gridloom.compile(cat.heat_2d), grid, SMALL).plan == "window"
    tuning.keep(spark, got, "heat", f"{tmp_path}/figures")
    figures = spark.read.parquet(f"{tmp_path}/figures")
    assert figures.count() == 4 and tuning.kept_plan(figures, "heat") == "window" and tuning.kept_plan(figures, "other") is None


def test_it_runs(grid):
    got = measured_plans(grid, {"u": cat.box(1, 2)}, SMALL)
    assert {t.plan for t in got} == {"scatter", "brick"} and all(t.whole_s > 0 for t in got)


@pytest.mark.parametrize("options, message", [
    ({"plan": "fast"}, "plan 'fast'"), ({"halo": "wrap"}, "halo 'wrap'"), ({"steps": 0}, "steps"), ({"parts": 0}, "parts"), ({"side": -1}, "side"), ({"axis": 2}, "axis 2 of 2"),
    ({"halo": "drop", "steps": 2}, "keep the halo"), ({"bc": "sticky"}, "boundary kind 'sticky'"),
])
def test_bad_options_are_named(options, message):
    with pytest.raises(ValueError, match=message):
        gridloom.compile(cat.heat_2d, **options)
