"""Events that stream into a grid: in random order and batches, over restarts, and too late."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from gridloom.functions.frontend import from_text
from gridloom.streaming.cells import LiveGrid
from pyspark.sql import functions as F

UP = {"u": from_text("up", "0.25 * u[i, j-1] + 0.5 * u[i, j] + 0.125 * (u[i-1, j] + u[i+1, j])")}
USERS, DAYS, START = 20, 16, datetime(2024, 1, 1)


def made(seed, n=300):
    rng = random.Random(seed)
    rows = sorted(((rng.randrange(USERS), START + timedelta(hours=rng.randrange(24 * DAYS), minutes=rng.randrange(60))) for _ in range(n)), key=lambda r: r[1])
    # Out of order by less than a day and a half.
    return sorted(rows, key=lambda r: r[1] + timedelta(hours=rng.randrange(36)))


def put(spark, rows, folder):
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def surface(live):
    return {(r["i"], r["j"]): (r["n"], r["u"]) for r in live.surface().collect()}


def plain(rows, steps, side):
    n = np.zeros((USERS, DAYS))
    for (i, j), c in Counter((u, (t - START).days) for u, t in rows).items():
        n[i, j] = c
    u = n
    for _ in range(steps):
        v = u.copy()
        v[1:-1, 1:-1] = 0.25 * u[1:-1, :-2] + 0.5 * u[1:-1, 1:-1] + 0.125 * (u[:-2, 1:-1] + u[2:, 1:-1])
        u = v
    reach = {(a // side, b // side) for i, j in zip(*np.nonzero(n)) for a in range(i - steps, i + steps + 1) for b in range(j - steps, j + steps + 1)}
    return {(i, j): (n[i, j], u[i, j]) for i in range(USERS) for j in range(DAYS) if (i // side, j // side) in reach}


@pytest.mark.parametrize("seed, files", [(1, 1), (2, 4)])
def test_replayed_events_give_the_batch_grid(spark, tmp_path, seed, files):
    rows = made(seed)
    live = LiveGrid(spark, f"{tmp_path}/live", ((0, USERS - 1), (0, DAYS - 1)), UP, steps=2, side=4)
    stream = lambda: spark.readStream.schema("user_id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    for k in range(files):  # each run goes on from the checkpoint
        put(spark, rows[k * len(rows) // files : (k + 1) * len(rows) // files], f"{tmp_path}/events")
        live.run(stream(), "user_id", "ts")
    assert surface(live) == plain(rows, 2, 4) and live.late == 0
    before = surface(live)
    live.run(stream(), "user_id", "ts")  # nothing new
    assert surface(live) == before


def test_late_events_are_counted_and_change_nothing(spark, tmp_path):
    rows = made(3)
    live = LiveGrid(spark, f"{tmp_path}/live", ((0, USERS - 1), (0, DAYS - 1)), UP, side=8)
    stream = lambda: spark.readStream.schema("user_id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    put(spark, rows, f"{tmp_path}/events")
    live.run(stream(), "user_id", "ts")
    before = surface(live)
    put(spark, [(4, START), (5, START + timedelta(days=1)), (None, START), (6, None)], f"{tmp_path}/events")  # long before the watermark
    live.run(stream(), "user_id", "ts")
    assert live.late == 2 and surface(live) == before
    put(spark, [(4, START + timedelta(days=DAYS - 1))], f"{tmp_path}/events")  # within the delay
    live.run(stream(), "user_id", "ts")
    assert live.late == 2 and surface(live) == plain([*rows, (4, START + timedelta(days=DAYS - 1))], 1, 8)


def test_only_reached_blocks_are_written(spark, tmp_path):
    live = LiveGrid(spark, f"{tmp_path}/live", ((0, USERS - 1), (0, DAYS - 1)), UP, side=4)
    stream = lambda: spark.readStream.schema("user_id bigint, ts timestamp").parquet(f"{tmp_path}/events")
    put(spark, [(1, START + timedelta(days=14)), (17, START + timedelta(days=14))], f"{tmp_path}/events")
    live.run(stream(), "user_id", "ts")
    first = {f: f.stat().st_mtime_ns for f in (tmp_path / "live/surface").rglob("*.parquet")}
    put(spark, [(2, START + timedelta(days=14))], f"{tmp_path}/events")
    live.run(stream(), "user_id", "ts")
    same = {f for f in (tmp_path / "live/surface").rglob("*.parquet") if first.get(f) == f.stat().st_mtime_ns}
    assert same and all("b_i=4" in str(f) or "b_i=3" in str(f) for f in same)
    assert live.surface().where(F.col("n") > 0).count() == 3
