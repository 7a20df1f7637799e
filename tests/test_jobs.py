"""The jobs: what they write, running them again, and input that grows."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from jobs import activity_baseline, text_density
from jobs.common import config_of
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent


# -- text density --------------------------------------------------------------------------------

SETTINGS = {"chars_per_row": 10, "rows": 40, "columns": 24, "tile": 8, "steps": 2}


def plain_density(rows, c):
    counts = Counter()
    for text, lang in rows:
        text = text or ""
        counts[lang or "unknown", min(len(text) // c["chars_per_row"], c["rows"] - 1), min(4 * len(text) // (text.count(" ") + 1), c["columns"] - 1)] += 1
    out = {}
    t = c["tile"]
    for lang in {k[0] for k in counts}:
        n = np.zeros((c["rows"], c["columns"]))
        for (x, i, j), v in counts.items():
            if x == lang:
                n[i, j] = v
        u = n
        for _ in range(c["steps"]):
            v = u.copy()
            v[1:-1, 1:-1] = 0.5 * u[1:-1, 1:-1] + 0.125 * (u[:-2, 1:-1] + u[2:, 1:-1] + u[1:-1, :-2] + u[1:-1, 2:])
            u = v
        hit = {(a // t, b // t) for x, i, j in counts if x == lang for a in range(i - 2, i + 3) for b in range(j - 2, j + 3)}
        out |= {(lang, i, j): (int(n[i, j]), u[i, j]) for i in range(c["rows"]) for j in range(c["columns"]) if (i // t, j // t) in hit}
    return out


FIRST = [("one two three", "en"), ("", "en"), (None, None), ("x" * 5000, "de"), ("a b c d e f g " * 9, ""), ("née 😀 " * 7, "fr")]
SECOND = [("one two three", "en"), ("four words stand here", "fr"), ("y" * 120, "fr")]


def put(spark, rows, folder):
    spark.createDataFrame(rows, "text string, lang string").withColumn("doc_id", F.lit(1)).coalesce(1).write.mode("append").parquet(folder)


def surface(spark, out):
    return {(r["lang"], r["i"], r["j"]): (r["n"], r["density"]) for r in text_density.output(spark, out).collect()}


def files(out):
    return {f: os.stat(f).st_mtime_ns for f in Path(out, "surface").rglob("*.parquet")}


@pytest.fixture
def places(tmp_path):
    return f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/checkpoint"


def test_growing_input(spark, places):
    docs, out, _ = places
    put(spark, FIRST, docs)
    assert text_density.run(spark, *places, SETTINGS)["read"] == len(FIRST)
    assert surface(spark, out) == plain_density(FIRST, SETTINGS)
    first = files(out)
    assert text_density.run(spark, *places, SETTINGS) == {"read": 0, "wrote": 0}  # nothing is new, nothing is written
    assert files(out) == first
    put(spark, SECOND, docs)
    done = text_density.run(spark, *places, SETTINGS)
    assert done["read"] == len(SECOND)  # only what is new
    want = plain_density(FIRST + SECOND, SETTINGS)
    assert surface(spark, out) == want and 0 < done["wrote"] < len(want)
    same = {f for f, t in files(out).items() if first.get(f) == t}
    assert {f for f in first if "lang=de" in str(f)} <= same and len(same) < len(files(out))  # tiles out of reach are not touched


def test_a_run_that_failed_is_made_good(spark, places, monkeypatch):
    docs, out, _ = places
    put(spark, FIRST, docs)
    monkeypatch.setattr(text_density, "swept_blocks", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        text_density.run(spark, *places, SETTINGS)  # after the stream has taken the files
    monkeypatch.undo()
    assert text_density.run(spark, *places, SETTINGS)["read"] == 0
    assert surface(spark, out) == plain_density(FIRST, SETTINGS)


def test_many_files_in_several_batches(spark, places):
    docs, out, _ = places
    for k in range(5):
        put(spark, FIRST[k : k + 2], docs)
    assert text_density.run(spark, *places, SETTINGS | {"files_per_batch": 2})["read"] == 10
    assert text_density.table_at(spark, f"{out}/deltas", text_density.DELTAS, "batch").select("batch").distinct().count() == 3
    assert surface(spark, out) == plain_density([r for k in range(5) for r in FIRST[k : k + 2]], SETTINGS)


def test_no_documents(spark, places):
    docs, out, _ = places
    put(spark, FIRST[:0] or [("x", "en")], docs)
    spark.createDataFrame([], "text string, lang string").write.mode("overwrite").parquet(docs)
    assert text_density.run(spark, *places, SETTINGS)["wrote"] == 0


# -- activity baseline ---------------------------------------------------------------------------


def plain_activity(rows, steps):
    counts = Counter((kind or "unknown", user, day) for kind, user, day in rows if user is not None and day is not None)
    lo, hi = min(k[2] for k in counts), max(k[2] for k in counts)
    out, measures = {}, {}
    for kind in {k[0] for k in counts}:
        users = sorted({k[1] for k in counts if k[0] == kind})
        n = np.array([[counts[kind, u, d] for d in range(lo, hi + 1)] for u in users], float)
        u = n
        for s in range(1, steps + 1):
            v = u.copy()
            v[:, 1:-1] = 0.25 * u[:, :-2] + 0.5 * u[:, 1:-1] + 0.25 * u[:, 2:]
            v[:, 0], v[:, -1] = v[:, 1], v[:, -2]
            inner = v[:, 1:-1]
            measures[kind, s] = inner.sum(), (inner * inner).sum(), np.abs(inner - u[:, 1:-1]).max(), inner.size
            u = v
        out |= {(kind, user, lo + d): (int(n[k, d]), u[k, d], n[k, d] - u[k, d]) for k, user in enumerate(users) for d in range(hi - lo + 1)}
    return out, measures


EVENTS = [("view", u, d) for u in (1, 2, 900) for d in range(0, 12, u % 4 + 1)] + [("buy", 5, 3), ("buy", 5, 3), (None, 7, 11), ("", 7, 4), ("view", None, 3), ("view", 3, None)]


def events(spark, rows, path):
    df = spark.createDataFrame(rows, "event_type string, user_id long, day int")
    df.select("event_type", "user_id", F.expr("TIMESTAMP'2024-01-01 07:00:00' + make_dt_interval(day)").alias("ts")).write.parquet(path)


def test_activity(spark, tmp_path):
    path, out = f"{tmp_path}/events", f"{tmp_path}/out"
    events(spark, EVENTS, path)
    done = activity_baseline.run(spark, path, out)
    want, measures = plain_activity(EVENTS, 4)
    assert done == {"read": len(EVENTS), "left_out": 2, "wrote": len(want)}

    def read():
        rows = activity_baseline.output(spark, out).collect()
        return (
            {(r["event_type"], r["user_id"], r["day"]): (r["n"], r["expected"], r["excess"]) for r in rows if r["step"] is None},
            {(r["event_type"], r["step"]): (r["mass"], r["energy"], r["change"], r["n_cells"]) for r in rows if r["step"] is not None},
        )

    assert read() == (want, measures)
    assert {f.name for f in Path(out, "surface").iterdir() if f.is_dir()} == {"event_type=view", "event_type=buy", "event_type=unknown"}
    activity_baseline.run(spark, path, out)  # again: the same
    assert read() == (want, measures)


def test_activity_of_few_days_and_of_none(spark, tmp_path):
    for k, rows in enumerate(([("view", 1, 3), ("view", 2, 4)], [])):
        events(spark, rows, f"{tmp_path}/events{k}")
        activity_baseline.run(spark, f"{tmp_path}/events{k}", f"{tmp_path}/out{k}")
        got = activity_baseline.output(spark, f"{tmp_path}/out{k}") if rows else None
        assert not rows or sorted((r["user_id"], r["day"], r["n"], r["excess"]) for r in got.collect()) == [(1, 3, 1, 0.0), (1, 4, 0, 0.0), (2, 3, 0, 0.0), (2, 4, 1, 0.0)]


# -- both ----------------------------------------------------------------------------------------


def test_settings():
    assert config_of(text_density.DEFAULTS, {"tile": 4})["tile"] == 4
    with pytest.raises(ValueError, match="unknown settings"):
        config_of(text_density.DEFAULTS, {"tiles": 4})


def test_command_line(spark, tmp_path):
    put(spark, FIRST, f"{tmp_path}/docs")
    (tmp_path / "config.json").write_text(json.dumps(SETTINGS))
    args = ["--documents", f"{tmp_path}/docs", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/check", "--config", f"{tmp_path}/config.json", "--scratch", f"{tmp_path}/scratch"]
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    run = subprocess.run([sys.executable, "-m", "jobs.text_density", *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert f"read {tmp_path}/docs: {len(FIRST)} new documents" in run.stderr and "wrote" in run.stderr
    assert surface(spark, f"{tmp_path}/out") == plain_density(FIRST, SETTINGS)


def test_jobs_import_nothing_of_the_training_data_part():
    for f in (ROOT / "jobs").glob("*.py"):
        assert "llm" not in f.read_text() and "corpus_pipeline" not in f.read_text()


@pytest.mark.parametrize("name", ["job1_activity_baseline", "job2_text_density"])
def test_registered_query_equals_its_sql(spark, sf_dir, name):
    import __spark_entry__ as entry
    import duckdb

    con = duckdb.connect()
    for t in ("events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)
