"""Line dedup: the winnowing guarantee and what may never happen, against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gridloom.llm import line_dedup as ld
from pyspark.sql import functions as F


def lines_of(rng, n):
    return [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 8, 30, 60]))) for _ in range(n)]


def corpus(seed):
    rng = random.Random(seed)
    shared = [lines_of(rng, rng.choice([1, 2, 5, 9])) for _ in range(12)]
    rows = []
    for d in range(120):
        own = lines_of(rng, rng.choice([0, 1, 4, 12]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(shared)
        if rng.random() < 0.2:
            own.insert(rng.randint(0, len(own)), rng.choice(["", " \t", "same short line"]))
        rows.append((d, "\n".join(own)))
    return [*rows, (500, rows[7][1]), (501, rows[7][1]), (600, None), (601, ""), (None, rows[9][1])]


def strip(x):
    return x.strip(" \t\x0b\x0c\r")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_guarantee_and_safety(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS key", "1 AS runs")
    out = {r["row"]["doc_id"]: r for r in ld.dedup_lines(df.repartition(3)).collect()}
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen_lines, seen_runs = set(), set()
    for d, text in order:
        r = out[d]
        if text is None:
            assert r["text"] is None and r["n_lines"] == 0
            continue
        lines = text.split("\n")
        left = r["text"].split("\n") if r["n_removed"] < len(lines) else []
        assert r["n_lines"] == len(lines) and r["n_removed"] == len(lines) - len(left)
        # What is left is a subsequence of the lines, and every line taken out stood somewhere before.
        it, gone = iter(lines), []
        for x in left:
            for y in it:
                if y == x:
                    break
                gone.append(y)
            else:
                raise AssertionError("not a subsequence")
        gone += list(it)
        before = set(seen_lines)
        for y in lines:
            before.add(strip(y))
        assert all(strip(y) in before for y in gone)
        # No run of GUARANTEE words that stood whole in an earlier document is left whole.
        kept_runs = set()
        for a in range(len(left)):
            words, b = 0, a
            while b < len(left) and words < ld.GUARANTEE:
                words += len(left[b].split())
                b += 1
            if words >= ld.GUARANTEE and left[a].split():
                kept_runs.add(tuple(map(strip, left[a:b])))
        assert not kept_runs & seen_runs
        for a in range(len(lines)):
            for b in range(a + 1, min(len(lines), a + 30) + 1):
                seen_runs.add(tuple(map(strip, lines[a:b])))
        seen_lines |= {strip(y) for y in lines}
    first = min((d for d, t in rows if t == rows[7][1] and d is not None))
    assert out[500]["n_removed"] >= out[first]["n_removed"] and out[501]["text"] == out[500]["text"]


def test_first_occurrences_stay(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {strip(x) for r in ld.dedup_lines(df).collect() for x in (r["text"] or "").split("\n")}
    assert {strip(x) for _, t in rows for x in (t or "").split("\n")} - left <= {""}


def test_stage_columns_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, 9, "a"), (2, f"own words\n{long}", 9, "b"), (3, long, 9, "c"), (4, "", 0, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, key string")
    got = sorted(tuple(r) for r in ld.without_repeats(df).collect())
    assert got == [(1, long, 9, "a"), (2, "own words", 9, "b"), (4, "", 0, "d")]
    assert ld.dedup_lines(df.limit(0)).collect() == []


def test_every_repeat_of_a_line_goes(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))
    lines = [fresh(n) for n in (6, 7, 9, 11, 12, 15, 19, 23)]
    rows = [(0, "\n".join(x for y in lines for x in (y, fresh(9))))]
    for d in range(1, 120):
        own = [fresh(rng.choice([1, 4, 9, 30])) for _ in range(rng.choice([0, 1, 5]))]
        own.insert(rng.randint(0, len(own)), " " * (d % 3) + rng.choice(lines))
        rows.append((d, "\n".join(own)))
    out = {r["row"]["doc_id"]: r["text"] for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == rows[0][1]
    for d, text in rows[1:]:
        assert out[d] == "\n".join(x for x in text.split("\n") if x.strip() not in lines)


def test_extend():
    a, b = np.array([1, 2, 3, 4, 9], np.uint64), np.array([7, 2, 3, 4], np.uint64)
    assert ld.extend(a, b, 2, 2) == (1, 4)
    assert ld.extend(a, a, 0, 0) == (0, 5)


def plainly(rows):
    """Every place of a fingerprint but the first is matched with the first, and what the match covers goes."""
    docs = {d: (t, *ld.line_hashes(t or "")) for d, t in rows}
    order = sorted(docs, key=lambda d: (d is not None, d or 0))
    first, gone = {}, {d: set() for d in docs}
    places = [(d, at, h) for d in order for at, h in ld.fingerprints(*docs[d][1:])]
    for d, at, h in places:
        if h not in first:
            first[h] = d, at
            continue
        other, there = first[h]
        gone[d] |= set(range(*ld.extend(docs[d][1], docs[other][1], at, there)))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, (t, _, _) in docs.items()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_plain_version(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [line(9)] * 3 + [line(rng.choice([1, 3, 8, 14])) for _ in range(30)]
    runs = [[line(rng.choice([2, 4, 7])) for _ in range(rng.choice([3, 6, 12]))] for _ in range(12)]
    rows = []
    for d in rng.sample(range(1000), 120):
        own = []
        for _ in range(rng.randrange(1, 7)):
            own += rng.choice([[line(rng.choice([3, 9]))], [rng.choice(common)], list(rng.choice(runs)), [""], [" \t"]])
        if rng.random() < 0.3:
            own.append(common[0])  # one line stands in very many
        rows.append((d, "\n".join(own)))
    rows += [(2000, None), (2001, ""), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", F.lit(1)).repartition(7)
    got = {r["row"]["doc_id"]: r["text"] for r in ld.dedup_lines(df).collect()}
    assert got == plainly(rows)
