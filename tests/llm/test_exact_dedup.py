"""Exact dedup against plain Python; what the filter lets pass, and that nothing but it is shuffled."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from gridloom.llm import exact_dedup as ed
from pyspark.sql import functions as F


def plain(rows):
    """{(id, text): (keep_id, group_size)} and the number of rows that stay, by digest."""
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest(), []).append((i, t))
    out = []
    for sha, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(i, best[0], len(own), sha) for i, _ in own]
    return sorted(out, key=repr), {sha: min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for sha, g in groups.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, f"text {i} " + " ".join(rng.choice("abc") for _ in range(5))) for i in range(400)]
    out += [(1000 + i, "one  text\tof many" + " " * (i % 4)) for i in range(300)]  # a third of all rows are copies of one text
    out += [(2000 + i, out[i][1].replace(" ", rng.choice(["", "\n", "\x0b", "  "]))) for i in range(60)]
    out += [(3000, None), (3001, ""), (3002, " \n\x0c\r"), (None, None), (3003, "née 😀"), (None, "n é e 😀"), (None, "alone without id")]
    out += [(3004, "x" * 300_000), (3005, "x" * 150_000 + " " + "x" * 150_000), (3006, "a b"), (3007, "ab"), (3008, "A b"), (3009, "twice"), (3009, "twice")]
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("other") for c in ("sha", "row", "n_points", "again", "salt", "best", "kept", "id")}).repartition(5)


@pytest.mark.parametrize("most", [1 << 15, ed.MAX_BITS])
def test_equals_plain_groups(spark, rows, most):
    got = ed.mark_copies(frame(spark, rows), max_bits=most).collect()
    want, best = plain(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    kept = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted(best)  # one of each
    assert all(r["doc_id"] == r["keep_id"] == best[r["text_sha256"]][0] for r in kept)


def test_a_full_filter_changes_nothing(spark, rows):
    """A filter of one slot a row lets nearly all rows through, and the result is the same."""
    few = sorted(map(repr, ed.mark_copies(frame(spark, rows), bits_per_row=1, max_bits=1).collect()))
    assert few == sorted(map(repr, ed.mark_copies(frame(spark, rows)).collect()))


def test_rows_of_one_text_each_pass_straight_through(spark):
    n = 20_000
    digests = spark.range(n).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("sha"))
    digests = digests.union(digests.limit(100))
    bits = ed.filter_bits(n)
    marked = ed.possibly_repeated(digests, ed.repeated_slots(digests, bits), bits)
    counts = marked.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("again").alias("all"), F.max("again").alias("some"))
    assert counts.where("n > 1 AND NOT all").count() == 0  # no copy is missed
    assert counts.where("n = 1 AND some").count() < 0.03 * n


def test_only_possibly_repeated_rows_are_shuffled(spark, rows):
    df = ed.mark_copies(frame(spark, rows))
    plan = df._jdf.queryExecution().executedPlan().toString()
    union = plan.split("Union", 1)[1]
    first = union.split("SortMergeJoin", 1)[0]
    assert "Exchange hashpartitioning" not in first  # the branch that passes through


def test_no_python_on_the_way(spark, rows):
    for f in (ed.mark_copies, ed.without_copies):
        plan = f(frame(spark, rows))._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_one_row_of_each_text_stays_whole(spark, rows):
    docs = frame(spark, rows)
    got = ed.without_copies(docs)
    assert got.columns == docs.columns
    _, best = plain(rows)
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(repr, best.values()))


def test_empty_table(spark):
    docs = frame(spark, []).limit(0)
    assert ed.mark_copies(docs).count() == 0 and ed.without_copies(docs).count() == 0
