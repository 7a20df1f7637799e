"""The manifest against a plain Merkle trie."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from gridloom.llm import merkle
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def trie(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def path(levels, i):
    """(left siblings, right siblings) of each level."""
    out = []
    for nodes in levels[:-1]:
        a = i // 3 * 3
        out.append((nodes[a:i], nodes[i + 1 : a + 3]))
        i //= 3
    return out


def plain(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    tries, subroots = {}, []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tries[s] = own, trie([leaf(r) for r in own])
        subroots.append(tries[s][1][-1][0])
    top = trie(subroots)
    out = []
    for k, s in enumerate(sources):
        own, levels = tries[s]
        for i, r in enumerate(own):
            way = path(levels, i) + path(top, k)
            cut = r
            if zlib.crc32(("-" if r[0] is None else str(r[0])).encode()) % 2 == 0 and r[4] is not None:
                cut = (*r[:4], r[4].replace("\n", ""))
            now = leaf(cut)
            for left, right in way:
                now = h(*left, now, *right)
            root = top[-1][0]
            out.append((r[0], s, leaf(r), subroots[k], root, h(*[x for a, b in way for x in (*a, *b)]), now, now == root))
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i * 7919, -i, i << 40]), "hot", "en", i, f"text\n{i}") for i in range(1, 220)]
    rows += [(rng.getrandbits(63), "wide", None, None, "é\n😀") for _ in range(41)]
    rows += [(i, f"s{i % 31}", "de", 3, None if i % 3 else "") for i in range(60)]
    rows += [(7, None, "en", 1, "a\nb"), (None, None, None, None, None), (None, "hot", "en", 2, "x"), (5, "", "en", 4, "\n\n")]
    rows += [(9, "hot", "en", 1, "twice\n")] * 5 + [(9, "hot", "en", 1, "other\n"), (10, "alone", "en", 1, "y" * 200_000 + "\n")]
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("leaf", "rank", "n", "m", "prefix", "node", "root", "bad", "path", "_own")}).repartition(3)


COLUMNS = ("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("digits", [1, 2, merkle.TIER])
def test_equals_a_plain_trie(spark, digits):
    rows = made(digits)
    got = merkle.manifest(frame(spark, rows), digits=digits)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10])
def test_small_tables(spark, n):
    rows = [(i, "a", "en", i, "x\ny") for i in range(n)]
    got = merkle.manifest(frame(spark, rows).limit(n), digits=1)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == (plain(rows) if n else [])


def test_tampering_is_found_where_there_was_some(spark):
    rows = [(i, "a", "en", 1, "x\ny" if i % 2 else "xy") for i in range(100)]
    got = {r["doc_id"]: r["verified"] for r in merkle.manifest(frame(spark, rows)).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 2 == 0) for i in range(100)}


def test_the_rows_may_lie_anywhere(spark):
    rows = made(5)
    one = merkle.manifest(spark.createDataFrame(rows, SCHEMA).coalesce(1)).first()["root"]
    assert one == merkle.manifest(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).first()["root"]


def test_ranks_of_ids(spark):
    rng = random.Random(2)
    ids = [None, -(1 << 63), (1 << 63) - 1, 0, -1, *[rng.getrandbits(64) - (1 << 63) for _ in range(300)], *range(8000, 8600)]
    df = spark.createDataFrame([("a", i) for i in ids], "source string, doc_id long").withColumns({"leaf": F.lit(b""), "m": F.lit(1).cast("long")})
    got = sorted(merkle.ranked_by_id(df).collect(), key=lambda r: r["rank"])
    assert [r["doc_id"] for r in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r["rank"] for r in got] == list(range(len(ids))) and {r["n"] for r in got} == {len(ids)}
