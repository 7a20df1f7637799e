"""The Jaccard join against brute force, with limits small enough that every path is taken."""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest

from gridloom.llm import jaccard_join as jj
from gridloom.llm.components import connected_components


def brute(rows, k=5):
    def grams(text):
        w = (text or "").encode().lower().split()
        if len(w) < k:
            return {tuple(w)} if w else set()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None and sets[i]:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 8, 30, 90]))] for _ in range(25)]
    rows = []
    for d in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            own[rng.randrange(len(own))] = rng.choice(words)
        if rng.random() < 0.4:
            own = own + passage
        text = rng.choice([" ", "\n", "  \t"]).join(rng.choice([w, w.upper()]) for w in own)
        rows.append((d, text))
    return [*rows, (900, None), (901, ""), (902, " \n"), (3, rows[3][1]), (None, rows[5][1]), (None, "alone and without id it stands here now")]


@pytest.mark.parametrize("seed, small, block, count", [(1, 8, 512, 8), (2, 2, 6, 3), (3, 1, 3, 2)])
def test_components_equal_brute_force(spark, seed, small, block, count):
    limits = jj.Limits(small=small, block=block, least_count=count, least_share=0.0)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "id").selectExpr("id AS doc_id", "text", "1 AS sid", "2 AS root")
    got = sorted((tuple(r) for r in jj.jaccard_components(df.repartition(3), limits=limits).collect()), key=repr)
    assert got == brute(rows)


def test_one_of_each_keeps_every_column(spark):
    rows = [(2, "a b c d e f g h", "x"), (1, "A b c d e f g h", "y"), (3, None, "z"), (3, None, "z"), (7, "other words stand here", "u"), (7, "other words stand here", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(tuple(r) for r in jj.one_of_each(df).collect())
    assert got == [(1, "A b c d e f g h", "y"), (3, None, "z"), (3, None, "z"), (7, "other words stand here", "u")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jj.jaccard_components(df).collect() == []
    assert jj.one_of_each(df).collect() == []


def test_trie_overlaps_equal_set_overlaps():
    rng = np.random.default_rng(5)
    t = Fraction(3, 4)
    for _ in range(30):
        probe = rng.choice(60, rng.integers(1, 40), replace=False).astype(np.uint64)
        sets = []
        for _ in range(25):
            own = np.unique(np.concatenate([rng.choice(probe, max(1, int(len(probe) * rng.random()))), rng.choice(80, rng.integers(0, 12)).astype(np.uint64)]))
            sets.append(own)
        trie = jj.Trie(sets)
        for among in (None, list(range(0, 25, 3))):
            got = trie.overlaps(probe, t, among)
            for i in range(25) if among is None else among:
                s = set(sets[i].tolist())
                both = len(s & set(probe.tolist()))
                linked = 4 * both >= 3 * len(s | set(probe.tolist()))
                assert got.get(i) == both if linked else i not in got
            assert among is None or set(got) <= set(among)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 101), (7, 7), (-5, 60)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99, 101: 99, -5: -5, 60: -5}


@pytest.mark.parametrize("seed, hot, probes, tokens", [(4, 4, 5, 1 << 22), (5, 2, 4096, 90)])
def test_hot_ngrams_and_small_blocks_lose_nothing(spark, seed, hot, probes, tokens):
    limits = jj.Limits(small=2, leaders=1, least_count=2, least_share=0.0, hot=hot, block=4, probes=probes, tokens=tokens)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jj.jaccard_components(df.repartition(3), limits=limits).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("leaders", [1, 8])
def test_few_sets_of_very_many_copies_stay_one_group(spark, leaders):
    """Ten near copies that all link, each in many tasks: their n-grams are hot, but few sets hold them."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:-1], f"end{i}"]) for i in range(10)]
    rows = [(40 * i + c, t) for i, t in enumerate(texts) for c in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40, "doc_id")
    got = jj.jaccard_components(df, limits=jj.Limits(hot=64, leaders=leaders)).collect()
    assert len(got) == 400 and {r["component_id"] for r in got} == {0}


def near_copies(n, seed=3):
    """Copies of one text, each with so many words changed that most pairs do not link."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(n):
        own = list(base)
        for p in rng.sample(range(200), 6):
            own[p] = f"x{rng.randrange(10**9)}"
        rows.append((d, " ".join(own)))
    return rows


def test_rows_grow_in_proportion_where_near_copies_do_not_link(spark, monkeypatch):
    most = {}
    for n in (100, 200, 400):
        seen = []
        monkeypatch.setattr(jj, "saved", lambda df, name, own=jj.saved: seen.append((name, (out := own(df, name)).count())) or out)
        rows = near_copies(n)
        got = sorted((tuple(r) for r in jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
        assert got == brute(rows)
        monkeypatch.undo()
        most[n] = {name: max(c for k, c in seen if k == name) for name, _ in seen}
    for name, c in most[400].items():
        assert c <= 2.6 * max(most[200][name], 200), (name, most)
    assert most[400]["jaccard-links"] < 400


def test_spanning_forest_joins_what_links():
    rng = np.random.default_rng(8)
    t = Fraction(3, 4)
    base = rng.choice(1 << 40, 60, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(30, 58), replace=False), rng.choice(1 << 40, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(70)]
    edges = jj.spanning_forest(np.arange(40), np.arange(40), sets[:40], np.arange(40, 70), np.arange(40, 70), sets[40:], t)
    root = list(range(70))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    want = list(range(70))
    for x in range(40, 70):
        for y in range(40):
            a, b = set(sets[x].tolist()), set(sets[y].tolist())
            if 4 * len(a & b) >= 3 * len(a | b):
                want = [want[x] if w == want[y] else w for w in want]
    for u, v in edges:
        assert find(u) != find(v)  # one row for each merging
        root[find(u)] = find(v)
    assert all((find(i) == find(j)) == (want[i] == want[j]) for i in range(70) for j in range(70))


def test_bitmaps_allow_every_link():
    rng = np.random.default_rng(9)
    t = Fraction(3, 4)
    for n in (3, 20, 33, 400):
        base = rng.choice(1 << 50, n, replace=False).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(max(1, n // 2), n + 1), replace=False), rng.choice(1 << 50, rng.integers(0, 1 + n // 4)).astype(np.uint64)])) for _ in range(60)]
        bits, sizes = [jj.parities(s) for s in sets], np.array([len(s) for s in sets])
        for a, b in ((s, z) for s in sets[:20] for z in sets[20:]):
            wide, small = sorted((jj.parities(a), jj.parities(b)), key=len, reverse=True)
            assert int(np.bitwise_count(jj.fold(wide, len(small)) ^ small).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))
        hits, hit = jj.may_link(bits[:20], bits[20:], sizes[:20], sizes[20:], lambda i: np.ones(40, bool), t)
        for i in range(20):
            for j in range(40):
                x, y = set(sets[i].tolist()), set(sets[20 + j].tolist())
                if 4 * len(x & y) >= 3 * len(x | y):
                    assert hits[i] and hit[j]
