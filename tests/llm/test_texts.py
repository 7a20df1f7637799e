"""Packing, token counts, decontamination, both classifiers, the pipeline and the queries' wiring."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import decontaminate as dc
from gridloom.llm import packing, quality_classifier, token_counts, toxicity
from gridloom.llm.common import slices, split_words
from gridloom.llm.queries import queries, tokenizer_path
from gridloom.llm.training import fit_logistic, sigmoid
from pyspark.sql import functions as F

ODD = ["", "  x ", "H̱ \x01 a\x01b", "Don't it's ÉCOLE, a1b2!! ... <|endoftext|> x<|startoftext|>y", "ﬁ Å Å İSTANBUL ß", "'s''t 're'd", None, "a b　c"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(alphabet=st.sampled_from(list("aAbz éÉß'0129.,!?\t\n\x0b\x01<|>́ ñ中😀")), max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_chunk_encoder_equals_the_tokenizer(texts):
    from tokenizers import Tokenizer

    own = packing.encoder(tokenizer_path())
    plain = Tokenizer.from_file(tokenizer_path())
    bounds, ids = own.encode(pa.array([*texts, *ODD], pa.string()))
    for i, t in enumerate([*texts, *ODD]):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == ids_of(plain, t), repr(t)


def test_encoder_forgets_and_still_agrees(tokenizer):
    own = packing.ChunkEncoder(tokenizer_path(), most=10, join=3)
    for k in range(5):
        texts = [f"word{k} other thing{i}, and more{i}!" for i in range(20)]
        bounds, ids = own.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == ids_of(tokenizer, t)


def test_split_words_equals_bytes_split():
    texts = pa.array([None, "", " A b\x0bC ", "é É x", "\x1fq \x1c", "one"])
    bounds, codes, words = split_words(texts)
    for i, t in enumerate(texts.to_pylist()):
        assert [words[int(c)].as_py().encode() for c in codes[bounds[i] : bounds[i + 1]]] == (t or "").encode().lower().split()
    assert list(slices(pa.array(["a" * 5_000_000, "b", None, "c" * 5_000_000]))) == [(0, 1), (1, 3), (3, 4)]


@given(st.integers(1, 10_000), st.sampled_from([64, 2048]))
@settings(max_examples=200, deadline=None)
def test_cut_covers_a_document(total, capacity):
    pieces = packing.cut(total, capacity)
    assert pieces[0][0] == 0 and sum(n for _, n in pieces) == total
    assert all(a + n == b for (a, n), (b, _) in zip(pieces[:-1], pieces[1:], strict=True)) and all(0 < n <= capacity for _, n in pieces)


def test_packing_round_trip(spark, tokenizer, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit(1).alias("start"), F.lit("x").alias("length"))
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (10_000, "")], "doc_id long, text string")
    texts = defaultdict(list)
    both = docs.unionByName(odd, allowMissingColumns=True)
    for r in both.collect():
        texts[r["doc_id"]].append(r["text"])
    rows = packing.pack(both.repartition(3), tokenizer_path()).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        wanted = []
        for t in texts[d]:
            ids = np.array([*ids_of(tokenizer, t), 1], "<u4")
            wanted.append((ids, len(ids)))
        assert sum(r["length"] for r in own) == sum(n for _, n in wanted)
        if len(wanted) == 1:
            ids, n = wanted[0]
            for r in own:
                assert r["doc_tokens"] == n and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in rows) > 0.8 * 2048 * len(sequences)
    assert packing.pack(docs.limit(0), tokenizer_path()).collect() == []


def test_segment_tree():
    rng = random.Random(1)
    values = [rng.randint(0, 9) for _ in range(13)]
    tree = token_counts.SegmentTree(values)
    for _ in range(50):
        i = rng.randrange(13)
        values[i] = rng.randint(0, 9)
        tree.update(i, values[i])
        assert tree.total == sum(values)
        if tree.total:
            at = rng.randrange(tree.total)
            leaf, before = tree.find(at)
            assert before == sum(values[:leaf]) and before <= at < before + values[leaf]


def test_edits_equal_a_full_count(tokenizer):
    rng = random.Random(3)
    own = packing.encoder(tokenizer_path())
    words = ["alpha", "beta,", "x1", "Don't", "\n", "éa", "  ", "12345", "##"]
    for _ in range(25):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 400, 900])))
        doc = token_counts.DocumentCount.of(text, own)
        assert doc.total == len(ids_of(tokenizer, text)) and doc.text == text
        for _ in range(6):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 5, 1500]))
            new = rng.choice(["", " ", "new", "a b", "'s"])
            text = text[:a] + new + text[b:]
            doc.replace(a, b, new)
            assert doc.text == text and doc.total == len(ids_of(tokenizer, text))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 12)))
        edits = [(a, b, rng.choice(["", "z", " "])) for a, b in zip(cuts[::2], cuts[1::2])]
        for a, b, new in reversed(edits):
            text = text[:a] + new + text[b:]
        doc.apply(edits)
        assert doc.text == text and doc.total == len(ids_of(tokenizer, text))


def test_count_query_equals_brute_force(spark, tokenizer, sf_dir):
    import re

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries()["op8_token_counts"](spark, sf_dir).collect():
        t = texts[r["doc_id"]]
        edited = re.sub(r"[0-9]{4,}|[#*$%&]{2,}", lambda m: "0" if m[0][0].isdigit() else "", t)
        assert (r["n_tokens"], r["n_tokens_after"]) == (len(ids_of(tokenizer, t)), len(ids_of(tokenizer, edited)))
        assert r["n_encoded"] == 0 or r["n_edits"] > 0
    df = spark.createDataFrame([(1, None), (None, ""), (1, None)], "doc_id long, text string")
    none = F.lit(None).cast("array<struct<start:int,end:int,text:string>>")
    assert sorted((tuple(r) for r in token_counts.count_edited(df, none, tokenizer_path()).collect()), key=repr) == [(1, 0, 0, 0, 1, 0)] * 2 + [(None, 0, 0, 0, 1, 0)]


def test_stored_leaves_under_edits_equal_a_full_count(spark, tokenizer):
    rng = random.Random(6)
    words = ["alpha", "beta,", "x1", "Don't", "\n", "éa", "12345", "##"]
    texts = {d: " ".join(rng.choice(words) for _ in range(n)) for d, n in enumerate([0, 1, 40, 2000, 3000, 900])}
    docs = spark.createDataFrame([*texts.items(), (8, None), (3, texts[3])], "doc_id long, text string").withColumn("leaf", F.lit("clash"))
    table = token_counts.stored_leaves(docs, tokenizer_path())
    for _ in range(2):
        table = token_counts.saved(table, "leaves")
        asked = []
        for d in (0, 1, 3, 4, 8):
            n = len(texts.get(d, ""))
            cuts = sorted(rng.sample(range(n + 1), min(n + 1, 10)))
            own = [(a, b, rng.choice(["", "z", " ", "new words "])) for a, b in zip(cuts[::2], cuts[1::2])] or [(0, 0, "now")]
            asked += [(d, *e) for e in own]
            text = texts.get(d, "")
            for a, b, new in reversed(own):
                text = text[:a] + new + text[b:]
            texts[d] = text
        edits = spark.createDataFrame([*asked, (77, 0, 1, "x"), (None, 0, 1, "x")], "doc_id long, start int, end int, text string")
        edited = token_counts.edit_leaves(table, edits, tokenizer_path())
        same = edited.join(table, ["doc_id", "key", "leaf", "points", "tokens", "text"]).count()
        assert same > 0.3 * table.count()  # leaves that no edit touches are as they were
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_totals(edited).collect()}
        assert got == {d: len(ids_of(tokenizer, t)) for d, t in texts.items()}
        table = edited
    assert token_counts.edit_leaves(table.limit(0), edits, tokenizer_path()).collect() == []


def test_equal_edits_are_each_applied(spark, tokenizer):
    text, many = "alpha beta gamma delta", [(5, 5, " new word")] * 2 + [(10, 16, ""), (10, 16, "")]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    table = token_counts.saved(token_counts.stored_leaves(docs, tokenizer_path()), "leaves")
    edits = spark.createDataFrame([(1, *e) for e in many], "doc_id long, start int, end int, text string")
    after = token_counts.token_totals(token_counts.edit_leaves(table, edits, tokenizer_path())).first()["n_tokens"]
    column = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text")) for a, b, t in many])
    assert after == token_counts.count_edited(docs, column, tokenizer_path()).first()["n_tokens_after"] == len(ids_of(tokenizer, "alpha new word new word beta delta"))
    assert token_counts.edit_leaves(table, edits.limit(0), tokenizer_path()).collect() == table.collect()


def test_overlapping_edits(tokenizer):
    doc = token_counts.DocumentCount.of("abcdefghij", packing.encoder(tokenizer_path()))
    doc.apply([(1, 5, "X"), (3, 7, "Y"), (2, 3, "Z")])
    assert doc.text == "aXZYhij" and doc.total == len(ids_of(tokenizer, doc.text))


def lcs_plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], (last + 1 if x == y else max(row[j + 1], row[j]))
    return row[-1]


@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=30))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    assert dc.lcs(np.array(a, np.uint64), np.array(b, np.uint64)) == lcs_plain(a, b)


def planted(seed=5, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(20_000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, draw(rng.randint(15, 60))) for i in range(12)]
    rows, truth = [], set()
    for d in range(n):
        text = draw(rng.choice([5, 60, 300]))
        if d % 4 == 0:
            i, own = rng.choice(items)
            own = list(own)
            if d % 8 == 0:  # a paraphrase: a fifth of the words changed
                for k in rng.sample(range(len(own)), len(own) // 5):
                    own[k] = rng.choice(words)
            at = rng.randint(0, len(text))
            text = text[:at] + own + text[at:]
            truth.add((d, i))
        rows.append((d, " ".join(w.capitalize() if rng.random() < 0.1 else w + rng.choice(["", "", ",", "."]) for w in text)))
    return rows, [(i, " ".join(w)) for i, w in items], truth


def test_planted_items_are_found(spark):
    rows, items, truth = planted()
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, items[0][1])], "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame([*items, (77, None), (78, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs.repartition(3), bench).collect()}
    assert got == truth | {(None, 0)}
    left = dc.without_contaminated(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == ({d for d, _ in rows} | {900, 901}) - {d for d, _ in truth}
    assert dc.contaminated(docs.limit(0), bench).collect() == [] and dc.contaminated(docs, bench.limit(0)).collect() == []


def spoken(rng, common, rare, n, share=0.5):
    """Words of a text: common ones, and else rare ones that stand nowhere else."""
    return [rng.choice(common) if rng.random() < share else f"{rng.choice(rare)}{rng.randrange(10**9)}" for _ in range(n)]


def found_in(spark, texts, items):
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench).collect()}


def test_paraphrases_that_the_check_accepts_are_found(spark):
    rng = random.Random(8)
    common, rare = [f"the{i}" for i in range(40)], ["anor", "belo", "cidu"]
    items = [spoken(rng, common, rare, n, 0.6) for n in (20, 26, 33, 48)]
    texts, truth = [spoken(rng, common, rare, 300) for _ in range(160)], set()
    for i, item in enumerate(items):
        rarest = sorted(range(len(item)), key=lambda k: item[k] in common)
        for kept in (0.45, 0.5, 0.55, 0.6, 0.65, 0.7):
            for answer in (False, True):  # the rarest words give way to synonyms, the answer's too or not
                free = [k for k in rarest if not answer or k < len(item) - dc.ANSWER]
                own = list(item)
                for k in free[: len(item) - dc.least_common(len(item), kept)]:
                    own[k] = f"synonym{rng.randrange(10**9)}"
                before, after = spoken(rng, common, rare, 150, 0), spoken(rng, common, rare, 150, 0)
                if kept >= dc.LCS_ALONE or (answer and kept >= dc.LCS_WITH_ANSWER):
                    truth.add((len(texts), i))
                texts.append(before + own + after)
    # The common words of an item alone, in order but far apart, are no copy of it.
    words = [w for w in items[1] if w in common]
    texts.append([x for w in words for x in [w, *spoken(rng, common, rare, 5, 0)]])
    assert found_in(spark, texts, items) == truth


def test_copies_in_many_documents_are_found(spark):
    rng = random.Random(9)
    common, rare = [f"the{i}" for i in range(40)], ["anor", "belo", "cidu"]
    items = [spoken(rng, common, rare, n, 0.3) for n in (6, 12, 17, 24, 40)]
    texts, truth = [], set()
    for d in range(200):
        texts.append(spoken(rng, common, rare, 60, 0.2))
        for i, share in enumerate((0.8, 0.2, 0.1, 0.3, 0.05)):
            if rng.random() < share:
                texts[-1] += items[i] + spoken(rng, common, rare, 30, 0.2)
                truth.add((d, i))
    assert found_in(spark, texts, items) == truth


def test_repeated_and_templated_items_are_found(spark):
    rng = random.Random(10)
    common, rare = [f"the{i}" for i in range(40)], ["anor", "belo", "cidu"]
    one, template = spoken(rng, common, rare, 25), spoken(rng, [], rare, 30, 0)
    own = [spoken(rng, common, rare, 4, 0) for _ in range(20)]
    items = [one] * 8 + [template[:20] + w + template[20:] for w in own]
    texts = [spoken(rng, common, rare, 100) for _ in range(100)]
    truth = set()
    for i in range(7, len(items)):
        texts.append(spoken(rng, common, rare, 41, 0) + items[i] + spoken(rng, common, rare, 40, 0))
        # Items of one template have over 60 % of their words in common: each is found in each copy.
        truth |= {(len(texts) - 1, k) for k in (range(8) if i == 7 else range(8, len(items)))}
    assert found_in(spark, texts, items) == truth
    h = [np.arange(5, dtype=np.uint64)] * 9 + [np.arange(5, 9, dtype=np.uint64)]
    assert dc.telling_words(h).tolist() == list(range(9))


def test_all_items_are_found_in_groups_of_few_columns(spark, monkeypatch):
    rows, items, truth = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "COLUMNS", 64)  # words share columns
    monkeypatch.setattr(dc, "MOST_WORDS", 150)  # several surveys and searches
    monkeypatch.setattr(dc, "TOGETHER", 2)
    assert {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench).collect()} == truth
    assert {r["doc_id"] for r in dc.without_contaminated(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in truth}


def test_items_many_times_over_long_ones_and_few_documents(spark):
    rng = random.Random(12)
    common, rare = [f"the{i}" for i in range(40)], ["anor", "belo", "cidu"]
    one, long_one = spoken(rng, common, rare, 25), spoken(rng, common, rare, 20_000, 0.3)
    items = [one] * 300 + [long_one, [rng.choice(common) for _ in range(30)]]
    texts = [spoken(rng, common, rare, 80) for _ in range(30)]
    before = spoken(rng, common, rare, 50, 0)
    texts += [before + one + spoken(rng, common, rare, 9, 0), long_one[:15_000] + spoken(rng, common, rare, 9, 0), before + items[-1] + before]
    assert found_in(spark, texts, items) == {(30, i) for i in range(300)} | {(31, 300), (32, 301)}
    docs = spark.createDataFrame([(0, " ".join(texts[30]))], "doc_id long, text string")  # a corpus of one document
    bench = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(items[-1]))], "item_id long, text string")
    (found,) = dc.contaminated(docs, bench).collect()
    assert (found["item_id"], found["start_word"], found["end_word"], found["common_words"]) == (1, 50, 75, 25)


def test_decontamination_equals_a_plain_search(spark):
    """Every document and item, by the stated rule over all stretches, without index or bound."""
    rng = random.Random(13)
    common, rare = [f"the{i}" for i in range(30)], ["anor", "belo"]
    items = [spoken(rng, common, rare, n, 0.4) for n in (9, 16, 24, 35)]
    texts = []
    for _ in range(80):
        text = spoken(rng, common, rare, rng.choice([3, 40, 120]), 0.3)
        own = rng.choice(items)
        kept = [w if rng.random() < rng.choice([0.4, 0.7, 1.0]) else f"new{rng.randrange(10**9)}" for w in own]
        at = rng.randint(0, len(text))
        texts.append(text[:at] + kept + text[at:])

    def plainly(text, item):
        reach = max(24, 2 * len(item))
        for lo in range(0, len(text), 8):
            part = text[max(0, lo - reach) : lo + 24 + reach]
            both = lcs_plain(part, item)
            tail = item[-dc.ANSWER :]
            answer = any(part[i : i + len(tail)] == tail for i in range(len(part)))
            if answer and both >= dc.least_common(len(item), dc.LCS_WITH_ANSWER):
                return True
            if both >= dc.least_common(len(item), dc.LCS_ALONE):
                near = [text[i : i + 2 * len(item)] for i in range(len(text))]
                own = {w for w in item if w not in common}
                if any(lcs_plain(x, item) >= dc.least_common(len(item), dc.LCS_ALONE) for x in near) or own & set(part):
                    return True
        return False

    assert found_in(spark, texts, items) == {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if plainly(t, x)}


def searched(spark, rows, items, space=lambda v: v):
    """Rows found in texts, with the singular vectors changed."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = dc.finders(docs.select("text"), items)
    for f in found:
        f.v, f.projected = space(f.v), space(f.projected)
    prepared = dc.plain_words(pa.array([t for _, t in rows], pa.string()))
    return [r for f in found for r in f.find(prepared)]


def test_the_cosine_leads_to_copies_and_without_the_space_to_none(spark, sf_dir):
    rows, items, truth = planted()
    led = [r for r in searched(spark, rows, items) if r[-1]]
    assert len({(r[0], r[1]) for r in led}) >= 0.9 * len(truth)
    assert not any(r[-1] for r in searched(spark, rows, items, np.zeros_like))
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = dc.contaminated(docs, bench).select("by_cosine").collect()
    assert out and sum(r["by_cosine"] for r in out) >= 0.9 * len(out)


def test_cosine_candidates_equal_plain_cosines(spark, monkeypatch):
    """Every stretch and item with a window at the least cosine is a candidate, in parts of any size."""
    rows, items, _ = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bounds, codes, by_code = dc.plain_words(pa.array([t for _, t in rows], pa.string()))
    for f in dc.finders(docs.select("text"), items):
        n = np.diff(bounds)
        blocks = -(-n // f.stretch)
        stretches = np.where(blocks > 1, blocks - 1, blocks)
        first = np.cumsum(stretches) - stretches
        got = [set(f.near(dc.weighted_windows(f.items, bounds, codes, by_code), first, stretches).tolist())]
        monkeypatch.setattr(dc, "WINDOWS", 3)
        got.append(set(f.near(dc.weighted_windows(f.items, bounds, codes, by_code), first, stretches).tolist()))
        monkeypatch.undo()
        assert got[0] == got[1]
        for q in f.by_cosine.tolist():
            for d in range(len(n)):
                lo = np.arange(0, n[d], dc.BLOCK)
                cosine = f.cosines(q, by_code[codes[bounds[d] : bounds[d + 1]]], lo)
                for at in lo[cosine >= dc.LEAST_COSINE + 0.05].tolist():
                    s = min(max(at - f.reach[q], 0) // f.stretch, stretches[d] - 1)
                    assert (first[d] + s) * len(f.items.ids) + q in got[0]


def test_latent_space_is_orthonormal_and_holds_the_items(spark):
    rows, items, _ = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bounds, codes, h = dc.plain_words(pa.array([t for _, t in items]))
    words = [h[codes][a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    seen = dc.survey(docs, dc.telling_words(words))
    own = dc.Items([i for i, _ in items], words, dc.weights_of(seen.rarity, 0.0), seen.vocabulary)
    v = dc.latent_space(seen, own)
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3)
    matrix = own.rows(0, len(items))
    kept = np.linalg.norm(matrix @ v, axis=1) / np.linalg.norm(matrix, axis=1)
    # The survey's product is that of the passages' counts.
    counts = []
    for _, text in rows:
        b, c, k = dc.plain_words(pa.array([text]))
        col = own.columns(k)[c]
        for at in range(0, len(col), dc.BLOCK * dc.WINDOW):
            part = col[at : at + dc.BLOCK * dc.WINDOW]
            counts.append(np.bincount(part[part >= 0], minlength=own.width))
    c = np.array(counts, float)
    o = np.zeros((own.width, seen.product.shape[1]))
    o[np.arange(own.width), seen.slot] = seen.sign
    assert np.allclose(seen.product, c.T @ (c @ o))
    assert kept.min() > 0.95


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 3))
    y = (rng.random(3000) < sigmoid(x @ [2.0, -1.0, 0.0] + 0.5)).astype(float)
    w, b = fit_logistic(x, y)
    assert np.allclose(w, [2, -1, 0], atol=0.25) and abs(b - 0.5) < 0.2
    assert fit_logistic(x[:0], y[:0])[0].tolist() == [0, 0, 0]


def test_quality_on_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    out = quality_classifier.scored(docs.withColumn("host", F.lit(1)), train)
    rows = out.select(F.col("row.doc_id").alias("doc_id"), "kept", "p_low").join(test, "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.9 * len(rows)
    kept = quality_classifier.kept_documents(docs, train)
    assert kept.columns == docs.columns


def test_priors_and_posteriors_equal_numpy(spark):
    rng = random.Random(21)
    rows = [(f"h{h}", f"p{rng.randrange(1 + h % 4)}", rng.gauss((-1.5, 0.5, 2.0)[h % 3], 2)) for h in range(12) for _ in range(3 + 7 * h)]
    base = -0.7
    got = {(r["host"], r["path"]): r for r in quality_classifier.priors(spark.createDataFrame(rows, "host string, path string, llr double"), base).collect()}
    n, s = Counter(), Counter()
    for h, p, x in rows:
        n[h, p] += 1
        s[h, p] += 1 / (1 + np.exp(-(x + base)))
    rate = sum(s.values()) / len(rows)

    def strength(counts, sums, centres):
        w, r, c = np.array(counts, float), np.array(sums) / np.array(counts), np.array(centres)
        within = (w * c * (1 - c)).sum() / w.sum()
        return min(max(within / max(((w * (r - c) ** 2).sum() - (len(w) - 1) * within) / w.sum(), 1e-6), 1), 1e6)

    hosts = sorted({h for h, _ in n})
    hn, hs = ({h: sum(v for (x, _), v in of.items() if x == h) for h in hosts} for of in (n, s))
    k1 = strength([hn[h] for h in hosts], [hs[h] for h in hosts], [rate] * len(hosts))
    hr = {h: (hs[h] + k1 * rate) / (hn[h] + k1) for h in hosts}
    keys = sorted(n)
    k2 = strength([n[k] for k in keys], [s[k] for k in keys], [hr[k[0]] for k in keys])
    assert set(got) == set(keys)
    for k in keys:
        r = min(max((s[k] + k2 * hr[k[0]]) / (n[k] + k2), 1e-4), 1 - 1e-4)
        prior = min(max(np.log(r / (1 - r)), base - quality_classifier.PRIOR_REACH), base + quality_classifier.PRIOR_REACH)
        assert np.allclose((got[k]["host_rate"], got[k]["path_rate"], got[k]["prior"]), (hr[k[0]], r, prior))


def test_posteriors_add_evidence_and_prior(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    every = quality_classifier.scored(docs, labels).selectExpr("row.doc_id", "evidence", "path_rate", "p_low", "kept").collect()
    few = quality_classifier.scored(docs, labels, carried=["doc_id"])
    assert few.select("row.*").columns == ["doc_id"]
    assert sorted(map(tuple, few.selectExpr("row.doc_id", "evidence", "path_rate", "p_low", "kept").collect())) == sorted(map(tuple, every))
    base = quality_classifier.fit_evidence(docs, labels).base
    reach = quality_classifier.PRIOR_REACH
    for r in every:
        prior = min(max(np.log(r["path_rate"] / (1 - r["path_rate"])), base - reach), base + reach)
        assert np.isclose(r["p_low"], 1 / (1 + np.exp(-(r["evidence"] + prior)))) and r["kept"] == (r["p_low"] <= 0.5)


def test_quality_handles_nulls_and_no_labels(spark):
    df = spark.createDataFrame([(1, None, None, None), (None, "", "s", "l"), (3, "some words here", "s", None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_classifier.scored(df, labels).collect()
    assert len(rows) == 3 and all(r["p_low"] is not None for r in rows)
    assert quality_classifier.scored(df.limit(0), labels).collect() == []


def test_priors_shrink_small_paths(spark):
    rows = [("a", "x", -4.0)] * 400 + [("b", "y", 4.0)] * 400 + [("a", "z", 4.0)]
    got = {(r["host"], r["path"]): r for r in quality_classifier.priors(spark.createDataFrame(rows, "host string, path string, llr double"), 0.0).collect()}
    assert got["a", "x"]["path_rate"] < 0.1 < 0.8 < got["b", "y"]["path_rate"]
    assert got["a", "z"]["path_rate"] < 0.7 and got["a", "z"]["path_rate"] > got["a", "x"]["path_rate"]


def toxic_rows(n=600, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    bad = ["vile", "rotten", "foul", "nasty"]
    rows, labels = [], []
    for d in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        toxic = int(rng.random() < 0.25)
        for _ in range(toxic * rng.randint(1, 3)):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((d, " ".join(text)))
        labels.append((d, 1, toxic))
    return rows, labels


def test_toxicity_chain_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, (9000, None), (None, "vile rotten")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, known)
    assert chain.categories == ("low_quality", "toxic") and len(chain.models[1][0]) == len(chain.models[0][0]) + 1
    out = {r["doc_id"]: r for r in toxicity.predict(docs, chain).collect()}
    truth = {d: t for d, _, t in labels}
    assert all(out[d]["toxic"] == bool(truth[d]) for d in truth if d % 2 == 0)
    assert not out[9000]["toxic"] and out[None]["toxic"]
    assert toxicity.predict(docs.limit(0), chain).collect() == []
    empty = toxicity.train(docs, known.limit(0))
    assert not any(r["toxic"] for r in toxicity.predict(docs, empty).collect())


def test_the_chain_helps_a_category_with_few_labels():
    rng = np.random.default_rng(4)
    x = (rng.random((1500, 40)) < 0.2).astype(np.float32)
    truth = (x[:, :8].sum(1) >= 3).astype(float)
    y = np.stack([truth, truth], 1)
    y[40:, 1] = np.nan  # the later category is known for forty rows only

    def ranked(known):
        """The share of pairs of a row with and one without the category that are in the right order."""
        chain = toxicity.fit_chain(("a", "b")[-known.shape[1] :], np.zeros(0, np.uint64), x[:1000], known)
        p, t = chain.predict(x[1000:])[:, -1], truth[1000:] == 1
        return (p[t][:, None] > p[~t]).mean()

    assert ranked(y[:1000]) >= ranked(y[:1000, 1:]) + 0.05


def test_probabilities_in_training_are_out_of_fold():
    """A row's own label does not reach the probability that the next model learns from."""
    rng = np.random.default_rng(5)
    x, y = np.eye(200, dtype=np.float32), (rng.random((200, 2)) < 0.5).astype(float)
    chain = toxicity.fit_chain(("a", "b"), np.zeros(0, np.uint64), x, y, l2=0.01)
    own = sigmoid(x @ chain.models[0][0] + chain.models[0][1])
    assert np.corrcoef(own, y[:, 0])[0, 1] > 0.9  # each row is known by a feature of its own
    assert abs(chain.models[1][0][-1]) < 20


def test_best_threshold():
    assert toxicity.best_threshold(np.array([0.9, 0.3, 0.2]), np.array([1, 1, 0])) == pytest.approx(0.25)
    assert toxicity.best_threshold(np.zeros(0), np.zeros(0)) == 0.5


def test_queries_are_named_once_for_each_operator():
    names = [n.split("_")[0] for n in queries()]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{k}" for k in range(1, 13)]


def test_chain_predictions_equal_plain_sums(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    chain = toxicity.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    place = {f: i for i, f in enumerate(chain.features.tolist())}
    found = toxicity.predict(docs, chain).collect()
    assert len(found) == len(texts) and any(r["toxic"] for r in found)
    for r in found:
        here = sorted({place[h] for h in toxicity.feature_hashes(pa.array([texts[r["doc_id"]]], pa.string()))[1].tolist() if h in place})
        earlier = []
        for category, (w, b) in zip(chain.categories, chain.models, strict=True):
            z = b + sum(w[i] for i in here) + w[len(place)] * np.log1p(len(here)) + sum(w[len(place) + 1 + k] * p for k, p in enumerate(earlier))
            earlier.append(1 / (1 + np.exp(-z)))
            assert abs(r[f"p_{category}"] - earlier[-1]) < 1e-5
        assert r["toxic"] == (earlier[-1] >= chain.threshold) or abs(earlier[-1] - chain.threshold) < 1e-5


def test_later_categories_are_learned_from_out_of_fold_probabilities():
    """The second model sees, for each row, what a first model says that has not seen the row."""
    rng = np.random.default_rng(4)
    x = (rng.random((400, 6)) < 0.4).astype(np.float32)
    y = np.stack([(x[:, 0] + rng.random(400) > 1.1), (x[:, 1] + x[:, 0] + rng.random(400) > 1.6)], axis=1).astype(float)
    y[rng.random(400) < 0.2, 0] = np.nan
    chain = toxicity.fit_chain(("a", "b"), np.arange(6, dtype=np.uint64), x, y)
    fold = np.random.default_rng(3).permutation(400) % toxicity.FOLDS
    known = ~np.isnan(y[:, 0])
    p = np.array([0.0] * 400)
    for f in range(toxicity.FOLDS):
        others = [i for i in range(400) if fold[i] != f and known[i]]
        w, b = fit_logistic(x[others], y[others, 0], 0.5)
        for i in np.flatnonzero(fold == f):
            p[i] = sigmoid(x[i] @ w + b)
    for got, want in zip(chain.models, (fit_logistic(x[known], y[known, 0], 0.5), fit_logistic(np.hstack([x, p[:, None]]), y[:, 1], 0.5)), strict=True):
        assert np.allclose(got[0], want[0], atol=1e-6) and np.isclose(got[1], want[1])
