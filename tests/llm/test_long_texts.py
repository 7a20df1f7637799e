"""One very long text, and one very long word, through every operator."""

from __future__ import annotations

import random

import pytest
from gridloom.llm import decontaminate, jaccard_join, line_dedup, packing, quality_classifier, quality_rules, secrets, sharding, token_counts, toxicity
from gridloom.llm.queries import tokenizer_path
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(5000)]
    long_one = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(15_000))  # 180,000 words
    rows = [(1, long_one, "a"), (2, long_one + "\nand a last line of some words", "a"), (3, "x" * 400_000, "b"), (4, "a short one of a few words here", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).repartition(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")


def test_jaccard(docs):
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4} and jaccard_join.one_of_each(docs).count() == 3


def test_line_dedup(docs):
    out = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert out[2]["text"] == "and a last line of some words" and out[2]["n_removed"] == 15_000 and out[1]["n_removed"] == 0


def test_decontamination(spark, docs):
    text = docs.where("doc_id = 1").first()["text"]
    item = " ".join(text.split()[90_000:90_040])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(found) == {1, 2} and (found[1]["start_word"], found[1]["end_word"]) == (90_000, 90_040)


def test_packing_and_counts(docs):
    rows = packing.pack(docs, tokenizer_path()).collect()
    totals = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert {d: sum(r["length"] for r in rows if r["doc_id"] == d) for d in totals} == totals
    edit = F.array(F.struct(F.lit(10).alias("start"), F.lit(12).alias("end"), F.lit("zz").alias("text")))
    counted = {r["doc_id"]: r for r in token_counts.count_edited(docs, edit, tokenizer_path()).collect()}
    assert {d: r["n_tokens"] + 1 for d, r in counted.items()} == totals and counted[1]["n_encoded"] == 1


def test_native_operators(docs, labels):
    assert sharding.assign_shards(docs).count() == 4
    assert {r["n_hex"] for r in secrets.scan(docs).collect()} == {0}
    out = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, quality_rules.fit_rules(docs, labels)).collect()}
    assert out[1]["n_words"] == 180_000 and out[3]["word_chars"] == 400_000


def test_classifiers(docs, labels):
    assert quality_classifier.scored(docs, labels).count() == 4
    assert toxicity.predict(docs, toxicity.train(docs, labels)).count() == 4
