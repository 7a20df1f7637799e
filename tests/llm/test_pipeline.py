"""The pipeline's stages against plain versions of what they promise."""

from __future__ import annotations

import contextlib
from types import SimpleNamespace

import corpus_pipeline
import pyarrow as pa
from gridloom.llm import common, packing
from gridloom.llm.queries import tokenizer_path
from pyspark.sql import functions as F


def test_stages_chain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit("kept"))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= before
        docs, before = out, out.count()
    assert docs.select("doc_id").distinct().count() == before
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


def test_last_stage_counts_tokens(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {1: len(t.encode("one two", add_special_tokens=False).ids) + 1, 2: 1}


def written(spark, folder, rows, schema="doc_id long, text string, lang string, source string, n_chars int, key string, sid int"):
    """A folder of tables: these documents (with clashing columns), a benchmark and no labels."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(30))), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


def test_run_over_odd_documents(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    leak = words.replace("w", "v") + " " + " ".join(f"item{i}" for i in range(30))
    long_one = " ".join(f"long{i}" for i in range(30_000))
    rows = [
        (1, words, "en", "a"), (2, words, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (None, words.replace("w", "q"), "en", "b"),
        (5, leak, "en", None), (6, long_one, "en", "b"), (7, words.replace("w59", "other"), None, "b"),
    ]
    folder = written(spark, tmp_path, [(*r, None, "k", 1) for r in rows])
    out = corpus_pipeline.run(spark, folder).collect()
    # Copies (2) go with their repeated lines, near copies (7) with their group, the leak (5) with its item.
    assert sorted({r["doc_id"] for r in out}, key=repr) == sorted([1, 3, 4, 6, None], key=repr)
    assert {r["doc_tokens"] for r in out if r["doc_id"] in (3, 4)} == {1}


def test_run_over_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [])).collect() == []


def test_python_steps_release_memory_at_the_end_of_a_task(spark, tmp_path, monkeypatch):
    steps, called = [], []
    frame = type(spark.range(0))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **kw: steps.append(f) or plain(self, f, *a, **kw))
    corpus_pipeline.run(spark, written(spark, tmp_path, [(1, "some words\nof two lines", "en", "a", None, "k", 1)])).collect()
    assert {f.__module__.rsplit(".", 1)[-1] for f in steps} == {"line_dedup", "jaccard_join", "decontaminate", "packing"}
    monkeypatch.setattr(common, "release", lambda: called.append(1))
    for f in steps:
        called.clear()
        with contextlib.suppress(AttributeError):  # there is no TaskContext here
            list(f(iter([])))
        assert called, f


def test_a_packing_task_leaves_no_parts_in_its_worker(monkeypatch):
    docs = SimpleNamespace(selectExpr=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = packing.pack(docs, tokenizer_path())
    batch = pa.record_batch([pa.array([1, 2]), pa.array([" ".join(f"part{i}" for i in range(5000)), None])], names=["doc_id", "text"])
    first, again = list(run(iter([batch]))), list(run(iter([batch])))
    assert first == again and sum(sum(b.column(2).to_pylist()) for b in first) > 5000
    assert not packing.encoder(tokenizer_path()).rows
