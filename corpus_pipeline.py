"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns
the columns of ``documents``; the last one returns the pieces of the packed sequences.

Null and empty texts have no words to repeat, to link or to contaminate: they stay unless the
classifier rejects them, and pack as an end mark alone.  Very long texts are worked on whole.  Null
ids stay; of near-duplicates and of equal rows the one of least id stays, ids before nulls.  Extra
columns pass through all stages but the last, whatever their names.  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import saved, table

#: No SQL: the stages learn models, winnow and tokenize; tests compare them with plain versions.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    from gridloom.llm.quality_classifier import kept_documents

    return kept_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents that hold nothing else."""
    from gridloom.llm.line_dedup import without_repeats

    return without_repeats(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least id."""
    from gridloom.llm.jaccard_join import one_of_each

    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    from gridloom.llm.decontaminate import without_contaminated

    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    from gridloom.llm.packing import pack
    from gridloom.llm.queries import tokenizer_path

    return pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, "stage-" + name.replace(" ", "-"))
    return docs
