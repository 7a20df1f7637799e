"""The registered queries of the twelve operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents")).drop("found")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules, fit_rules

    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


#: The edits of the count query: runs of digits are masked and runs of symbols taken out.
EDITS = {r"[0-9]{4,}": "0", r"[#*$%&]{2,}": ""}


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .native import matches
    from .token_counts import count_edited

    text = F.coalesce(F.col("text"), F.lit(""))

    def edit(new: str):
        return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(new).alias("text"))

    edits = F.concat(*[F.transform(matches(text, pattern), edit(new)) for pattern, new in EDITS.items()])
    return count_edited(table(spark, sf_dir, "documents"), edits, tokenizer_path())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import scored

    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carried=["doc_id"])
    digits = [F.round(c, 6).alias(c) for c in ("evidence", "host_rate", "path_rate", "p_low")]
    return out.select(F.col("row.doc_id").alias("doc_id"), *digits, "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import predict, train

    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs, table(spark, sf_dir, "labels")))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import mark_copies

    return mark_copies(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the secret scan reports of the fixed patterns, which SQL can say."""
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the fixed test of the quality rules, which SQL can say."""
    return op7_quality_rules(spark, sf_dir).drop("rule", "kept")


def base_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Those columns of operators 5 and 7 that do not depend on what is learned."""
    return {f.__name__: f for f in (secret_base_spans, quality_base_counts)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
