"""Registered queries: each applies one operator with production parameters to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import op1_secrets, op2_licenses, op3_simhash, op4_bpe, op5_token_counts, op6_toxicity, op7_lines
from lexmill.llm import op8_decontaminate, op9_substrings, op10_quality, op11_pii, op12_divergence, op13_interaction, oracles
from lexmill.llm.common import documents

#: The other operators cannot be written in SQL over whole tables; tests compare them with brute force.
ORACLES: dict[str, str] = {
    "op11_pii_scan": oracles.PII, "op12_source_divergence": oracles.DIVERGENCE, "op13_filter_interaction": oracles.INTERACTION,
}
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return op1_secrets.secret_digests(docs, op1_secrets.fit_formats(docs))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_licenses.license_matches(documents(spark, sf_dir))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = op3_simhash.simhash_components(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_bpe.bpe_digests(documents(spark, sf_dir), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op6_toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = op6_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op6_toxicity.toxicity_scores(docs, model)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = op7_lines.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_substrings.dedup_digests(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = op10_quality.fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op10_quality.quality_verdicts(docs, field)


def op11_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_pii.pii_digests(documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_divergence.source_divergence(documents(spark, sf_dir))


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_interaction.interaction_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_license_scan, op3_simhash_groups, op4_bpe_round_trip, op5_token_count, op6_toxicity_score,
        op7_line_dedup, op8_contamination, op9_substring_dedup, op10_quality_rules, op11_pii_scan, op12_source_divergence,
        op13_filter_interaction, pipeline,
    )
}
