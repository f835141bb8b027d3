"""The registered queries opN_<name> of the training-data operators, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard_join, oracles, packing, quality_classifier, quality_rules, secret_ledger, substring_dedup, suffix_dedup, token_counts, warc
from .common import shared_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[out[f"s_{c}"].alias(c) for c in base], "base_failed", "kept")


def op2_count_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.join_sets(read(spark, sf_dir, "documents"))
    return out.select(out["id"].alias("doc_id"), "n_shingles", "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary())


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two runs of one ledger: the base rules first, then all; the second scans only the pairs that the first left
    base = tuple(r for r in secret_ledger.RULES if r.kind in secret_ledger.BASE_KINDS)
    return secret_ledger.digest(secret_ledger.scan_in_runs(read(spark, sf_dir, "documents"), [base, secret_ledger.RULES]))


def op5_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.find(docs, read(spark, sf_dir, "benchmark")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(read(spark, sf_dir, "documents"), keep_bytes=False))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary())


def op10_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup(read(spark, sf_dir, "documents"), keep_text=False))


QUERIES = {
    "op1_risk_controlled_rules": op1_risk_controlled_rules,
    "op2_count_tree_join": op2_count_tree_join,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_secret_ledger": op4_secret_ledger,
    "op5_suffix_decontamination": op5_suffix_decontamination,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_warc": op8_warc,
    "op10_recompression_dedup": op10_recompression_dedup,
    "op9_token_counts": op9_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op1_risk_controlled_rules": oracles.op1(),
    "op2_count_tree_join": oracles.op2(),
    "op4_secret_ledger": oracles.op4(),
    "op5_suffix_decontamination": oracles.op5(),
    "op7_suffix_array_dedup": oracles.op7(),
    "op8_warc": oracles.op8(),
    "op10_recompression_dedup": oracles.op10(),
}
