"""The queries of this subpackage: each applies its operator, with its own defaults, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, mixing, quality_crf, quality_rules, secrets, simhash, tokens, toxicity
from .common import crc_mod, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(*columns)


def _graded(scored: DataFrame, folds: int, held: int) -> DataFrame:
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return _graded(toxicity.score_toxicity(docs, model), 5, 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.fit_quality(docs, table(spark, sf_dir, "labels"))
    return _graded(quality_crf.score_quality(docs, model), 3, 1)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify_language(docs, langid.fit_langid(docs))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_simhash, op2_quality_rules, op3_toxicity, op4_mixing, op5_secrets, op6_decontamination, op7_licenses, op8_quality, op9_langid, op10_token_counts, pipeline)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.oracle_sql(), "op4_mixing": mixing.oracle_sql(), "op5_secrets": secrets.oracle_sql(), "op6_decontamination": decontam.oracle_sql()}
