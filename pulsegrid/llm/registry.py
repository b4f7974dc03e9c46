"""Queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anisotropic, bottom_k, crf, divergence, importance, interpolation, kneser_ney, mixing, oracles, packing, rule_ensemble, secret_scan, shared, simhash, url_rules


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.small_batches(spark)
    docs = shared.table(spark, sf_dir, "documents")
    model = crf.learn(docs, ~F.coalesce(shared.fold("doc_id", 5) == 0, F.lit(True)))
    return crf.identify(docs, model).select("doc_id", shared.is_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.small_batches(spark)
    return packing.pack(shared.table(spark, sf_dir, "documents"))


def op3_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.small_batches(spark)
    return interpolation.score(shared.table(spark, sf_dir, "documents"))


def op4_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.small_batches(spark)
    return kneser_ney.judge(shared.table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.small_batches(spark)
    return simhash.near_duplicates(shared.table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic.nearest(shared.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(shared.table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(shared.table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.small_batches(spark)
    docs, labels = (shared.table(spark, sf_dir, t) for t in ("documents", "labels"))
    ensemble = rule_ensemble.learn(docs, labels, ~F.coalesce(shared.fold("doc_id", 5) == 0, F.lit(True)))
    scored = rule_ensemble.score(docs, ensemble)
    return scored.select("doc_id", shared.is_fold("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.small_batches(spark)
    return secret_scan.scan(shared.table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.small_batches(spark)
    return divergence.audit(shared.table(spark, sf_dir, "documents"))


def op12_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.small_batches(spark)
    return bottom_k.near_duplicates(shared.table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.small_batches(spark)
    return importance.resample(*(shared.table(spark, sf_dir, t) for t in ("documents", "benchmark")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name; `pipeline` is corpus_pipeline.run. After them, what SQL can check of them."""
    own = (pipeline, op1_language, op2_packing, op3_interpolation, op4_perplexity, op5_simhash, op6_nearest, op7_url_rules, op8_mixing, op9_quality, op10_secrets, op11_divergence, op12_bottom_k, op13_importance)
    return {f.__name__: f for f in own} | oracles.QUERIES


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express in whole; the operators' own queries are tested against brute force."""
    return dict(oracles.SQL)
