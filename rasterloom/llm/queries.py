"""Queries of the training-data operators, their SQL, and their registration."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fim, langid, lmscore, ngram_join, oracles, packing, quality_classifier, quality_rules, sharding, topk, toxicity
from .common import table

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(spark, table(spark, sf_dir, "documents"))


def op2_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.cross_entropy_difference(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spark, table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(spark, table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return sharding.place(spark, docs, "doc_id", SHARDS)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(spark, table(spark, sf_dir, "documents"))


def op10_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(table(spark, sf_dir, "documents"))


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(spark, table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_langid_crf, op2_toxicity_gbt, op3_lm_cross_entropy, op4_bpe_prefix, op5_ngram_join, op6_quality_rules, op7_sharding, op8_packing, op9_exact_dedup, op10_quality_cotraining, op11_fill_in_middle, op12_top_products)}


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_join": oracles.ngram_join(), "op6_quality_rules": oracles.quality_rules(), "op7_sharding": oracles.sharding(SHARDS), "op9_exact_dedup": oracles.exact_dedup(), "op11_fill_in_middle": oracles.fill_in_middle(), "op12_top_products": oracles.top_products()}
