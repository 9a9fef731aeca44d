"""Queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import common, decontamination, jaccard, language, lm_scoring, metric_join, mixing, pii, sharding, token_files, toxicity


def op1_benchmark_decontamination(spark, sf_dir):
    docs, items = common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark")
    return decontamination.digest(decontamination.decontaminate(docs, items))


def op2_language_id(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    held_out = common.fold_of(F.col("doc_id"), 4) == 2
    return language.identify(docs.select("doc_id", "text", "lang")).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_source_mixing(spark, sf_dir):
    return mixing.mix(common.documents(spark, sf_dir)).drop("source")


def op4_pii_boosting(spark, sf_dir):
    return pii.digest(pii.detect(common.documents(spark, sf_dir)))


def op5_arrow_token_files(spark, sf_dir):
    return token_files.round_trip(common.documents(spark, sf_dir))


def op6_ngram_jaccard_join(spark, sf_dir):
    return jaccard.join(common.documents(spark, sf_dir))


def op7_toxicity(spark, sf_dir):
    return toxicity.detect(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


def op8_elias_fano_lm(spark, sf_dir):
    return lm_scoring.score_all(common.documents(spark, sf_dir))


def op9_hash_tree_sharding(spark, sf_dir):
    return sharding.shard(common.documents(spark, sf_dir), shards=16)


def op10_metric_range_join(spark, sf_dir):
    return metric_join.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def queries():
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_language_id, op3_source_mixing, op4_pii_boosting, op5_arrow_token_files, op6_ngram_jaccard_join, op7_toxicity, op8_elias_fano_lm, op9_hash_tree_sharding, op10_metric_range_join)}


def oracle_sql():
    return {"op1_benchmark_decontamination": decontamination.ORACLE_SQL, "op3_source_mixing": mixing.ORACLE_SQL, "op6_ngram_jaccard_join": jaccard.ORACLE_SQL, "op10_metric_range_join": metric_join.ORACLE_SQL}
