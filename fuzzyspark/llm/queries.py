"""The operators' queries over the tables of a folder, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fuzzyspark.llm import collocations, decontaminate, filter_audit, fingerprints, hnsw, mixing, quality, secrets, sharding, simhash, token_files, toxicity, urls
from fuzzyspark.llm.common import table


def op1_toxic_clauses(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_fm_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.report(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op3_linked_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(table(spark, d, "documents"))


def op4_url_rules(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge(table(spark, d, "pages"))


def op5_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"))


def op6_simhash_groups(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op7_token_files(spark: SparkSession, d: str) -> DataFrame:
    return token_files.token_files(table(spark, d, "documents"))


def op8_weak_label_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(table(spark, d, "documents"))


def op9_hnsw_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return hnsw.nearest(table(spark, d, "embeddings"))


def op10_hash_tree_shards(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_documents(table(spark, d, "documents"), 16)


def op11_setm_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(table(spark, d, "documents"))


def op12_filter_interactions(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.audit(table(spark, d, "documents"), table(spark, d, "labels"))


def op13_weighted_samples(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxic_clauses, op2_fm_decontaminate, op3_linked_secrets, op4_url_rules, op5_mix_sources, op6_simhash_groups,
                                 op7_token_files, op8_weak_label_quality, op9_hnsw_neighbours, op10_hash_tree_shards,
                                 op11_setm_collocations, op12_filter_interactions, op13_weighted_samples)}
ORACLES = {"op5_mix_sources": mixing.oracle(), "op11_setm_collocations": collocations.oracle(),
           "op12_filter_interactions": filter_audit.oracle()}
