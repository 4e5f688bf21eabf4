"""Registered queries of the training-data operators, next to their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelweave.llm import bpe, centroids, credentials, fingerprints, language, mixing, near_dup, negatives, quality, sharding, topk, toxicity, warc
from reelweave.llm.common import read_table


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(read_table(spark, sf_dir, "documents"))


def op2_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(read_table(spark, sf_dir, "documents"))


def op3_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read_table(spark, sf_dir, "documents"), with_ids=False)


def op4_norm_bucket_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_setsketch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.grouped(read_table(spark, sf_dir, "documents")).drop("class")


def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(read_table(spark, sf_dir, "documents"))


def op7_salvage_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read_table(spark, sf_dir, "pages"))


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.tagged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return rows.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(read_table(spark, sf_dir, "documents"), shards=40)


def op11_shared_list_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", noisy), F.col("vec_id") % 100 == 0, k=5, low=80, high=100)


def op12_incremental_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(read_table(spark, sf_dir, "embeddings"), clusters=40, rounds=5)


def op13_linked_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digests(credentials.credentials(read_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_subword_language": op2_subword_language,
    "op3_pair_index_bpe": op3_pair_index_bpe,
    "op4_norm_bucket_top_k": op4_norm_bucket_top_k,
    "op5_setsketch_groups": op5_setsketch_groups,
    "op6_multiset_hash": op6_multiset_hash,
    "op7_salvage_warc": op7_salvage_warc,
    "op8_site_quality": op8_site_quality,
    "op9_crf_toxicity": op9_crf_toxicity,
    "op10_kd_shards": op10_kd_shards,
    "op11_shared_list_negatives": op11_shared_list_negatives,
    "op12_incremental_centroids": op12_incremental_centroids,
    "op13_linked_credentials": op13_linked_credentials,
}

ORACLE = {
    "op1_pareto_mix": mixing.oracle(),
    "op4_norm_bucket_top_k": topk.oracle(),
    "op7_salvage_warc": warc.oracle(),
    "op11_shared_list_negatives": negatives.oracle(),
    "op12_incremental_centroids": centroids.oracle(),
    "op13_linked_credentials": credentials.oracle(),
}
