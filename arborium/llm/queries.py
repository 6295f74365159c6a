"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lattice_lm, media, merkle, mixing, neardup, packing, pii, quality, resampling, token_files, toxicity, url_trust, vectors


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_documents(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).drop("rejected_by")  # which rule is named depends on timing


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


def op4_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(documents(spark, sf_dir))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classify(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_media": op1_media,
    "op2_quality": op2_quality,
    "op3_token_files": op3_token_files,
    "op4_url_trust": op4_url_trust,
    "op5_pii": op5_pii,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_lattice_lm": op8_lattice_lm,
    "op9_neardup": op9_neardup,
    "op10_packing": op10_packing,
    "op11_resampling": op11_resampling,
    "op12_merkle": op12_merkle,
    "op13_vectors": op13_vectors,
}

ORACLE_SQL = {
    "op2_quality": quality.ORACLE_SQL,
    "op4_url_trust": url_trust.oracle_sql(),
    "op6_mixing": mixing.ORACLE_SQL,
    "op11_resampling": resampling.oracle_sql(),
    "op12_merkle": merkle.oracle_sql(),
    "op13_vectors": vectors.ORACLE_SQL,
}
