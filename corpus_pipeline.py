"""A corpus pipeline of five stages over documents; each stage's result is written and read again as the next one's input.

Defined results: null and empty texts pass toxicity and near-duplicates (documents without words or without an id are never
copies), have no personal data, count no words, so that mixing takes none of them in a source of positive size, and rows that
repeat an id and a text are one document after near-duplicates, other texts of that id are others; an empty table gives an empty table; further columns are
carried along up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborium.llm import mixing, neardup, packing, pii, toxicity
from arborium.llm.common import written

#: Documents with this percentage of shared word shingles, or more, are copies; op9_neardup's contract alone has 85.
COPY_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go."""
    return toxicity.clean_stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_close_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.one_of_each_stage(docs, COPY_PERCENT)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return pii.masked_stage(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's target asks."""
    return mixing.mixed_stage(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of full training sequences."""
    return packing.packed_stage(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_close_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Token ids, MinHash groups and the fitted lexicon are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, stages: list = STAGES) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in stages[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return stages[-1][1](spark, docs, sf_dir)
