"""Incremental loads: new or changed files of a folder are parsed once, as a stream."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import registry, swc


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of neuron_id, content, md5 of the files that come to a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return read.select(swc.base_name(F.col("path")).alias("neuron_id"), "content", F.md5("content").alias("md5"))


def read_table(spark: SparkSession, table: str, part: str, schema: str | None = None) -> DataFrame | None:
    """The rows or files of an ingested table, with batch, which names the stream and the batch that brought them; None if there are none."""
    try:
        reader = spark.read.schema(f"{schema}, batch string") if schema else spark.read
        return reader.parquet(f"{table}/{part}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def ingest(spark: SparkSession, folder: str, form: str, table: str, checkpoint: str):
    """Adds the parsed rows of files that table doesn't hold with the same content; ends when all are read.

    table has two folders: rows, the parsed rows, and files, the names and digests read so far, each with a folder for a batch
    of a stream that is overwritten as a whole. A batch that was broken off comes again with its number and the same files, and
    replaces what it left: no row is lost or comes twice. A stream with another checkpoint has folders of its own.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, number: int) -> None:
        session, name = batch.sparkSession, f"{stream}-{number}"
        known = read_table(session, table, "files", "neuron_id string, md5 string")
        fresh = batch if known is None else registry.newer(batch, known.filter(F.col("batch") != name).drop("batch"))
        fresh = fresh.select("neuron_id", "content", "md5")
        part = registry.FORMATS[form].kind
        rows = registry.parsed(fresh, form, part).join(fresh.select("neuron_id", "md5"), "neuron_id")
        rows.write.mode("overwrite").parquet(f"{table}/rows/batch={name}")
        fresh.select("neuron_id", "md5").write.mode("overwrite").parquet(f"{table}/files/batch={name}")

    return watch(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
