"""Incremental refresh: a stream of document versions, also late, repeated and deleted ones, built into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.plans import build
from leafloom.plans.producers import Producers
from leafloom.sources.files import Store

#: A null text deletes the document.
SOURCE = "doc_id string, text string, version long"
VERSIONS = "doc_id string, version long, deleted boolean"


def latest(batch: DataFrame) -> DataFrame:
    """The newest version of each document in a batch; of equal versions the larger text, a deletion last."""
    return batch.groupBy("doc_id").agg(F.max(F.struct("version", F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("deleted"))).alias("v")).select("doc_id", "v.*")


def newer(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``latest`` that are newer than the version the store has of their document."""
    had = known.select("doc_id", F.col("version").alias("had"))
    return latest(batch).join(had, "doc_id", "left").where("had IS NULL OR version > had").drop("had")


def merge(store: Store, batch: DataFrame, use: Producers | None = None) -> None:
    """Builds what a batch brings that is newer.  The versions are a table of the same commit as the documents' rows, so a
    batch that is run again, or an older version that comes late, changes nothing."""
    with store.staged(newer(batch, store.read("versions", VERSIONS, optional=True))) as rows:
        if rows.isEmpty():
            return
        found = rows.where("NOT deleted").select(
            F.col("doc_id").alias("id"), F.col("doc_id").alias("source"), "text", F.sha2("text", 256).alias("source_hash"),
            F.sha2("text", 256).alias("source_file_hash"), F.lit(None).cast("string").alias("error"),
        )
        build.build(store.spark, found, store, force=True, use=use, beside=rows.select("doc_id", "version", "deleted"), removed=rows.where("deleted").select("doc_id"))


def refresh(spark: SparkSession, source: str, store: Store, checkpoint: str, available_now: bool = True, use: Producers | None = None):
    """Starts the query: Parquet files of SOURCE rows below ``source`` go to all tables of the store."""
    stream = spark.readStream.schema(SOURCE).parquet(source).writeStream.foreachBatch(lambda batch, _: merge(store, batch, use)).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
