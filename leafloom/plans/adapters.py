"""Driver tables as sections: lines of documents, a hierarchy of regions, turns of conversations, and stored vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.session import shared_dir, small_batches
from leafloom.sources import markdown


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def staged(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, where a plan reads them more than once; it stays until its owner clears the
    folder."""
    path = f"{shared_dir(rows.sparkSession)}/leafloom/{name}-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document that is not blank is a section of level 1, titled by its first six words."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.concat_ws("/", "lang", "source").alias("source"), F.posexplode(F.split("text", "\n")).alias("pos", "raw_text")).where(F.trim("raw_text") != "")
    return rows.select(
        "doc_id", "pos", F.concat(F.lit("line-"), "pos").alias("section_id"), F.array_join(F.slice(T.words(F.col("raw_text")), 1, 6), " ").alias("title"), F.lit(1).alias("level"),
        F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("children"), F.struct(F.lit(0).alias("start"), F.length("raw_text").alias("end")).alias("span"),
        F.array().cast("array<string>").alias("path"), "raw_text", "source",
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws("/", "lang", "source").alias("source"), F.col("doc_id").alias("doc_ord"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading rows of one document per region: region, its nations, their customers, in key order."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    small = F.broadcast(nation)  # 25 rows by the schema
    one = region.select(F.col("r_regionkey").alias("doc_id"), F.lit(1).alias("level"), F.col("r_name").alias("title"), F.lit(-1).alias("a"), F.lit(-1).alias("b"))
    two = nation.select(F.col("n_regionkey").alias("doc_id"), F.lit(2).alias("level"), F.col("n_name").alias("title"), F.col("n_nationkey").alias("a"), F.lit(-1).alias("b"))
    three = customer.join(small, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("doc_id"), F.lit(3).alias("level"), F.col("c_mktsegment").alias("title"), F.col("n_nationkey").alias("a"), F.col("c_custkey").alias("b"))
    rows = one.unionByName(two).unionByName(three)
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("a", "b")) - 1
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), pos.alias("pos"), "level", "title").withColumn("start", F.col("pos") * 10).withColumn("body_start", F.col("pos") * 10 + 5).withColumn("size", F.lit(1 << 30))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = markdown.assemble(hierarchy(spark, sf_dir))
    return rows.select("doc_id", "pos", "section_id", "title", "level", "parent", "children", "span", "path", F.lit("").alias("raw_text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors with their label as scope."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.lit("vectors").alias("doc_id"), F.concat_ws("/", F.concat(F.lit("label-"), "label"), F.col("vec_id").cast("string")).alias("section_id"), "vec_id", F.size("embedding").alias("dim"), T.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("vector"))
