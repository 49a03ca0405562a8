"""What the operators of this subpackage share: staged tables in the shared folder and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.session import small_batches

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all nodes share: ``spark.checkpoint.dir``; where it is unset, one below the warehouse, or for a
    local master one in the temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return f"file://{tempfile.gettempdir()}/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors and are read by any node.

    Each run has a folder of its own.  ``drop`` removes one table as soon as nothing reads it; what a returned DataFrame
    still reads stays until the folder is cleaned by its owner.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = small_batches(spark)
        self.dir = f"{shared_dir(spark)}/leafloom/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}"

    def stage(self, df: DataFrame, name: str, by: list[str] | None = None, codec: str = "zstd") -> DataFrame:
        """Writes the table and gives it as read from there.  Its shuffle files go when it is written."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer = df.write.option("compression", codec)
            (writer.partitionBy(*by) if by else writer).parquet(self.path(name))
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session sets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL string, made on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
