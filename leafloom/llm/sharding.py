"""Operator 8: a uniform shuffle into shards in two passes, for data larger than memory.

Pass one scatters the records by a seeded hash into buckets that fit in memory; pass two shuffles each bucket (Fisher and
Yates) and writes it.  Buckets follow one another, so a record's place in the whole order is its bucket's offset plus its
place in the bucket, and the shards are equal slices of that order: their row counts differ by one at most.  Offsets are a
table: sums over groups of buckets, and within each group; only their number of rows is ever in one place.

Defined results: a null text has no bytes; the order depends on the seed and the rows alone, not on how they were
partitioned (rows that agree in doc_id and text are interchangeable); an empty table writes nothing; all columns are kept
inside one ``record`` column, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafloom.llm._common import Scratch, documents, partitions, small_batches

OVERHEAD = 16
#: Buckets whose counts are summed up together; bytes of a task that shuffles buckets.
GROUP, TASK_BYTES = 1024, 256 << 20


def _size(text: str = "record.text"):
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + OVERHEAD).cast("long")


def _repeated(docs: DataFrame, place, scratch: Scratch, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Sets the rows apart whose equals (by ``place``) alone overfill a bucket, dealt by a staged number to ``split`` parts:
    all others (part 0) and those.  Usually there are none."""
    sums = docs.groupBy(place.alias("place")).agg(F.sum(_size()).alias("bytes"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    large = sums.where(F.col("bytes") > bucket_bytes)
    most = large.agg(F.max("bytes").alias("most")).first().most
    if most is None:
        return docs.withColumn("part", F.lit(0)), docs.limit(0).withColumn("part", F.lit(0))
    split = -(-most // bucket_bytes)
    keys = F.broadcast(large.select(F.col("place").alias("hot_place")))  # each stands for more than bucket_bytes
    hot = docs.join(keys, place == F.col("hot_place"), "left_semi").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(split)).cast("int"))
    return docs.join(keys, place == F.col("hot_place"), "left_anti").withColumn("part", F.lit(0)), scratch.stage(hot, "repeated")


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 17, bucket_bytes: int = 32 << 20) -> StructType:
    """Writes ``shard=N/`` folders of ``slot, size, record``; gives the schema of what it wrote.

    Scans without a shuffle of texts give the number of buckets and the rows of each; then texts are shuffled once, to as
    many tasks as their bytes need.  Rows that repeat so often that they would overfill a bucket are dealt to several, since
    equal rows are interchangeable.
    """
    spark = small_batches(docs.sparkSession)
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    total = docs.agg(F.coalesce(F.sum(_size()), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    n_buckets = max(-(-total.bytes // bucket_bytes), 2 * partitions(spark))
    place = F.xxhash64(F.lit(seed), F.col("record.doc_id"), F.col("record.text"))
    scratch = Scratch(spark, "shards")
    plain, hot = _repeated(docs, place, scratch, bucket_bytes)
    docs = plain.unionByName(hot)
    bucket = F.pmod(F.when(F.col("part") == 0, place).otherwise(F.xxhash64(place, F.col("part"))), F.lit(n_buckets)).cast("int")
    counts = scratch.stage(docs.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.floor(F.col("bucket") / GROUP)), "counts")
    before = lambda by: F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = counts.groupBy("g").agg(F.sum("n").alias("n")).select("g", before(Window.orderBy("g")).alias("ahead"))  # a row per GROUP buckets
    offsets = counts.withColumn("own", before(Window.partitionBy("g").orderBy("bucket"))).join(ahead, "g").select("bucket", (F.col("ahead") + F.col("own")).alias("offset"))
    base, extra = divmod(total.rows, shards)
    rows = docs.select(bucket.alias("bucket"), place.alias("place"), _size().alias("size"), "record")
    tasks = min(n_buckets, max(partitions(spark), -(-total.bytes // TASK_BYTES)))
    record = rows.schema["record"].dataType
    out = StructType.fromDDL("shard int, slot long, size long").add("record", record)

    def shuffled(table, where):
        import numpy as np
        import pyarrow as pa

        own = table.sort_by("place")
        rng = np.random.default_rng([seed, own["bucket"][0].as_py()])
        own = own.take(pa.array(rng.permutation(own.num_rows)))
        at = where["offset"][0].as_py() + np.arange(own.num_rows)
        late = at - extra * (base + 1)
        shard = np.where(late < 0, at // (base + 1), extra + late // max(base, 1))
        slot = at - shard * base - np.minimum(shard, extra)
        return pa.table({"shard": pa.array(shard, pa.int32()), "slot": pa.array(slot), "size": own["size"], "record": own["record"]})

    dealt = rows.repartition(tasks, "bucket").groupBy("bucket")
    done = dealt.cogroup(offsets.repartition(tasks, "bucket").groupBy("bucket")).applyInArrow(shuffled, out)
    done.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return out


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op8").path("shards")
    schema = write_shards(documents(spark, sf_dir), path)
    crc = F.crc32(F.coalesce(F.col("record.text"), F.lit("")).cast("binary"))
    return read_shards(spark, path, schema).select(
        F.col("record.doc_id").alias("doc_id"), "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
