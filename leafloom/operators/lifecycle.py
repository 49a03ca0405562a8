"""Index lifecycle: states, changes, readiness, and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.schema import STATES


def status(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Found files (id, source, source_hash, error) against the index manifest (id, indexed_hash, section_count,
    indexed_at): indexed, stale, missing, error, or orphaned where the file is gone."""
    rows = found.withColumn("here", F.lit(True)).join(manifest.withColumn("known", F.lit(True)), "id", "full_outer")
    state = (
        F.when(F.col("here").isNull(), "orphaned").when(F.col("error").isNotNull(), "error").when(F.col("known").isNull(), "missing")
        .when(F.col("indexed_hash") == F.col("source_hash"), "indexed").otherwise("stale")
    )
    return rows.select("id", "source", state.alias("state"), "section_count", "source_hash", "indexed_hash", "indexed_at", "error")


def changed(found: DataFrame, manifest: DataFrame, producers: dict[str, str] | None = None) -> DataFrame:
    """Documents to build: new ones, changed ones, and those built by other producers."""
    same = F.col("indexed_hash") == F.col("source_hash")
    for name, version in (producers or {}).items():
        same = same & F.col(name).eqNullSafe(version)
    kept = found.select("id", "source_hash").join(manifest, "id").where(same).select("id")
    return found.join(kept, "id", "left_anti")


def orphans(found: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(found.select("id"), "id", "left_anti")


def counters(rows: DataFrame) -> DataFrame:
    """Counts by state and readiness."""
    out = rows.agg(F.count_if(F.col("state") != "orphaned").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    return out.withColumn("readiness", readiness(*[F.col(c) for c in ("indexed", "total", "stale", "missing", "error")]))


def readiness(indexed: Column, total: Column, stale: Column, missing: Column, error: Column) -> Column:
    share = F.when(total == 0, 0).otherwise(F.bround(100 * indexed / total))
    return F.greatest(F.lit(0), F.least(F.lit(100), share - 8 * stale - 12 * missing - 18 * error)).cast("int")


def primary(rows: DataFrame, configured: str | None = None) -> DataFrame:
    """The configured document if indexed, else the first that is indexed or stale."""
    fit = rows.where(F.col("state").isin("indexed", "stale"))
    first = (F.col("id") == F.lit(configured)) & (F.col("state") == "indexed")
    return fit.orderBy(F.coalesce(first, F.lit(False)).desc(), "source").limit(1)


def merge(current: DataFrame, update: DataFrame) -> DataFrame:
    """Rows of updated documents replace those that were there."""
    return current.join(update.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(update)


def doctor(rows: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``problem, n`` of states and vector dimensions."""
    bad = rows.where(F.col("state") != "indexed").groupBy(F.col("state").alias("problem")).agg(F.count(F.lit(1)).alias("n"))
    dims = vectors.where(F.col("dim") != dim).groupBy(F.concat(F.lit("dimension "), "dim").alias("problem")).agg(F.count(F.lit(1)).alias("n"))
    return bad.unionByName(dims)


def sync_log(built: DataFrame) -> DataFrame:
    """One row per document from rows with an optional error: failures stay apart and do not stop the others."""
    by = Window.partitionBy("doc_id")
    return built.withColumn("failed", F.max(F.col("error").isNotNull()).over(by)).groupBy("doc_id").agg(F.first("failed").alias("failed"), F.max("error").alias("error"), F.count_if(F.col("error").isNull()).alias("sections"))
