"""The build of a repository: discovered files to all sub-index tables and the manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom import schema
from leafloom.operators import entities, index, lifecycle, tree
from leafloom.plans.producers import Producers, hash_embedder
from leafloom.sources import files, markdown

TABLES = {"sections": schema.SECTIONS, "summaries": schema.SUMMARIES, "vectors": schema.VECTORS, "entity_hits": schema.ENTITY_HITS, "xrefs": schema.XREFS}
#: What a build writes of a document.
BUILT = (*TABLES, "records", "postings", "manifest")
PLAIN = r"\.(html?|txt|rst|csv|tsv|json|xml)$"


def _suffixes(names: tuple[str, ...]) -> str:
    return r"\.(" + "|".join(x[1:] for x in names) + ")$"


def readable(discovered: DataFrame, version: str = "1") -> DataFrame:
    """``id, source, text, source_hash, source_file_hash, error``: a file that has no reader or is no UTF-8 has an error and
    no text, a converted one also if nothing is left of it; none stops the others."""
    low = F.lower("source")
    known, converted = low.rlike(_suffixes(files.MARKDOWN)), low.rlike(PLAIN)
    rows = discovered.withColumn("raw", F.try_validate_utf8(F.col("content").cast("string")))
    body = F.when(low.rlike(r"\.html?$"), files.html_to_markdown(F.col("raw"))).otherwise(F.col("raw"))
    rows = rows.withColumn("body", F.when(known, F.col("raw")).when(converted, body))
    error = (
        F.when(~(known | converted), F.concat(F.lit("no reader: "), "source")).when(F.col("raw").isNull(), F.lit("not valid UTF-8"))
        .when(converted & ~F.col("body").rlike(r"\S"), F.lit("nothing left after conversion"))
    )
    stem = F.regexp_extract("source", r"([^/]+?)(?:\.[^./]+)?$", 1)
    rows = rows.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), F.when(known, F.col("body")).otherwise(markdown.with_title(F.col("body"), stem))))
    mark = F.concat("content", F.encode(F.concat(F.char(F.lit(0)), F.lit(version), F.char(F.lit(0)), F.col("text")), "UTF-8"))
    source_hash = F.when(known, F.sha2("text", 256)).otherwise(F.sha2(mark, 256))
    return rows.select("id", "source", "text", source_hash.alias("source_hash"), "source_file_hash", "error")


def manifest(store: files.Store) -> DataFrame:
    """What is built, by document; empty before the first build."""
    return store.read("manifest", schema.MANIFEST, optional=True).withColumnRenamed("doc_id", "id")


class Failures:
    """What producers could not do: their rows with an error, by document and stage.  Staged rows stay until ``clean``."""

    def __init__(self, store: files.Store):
        self.store, self.paths = store, []
        self.found = store.spark.createDataFrame([], schema.FAILURES)

    def staged(self, rows: DataFrame) -> DataFrame:
        self.paths.append(f"{self.store.root}/_work/{uuid.uuid4().hex[:12]}")
        rows.write.parquet(self.paths[-1])
        return self.store.spark.read.schema(rows.schema).parquet(self.paths[-1])

    def add(self, stage: str, rows: DataFrame) -> None:
        self.found = self.found.unionByName(rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(stage).alias("stage"), F.col("error").cast("string").alias("error")))

    def kept(self, stage: str, made: DataFrame) -> DataFrame:
        """A producer's rows without its errors."""
        if "error" not in made.columns:
            return made
        rows = self.staged(made)
        self.add(stage, rows.where("error IS NOT NULL"))
        return rows.where("error IS NULL").drop("error")

    def clean(self) -> None:
        for path in self.paths:
            self.store.delete(path)


def build(spark: SparkSession, found: DataFrame, store: files.Store, dim: int = 64, force: bool = False, use: Producers | None = None, beside: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Builds what is new or changed of ``found`` (see ``readable``) and returns ``id, source, rebuilt, ok, error``, one row
    per document.

    All tables of a build are one commit: readers see it whole or not at all, and the work is in proportion to the documents
    built.  A tree that isn't well formed, and whatever a producer raises for a document, is that document's error: it keeps
    what was built before, and the others are built.  Rows of ``versions`` (``beside``) and documents to remove go into the
    same commit.
    """
    use = use or Producers(embedder=hash_embedder(dim))
    producers = use.fingerprint()
    log = f"{store.root}/_work/log-{uuid.uuid4().hex[:12]}"
    with store.staged(found) as rows:
        good = rows.where("error IS NULL")
        todo = good if force else lifecycle.changed(good, manifest(store), producers)
        with store.staged(todo.withColumnRenamed("id", "doc_id")) as docs:
            failures = Failures(store)
            if beside is not None or not docs.isEmpty():
                _commit(store, docs, use, producers, failures, beside, removed)
            rebuilt = docs.select(F.col("doc_id").alias("id"), F.lit(True).alias("rebuilt"))
            failed = failures.found.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.concat_ws(": ", "stage", "error")).alias("failed"))
            out = rows.join(rebuilt, "id", "left").join(failed, "id", "left")
            error = F.coalesce("error", "failed")
            out = out.select("id", "source", (F.coalesce("rebuilt", F.lit(False)) & F.col("failed").isNull()).alias("rebuilt"), error.isNull().alias("ok"), error.alias("error"))
            out.write.parquet(log)
            failures.clean()
    return spark.read.parquet(log)


def _commit(store: files.Store, docs: DataFrame, use: Producers, producers: dict[str, str], failures: Failures, beside: DataFrame | None, removed: DataFrame | None) -> None:
    with store.commit() as commit:
        kept = failures.kept
        sections = commit.put("sections", kept("parser", use.get("parser")(docs.select("doc_id", "text"))), schema.SECTIONS)
        failures.add("tree", tree.validate(sections).select("doc_id", F.concat_ws(" ", "problem", "section_id").alias("error")))
        summaries = commit.put("summaries", kept("summarizer", use.get("summarizer")(sections)), schema.SUMMARIES)
        vectors = commit.put("vectors", kept("embedder", use.get("embedder")(sections)), schema.VECTORS)
        hits = commit.put("entity_hits", kept("entity_extractor", use.get("entity_extractor")(sections)), schema.ENTITY_HITS)
        commit.put("xrefs", kept("xref_extractor", use.get("xref_extractor")(sections, entities.fold(hits))), schema.XREFS)
        failed = failures.found = failures.staged(failures.found.distinct())
        good = docs
        if not failed.isEmpty():
            commit.without(failed)
            good, sections, summaries, vectors = (x.join(failed, "doc_id", "left_anti") for x in (docs, sections, summaries, vectors))
        index.write(commit, sections, vectors, summaries, docs.select("doc_id", "source"))
        counts = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("section_count"))
        made = good.join(counts, "doc_id", "left").select(
            "doc_id", F.col("source_hash").alias("indexed_hash"), F.col("source_file_hash").alias("indexed_source_file_hash"),
            F.coalesce("section_count", F.lit(0)).cast("int").alias("section_count"), F.current_timestamp().alias("indexed_at"), *[F.lit(v).alias(k) for k, v in producers.items()],
        )
        commit.put("manifest", made, schema.MANIFEST)
        gone = good.select("doc_id")
        commit.replaces(gone if removed is None else gone.unionByName(removed), list(BUILT))
        if beside is not None:
            commit.put("versions", beside)
            commit.replaces(beside, ["versions"])


def sync(spark: SparkSession, root: str, store: files.Store, config: files.RepoConfig | None = None, dim: int = 64, force: bool = False, use: Producers | None = None) -> DataFrame:
    """Discovers the documents of a repository and builds them; none at all is an error of the configuration."""
    found = files.discover(spark, root, config or files.load_config(root))
    if found.isEmpty():
        raise schema.InvalidConfig("no documents match the include patterns")
    return build(spark, readable(found), store, dim, force, use)


def list_documents(found: DataFrame, store: files.Store) -> DataFrame:
    """States of found and built documents (see ``lifecycle.status``) with the title of the first section, by source."""
    title: Column = F.min_by("title", "pos").alias("title")
    titles = store.read("sections", schema.SECTIONS, optional=True).groupBy(F.col("doc_id").alias("id")).agg(title)
    return lifecycle.status(found, manifest(store)).join(titles, "id", "left").orderBy("source", "id")
