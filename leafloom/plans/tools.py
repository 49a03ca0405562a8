"""What a reader asks of a built repository, over one version of its store: documents, search, context, graph, impact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom import schema
from leafloom.functions import text as T
from leafloom.operators import entities, graph, index, search
from leafloom.plans import build
from leafloom.sources.store import Store

#: What is made from a document, and what reads it.
ARTIFACTS = {"sections": "tree", "summaries": "summaries", "vectors": "vectors", "entity_hits": "entities", "xrefs": "references", "records": "search index", "postings": "search index", "manifest": "manifest"}
SURFACES = ("search_documents", "context", "graph", "impact", "outline", "get_section", "search_semantic", "search_keyword", "find_mentions", "get_related", "read_range")
GUIDANCE = {
    "indexed": "search, then open sections at the level you need",
    "stale": "its source has changed since it was built: answers are of the old text; build again",
    "missing": "it was never built: build before you search it",
    "error": "it can't be built: its error says why",
    "orphaned": "its source is gone: remove it from the store",
}


@dataclass(frozen=True)
class Context:
    """Sections in order of rank, a map of them and their relationships, and the documents that need care."""

    sections: DataFrame
    nodes: DataFrame
    edges: DataFrame
    stale: DataFrame
    skipped: DataFrame


class Workspace:
    """The tools over one version of a store.  ``found``: the documents as discovered (see ``build.readable``), which tell
    what is stale; without it nothing is."""

    def __init__(self, store: Store, found: DataFrame | None = None):
        self.store, self.spark, self.found = store, store.spark, found
        self.snapshot = store.snapshot()
        self.index = index.Index(self.snapshot)

    def table(self, name: str) -> DataFrame:
        return self.snapshot.read(name, build.TABLES[name])

    def documents(self, state: str | None = None) -> DataFrame:
        """States of found and built documents with what to do about each, or those of one state."""
        if state is not None and state not in schema.STATES:
            raise schema.InvalidInput(f"unknown state {state}")
        if self.found is None:
            raise schema.InvalidInput("states need the documents as discovered")
        guidance = F.create_map(*[F.lit(x) for pair in GUIDANCE.items() for x in pair])
        rows = build.list_documents(self.found, self.store).withColumn("guidance", F.element_at(guidance, F.col("state")))
        return rows if state is None else rows.where(F.col("state") == state)

    def search(self, question: str, k: int = 8, sections_per_doc: int = 1, vector: list[float] | None = None, locales: tuple[str, ...] = (), edges: bool = True) -> DataFrame:
        """The best sections of all documents with their signals, ``rank`` and matched terms."""
        schema.within("k", k, 1, 32)
        schema.within("sections_per_doc", sections_per_doc, 1, 8)
        if not question.strip():
            raise schema.InvalidInput("empty query")
        asked = self.spark.createDataFrame([("q", question, vector)], "query_id string, question string, vector array<double>")
        asked = asked if vector is not None else asked.drop("vector")
        near = search.graph_edges(self.table("sections"), self.table("xrefs"), entities.fold(self.table("entity_hits"))) if edges else None
        return index.search(self.index, asked, k, sections_per_doc, locales, near).drop("query_id")

    def skipped(self, vector: list[float] | None) -> DataFrame:
        """Documents that can't be searched by a vector: theirs have another dimension."""
        rows = self.index.records.where(F.col("dim") != (len(vector) if vector is not None else -1)) if vector is not None else self.index.records.limit(0)
        return rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("dim")).alias("dims"))

    def context(self, question: str, k: int = 5, related_k: int = 3, level: str = "synopsis", max_section_chars: int = 1600, sections_per_doc: int = 1, vector: list[float] | None = None) -> Context:
        """The best sections with their content at a level, their strongest relationships, and a map of both."""
        schema.within("related_k", related_k, 0, 12)
        hits = self.index.kept(self.search(question, k, sections_per_doc, vector))
        docs = [r.doc_id for r in hits.select("doc_id").distinct().collect()]  # k at most
        own = lambda name: self.table(name).where(F.col("doc_id").isin(*docs))
        rows = self.index.kept(graph.context(hits.select("doc_id", "section_id", "source", "score", "rank"), own("sections"), own("summaries"), own("xrefs"), level, related_k, max_section_chars))
        related = rows.select("doc_id", "section_id", F.explode("related").alias("r")).select("doc_id", "section_id", "r.*") if related_k else None
        section = lambda s: graph.node_id("section", F.col("doc_id"), F.col(s))
        ids = rows.select("doc_id", "section_id")
        edges = rows.select(graph.node_id("document", F.col("doc_id")).alias("source"), section("section_id").alias("target"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))
        if related is not None:
            ids = ids.union(related.select("doc_id", "id")).distinct()
            edges = edges.unionByName(related.select(section("section_id").alias("source"), section("id").alias("target"), "kind", F.round("confidence", 4).alias("confidence")))
        nodes = rows.select(graph.node_id("document", F.col("doc_id")).alias("id"), F.lit("document").alias("kind"), F.col("source").alias("label")).distinct()
        nodes = nodes.unionByName(ids.join(own("sections").select("doc_id", "section_id", "title"), ["doc_id", "section_id"]).select(section("section_id").alias("id"), F.lit("section").alias("kind"), F.col("title").alias("label")))
        stale = self.documents("stale").select("id", "source") if self.found is not None else self.spark.createDataFrame([], "id string, source string")
        return Context(rows, nodes, edges.dropDuplicates(["source", "target", "kind"]), stale, self.skipped(vector))

    def document_impact(self, doc_id: str, max_results: int = 24) -> dict[str, DataFrame]:
        """What a change of a document touches: its first sections, documents that share entities, the tables made from it
        with their rows, and the tools that read them."""
        schema.within("max_results", max_results, 1, 100)
        order = self.snapshot.read("manifest", schema.MANIFEST).select("doc_id", F.col("doc_id").alias("doc_ord"))
        sections, related = graph.document_impact(self.table("sections"), entities.fold(self.table("entity_hits")), order, doc_id, max_results)
        counts = None
        for name, made in ARTIFACTS.items():
            if name == "postings":
                rows = self.index.entries(self.index.blocks()).where(F.col("doc_id") == doc_id)
            else:
                rows = self.snapshot.read(name, "doc_id string", optional=True).where(F.col("doc_id") == doc_id)
            one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), F.lit(made).alias("made"), "rows")
            counts = one if counts is None else counts.unionByName(one)
        return {"sections": sections, "related_documents": related, "artifacts": counts, "surfaces": self.spark.createDataFrame([(s,) for s in SURFACES], "surface string")}

    def read(self, doc_id: str, section_id: str) -> DataFrame:
        return self.table("sections").where((F.col("doc_id") == doc_id) & (F.col("section_id") == section_id)).select("*", T.anchor(F.col("doc_id"), F.col("section_id")).alias("anchor"))
