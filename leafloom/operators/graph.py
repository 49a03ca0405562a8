"""Neighbourhoods, relationship maps and change impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafloom import schema
from leafloom.functions import text as T

REL = ["doc_id", "src", "id", "kind", "relation", "direction", "confidence"]


def neighbours(sections: DataFrame, xrefs: DataFrame | None = None, kinds: tuple[str, ...] = ("parent", "child", "xref")) -> DataFrame:
    """Relationships of every section: rows of REL.  Roots have no siblings."""
    none = F.lit(None).cast("string")
    up = sections.where("parent IS NOT NULL")
    parts = []
    if "parent" in kinds:
        parts.append(up.select("doc_id", F.col("section_id").alias("src"), F.col("parent").alias("id"), F.lit("parent").alias("kind"), none.alias("relation"), none.alias("direction"), F.lit(1.0).alias("confidence")))
    if "child" in kinds:
        parts.append(up.select("doc_id", F.col("parent").alias("src"), F.col("section_id").alias("id"), F.lit("child").alias("kind"), none.alias("relation"), none.alias("direction"), F.lit(1.0).alias("confidence")))
    if "sibling" in kinds:
        a, b = up.select("doc_id", "parent", F.col("section_id").alias("src")), up.select("doc_id", "parent", F.col("section_id").alias("id"))
        parts.append(a.join(b, ["doc_id", "parent"]).where("src <> id").select("doc_id", "src", "id", F.lit("sibling").alias("kind"), none.alias("relation"), none.alias("direction"), F.lit(1.0).alias("confidence")))
    if "xref" in kinds and xrefs is not None:
        parts.append(xrefs.select("doc_id", "src", F.col("dst").alias("id"), F.lit("xref").alias("kind"), F.col("kind").alias("relation"), F.lit("outgoing").alias("direction"), "confidence"))
        parts.append(xrefs.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("id"), F.lit("xref").alias("kind"), F.col("kind").alias("relation"), F.lit("incoming").alias("direction"), "confidence"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["doc_id", "src", "id", "kind", "relation", "direction"])


def relationships(sections: DataFrame, xrefs: DataFrame | None = None, k: int = 3) -> DataFrame:
    """The k strongest relationships of every section, with titles; a missing title is the id."""
    order = Window.partitionBy("doc_id", "src").orderBy(F.desc("confidence"), "kind", "id", F.coalesce("direction", F.lit("")))
    rows = neighbours(sections, xrefs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    titles = sections.select("doc_id", F.col("section_id").alias("id"), "title")
    return rows.join(titles, ["doc_id", "id"], "left").select(*REL[:-1], F.round("confidence", 4).alias("confidence"), F.coalesce("title", "id").alias("title"), "rank")


def related(sections: DataFrame, xrefs: DataFrame | None, doc_id: str, section_id: str, kinds: tuple[str, ...] = ("xref",), k: int = 8, summaries: DataFrame | None = None) -> DataFrame:
    """Neighbours of one section by confidence and id."""
    schema.within("k", k, 1, 32)
    if set(kinds) - {"xref", "sibling", "parent", "child"}:
        raise schema.InvalidInput(f"unknown kinds {kinds}")
    own = neighbours(sections, xrefs, kinds).where((F.col("doc_id") == doc_id) & (F.col("src") == section_id))
    rows = own.join(sections.select("doc_id", F.col("section_id").alias("id"), "title"), ["doc_id", "id"], "left").withColumn("title", F.coalesce("title", "id"))
    if summaries is not None:
        rows = rows.join(summaries.select("doc_id", F.col("section_id").alias("id"), "gist"), ["doc_id", "id"], "left")
    return rows.orderBy(F.desc("confidence"), "id", "kind", "direction").limit(k)


def node_id(kind: str, *parts) -> object:
    return F.concat_ws(":", F.lit({"document": "doc"}.get(kind, kind)), *parts)


def repo_graph(sections: DataFrame, sources: DataFrame, xrefs: DataFrame | None = None, entities: DataFrame | None = None, max_sections: int = 120, max_entities: int = 40) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents, the first sections in document order, and the entities most mentioned there."""
    schema.within("max_sections", max_sections, 1, 500)
    schema.within("max_entities", max_entities, 0, 200)
    docs = sources.select(node_id("document", F.col("doc_id").cast("string")).alias("id"), F.lit("document").alias("kind"), F.col("source").alias("label"), F.lit(None).cast("long").alias("mentions"))
    chosen = sections.join(sources.select("doc_id", "doc_ord"), "doc_id").orderBy("doc_ord", "pos").limit(max_sections).select("doc_id", "section_id", "title", "parent")
    sec = lambda c: node_id("section", F.col("doc_id").cast("string"), F.col(c))
    nodes = docs.unionByName(chosen.select(sec("section_id").alias("id"), F.lit("section").alias("kind"), F.col("title").alias("label"), F.lit(None).cast("long").alias("mentions")))
    up = chosen.select("doc_id", F.col("section_id").alias("parent"), F.lit(True).alias("shown"))
    inside = chosen.join(up, ["doc_id", "parent"], "left")
    source = F.when(F.col("shown"), sec("parent")).otherwise(node_id("document", F.col("doc_id").cast("string")))
    edges = inside.select(source.alias("source"), sec("section_id").alias("target"), F.lit("contains").alias("kind"), F.lit(None).cast("string").alias("relation"), F.lit(1.0).alias("confidence"))
    keys = chosen.select("doc_id", "section_id")
    if xrefs is not None:
        refs = xrefs.join(keys.withColumnRenamed("section_id", "src"), ["doc_id", "src"], "left_semi").join(keys.withColumnRenamed("section_id", "dst"), ["doc_id", "dst"], "left_semi")
        edges = edges.unionByName(refs.select(sec("src").alias("source"), sec("dst").alias("target"), F.lit("xref").alias("kind"), F.col("kind").alias("relation"), F.round("confidence", 4).alias("confidence")))
    if entities is not None and max_entities:
        m = entities.select("kind", "canonical", "doc_id", F.explode("mentions").alias("m")).select("kind", "canonical", "doc_id", "m.section_id").distinct().join(keys, ["doc_id", "section_id"], "left_semi")
        top = m.groupBy("kind", "canonical").agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "kind", F.lower("canonical"), "canonical").limit(max_entities)
        ent = lambda: node_id("entity", F.col("kind"), T.slug(F.col("canonical")))
        nodes = nodes.unionByName(top.select(ent().alias("id"), F.lit("entity").alias("kind"), F.col("canonical").alias("label"), "mentions").dropDuplicates(["id"]))
        named = m.join(top.select("kind", "canonical"), ["kind", "canonical"])
        edges = edges.unionByName(named.select(sec("section_id").alias("source"), ent().alias("target"), F.lit("mentions").alias("kind"), F.col("kind").alias("relation"), F.lit(1.0).alias("confidence")))
    return nodes, edges.dropDuplicates(["source", "target", "kind", "relation"])


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counted = nodes.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("document", "documents"), ("section", "sections"), ("entity", "entities"))])
    return counted.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each


def inspector_payload(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as JSON lines for a viewer."""
    return nodes.select(F.lit("node").alias("what"), F.to_json(F.struct("*")).alias("json")).unionByName(edges.select(F.lit("edge").alias("what"), F.to_json(F.struct("*")).alias("json")))


def entity_keys(entities: DataFrame) -> DataFrame:
    return entities.select("doc_id", "kind", "canonical").distinct()


def related_documents(entities: DataFrame, doc_id: str, sources: DataFrame, max_results: int = 24) -> DataFrame:
    """Documents by the number of entities shared with one document."""
    schema.within("max_results", max_results, 1, 100)
    keys = entity_keys(entities)
    own = keys.where(F.col("doc_id") == doc_id).select("kind", "canonical")
    n = keys.where(F.col("doc_id") != doc_id).join(own, ["kind", "canonical"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))
    return n.join(sources.select("doc_id", "doc_ord"), "doc_id").orderBy(F.desc("shared"), "doc_ord").limit(max_results).select("doc_id", "shared")


def document_impact(sections: DataFrame, entities: DataFrame, sources: DataFrame, doc_id: str, max_results: int = 24) -> tuple[DataFrame, DataFrame]:
    """The first sections of a document and the documents related to it."""
    own = sections.where(F.col("doc_id") == doc_id).orderBy("pos").limit(max_results).select("doc_id", "section_id", "title")
    return own, related_documents(entities, doc_id, sources, max_results)


def section_impact(sections: DataFrame, xrefs: DataFrame | None, entities: DataFrame, doc_id: str, section_id: str, max_results: int = 24) -> DataFrame:
    """Sections that a change of one section touches: relationships, then sections that share an entity (0.18)."""
    schema.within("max_results", max_results, 1, 100)
    near = relationships(sections, xrefs, max_results).where((F.col("doc_id") == doc_id) & (F.col("src") == section_id)).select("doc_id", "id", "kind", "confidence")
    m = entities.select("kind", "canonical", "doc_id", F.explode("mentions").alias("m")).select(F.col("kind").alias("k"), "canonical", "doc_id", F.col("m.section_id").alias("id")).distinct()
    own = m.where((F.col("doc_id") == doc_id) & (F.col("id") == section_id)).select("k", "canonical")
    share = m.join(own, ["k", "canonical"], "left_semi").where(~((F.col("doc_id") == doc_id) & (F.col("id") == section_id))).select("doc_id", "id").distinct()
    rows = near.unionByName(share.select("doc_id", "id", F.lit("shared_entity").alias("kind"), F.lit(0.18).alias("confidence"))).groupBy("doc_id", "id", "kind").agg(F.max("confidence").alias("confidence"))
    return rows.orderBy(F.desc("confidence"), "kind", "doc_id", "id").limit(max_results)


def affected_documents(impact: DataFrame, doc_id: str) -> DataFrame:
    return impact.select("doc_id").union(impact.sparkSession.createDataFrame([(doc_id,)], "doc_id string")).distinct()


def context(hits: DataFrame, sections: DataFrame, summaries: DataFrame, xrefs: DataFrame | None = None, level: str = "synopsis", related_k: int = 3, max_section_chars: int = 1600) -> DataFrame:
    """Hits (doc_id, section_id, score, and their ``rank`` and ``source`` where they have them) with clipped content and their
    strongest relationships."""
    from leafloom.operators.tree import content_at

    schema.within("related_k", related_k, 0, 12)
    schema.within("max_section_chars", max_section_chars, 200, 8000)
    ranked = hits if "rank" in hits.columns else hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id", "section_id")))  # k rows
    given = ["source"] if "source" in hits.columns else []
    rows = F.broadcast(ranked).join(sections, ["doc_id", "section_id"]).join(summaries.select("doc_id", "section_id", "gist", "synopsis", "digest"), ["doc_id", "section_id"], "left")
    rows = rows.select("rank", "doc_id", *given, "section_id", "title", "path", "score", F.substring(content_at(level), 1, max_section_chars).alias("content"), T.anchor(F.col("doc_id"), F.col("section_id")).alias("anchor"))
    if related_k == 0:
        return rows.withColumn("related", F.array().cast("array<string>")).orderBy("rank")
    near = relationships(sections, xrefs, related_k).groupBy("doc_id", F.col("src").alias("section_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "kind", "confidence"))).alias("related"))
    return rows.join(near, ["doc_id", "section_id"], "left").orderBy("rank")
