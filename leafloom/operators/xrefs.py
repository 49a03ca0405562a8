"""Cross-references: links to anchors, references by number, and sections that share defined entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import text as T

#: Patterns and confidences.
LINK = r"\[[^\]]+\]\(#([^)\s]+)\)"
REFERENCE = r"(?i)(?:§\s*|(?:Section|Chapter|§)\s+)([0-9]+(?:\.[0-9]+)*)\b"
UNIQUE, AMBIGUOUS, TEXTUAL = 0.95, 0.75, 0.7
SHARED_BASE, SHARED_STEP, SHARED_CAP = 0.3, 0.2, 0.8


def _matches(sections: DataFrame, pattern: str) -> DataFrame:
    """``doc_id, pos, src, ord, found, start, end`` of the pattern's first group; offsets from the pieces between matches."""
    body = F.col("raw_text")
    whole, group = F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    rows = sections.select("doc_id", "pos", F.col("section_id").alias("src"), F.split(body, pattern, -1).alias("gaps"), whole.alias("whole"), group.alias("own")).where(F.size("whole") > 0)
    rows = rows.select("doc_id", "pos", "src", "gaps", "whole", F.posexplode("own").alias("ord", "found"))
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    begin = total(F.col("gaps"), F.col("ord") + 1) + total(F.col("whole"), F.col("ord"))
    inside = F.length(F.get("whole", F.col("ord"))) - F.length(F.element_at(F.split(F.get("whole", F.col("ord")), r"\Q(#\E|(?<=[^0-9.])(?=[0-9.]+$)"), F.lit(-1)))
    return rows.select("doc_id", "pos", "src", "ord", "found", (begin + inside).alias("start")).withColumn("end", F.col("start") + F.length("found"))


def _edge(kind: str, confidence) -> list:
    return ["doc_id", "pos", "ord", "src", "dst", F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence") if isinstance(confidence, float) else confidence.alias("confidence"), F.struct("start", "end").alias("span")]


def links(sections: DataFrame) -> DataFrame:
    """Anchor links to sections whose last id part is the anchor; each candidate gets an edge."""
    target = sections.select("doc_id", F.element_at(F.split("section_id", "/"), F.lit(-1)).alias("key"), F.col("section_id").alias("dst"))
    target = target.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "key")))
    found = _matches(sections, LINK).withColumn("key", F.lower("found")).join(target, ["doc_id", "key"]).where("dst <> src")
    return found.select(*_edge("link", F.when(F.col("n") == 1, UNIQUE).otherwise(AMBIGUOUS)))


def textual(sections: DataFrame) -> DataFrame:
    """References by number to the first section whose title begins with it."""
    first = Window.partitionBy("doc_id", "found").orderBy("pos")
    target = sections.select("doc_id", "pos", T.numeric_prefix(F.col("title")).alias("found"), F.col("section_id").alias("dst")).where("found IS NOT NULL")
    target = target.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("doc_id", "found", "dst")
    return _matches(sections, REFERENCE).join(target, ["doc_id", "found"]).where("dst <> src").select(*_edge("textual", TEXTUAL))


def entity_mediated(entities: DataFrame, most_sections: int | None = None) -> DataFrame:
    """Edges both ways between sections of a document that share defined entities.

    ``most_sections`` leaves out entities named in more sections; by default none is left out.
    """
    m = entities.where("kind = 'defined'").select("doc_id", "ent_ord", F.posexplode("mentions").alias("i", "m"))
    m = m.groupBy("doc_id", "ent_ord", F.col("m.section_id").alias("section_id")).agg(F.min_by("m.span", "i").alias("span"))
    if most_sections is not None:
        m = m.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "ent_ord"))).where(F.col("n") <= most_sections)
    a, b = m.select("doc_id", "ent_ord", F.col("section_id").alias("src"), "span"), m.select("doc_id", "ent_ord", F.col("section_id").alias("dst"))
    both = a.join(b, ["doc_id", "ent_ord"]).where("src <> dst")
    rows = both.groupBy("doc_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min_by("span", "ent_ord").alias("span"))
    return rows.select("doc_id", F.lit(1 << 30).alias("pos"), F.lit(0).alias("ord"), "src", "dst", F.lit("entity").alias("kind"), F.least(F.lit(SHARED_CAP), SHARED_BASE + SHARED_STEP * F.col("n")).alias("confidence"), "span")


def extract(sections: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """All edges of the three extractors, one per (src, dst, kind): the most confident, the first of equals."""
    edges = links(sections).unionByName(textual(sections))
    return dedupe(edges if entities is None else edges.unionByName(entity_mediated(entities)))


def dedupe(edges: DataFrame) -> DataFrame:
    best = edges.where("src <> dst").groupBy("doc_id", "src", "dst", "kind").agg(F.max_by(F.struct("confidence", "span"), F.struct("confidence", F.negative("pos"), F.negative("ord"))).alias("b"))
    return best.select("doc_id", "src", "dst", "kind", "b.confidence", "b.span")


def outgoing(xrefs: DataFrame, doc_id: str, section_id: str) -> DataFrame:
    return xrefs.where((F.col("doc_id") == doc_id) & (F.col("src") == section_id)).orderBy(F.desc("confidence"), "dst")


def incoming(xrefs: DataFrame, doc_id: str, section_id: str) -> DataFrame:
    return xrefs.where((F.col("doc_id") == doc_id) & (F.col("dst") == section_id)).orderBy(F.desc("confidence"), "src")


def consecutive(sections: DataFrame) -> DataFrame:
    """A deterministic extractor for tests: each section refers to the next."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    rows = sections.select("doc_id", "pos", F.lit(0).alias("ord"), F.col("section_id").alias("src"), F.lead("section_id").over(by).alias("dst")).where("dst IS NOT NULL")
    return rows.select("*", F.lit("link").alias("kind"), F.lit(1.0).alias("confidence"), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")).alias("span"))
