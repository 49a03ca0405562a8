"""What makes the sub-indexes of a build, by name: parsers, summarizers, embedders, extractors.

A producer is a function from DataFrames to the rows of its table.  A column ``error`` beside them marks documents that it
could not do: these are left as they were, the others are built.  ``per_document`` makes a producer of a plain function of
one document, ``of_model`` one of a function over a batch of texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leafloom import schema
from leafloom.functions import text as T
from leafloom.operators import entities, models, tree, vectors, xrefs
from leafloom.sources import markdown

Producer = Callable[..., DataFrame]
#: What each kind is given: parser (docs), summarizer and embedder (sections), entity_extractor (sections), xref_extractor
#: (sections, entities).
KINDS = {"parser": schema.SECTIONS, "summarizer": schema.SUMMARIES, "embedder": schema.VECTORS, "entity_extractor": schema.ENTITY_HITS, "xref_extractor": schema.XREFS}
_REGISTRY: dict[tuple[str, str], Producer] = {}


def register(kind: str, name: str, producer: Producer) -> None:
    """Makes a producer known; a name stands for what it gives, so documents that another name built are built again."""
    if kind not in KINDS:
        raise schema.InvalidConfig(f"unknown kind {kind}")
    _REGISTRY[kind, name] = producer


def lookup(kind: str, name: str) -> Producer:
    if (kind, name) not in _REGISTRY:
        raise schema.InvalidConfig(f"no {kind} {name}")
    return _REGISTRY[kind, name]


@dataclass(frozen=True)
class Producers:
    """Names of the producers of a build."""

    parser: str = "markdown"
    summarizer: str = "offline"
    embedder: str = "hash-64"
    entity_extractor: str = "heuristic"
    xref_extractor: str = "heuristic"

    def get(self, kind: str) -> Producer:
        return lookup(kind, getattr(self, kind))

    def fingerprint(self) -> dict[str, str]:
        return {k: getattr(self, k) for k in KINDS}


def hash_embedder(dim: int) -> str:
    """The name of the offline embedder of a dimension."""
    register("embedder", f"hash-{dim}", lambda sections: vectors.build(sections, dim))
    return f"hash-{dim}"


register("parser", "markdown", markdown.parse)
register("summarizer", "offline", tree.build_summaries)
register("entity_extractor", "heuristic", entities.hits)
register("entity_extractor", "one-per-section", entities.one_per_section)
register("xref_extractor", "heuristic", xrefs.extract)
register("xref_extractor", "consecutive", lambda sections, _: xrefs.consecutive(sections).select("doc_id", "src", "dst", "kind", "confidence", F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")).alias("span")))
for _dim in (16, 64, 256):
    hash_embedder(_dim)


def per_document(function: Callable[..., list[dict]], ddl: str) -> Producer:
    """A producer of a function from the rows of one document (lists of dicts, one per table) to rows of ``ddl``, whose
    doc_id is set, on the executors.  An error it raises is that document's.  A task holds one document at a time."""

    def run(*tables: DataFrame) -> DataFrame:
        arrow = to_arrow_schema(StructType.fromDDL(f"{ddl}, error string"))

        def rows(doc, parts):
            import pyarrow as pa

            try:
                out = [{**r, "doc_id": doc} for r in function(*parts)]
                return pa.Table.from_pylist(out, schema=arrow)
            except Exception as error:  # whatever a plug-in raises is its document's error
                return pa.Table.from_pylist([{"doc_id": doc, "error": f"{type(error).__name__}: {error}"}], schema=arrow)

        def ordered(table) -> list[dict]:
            found = table.to_pylist()
            return sorted(found, key=lambda r: r["pos"]) if found and "pos" in found[0] else found

        if len(tables) == 1:
            return tables[0].groupBy("doc_id").applyInArrow(lambda key, one: rows(key[0].as_py(), [ordered(one)]), f"{ddl}, error string")
        both = tables[0].groupBy("doc_id").cogroup(tables[1].groupBy("doc_id"))
        return both.applyInArrow(lambda key, one, two: rows(key[0].as_py(), [ordered(one), ordered(two)]), f"{ddl}, error string")

    return run


def summarizer_of(call: models.Batch, model: str, size: int = 32, workers: int = 4, levels: tuple[str, ...] = T.LEVELS) -> Producer:
    """Summaries by a model: one request for each section and level; levels that aren't asked for stay null."""

    def run(sections: DataFrame) -> DataFrame:
        t, b = F.col("title"), F.col("raw_text")
        asks = F.array(*[F.struct(F.lit(n).alias("level"), models.prompt(n, t, b).alias("prompt")) for n in levels])
        rows = sections.select("doc_id", "section_id", T.section_hash(t, b).alias("section_hash"), F.explode(asks).alias("a")).select("doc_id", "section_id", "section_hash", "a.*")
        made = models.mapped(rows, "prompt", "text", "string", call, size, workers)
        cut = F.create_map(*[x for n in levels for x in (F.lit(n), T.within_budget(F.trim("text"), n))])
        made = made.withColumn("text", F.element_at(cut, F.col("level")))
        out = made.groupBy("doc_id", "section_id", "section_hash").agg(*[F.max(F.when(F.col("level") == n, F.col("text"))).alias(n) for n in T.LEVELS], F.max("error").alias("error"))
        return out.select("doc_id", "section_id", *T.LEVELS, F.lit(model).alias("model"), "section_hash", F.current_timestamp().alias("generated_at"), "error")

    return run


def embedder_of(call: models.Batch, dim: int, size: int = 32, workers: int = 4) -> Producer:
    """Vectors by a model; a vector of another length is its document's error."""
    return lambda sections: models.embed(sections, call, dim, size, workers)

