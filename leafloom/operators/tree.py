"""Queries over heading trees.  ``sections`` has the columns of ``schema.SECTIONS``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom import schema
from leafloom.functions import text as T


def ancestor_ids(section_id: Column) -> Column:
    """Ids of all ancestors, nearest first, from the id alone."""
    parts = F.split(section_id, "/")
    n = F.size(parts)
    up = F.transform(F.sequence(n - 1, F.lit(1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.when(n > 1, up).otherwise(F.array().cast("array<string>"))


def roots(sections: DataFrame) -> DataFrame:
    return sections.where("parent IS NULL")


def children(sections: DataFrame, doc_id: str, section_id: str) -> DataFrame:
    return sections.where((F.col("doc_id") == doc_id) & (F.col("parent") == section_id))


def descendants(sections: DataFrame, doc_id: str, section_id: str) -> DataFrame:
    """Depth first; ids are paths, so that is document order below the prefix."""
    return sections.where((F.col("doc_id") == doc_id) & F.col("section_id").startswith(f"{section_id}/")).orderBy("pos")


def ancestors(sections: DataFrame, doc_id: str, section_id: str) -> DataFrame:
    parts = section_id.split("/")
    ids = ["/".join(parts[:k]) for k in range(len(parts) - 1, 0, -1)]
    own = sections.where((F.col("doc_id") == doc_id) & F.col("section_id").isin(ids))
    return own.orderBy(F.col("level").desc())


def outline(sections: DataFrame, depth: int = 2, focus: str | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """Flat rows of the outline of every document, with ``truncated`` where children are cut.

    Without a focus depth is a heading level; a focus counts from its own level.  The rows reached are those whose
    ancestors are all within the depth, which holds for every row because levels grow downward.
    """
    schema.within("depth", depth, 1, 6)
    rows = sections
    base = F.lit(0)
    if focus is not None:
        top = sections.where(F.col("section_id") == focus).select("doc_id", (F.col("level") - 1).alias("base"))
        rows = sections.where(T.in_scope(F.col("section_id"), focus)).join(F.broadcast(top), "doc_id")
        base = F.col("base")
    # a root always shows; a child shows where its parent is above the depth limit
    up = sections.select("doc_id", F.col("section_id").alias("parent"), F.col("level").alias("parent_level"))
    rows = rows.join(up, ["doc_id", "parent"], "left")
    start = F.col("parent").isNull() if focus is None else F.col("section_id") == focus
    rows = rows.where(start | (F.col("parent_level") < depth + base))
    cut = (F.size("children") > 0) & (F.col("level") >= depth + base)
    rows = rows.select("doc_id", "pos", "section_id", "title", "level", "parent", cut.alias("truncated"))
    if summaries is not None:
        rows = rows.join(summaries.select("doc_id", "section_id", "gist", "synopsis"), ["doc_id", "section_id"], "left")
    return rows


def content_at(level: str) -> Column:
    """Content of joined sections and summaries at a level; null where it is missing."""
    if level not in ("gist", "synopsis", "digest", "full"):
        raise schema.InvalidInput(f"unknown level {level}")
    return F.col("raw_text") if level == "full" else F.col(level)


def deeper_levels(level: str) -> Column:
    order = ["gist", "synopsis", "digest", "full"]
    rest = order[order.index(level) + 1 :]
    return F.filter(F.array(*[F.lit(x) if x != "digest" else F.when(F.col("digest").isNotNull(), F.lit(x)) for x in rest]).cast("array<string>"), lambda x: x.isNotNull())


def get_section(sections: DataFrame, summaries: DataFrame, doc_id: str, section_id: str, level: str = "synopsis") -> DataFrame:
    """One row: content at the level, path, whether it has children, deeper levels.  ``expand`` is the same query."""
    own = sections.where((F.col("doc_id") == doc_id) & (F.col("section_id") == section_id))
    rows = own.join(summaries.select("doc_id", "section_id", "gist", "synopsis", "digest"), ["doc_id", "section_id"], "left")
    found = rows.select("doc_id", "section_id", "title", "path", content_at(level).alias("content"), (F.size("children") > 0).alias("has_children"), deeper_levels(level).alias("next_levels"))
    if found.where("content IS NOT NULL").isEmpty():
        raise schema.NotFound(f"{section_id} at level {level}")
    return found


def read_range(sections: DataFrame, doc_id: str, start_id: str, end_id: str, max_tokens: int = 4000) -> DataFrame:
    """Sections from start to end whose running token sum is within the budget (the first always is), with ``next_id``,
    the first that was left out."""
    if max_tokens < 1:
        raise schema.InvalidInput("max_tokens must be positive")
    own = sections.where(F.col("doc_id") == doc_id)
    edge = {r.section_id: r.pos for r in own.where(F.col("section_id").isin(start_id, end_id)).select("section_id", "pos").collect()}
    if start_id not in edge or end_id not in edge:
        raise schema.NotFound(start_id if start_id not in edge else end_id)
    if edge[start_id] > edge[end_id]:
        raise schema.InvalidInput("start is after end")
    return budgeted(own.where(F.col("pos").between(edge[start_id], edge[end_id])), max_tokens)


def budgeted(rows: DataFrame, max_tokens: int) -> DataFrame:
    """Per document the rows in order within a token budget."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("content", T.rendered(F.col("title"), F.col("raw_text"))).withColumn("tokens", T.token_estimate(F.col("content")))
    rows = rows.withColumn("total", F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(by))
    kept = (F.col("total") <= max_tokens) | (F.col("rn") == 1)
    rows = rows.withColumn("next_id", F.min_by(F.when(~kept, F.col("section_id")), F.when(~kept, F.col("pos"))).over(Window.partitionBy("doc_id")))
    return rows.where(kept).select("doc_id", "pos", "section_id", "content", "tokens", "total", "next_id")


def build_summaries(sections: DataFrame, model: str = "offline", digest_from: int = 0) -> DataFrame:
    """Offline summaries of all sections; a digest only for bodies of ``digest_from`` words or more."""
    t, b = F.col("title"), F.col("raw_text")
    levels = {n: T.within_budget(T.summary(t, b, n), n) for n in T.LEVELS}
    return sections.select("doc_id", "section_id", levels["gist"].alias("gist"), levels["synopsis"].alias("synopsis"), F.when(F.size(T.words(b)) >= digest_from, levels["digest"]).alias("digest"), F.lit(model).alias("model"), T.section_hash(t, b).alias("section_hash"), F.current_timestamp().alias("generated_at"))


def keyword_hits(sections: DataFrame, terms: list[str], scope: str | None = None, mode: str = "any") -> DataFrame:
    """Score = occurrences times term length, over lower-case title and body."""
    if not 1 <= len(terms) <= 8 or any(not t.strip() for t in terms):
        raise schema.InvalidInput("one to eight terms")
    if mode not in ("any", "all"):
        raise schema.InvalidInput(f"unknown mode {mode}")
    low = [t.strip().lower() for t in terms]
    hay = F.lower(F.concat(F.col("title"), F.lit("\n"), F.col("raw_text")))
    rows = sections.where(T.in_scope(F.col("section_id"), scope)).withColumn("hay", hay)
    counts = [T.occurrences(F.col("hay"), F.lit(t)) for t in low]
    found = [F.col("hay").contains(t) for t in low]
    keep = found[0]
    for f in found[1:]:
        keep = (keep | f) if mode == "any" else (keep & f)
    score = sum((c * len(t) for c, t in zip(counts[1:], low[1:], strict=True)), counts[0] * len(low[0]))
    return rows.where(keep).withColumn("score", score).withColumn("counts", F.array(*counts)).drop("hay")


def search_keyword(sections: DataFrame, terms: list[str], scope: str | None = None, k: int = 12, mode: str = "any") -> DataFrame:
    schema.within("k", k, 1, 32)
    rows = keyword_hits(sections, terms, scope, mode)
    return rows.orderBy(F.desc("score"), "section_id", "doc_id").limit(k).select("doc_id", "section_id", "title", "score", "counts", T.head(F.col("raw_text")).alias("snippet"))


def validate(sections: DataFrame) -> DataFrame:
    """Rows of problems: duplicate ids, unknown parents or children, levels and spans out of range.

    One pass: every row gives its own id, its parent's and its children's, and each id is counted by what it is given as.
    """
    names = ("own", "up", "down", "odd")
    given = lambda s, what: F.struct(s.alias("section_id"), *[F.lit(int(n == what)).cast("long").alias(n) for n in names])
    some = lambda cond, e: F.filter(F.array(e), lambda _: cond)
    odd = F.expr("coalesce(level NOT BETWEEN 1 AND 6 OR span.start < 0 OR span.end < span.start OR trim(section_id) = '', FALSE)")
    own = F.concat(F.array(given(F.col("section_id"), "own")), some(odd, given(F.col("section_id"), "odd")))
    up = some(F.col("parent").isNotNull(), given(F.col("parent"), "up"))
    down = F.transform(F.coalesce("children", F.array().cast("array<string>")), lambda c: given(c, "down"))
    rows = sections.select("doc_id", F.explode(F.concat(own, up, down)).alias("e")).groupBy("doc_id", "e.section_id").agg(*[F.sum(f"e.{n}").alias(n) for n in names])
    known = (F.col("own") > 0) & F.col("doc_id").isNotNull() & F.col("section_id").isNotNull()
    times = lambda n, problem: F.array_repeat(F.lit(problem), n.cast("int"))
    found = F.concat(times(F.col("own") > 1, "duplicate id"), times(F.when(known, 0).otherwise(F.col("up")), "unknown parent"), times(F.when(known, 0).otherwise(F.col("down")), "unknown child"), times(F.col("odd"), "out of range"))
    return rows.select("doc_id", "section_id", F.explode(found).alias("problem"))
