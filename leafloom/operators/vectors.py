"""Section vectors and exact nearest neighbours, also for many queries in one plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom import schema
from leafloom.functions import text as T

SCOPE = r"^[a-z0-9][a-z0-9_/-]*$"
#: Rows and query vectors of one block, and of one product inside it.
MOST_ROWS, MOST_QUERIES, CHUNK = 8192, 8192, 1024
#: What the order of a sum can change in a score.
MARGIN = 1e-9


def offline(title: Column, body: Column, dim: int = 64) -> Column:
    """The offline vector of a section, to unit length."""
    return F.transform(T.hash_embedding(T.embedding_text(title, body), dim), lambda x: x.cast("float"))


def build(sections: DataFrame, dim: int = 64) -> DataFrame:
    """Offline vectors of all sections."""
    return sections.select("doc_id", "section_id", F.lit(dim).alias("dim"), offline(F.col("title"), F.col("raw_text"), dim).alias("vector"))


def nearest(vectors: DataFrame, query: list[float], k: int = 8, scope: str | None = None) -> DataFrame:
    """The k best by cosine; the scope is filtered before ranking and pushed to the scan; ties by id."""
    schema.within("k", k, 1, 32)
    if scope is not None and not re.match(SCOPE, scope):
        raise schema.BuildFailed(f"bad scope {scope!r}")
    q = T.unit(F.array(*[F.lit(float(x)) for x in query]))
    rows = vectors.where((F.size("vector") == len(query)) & T.in_scope(F.col("section_id"), scope))
    score = T.clamp(T.dot(F.col("vector"), q))
    return rows.select("doc_id", "section_id", score.alias("score")).orderBy(F.desc("score"), "section_id", "doc_id").limit(k)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """The k best for each row of ``query_id, query`` (unit vectors): ``query_id, doc_id, section_id, score, rank``.

    Rows and queries are dealt to blocks, each block of queries meets each block of rows in one task as a matrix product, and
    only the k best of each query leave it.  Of equal vectors the first k by id are compared, as no other can be among the
    best; they are found before.  All pairs are computed, in bounded memory; what is shuffled are rows once for each block of
    queries and k for each query and block of rows.
    """
    same = Window.partitionBy("vector").orderBy("section_id", "doc_id")
    rows = vectors.select("doc_id", "section_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    rows = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k).drop("n")
    n_rows, n_queries = (max(1, -(-x.count() // most)) for x, most in ((vectors, MOST_ROWS), (queries, MOST_QUERIES)))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.withColumn("r", deal(n_rows, "doc_id", "section_id")).withColumn("q", every(n_queries))
    right = queries.select("query_id", F.transform("query", lambda x: x.cast("double")).alias("query"))
    right = right.withColumn("q", deal(n_queries, "query_id")).withColumn("r", every(n_rows))
    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *right.schema]}
    ddl = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, section_id {kinds['section_id']}, score double"
    left, right = (x.repartition(n_rows * n_queries, "r", "q") for x in (left, right))  # small blocks of much work: none are merged
    best = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(_best_of_block(k, ddl), ddl)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "section_id", "doc_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _best_of_block(k: int, ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(rows, asked):
        """The k best rows of each query.  A product of matrices sums in an order of its own, so it only tells which pairs can
        be among the best; their scores are summed entry by entry like ``text.dot``, and equal ones are ordered by id."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = []
        table = rows.sort_by([("section_id", "ascending"), ("doc_id", "ascending")]).combine_chunks()

        def sizes(t, name):
            """Lengths of vectors; -1 where one is null or holds a null: its scores are null, which ``text.clamp`` makes 1."""
            column = t.column(name).combine_chunks()
            n = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False).copy()
            n[pc.list_parent_indices(column).to_numpy()[np.flatnonzero(pc.is_null(pc.list_flatten(column)).to_numpy(zero_copy_only=False))]] = -1
            return n

        def dense(t, name, which, dim):
            return pc.list_flatten(t.column(name).take(pa.array(which))).to_numpy().reshape(len(which), dim)

        def clamped(x):
            return np.where(np.isnan(x), 1.0, np.clip(x, 0.0, 1.0))

        have, wanted = sizes(table, "vector"), sizes(asked, "query")
        for dim in np.unique(wanted):
            at, of = np.flatnonzero((have == dim) & (dim >= 0)), np.flatnonzero(wanted == dim)
            v = dense(table, "vector", at, dim) if len(at) else None
            others = np.flatnonzero((have != dim) | (dim < 0))[:k]
            for a in range(0, len(of), CHUNK):
                own = of[a : a + CHUNK]
                ends = np.full(len(own), -np.inf)  # the k-th best so far
                who, where, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                q = dense(asked, "query", own, dim) if len(at) else None
                for b in range(0, len(at), CHUNK):
                    near = clamped(q @ v[b : b + CHUNK].T)
                    if not b and near.shape[1] > k:
                        ends = np.partition(near, -k, axis=1)[:, -k]
                    i, j = np.nonzero(near >= (ends - MARGIN)[:, None])
                    exact = np.zeros(len(i))
                    for d in range(dim):
                        exact += q[i, d] * v[b + j, d]
                    who, where, score = np.concatenate([who, i]), np.concatenate([where, b + j]), np.concatenate([score, clamped(exact)])
                    order = np.lexsort((where, -score, who))  # rows stand in the order of their ids
                    who, where, score = who[order], where[order], score[order]
                    place = np.arange(len(who)) - np.searchsorted(who, who)
                    who, where, score, place = (x[place < k] for x in (who, where, score, place))
                    ends[who[place == k - 1]] = score[place == k - 1]
                found = [(own[who], at[where], pa.array(score))] if len(who) else []
                if len(others):
                    found.append((np.repeat(own, len(others)), np.tile(others, len(own)), pa.array(np.ones(len(own) * len(others)))))
                for x, y, scores in found:
                    columns = [asked.column("query_id").take(pa.array(x)), *(table.column(c).take(pa.array(y)) for c in ("doc_id", "section_id")), pa.chunked_array([scores])]
                    out.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow))
        return pa.concat_tables(out) if out else pa.Table.from_pylist([], schema=arrow)

    return run


def check(vectors: DataFrame, sections: DataFrame, dim: int) -> DataFrame:
    """Problems: vectors of another dimension, sections without one."""
    wrong = vectors.where(F.size("vector") != dim).select("doc_id", "section_id", F.lit("dimension").alias("problem"))
    none = sections.select("doc_id", "section_id").join(vectors, ["doc_id", "section_id"], "left_anti").select("doc_id", "section_id", F.lit("no vector").alias("problem"))
    return wrong.unionByName(none)


def search_semantic(vectors: DataFrame, sections: DataFrame, query: list[float], text: str, k: int = 8, scope: str | None = None) -> DataFrame:
    """Nearest sections that the tree still has, with their strongest evidence window."""
    from leafloom.functions.query import query_terms

    hits = nearest(vectors, query, k, scope)
    rows = F.broadcast(hits).join(sections.select("doc_id", "section_id", "title", "raw_text"), ["doc_id", "section_id"])  # k rows
    return rows.select("doc_id", "section_id", "title", "score", T.head(F.col("raw_text")).alias("head"), T.evidence(F.col("raw_text"), query_terms(text)).alias("evidence"), T.anchor(F.col("doc_id"), F.col("section_id")).alias("anchor")).orderBy(F.desc("score"), "section_id")
