"""Slots for external models: summaries and vectors by any function over batches of texts, with retries.

The offline models are column expressions (``tree.build_summaries``, ``vectors.build``); a remote model is a function from
a list of texts to a list of results, which runs in Arrow batches on the executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom import schema
from leafloom.functions import text as T

Batch = Callable[[list[str]], list]
RETRY = (429, 500, 502, 503, 504)


def retried(call: Batch, tries: int = 4, wait: float = 0.5) -> Batch:
    """Tries again with doubled waits where the error carries a status that may pass."""

    def run(texts: list[str]) -> list:
        for k in range(tries):
            try:
                return call(texts)
            except Exception as error:
                if getattr(error, "status", None) not in RETRY or k == tries - 1:
                    raise
                time.sleep(wait * 2**k)
        return []

    return run


def prompt(level: str, title: Column, body: Column) -> Column:
    """The request for a summary of one section."""
    if level not in T.BUDGETS:
        raise schema.InvalidInput(f"unknown level {level}")
    ask = f"Write the {level} of this section in at most {T.BUDGETS[level]} words. Answer with the text only.\n\n"
    return F.concat(F.lit(ask + "Title: "), title, F.lit("\n\n"), body)


def batch_answers(answer: Column) -> Column:
    """``{"items": [{"id", "summary"}]}``, also inside a code fence, as an array of (id, summary)."""
    bare = F.regexp_replace(F.trim(answer), r"^```[a-z]*\s*|\s*```$", "")
    return F.from_json(bare, "items array<struct<id:string,summary:string>>")["items"]


def answered(call: Batch, texts: list[str]) -> list[tuple[object, str | None]]:
    """An answer or an error for each text: a batch that fails is halved until only the texts at fault are left."""
    try:
        answers = call(texts)
        if len(answers) != len(texts):
            raise ValueError(f"{len(texts)} texts gave {len(answers)} answers")
        return [(a, None) for a in answers]
    except Exception as error:  # whatever a model raises is the text's error
        if len(texts) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        half = len(texts) // 2
        return answered(call, texts[:half]) + answered(call, texts[half:])


def mapped(rows: DataFrame, text: str, out: str, kind: str, call: Batch, size: int = 32, workers: int = 1) -> DataFrame:
    """Adds the column ``out`` of the SQL type ``kind`` by ``call`` over batches of ``size`` texts, and ``error``.

    A task has up to ``workers`` calls under way, and as many batches read ahead; rows keep their order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = StructType(list(rows.schema) + StructType.fromDDL(f"{out} {kind}, error string").fields)
    arrow = to_arrow_schema(whole)

    def run(batches: Iterator) -> Iterator:
        from collections import deque
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        def done(part, future) -> pa.RecordBatch:
            found = future.result()
            values = [pa.array([f[k] for f in found], arrow.field(n).type) for k, n in enumerate((out, "error"))]
            return pa.RecordBatch.from_arrays([*part.columns, *values], schema=arrow)

        with ThreadPoolExecutor(workers) as pool:
            under_way: deque = deque()
            for batch in batches:
                for a in range(0, batch.num_rows, size):
                    part = batch.slice(a, size)
                    texts = part.column(part.schema.get_field_index(text)).to_pylist()
                    under_way.append((part, pool.submit(answered, call, texts)))
                    if len(under_way) > 2 * workers:
                        yield done(*under_way.popleft())
            while under_way:
                yield done(*under_way.popleft())

    return rows.mapInArrow(run, whole)


def sure(made: DataFrame, out: str) -> DataFrame:
    """Rows without ``error``; one that has it stops the job."""
    checked = F.when(F.col("error").isNull(), F.col(out)).otherwise(F.raise_error(F.col("error")))
    return made.withColumn(out, checked).drop("error")


def summarize(sections: DataFrame, level: str, call: Batch, model: str, cache: DataFrame | None = None) -> DataFrame:
    """Summaries at a level; sections whose content and model are in the cache are not asked again."""
    t, b = F.col("title"), F.col("raw_text")
    rows = sections.select("doc_id", "section_id", T.cache_key(F.lit(model), F.lit(level), T.section_hash(t, b)).alias("key"), prompt(level, t, b).alias("prompt"))
    known = None
    if cache is not None:
        from leafloom.sources.files import cache_misses

        rows, known = cache_misses(rows, cache)
    made = sure(mapped(rows, "prompt", "text", "string", call), "text").withColumn("text", T.within_budget(F.trim("text"), level)).drop("prompt")
    return made if known is None else made.unionByName(known.drop("prompt"))


def cached_summaries(store, sections: DataFrame, level: str, call: Batch, model: str) -> DataFrame:
    """``summarize`` with the store's table ``summary_cache``: answers it lacks are asked for and added, the rest is read."""
    found = summarize(sections, level, call, model, store.read("summary_cache", "key string, text string", optional=True))
    with store.staged(found) as rows:
        known = store.read("summary_cache", "key string, text string", optional=True)
        store.append("summary_cache", rows.select("key", "text").dropDuplicates(["key"]).join(known, "key", "left_anti"), "key string, text string")
    wanted = sections.select("doc_id", "section_id", T.cache_key(F.lit(model), F.lit(level), T.section_hash(F.col("title"), F.col("raw_text"))).alias("key"))
    return wanted.join(store.read("summary_cache", "key string, text string"), "key").select("doc_id", "section_id", "key", "text")


def embed(sections: DataFrame, call: Batch, dim: int, size: int = 32, workers: int = 1) -> DataFrame:
    """Vectors of all sections by a model, to unit length, and ``error``; another length than ``dim`` is one."""
    rows = sections.select("doc_id", "section_id", T.embedding_text(F.col("title"), F.col("raw_text")).alias("text"))
    found = mapped(rows, "text", "v", "array<double>", call, size, workers)
    error = F.coalesce("error", F.when(F.size("v") != dim, F.lit("a vector has another dimension")).when(F.col("v").isNull(), F.lit("no vector")))
    return found.select("doc_id", "section_id", F.lit(dim).alias("dim"), F.transform(T.unit(F.col("v")), lambda x: x.cast("float")).alias("vector"), error.alias("error"))
