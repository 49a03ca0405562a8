"""Evaluation: chunks of a structure-blind baseline, recall, latency and gates."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators import vectors

CHUNK_WORDS = 512


def chunks(docs: DataFrame, size: int = CHUNK_WORDS) -> DataFrame:
    """``doc_id, text`` to chunks of ``size`` words with character offsets.

    A chunk is cut from the words and the gaps before them, its offset comes from the lengths of the chunks before it; all
    within one row, nothing is shuffled and no row carries the whole text beside its chunks.
    """
    words, gaps = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), F.split("text", r"\S+", -1)

    def cut(pair: Column) -> Column:
        part = lambda a, k: F.slice(a, k * size + 1, F.lit(size))
        count = F.floor((F.size(pair["w"]) - 1) / size).cast("int")
        body = lambda k: F.array_join(F.zip_with(part(pair["w"], k), F.slice(pair["g"], k * size + 1, F.size(part(pair["w"], k))), lambda w, g: F.concat(g, w)), "")
        return F.transform(F.sequence(F.lit(0), count), lambda k: F.struct(body(k).alias("body"), F.length(F.get(pair["g"], k * size)).alias("lead")))

    def placed(pieces: Column) -> Column:
        """Where each chunk begins, as one running sum over their lengths."""
        seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: F.struct((a["at"] + F.length(x["body"])).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
        piece = lambda x, at, k: F.struct(k.alias("chunk"), (at + x["lead"]).alias("start"), (at + F.length(x["body"])).alias("end"), F.substring(x["body"], x["lead"] + 1, F.length(x["body"])).alias("text"))
        return T.let(F.aggregate(pieces, seed, step)["out"], lambda ahead: F.transform(pieces, lambda x, k: piece(x, F.get(ahead, k), k)))

    rows = docs.select("doc_id", F.struct(words.alias("w"), gaps.alias("g")).alias("p")).where(F.size("p.w") > 0)
    return rows.select("doc_id", F.explode_outer(T.let(T.let(F.col("p"), cut), placed)).alias("c")).select("doc_id", "c.*")


def assign_sections(pieces: DataFrame, sections: DataFrame) -> DataFrame:
    """The deepest section whose span holds a chunk's middle, the first of equals, else null.

    The range condition stands beside the equi key doc_id, so only sections of the same document meet.
    """
    mid = pieces.withColumn("mid", F.floor((F.col("start") + F.col("end")) / 2))
    s = sections.select("doc_id", "section_id", "level", "pos", "span")
    hit = mid.join(s, (mid.doc_id == s.doc_id) & (mid.mid >= s.span.start) & (mid.mid < s.span.end)).groupBy(mid.doc_id, "chunk").agg(F.max_by("section_id", F.struct("level", F.negative("pos"))).alias("section_id"))
    return pieces.join(hit, ["doc_id", "chunk"], "left")


def recall(retrieved: Column, expected: Column) -> Column:
    """The share of expected anchors found in a retrieved id; 1 where none is expected."""
    found = F.filter(expected, lambda e: F.exists(retrieved, lambda r: F.contains(r, e)))
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(F.size(found) / F.size(expected))


def bench_summary(results: DataFrame) -> DataFrame:
    """Mean recall and tokens by system."""
    return results.groupBy("system").agg(F.avg("recall").alias("mean_recall"), F.avg("tokens").alias("mean_tokens"), F.count(F.lit(1)).alias("questions"))


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, median, 95th percentile by nearest rank, and largest."""
    order = Window.partitionBy(*by).orderBy(value)
    ranked = rows.where(F.col(value).isNotNull()).withColumn("rn", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    near = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(0.95)))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg"), F.median(value).alias("p50"), F.max(F.when(F.col("rn") == near, F.col(value))).alias("p95"), F.max(value).alias("max"))


def hit_rates(cases: DataFrame) -> DataFrame:
    """Rates of cases whose first right answer is within 1, 3 and 5 (``rank``, null if none) and drilldowns."""
    within = lambda k: F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int"))
    return cases.agg(within(1).alias("top1"), within(3).alias("top3"), within(5).alias("top5"), F.avg(F.col("drilldown").cast("int")).alias("drilldown"), F.count(F.lit(1)).alias("cases"))


def gates(rates: DataFrame, least: dict[str, float]) -> DataFrame:
    """One row per threshold: measured value and whether it is reached."""
    rows = [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("least"), (F.col(k) >= v).alias("passed")) for k, v in least.items()]
    return rates.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def report(summary: DataFrame) -> str:
    """The summary as a Markdown table (one row per system)."""
    rows = summary.orderBy("system").collect()
    lines = ["| system | recall | tokens | questions |", "|---|---|---|---|"]
    return "\n".join(lines + [f"| {r.system} | {r.mean_recall:.2%} | {r.mean_tokens:.0f} | {r.questions} |" for r in rows])


def baseline_hits(pieces: DataFrame, questions: DataFrame, dim: int = 64, k: int = 8) -> DataFrame:
    """The structure-blind baseline: chunks ranked by the offline embedding of ``question_id, question``."""
    rows = pieces.select("doc_id", F.col("chunk").cast("string").alias("section_id"), T.hash_embedding(F.col("text"), dim).alias("vector"))
    asked = questions.select(F.col("question_id").alias("query_id"), T.hash_embedding(F.col("question"), dim).alias("query"))
    return vectors.nearest_batch(rows, asked, k)


EVIDENCE = "evidence struct<text:string,matched_terms:array<string>>"


def _evidence_of(clean: str, terms: list[str], size: int) -> tuple[str, list[str]]:
    """The window of ``size`` characters with most occurrences of the terms, and which of them it holds."""
    low = clean.lower()
    begins = {0} | {max(0, m.start() - size // 3) for t in terms for m in re.finditer(re.escape(t), low)}
    at = min(begins, key=lambda b: (-sum(low[b : b + size].count(t) for t in terms), b))
    shown = clean[at : at + size]
    shown = "..." + shown.lstrip() if at else shown
    return (shown.rstrip() + "..." if at + size < len(clean) else shown), [t for t in terms if t in low[at : at + size]]


def evidence(hits: DataFrame) -> DataFrame:
    """Adds ``evidence`` (see ``text.evidence``) to rows of ``question, raw_text``, for questions that are rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = StructType(list(hits.schema) + StructType.fromDDL(EVIDENCE).fields)
    arrow = to_arrow_schema(whole)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from leafloom.functions.query import query_terms

        for batch in batches:
            asked, bodies = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("question", "raw_text"))
            found = [_evidence_of((b or "").strip(), query_terms(q or ""), T.EVIDENCE_CHARS) for q, b in zip(asked, bodies, strict=True)]
            column = pa.array([{"text": t, "matched_terms": m} for t, m in found], arrow.field("evidence").type)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], schema=arrow)

    return hits.mapInArrow(run, whole)


def _best(scored: DataFrame, k: int, tie: str) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bench(docs: DataFrame, sections: DataFrame, summaries: DataFrame, questions: DataFrame, dim: int = 64, k: int = 8, chunk_words: int = CHUNK_WORDS, include: tuple[str, ...] = ("synopsis", "head", "evidence")) -> DataFrame:
    """A question suite answered by both systems in one plan: ``question_id, doc_id, system, section_ids, recall, tokens``.

    ``questions``: question_id, doc_id, question, expected (parts of section ids).  A question meets the sections, and the
    chunks, of its own document only.  The engine's tokens are those of its whole answer, the baseline's those of its chunks.

    Scores come from counts of words, which are whole numbers, and are compared at nine digits: texts that are equally near
    have equal scores, so their order is that of their ids and not of what was rounded away.
    """
    asked = questions.select("question_id", "doc_id", "question", "expected", T.hash_counts(F.col("question"), dim).alias("asked"))
    cosine = F.round(T.clamp(T.dot(F.col("counts"), F.col("asked")) / T.norm(F.col("counts")) / T.norm(F.col("asked"))), 9)
    rows = sections.select("doc_id", "section_id", T.hash_counts(T.embedding_text(F.col("title"), F.col("raw_text")), dim).alias("counts"))
    rows = rows.join(asked.select("question_id", "doc_id", "question", "asked"), "doc_id")
    hits = _best(rows.select("question_id", "doc_id", "question", "section_id", cosine.alias("score")), k, "section_id")
    hits = hits.join(sections.select("doc_id", "section_id", "title", "raw_text"), ["doc_id", "section_id"]).join(summaries.select("doc_id", "section_id", "synopsis"), ["doc_id", "section_id"], "left")
    parts = [F.col("section_id"), F.col("title"), T.anchor(F.col("doc_id"), F.col("section_id"))]
    if "synopsis" in include:
        parts.append(F.coalesce("synopsis", F.lit("")))
    if "head" in include:
        parts.append(T.head(F.col("raw_text")))
    if "evidence" in include:
        hits = evidence(hits)
        parts += [F.col("evidence.text"), F.array_join("evidence.matched_terms", " ")]
    answer = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "section_id", F.concat_ws(" ", *parts).alias("text")))).alias("a"))
    mine = asked.join(answer, "question_id", "left").withColumn("a", F.coalesce("a", F.array().cast("array<struct<rank:int,section_id:string,text:string>>")))
    mine = mine.select("question_id", "doc_id", "expected", F.lit("engine").alias("system"), F.transform("a", lambda x: x["section_id"]).alias("section_ids"), T.token_estimate(F.concat_ws(" ", "question", F.array_join(F.transform("a", lambda x: x["text"]), " "))).cast("long").alias("tokens"))

    pieces = assign_sections(chunks(docs, chunk_words), sections)
    pieces = pieces.select("doc_id", "chunk", "section_id", T.token_estimate(F.col("text")).alias("tokens"), T.hash_counts(F.col("text"), dim).alias("counts"))
    found = _best(pieces.join(asked.select("question_id", "doc_id", "asked"), "doc_id").select("question_id", "chunk", F.coalesce("section_id", F.lit("")).alias("section_id"), "tokens", cosine.alias("score")), k, "chunk")
    got = found.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "section_id"))).alias("a"), F.sum("tokens").alias("tokens"))
    theirs = asked.join(got, "question_id", "left").select(
        "question_id", "doc_id", "expected", F.lit("baseline").alias("system"), F.coalesce(F.transform("a", lambda x: x["section_id"]), F.array().cast("array<string>")).alias("section_ids"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
    )
    both = mine.unionByName(theirs)
    return both.select("question_id", "doc_id", "system", "section_ids", recall(F.col("section_ids"), F.col("expected")).alias("recall"), "tokens")
