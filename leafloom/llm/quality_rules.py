"""Operator 10: quality rules as a bitmask ledger.

Every rule is evaluated once; the ledger keeps the measurements and one failure bit per rule.  A policy is a version and
a mask of the rules that reject, applied to stored bits without reading texts again; ablations come from counts of the
bit patterns, by bitwise aggregation.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows get a row each; an empty table
gives no rows; other columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm._common import Scratch, arrow_schema, documents, text_of
from leafloom.llm.pretoken import _mix, parts_of
from leafloom.llm.textscan import codepoints, runs, separators, span_hashes

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Each rule's bit is its place: a name and the SQL condition under which a document fails.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
]
#: Policies by version: the rules that reject.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "repeated_lines", "symbols", "short_words", "long_words"),
}
BASE, CURRENT = 1, 2
WINDOW = 8


def mask_of(version: int) -> int:
    return sum(1 << k for k, (name, _) in enumerate(RULES) if name in POLICIES[version])


def measure(texts: list[str | None]) -> list[np.ndarray]:
    """The measurements of MEASURES after doc_id, each an array over the texts."""
    n = len(texts)
    cps, docs = codepoints(texts)
    if not len(cps):
        return [np.zeros(n, np.int64) for _ in range(6)]
    gap = separators(cps)
    starts, ends = runs(~gap, docs)
    doc = np.searchsorted(docs, starts, "right") - 1
    n_words = np.bincount(doc, minlength=n)
    word_chars = np.bincount(doc, ends - starts, minlength=n).astype(np.int64)
    symbol = np.flatnonzero(np.isin(cps, np.array([ord(c) for c in "#*$%&|<>"], np.uint32)))
    n_symbols = np.bincount(np.searchsorted(docs, symbol, "right") - 1, minlength=n)

    # lines: from a text's start or after a newline, to the next
    newline = cps == 10
    first = np.zeros(len(cps) + 1, bool)
    first[docs] = True
    first[np.flatnonzero(newline) + 1] = True
    begin = np.flatnonzero(first[:-1])
    end = np.append(begin[1:], len(cps))
    stop = end - newline[end - 1]
    worded = np.searchsorted(starts, begin) < np.searchsorted(starts, end)
    begin, stop = begin[worded], stop[worded]
    line_doc = np.searchsorted(docs, begin, "right") - 1
    keys = span_hashes(cps, begin, stop) + _mix(line_doc)
    order = np.argsort(keys, kind="stable")
    again = np.flatnonzero(keys[order][1:] == keys[order][:-1]) + 1
    n_dup_lines = np.bincount(line_doc[order[again]], minlength=n)
    n_lines = np.bincount(line_doc, minlength=n)

    # windows of eight words: hashed, and those that a text holds twice mark their words
    words = _mix(span_hashes(cps, starts, ends))
    repeats = np.zeros(n, np.int64)
    if (m := len(words) - WINDOW + 1) > 0:
        whole = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
        mixed = np.zeros(len(whole), np.uint64)
        for k in range(WINDOW):
            mixed = (mixed + words[whole + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        keys = mixed + _mix(doc[whole])
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = whole[twice]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        repeats = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return [x.astype(np.int64) for x in (n_words, word_chars, n_symbols, n_dup_lines, repeats, n_lines)]


def _measured():
    schema = arrow_schema(MEASURES)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in parts_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *map(pa.array, measure(texts))], schema=schema)

    return run


def ledger(docs: DataFrame) -> DataFrame:
    """Per document the measurements and ``failed``, the bits of the rules that it fails."""
    measured = docs.select("doc_id", text_of().alias("text")).mapInArrow(_measured(), MEASURES)
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failed", total)


def apply_policy(rows: DataFrame, version: int, column: str = "kept") -> DataFrame:
    """Adds whether the policy keeps each row of the ledger."""
    return rows.withColumn(column, F.col("failed").bitwiseAND(F.lit(mask_of(version))) == 0)


def ablations(rows: DataFrame, version: int) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone (kept if it went), and that are kept without it.

    Documents are first counted by bit pattern (at most 2**rules rows), all else is bitwise on the patterns.
    """
    mask = mask_of(version)
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).alias("bit")) for k, (name, _) in enumerate(RULES) if mask >> k & 1])
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    own = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(count(own).alias("n_failed"), count(own & rest).alias("n_only"), count(rest).alias("n_kept_without"))


def patterns(rows: DataFrame) -> DataFrame:
    """Documents by the bits that they fail: at most one row per subset of RULES."""
    return rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n_alike"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored once; the policies and the ablations are computed from its bits.

    ``sole_failure``: the bit of the one rule of the current policy without which the document would be kept (0: none);
    ``n_alike``: documents that fail the same rules.
    """
    scratch = Scratch(spark, "op10")
    rows = scratch.stage(ledger(documents(spark, sf_dir)), "ledger")
    alike = F.broadcast(patterns(rows))  # 2**rules rows at most
    rows = apply_policy(apply_policy(rows, BASE, "passed_base"), CURRENT, "passed").join(alike, "failed")
    bits = F.col("failed").bitwiseAND(F.lit(mask_of(CURRENT)))
    sole = F.when(bits.bitwiseAND(bits - 1) == 0, bits).otherwise(0)
    measures = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(
        *measures, (~F.col("passed_base")).alias("base_failed"), (F.col("passed_base") & F.col("passed")).alias("kept"), "failed", "n_lines", sole.alias("sole_failure"), "n_alike",
    )
