"""Operator 9: best-fit packing with bounded space.

A task keeps a fixed number of open sequences.  A bitset keyed by free space finds the open sequence with the least
free space that still holds a piece; a piece that fits nowhere opens a sequence, and if too many are open the fullest
closes first.  Documents longer than a sequence are cut; only the first piece is shorter than a whole sequence.

Tasks pack what they read; then the pieces of the sequences that stayed open are packed again, in the same way, by fewer and
fewer tasks until one has the rest.

Defined results: a null text is empty (one piece: the end id); repeated rows are packed each; an empty table gives no
rows; other columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm._common import Scratch, arrow_schema, documents, text_of, tokenizer_file
from leafloom.llm.pretoken import encoder, forget_encoders, parts_of

PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """Open sequences by free space; ``add`` gives the sequences that close."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.bits = size, most, 0, 0
        self.bins: dict[int, list[list]] = {}

    def add(self, piece, length: int) -> list[list]:
        if length == self.size:
            return [[piece]]
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            own = self._take(free)
        else:
            free, own = self.size, []
        own.append(piece)
        free -= length
        if free == 0:
            return [own]
        self.bins.setdefault(free, []).append(own)
        self.bits |= 1 << free
        self.open += 1
        if self.open > self.most:
            return [self._take((self.bits & -self.bits).bit_length() - 1)]
        return []

    def _take(self, free: int) -> list:
        own = self.bins[free].pop()
        if not self.bins[free]:
            del self.bins[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return own

    def rest(self) -> list[list]:
        return [own for free in sorted(self.bins) for own in self.bins[free]]


def _placed(closed: list[list[dict]], numbers) -> list[dict]:
    """The rows of sequences, with their number and places."""
    out = []
    for own in closed:
        number, at = next(numbers), 0
        for piece in own:
            out.append(piece | {"sequence_id": number, "offset": at})
            at += piece["length"]
    return out


def _pack(path: str, end_id: int, size: int, most: int):
    schema = arrow_schema(PACKED + ", closed boolean")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, bins = encoder(path), OpenBins(size, most)
        numbers = itertools.count(TaskContext.get().partitionId() << 33)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, _, texts in parts_of(batch.column(1)):
                ids, at = enc.encode(texts)
                at, out = at.tolist(), []
                for k in range(len(texts)):
                    raw = ids[at[k] : at[k + 1]].astype("<u4").tobytes() + end
                    n = len(raw) // 4
                    begin, piece = 0, 0
                    cut = n % size or size
                    while begin < n:
                        crc = zlib.crc32(raw[4 * begin : 4 * cut])
                        out += _placed(bins.add({"doc_id": doc_ids[a + k], "piece": piece, "start": begin, "length": cut - begin, "ids_crc32": crc, "closed": True}, cut - begin), numbers)
                        begin, cut, piece = cut, cut + size, piece + 1
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
        forget_encoders()
        if out := _placed(bins.rest(), numbers):
            yield pa.RecordBatch.from_pylist([row | {"closed": False} for row in out], schema)

    return run


def _pack_again(size: int, most: int, turn: int):
    schema = arrow_schema(PACKED + ", closed boolean")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        bins = OpenBins(size, most)
        numbers = itertools.count(turn << 57 | TaskContext.get().partitionId() << 33)
        numbers = (-1 - k for k in numbers)  # below zero: apart from those of the first pass
        for batch in batches:
            out: list[dict] = []
            for piece in batch.to_pylist():
                out += _placed(bins.add(piece | {"closed": True}, piece["length"]), numbers)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if out := _placed(bins.rest(), numbers):
            yield pa.RecordBatch.from_pylist([row | {"closed": False} for row in out], schema)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, open_bins: int = 512, pool: int = 200_000) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    Every task packs what it reads with ``open_bins`` open sequences.  What is open at its end is not written as it is:
    the pieces of all tasks' unfinished sequences (without their ids) are packed again in pools of about ``pool`` pieces
    with as many open sequences, and so on until one pool is left or a turn gains little; so what stays unfilled doesn't
    grow with the number of tasks.  Sequence ids are unique: the task's number, then a counter; below zero those of later
    turns.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    found = [scratch.stage(docs.select("doc_id", text_of().alias("text")).mapInArrow(_pack(tokenizer, end_id, size, open_bins), PACKED + ", closed boolean"), "turn-0")]
    left = found[-1].where("NOT closed").count()
    for turn in range(1, 32):
        pools = max(1, -(-left // pool))
        # dealt by hash, and in that order: lengths play no part in it
        unfinished = found[-1].where("NOT closed").drop("closed", "sequence_id", "offset").withColumn("h", F.xxhash64("doc_id", "piece", "start", "ids_crc32"))
        dealt = unfinished.repartition(pools, "h").sortWithinPartitions("h", "doc_id", "piece").drop("h")
        found.append(scratch.stage(dealt.mapInArrow(_pack_again(size, open_bins, turn), PACKED + ", closed boolean"), f"turn-{turn}"))
        before, left = left, found[-1].where("NOT closed").count()
        if pools == 1 or 4 * left > 3 * before:
            break
    out = found[-1].drop("closed")
    for turn in found[:-1]:
        out = out.unionByName(turn.where("closed").drop("closed"))
    return out


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file())
