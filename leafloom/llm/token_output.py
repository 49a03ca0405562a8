"""Operator 1: token ids as binary files, entropy-coded by a static range asymmetric numeral system (rANS).

One frequency table over the whole corpus is shared by all blocks.  A block holds whole documents, is coded on its own
by many interleaved lanes, and carries checkpoints (lane states and word positions at regular steps).  They cut it into
segments with a checksum each: blocks are decoded in parallel, the segments of a block side by side in one array, and a
part of a block from the segments that hold it alone.

File format (a Parquet dataset as the container, so commits are atomic and lost tasks are retried):

``blocks/``  one row per block: ``shard, block`` (their order is the document order), ``first`` (ids of the shard before
it), ``doc_ids``, ``doc_tokens``, ``n_tokens``, ``lanes``, ``states`` (uint64 LE per lane), ``words`` (uint32 LE stream),
``every`` (steps between checkpoints), ``checkpoints`` (per checkpoint: uint64 word position, then the lane states),
``segment_crcs`` (of each segment's first states and words), ``ids_crc``.
``table/``   ``token, freq``: frequencies that sum to 2**20.

Defined results: null texts count as empty (only the end id); rows are ordered by (doc_id, hash of the text), null ids
first; repeated rows are all kept; an empty table gives no blocks and an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm._common import Scratch, arrow_schema, documents, partitions, text_of, tokenizer_file
from leafloom.llm.pretoken import encoder, forget_encoders, parts_of

SCALE = 20
LOW = np.uint64(1 << 31)
BLOCK_TOKENS, LANES, EVERY = 1 << 18, 512, 128
PLAIN = "shard int, block int, first long, doc_ids array<long>, doc_tokens array<long>, n_tokens long, ids binary, seen array<struct<token:int,n:long>>"
CODED = "shard int, block int, first long, doc_ids array<long>, doc_tokens array<long>, n_tokens long, lanes int, every int, states binary, words binary, checkpoints binary, segment_crcs array<long>, ids_crc long"
DECODED = "shard int, doc_id long, local long, n_tokens long, ids_crc32 long"


class Table:
    """A static frequency table: every symbol that occurs gets at least one of the 2**20 slots."""

    def __init__(self, tokens: np.ndarray, freqs: np.ndarray):
        size = int(tokens.max()) + 1 if len(tokens) else 1
        self.freq = np.zeros(size, np.uint64)
        self.freq[tokens] = freqs
        self.start = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        """Positive counts to frequencies of at least 1 that sum to 2**20; ties go to the smaller symbol."""
        total, slots = int(counts.sum()), 1 << SCALE
        if len(counts) > slots:
            raise ValueError("more symbols than slots")
        freqs = np.maximum(1, (counts.astype(np.float64) * (slots / total)).astype(np.int64))
        order = np.argsort(-freqs, kind="stable")
        rest = slots - int(freqs.sum())
        if rest > 0:
            freqs[order[0]] += rest
        for k in order:
            if rest >= 0:
                break
            cut = min(-rest, int(freqs[k]) - 1, max(1, int(freqs[k]) // 8))
            freqs[k] -= cut
            rest += cut
        while rest < 0:  # only where nearly all symbols are as rare as can be
            big = np.flatnonzero(freqs > 1)[: -rest]
            freqs[big] -= 1
            rest += len(big)
        return freqs


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> dict:
    """Codes the ids of one block; id ``i`` goes to lane ``i % lanes`` at step ``i // lanes``."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    if n and (int(ids.max()) >= len(table.freq) or not table.freq[ids].all()):
        raise ValueError("an id is not in the frequency table")
    freqs, starts = table.freq[ids], table.start[ids]
    limit = freqs << np.uint64(63 - SCALE)
    state = np.full(lanes, LOW, np.uint64)
    chunks: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: b - a], freqs[a:b]
        over = x >= limit[a:b]
        if over.any():
            chunks.append((x[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            written += len(chunks[-1])
            x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[: b - a] = (q << np.uint64(SCALE)) + (x - q * f) + starts[a:b]
        if step and step % every == 0:
            marks.append((written, state.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
    check = b"".join(np.uint64(written - w).tobytes() + s.tobytes() for w, s in marks[::-1])
    out = {"lanes": lanes, "every": every, "states": state.tobytes(), "words": words.tobytes(), "checkpoints": check}
    states, at = segments(out | {"n_tokens": n})
    crcs = [_segment_crc(states[k], words[at[k] : at[k + 1]]) for k in range(len(states))]
    return out | {"segment_crcs": crcs, "ids_crc": zlib.crc32(ids.astype("<u4").tobytes())}


def segments(block: dict) -> tuple[np.ndarray, np.ndarray]:
    """The lane states at the start of each segment, and where its words start (with the end)."""
    marks = np.frombuffer(block["checkpoints"], np.uint64).reshape(-1, block["lanes"] + 1)
    states = np.concatenate([np.frombuffer(block["states"], np.uint64)[None, :], marks[:, 1:]])
    return states, np.concatenate([[0], marks[:, 0].astype(np.int64), [len(block["words"]) // 4]])


def _segment_crc(states: np.ndarray, words: np.ndarray) -> int:
    return zlib.crc32(words.tobytes(), zlib.crc32(states.tobytes()))


def decode_block(block: dict, table: Table, begin: int = 0, end: int | None = None) -> np.ndarray:
    """The ids ``begin`` to ``end`` of a block.  Only the segments that hold them are checked and decoded, all at once."""
    n, lanes, every = block["n_tokens"], block["lanes"], block["every"]
    end = n if end is None else min(end, n)
    if begin >= end:
        return np.zeros(0, np.uint32)
    first, last = begin // (lanes * every), -(-end // (lanes * every))
    states, at = segments(block)
    words = np.frombuffer(block["words"], "<u4")
    for k in range(first, last):
        if _segment_crc(states[k], words[at[k] : at[k + 1]]) != block["segment_crcs"][k]:
            raise ValueError("a segment's checksum differs")
    state, place = states[first:last].copy(), at[first:last, None].copy()
    out = np.zeros((last - first, every * lanes), np.uint32)
    mask, half = np.uint64((1 << SCALE) - 1), np.uint64(32)
    for step in range(every):
        left = np.clip(n - (np.arange(first, last) * every + step) * lanes, 0, lanes)  # lanes that have an id at this step
        if not left.any():
            break
        slot = state & mask
        symbol = table.symbol[slot]
        state = table.freq[symbol] * (state >> np.uint64(SCALE)) + slot - table.start[symbol]
        under = state < LOW
        if left[-1] < lanes:  # only the last segment ends early
            under[-1, left[-1] :] = False
        rank = np.cumsum(under, axis=1)
        state[under] = (state[under] << half) | words[(place + rank - 1)[under]]
        place += rank[:, -1:]
        out[:, step * lanes : (step + 1) * lanes] = symbol
    out = out.reshape(-1)[begin - first * lanes * every : end - first * lanes * every]
    if begin == 0 and end == n and zlib.crc32(out.astype("<u4").tobytes()) != block["ids_crc"]:
        raise ValueError("the ids' checksum differs")
    return out


def _plain_blocks(path: str, end_id: int, block_tokens: int):
    """Rows sorted by shard and document order to uncoded blocks, and at the end the counts of ids seen."""

    schema = arrow_schema(PLAIN)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(path)
        small = np.uint16 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.uint32
        seen = np.zeros(0, np.int64)
        shard, block, first = None, 0, 0
        docs: list[int | None] = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def row() -> pa.RecordBatch:
            nonlocal block, first, held, docs, sizes, parts, seen
            ids = np.concatenate(parts)
            counts = np.bincount(ids, minlength=len(seen))
            counts[: len(seen)] += seen
            seen = counts
            out = {"shard": shard, "block": block, "first": first, "doc_ids": docs, "doc_tokens": sizes, "n_tokens": len(ids), "ids": ids.astype(small).tobytes(), "seen": None}
            block, first, held, docs, sizes, parts = block + 1, first + len(ids), 0, [], [], []
            return pa.RecordBatch.from_pylist([out], schema)

        for batch in batches:
            shards, doc_ids = (batch.column(k).to_pylist() for k in range(2))
            for a, b, texts in parts_of(batch.column(2)):
                ids, at = enc.encode(texts)
                at = at.tolist()
                for k in range(b - a):
                    if shards[a + k] != shard:
                        if docs:
                            yield row()
                        shard, block, first = shards[a + k], 0, 0
                    own = ids[at[k] : at[k + 1]]
                    parts += [own, np.array([end_id], np.uint32)]
                    docs.append(doc_ids[a + k])
                    sizes.append(len(own) + 1)
                    held += len(own) + 1
                    if held >= block_tokens:
                        yield row()
        forget_encoders()
        if docs:
            yield row()
        if len(seen):
            have = np.flatnonzero(seen)
            counts = [{"token": t, "n": n} for t, n in zip(have.tolist(), seen[have].tolist(), strict=True)]
            yield pa.RecordBatch.from_pylist([{"shard": shard, "block": -1, "seen": counts}], schema)

    return run


def _coded_blocks(tokens: np.ndarray, freqs: np.ndarray, width: int):
    schema = arrow_schema(CODED)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = Table(tokens, freqs)
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                ids = np.frombuffer(row.pop("ids"), np.uint16 if width == 2 else np.uint32)
                yield pa.RecordBatch.from_pylist([row | encode_block(ids, table)], schema)

    return run


def _decoded(tokens: np.ndarray, freqs: np.ndarray):
    schema = arrow_schema(DECODED)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = Table(tokens, freqs)
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                raw = memoryview(decode_block(row, table).astype("<u4").tobytes())
                out, at = [], 0
                for doc, n in zip(row["doc_ids"], row["doc_tokens"], strict=True):
                    out.append({"shard": row["shard"], "doc_id": doc, "local": row["first"] + at, "n_tokens": n, "ids_crc32": zlib.crc32(raw[4 * at : 4 * (at + n)])})
                    at += n
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_tokens: int = BLOCK_TOKENS, shards: int | None = None) -> None:
    """Encodes all texts, appends ``end_id`` to each, and writes the files described above below ``path``.

    One range shuffle brings the texts into document order (a tie on doc_id is broken by the text's hash).  The uncoded
    blocks are staged, because the shared table needs the counts of the whole corpus; the counts come to the driver, at
    most one row per id of the vocabulary.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", text_of().alias("text")).repartitionByRange(shards or partitions(spark), F.col("doc_id"), tie)
    ordered = ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "text").sortWithinPartitions("shard", "doc_id", F.xxhash64("text"))
    plain = scratch.stage(ordered.mapInArrow(_plain_blocks(tokenizer, end_id, block_tokens), PLAIN), "plain")
    seen = plain.where("block = -1").select(F.explode("seen").alias("s")).groupBy("s.token").agg(F.sum("s.n").alias("n"))
    rows = sorted((r.token, r.n) for r in seen.collect())
    tokens = np.array([r[0] for r in rows], np.int64)
    freqs = Table.scaled(np.array([r[1] for r in rows], np.int64)) if rows else np.zeros(0, np.int64)
    spark.createDataFrame([(int(t), int(f)) for t, f in zip(tokens, freqs, strict=True)], "token int, freq long").coalesce(1).write.parquet(f"{path}/table")
    width = _width(tokenizer, end_id)
    blocks = plain.where("block >= 0").drop("seen").mapInArrow(_coded_blocks(tokens, freqs, width), CODED)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop("plain")


def _width(tokenizer: str, end_id: int) -> int:
    return 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32.

    Blocks decode independently; only the number of ids of each shard comes to the driver (as many rows as shards).
    """
    table = sorted((r.token, r.freq) for r in spark.read.parquet(f"{path}/table").collect())  # at most the vocabulary
    tokens, freqs = (np.array([r[k] for r in table], np.int64) for k in (0, 1))
    blocks = spark.read.schema(CODED).parquet(f"{path}/blocks")
    totals = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, before = [], 0
    for shard, n in totals:
        offsets.append((shard, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(offsets, "shard int, before long"))  # one row per shard
    found = blocks.select(*[c.strip().split(" ")[0] for c in CODED.split(", ")]).mapInArrow(_decoded(tokens, freqs), DECODED)
    return found.join(offsets, "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op1").path("files")
    write_token_files(documents(spark, sf_dir), path, tokenizer_file())
    return read_token_files(spark, path)
