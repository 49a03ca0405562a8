"""Operator 7: token counts by a finite-state transducer compiled from a byte-level BPE vocabulary.

A prefix of a piece has one BPE encoding, and its last token follows from the last tokens of shorter prefixes: of all
tokens that end here, the right one is that which BPE leaves alone beside the last token before it.  What the future can
depend on is therefore finite: for each suffix that may still grow into a token, the token before it and how many tokens
cover it.  Those tuples are the states; each transition is annotated with the change of the token count.  Transitions are
determinised when first met and kept for the worker's life, in a table with a bound.

A batch of texts is one byte string.  It is cut into equal chunks that advance together, one array operation a byte
position, each from the start state as if a piece began there.  Every chunk then gets a state map: of each state in which
its predecessor's map can end, the state in which the chunk ends and the tokens that this adds to the run from the start
state.  Maps are built for all chunks at once, a run stops where it meets the run from the start state (at the next piece
at the latest, most often after a few bytes).  A parallel prefix scan composes the maps by doubling, which gives the state
that each chunk is entered in and so its count.

Defined results: null texts have 0 bytes and 0 tokens; repeated rows count each; an empty table gives no rows; other
columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from leafloom.llm._common import arrow_schema, documents, text_of, tokenizer_file
from leafloom.llm.pretoken import PART, Batch, _byte_letters, parts_of

COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Transducer:
    """State 0 is the start of a piece.  ``table[state, column of byte]`` packs the next state and the count's change."""

    def __init__(self, path: str, most_states: int = 240_000):
        with open(path) as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or len(spec["added_tokens"]) > 1:
            raise ValueError("only plain byte-level BPE vocabularies can be compiled")
        self.special = spec["added_tokens"][0]["content"] if spec["added_tokens"] else None
        byte = {c: b for b, c in enumerate(_byte_letters())}
        vocab = {t: i for t, i in model["vocab"].items() if t != self.special}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made = [-1] * (max(vocab.values()) + 1)  # the rank of the merge that makes a token; bytes: -1
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.ranks.setdefault(pair, rank)
            if whole not in self.halves:
                self.halves[whole], self.made[whole] = pair, rank
        self.child: dict[tuple[int, int], int] = {}
        self.token, self.inner = [-1], [False]
        for raw, i in ((bytes(byte[c] for c in t), i) for t, i in vocab.items()):
            node = 0
            for b in raw:
                self.inner[node] = True
                if (node, b) not in self.child:
                    self.child[node, b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = self.child[node, b]
            self.token[node] = i
        self.most_states = most_states
        self.column = np.full(256, -1, np.int64)
        self.columns = 0
        self.table = np.full((1 << 10, 128), -1, np.int32)
        self.clear()

    def clear(self) -> None:
        start = (0, -1, 0)  # of each live suffix in turn: its trie node, the token before it, the tokens that cover it
        self.states: list[tuple] = [start]
        self.number = {start: 0}
        self.table[:] = -1

    def stays(self, a: int, b: int) -> bool:
        """BPE leaves the two tokens alone: undo their merges, the latest first, and see that no pair that then meets at
        the border would have been merged earlier (of equal merges the left one is first)."""
        bound = len(self.made)
        while True:
            meets = self.ranks.get((a, b), bound)
            if meets < bound:
                return False
            left, right = self.made[a], self.made[b]
            if left < 0 and right < 0:
                return True
            if left > right:
                bound, a = left, self.halves[a][1]
            else:
                bound, b = right + 1, self.halves[b][0]

    def compile(self, state: int, byte: int) -> int:
        """The packed transition; found once."""
        live = self.states[state]
        last = change = None
        grown: list[int] = []
        for k in range(0, len(live), 3):
            to = self.child.get((live[k], byte), -1)
            if to < 0:
                continue
            if last is None and (token := self.token[to]) >= 0 and (live[k + 1] < 0 or self.stays(live[k + 1], token)):
                last, change = token, 1 - live[k + 2]
            if self.inner[to]:
                grown += (to, live[k + 1], live[k + 2])
        for k in range(2, len(grown), 3):
            grown[k] += change
        key = (*grown, 0, last, 0)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.table):
                more = np.full((len(self.table) // 4, self.table.shape[1]), -1, np.int32)
                self.table = np.concatenate([self.table, more])
        if not -128 <= change < 128:
            raise OverflowError("a count changes by more than a byte holds")
        return (to << 8) | (change + 128)

    def columns_of(self, data: np.ndarray) -> np.ndarray:
        """The table's column of each byte; columns are given to bytes when first met."""
        if (self.column[data] < 0).any():
            for b in np.unique(data):
                if self.column[b] < 0:
                    self.column[b] = self.columns
                    self.columns += 1
            if self.columns > self.table.shape[1]:
                wide = np.full((len(self.table), 256), -1, np.int32)
                wide[:, : self.table.shape[1]] = self.table
                self.table = wide
            self.byte = np.zeros(256, np.int64)
            self.byte[self.column[self.column >= 0]] = np.flatnonzero(self.column >= 0)
        return self.column[data]

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        found = self.table[state, column]
        if (missing := np.flatnonzero(found < 0)).size:
            for k in missing.tolist():
                s, c = int(state[k]), int(column[k])
                if self.table[s, c] < 0:
                    value = self.compile(s, int(self.byte[c]))
                    self.table[s, c] = value
            found = self.table[state, column]
        return found

    def changes(self, data: np.ndarray, reset: np.ndarray, size: int = 256) -> np.ndarray:
        """The change of the token count at each byte; ``reset``: a piece starts at this byte."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int64)
        if len(self.states) > self.most_states:
            self.clear()
        lanes = -(-n // size)
        column = np.zeros(lanes * size, np.int64)
        column[:n] = self.columns_of(data)
        fresh = np.ones(lanes * size, bool)
        fresh[:n] = reset
        column, fresh = (np.ascontiguousarray(x.reshape(lanes, size).T) for x in (column, fresh))
        packed = np.zeros((size, lanes), np.int32)
        state = np.zeros(lanes, np.int64)
        for k in range(size):
            state[fresh[k]] = 0
            found = self.step(state, column[k])
            packed[k] = found
            state = (found >> 8).astype(np.int64)
        _, extra = self.entered(column, fresh, packed, state)
        out = (packed & 255).T.reshape(-1)[:n].astype(np.int64) - 128
        out[::size] += extra  # what another entry state adds to a chunk counts at its first byte
        return out

    def entered(self, column: np.ndarray, fresh: np.ndarray, packed: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk (a column of the arrays, run from state 0 to ``ends``) the state in which it is entered and the
        tokens that this adds."""
        size, lanes = packed.shape
        chunk, entry, out, add = np.arange(lanes), np.zeros(lanes, np.int64), ends.copy(), np.zeros(lanes, np.int64)
        new = np.arange(lanes)
        while True:  # the maps: an entry of a chunk for each end of its predecessor's map
            new = new[chunk[new] + 1 < lanes]
            asked = np.unique(np.column_stack([chunk[new] + 1, out[new]]), axis=0)
            have = np.isin(asked[:, 0] << 32 | asked[:, 1], chunk << 32 | entry)
            asked = asked[~have]
            if not len(asked):
                break
            own, state, where = asked[:, 0], asked[:, 1], np.arange(len(asked))
            to, more = ends[own], np.zeros(len(asked), np.int64)
            for k in range(size):
                go = ~fresh[k, own[where]]
                where, state = where[go], state[go]
                if not where.size:
                    break
                plain = packed[k, own[where]]
                found = self.step(state, column[k, own[where]])
                more[where] += (found & 255).astype(np.int64) - (plain & 255)
                go = found >> 8 != plain >> 8  # else it has met the run from state 0
                where, state = where[go], (found[go] >> 8).astype(np.int64)
            else:
                to[where] = state
            new = np.arange(len(chunk), len(chunk) + len(asked))
            chunk, entry, out, add = (np.concatenate(x) for x in ((chunk, own), (entry, asked[:, 1]), (out, to), (add, more)))
        key = chunk << 32 | entry
        order = np.argsort(key)
        jump = order[np.minimum(np.searchsorted(key[order], np.minimum(chunk + 1, lanes - 1) << 32 | np.where(chunk + 1 < lanes, out, entry)), len(key) - 1)]
        at, bit = np.zeros(lanes, np.int64), 1  # map entry 0 is that of the first chunk
        while bit < lanes:  # jump: over ``bit`` chunks
            use = (np.arange(lanes) & bit) > 0
            at[use] = jump[at[use]]
            jump = jump[jump]
            bit *= 2
        return entry[at], add[at]

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        batch = Batch(texts, self.special)
        if not len(batch.cps):
            return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        width = 1 + (batch.cps >= 0x80).astype(np.int64) + (batch.cps >= 0x800) + (batch.cps >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer(batch.joined.encode("utf-8", "surrogatepass"), np.uint8)
        reset = np.zeros(len(data), bool)
        reset[at[batch.starts]] = True
        sums = np.concatenate([[0], np.cumsum(self.changes(data, reset))])
        edges = at[batch.docs]
        tokens = sums[edges[1:]] - sums[edges[:-1]]
        if len(batch.special):  # a special token counts once, whatever its letters would give
            raw = self.special.encode()
            extra = 1 - int(self.changes(np.frombuffer(raw, np.uint8), np.arange(len(raw)) == 0).sum())
            np.add.at(tokens, np.searchsorted(batch.docs, batch.special, "right") - 1, extra)
        return edges[1:] - edges[:-1], tokens


_TRANSDUCERS: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of this worker for a vocabulary file."""
    if path not in _TRANSDUCERS:
        _TRANSDUCERS[path] = Transducer(path)
    return _TRANSDUCERS[path]


def _count(path: str, limit: int):
    schema = arrow_schema(COUNTED)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        machine = transducer(path)
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in parts_of(batch.column(1), 2 * PART):
                n_bytes, n_tokens = machine.count(texts)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], schema=schema)

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens are more than ``limit``; nothing is shuffled."""
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(_count(tokenizer, limit), COUNTED)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer_file())
