"""Operator 11: SentencePiece byte-pair models encoded by backtracking, and decoded again.

The library merges the best-scored pair of neighbours, leftmost first, until no pair is a piece.  The same result is
found from left to right without a queue of merges.  Two facts carry it: in a merged sequence every piece merges to itself
and every two neighbours, merged again from their characters, give just these two; and a text has one sequence only whose
neighbours all do.  So an Aho-Corasick automaton lists the pieces that start at each place, the longest is tried first, a
piece is taken if it agrees with its left neighbour, and where none fits the last piece is given up for a shorter one.
A place is reached by one valid sequence at most, so a place that failed once fails always: a bit for each place is
enough, and the work is linear in the text.

Chunks that no piece can span (the vocabulary says which neighbours occur inside pieces) are encoded on their own, each
distinct one once while a worker remembers it.  Characters that are no piece become their bytes.

Defined results: null and empty texts give begin and end ids only, and decode to the empty text; rows with a null id and
repeated rows are all kept; an empty table gives none; other columns are ignored.  Models whose normaliser does more than
mark spaces and put one before the text are refused; pieces a user defined, and unused ones, aren't supported.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm._common import arrow_schema, documents, text_of, tokenizer_file
from leafloom.llm.pretoken import PART, parts_of

SPACE = "▁"
ENCODED, DECODED = "doc_id long, n_tokens long, ids binary", "doc_id long, n_tokens long, ids binary, text string"
BLOCK = 4096
#: Ids from here on stand for single characters that are no piece.
STRAY = 1 << 24


class PieceCodec:
    """Ids of texts by a model file, with begin and end ids, and texts of ids.

    ``remembered`` bounds the chunks, and the pairs of pieces, that a worker holds; beyond it the memory is emptied.
    """

    def __init__(self, path: str, remembered: int = 500_000, longest: int = 64):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" A  é b ") != f"{SPACE}{SPACE}A{SPACE}{SPACE}é b{SPACE}":
            raise ValueError("the model's normaliser isn't supported")
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.remembered, self.longest = remembered, longest
        self.score: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        self.raw: list[bytes] = []
        self.text: list[str] = []
        self.silent, self.spaced, self.bytes = set(), set(), set()
        self.automaton = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.text.append(piece)
            if model.is_control(i):
                self.silent.add(i)
                self.raw.append(b"")
            elif model.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            elif model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes.add(i)
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            else:
                self.score[piece] = model.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
                if piece.startswith(SPACE):
                    self.spaced.add(i)
        for i, piece in enumerate(self.text):  # a piece that its own characters don't merge to is in no result
            if piece in self.score and self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.most = max(map(len, self.score))
        self.known_letters = {piece for piece in self.score if len(piece) == 1}
        self.joint = {piece[k : k + 2] for piece in self.score for k in range(len(piece) - 1)}
        splits = not any(pair[1] == SPACE and pair[0] != SPACE for pair in self.joint)
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if splits else ".+", re.DOTALL)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.agrees: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the rule itself: the best-scored pair, the leftmost of equals, until none is left."""
        parts, score = list(text), self.score
        ranks = [score.get(a + b) for a, b in zip(parts, parts[1:])]  # of each pair of neighbours
        while True:
            best = max((r for r in ranks if r is not None), default=None)
            if best is None:
                return parts
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = score.get(parts[k - 1] + parts[k])
            if k < len(ranks):
                ranks[k] = score.get(parts[k] + parts[k + 1])

    def fits(self, left: int, right: int) -> bool:
        """Whether the two pieces, merged again from their characters, stay what they are."""
        pair = [self.letters(left), self.letters(right)]
        if len(self.agrees) > 2 * self.remembered:
            self.agrees.clear()
        found = self.agrees[left << 32 | right] = self.merged("".join(pair)) == pair
        return found

    def letters(self, piece: int) -> str:
        return self.text[piece] if piece < STRAY else chr(piece - STRAY)

    def _matches(self, text: str, first: int, last: int) -> list[list[tuple[int, int]]]:
        """For each place from ``first`` to ``last`` the ends and ids of the pieces that start there, ascending; a
        character that is no piece counts as one of its own."""
        rows: list[list[tuple[int, int]]] = [[] for _ in range(last - first)]
        for end, (size, piece) in self.automaton.iter(text, first, min(len(text), last + self.most)):
            place = end - size + 1 - first
            if 0 <= place < last - first:
                rows[place].append((end + 1, piece))
        for place, row in enumerate(rows, first):
            if not row or row[0][0] != place + 1:
                row.insert(0, (place + 1, STRAY + ord(text[place])))
        return rows

    def pieces(self, text: str) -> list[int]:
        """The pieces of a text by backtracking over the places where a piece can start.  Matches are found by block, and
        those of three blocks are held."""
        n, agrees, fits = len(text), self.agrees, self.fits
        failed = bytearray(n // 8 + 1)
        held = {0: self._matches(text, 0, min(n, BLOCK))}
        rows, first, last = held[0], 0, BLOCK
        taken: list[int] = []
        went: list[tuple[int, int]] = []  # place, and how many of its matches are left
        place, left = 0, 0
        pick = len(rows[0]) if n else 0
        while place < n:
            row = rows[place - first]
            while pick:
                pick -= 1
                end, piece = row[pick]
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                if taken:
                    agreed = agrees.get(left << 32 | piece)
                    if not (fits(left, piece) if agreed is None else agreed):
                        continue
                went.append((place, pick))
                taken.append(piece)
                place, left, pick = end, piece, -1
                break
            if pick >= 0:  # no match fits: this place fails, the last piece is given up for a shorter one
                failed[place >> 3] |= 1 << (place & 7)
                place, pick = went.pop()
                taken.pop()
                left = taken[-1] if taken else 0
            if not first <= place < last and place < n:
                block = place // BLOCK
                if block not in held:
                    if len(held) > 2:
                        del held[next(iter(held))]
                    held[block] = self._matches(text, block * BLOCK, min(n, (block + 1) * BLOCK))
                rows, first, last = held[block], block * BLOCK, (block + 1) * BLOCK
            if pick < 0 and place < n:
                pick = len(rows[place - first])
        return taken

    def short_pieces(self, text: str) -> list[int]:
        """``pieces`` for a text of known characters within one block: the same search with less to keep."""
        n, agrees, fits = len(text), self.agrees, self.fits
        rows: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, piece) in self.automaton.iter(text):
            rows[end + 1 - size].append((end + 1, piece))
        failed, place, left = 0, 0, 0
        taken: list[int] = []
        went: list[tuple[int, list[tuple[int, int]]]] = []
        row = rows[0]
        while True:
            while row:
                end, piece = row.pop()
                if failed >> end & 1:
                    continue
                if taken:
                    agreed = agrees.get(left << 32 | piece)
                    if not (fits(left, piece) if agreed is None else agreed):
                        continue
                taken.append(piece)
                if end == n:
                    return taken
                went.append((place, row))
                place, left, row = end, piece, rows[end]
                break
            else:
                failed |= 1 << place
                place, row = went.pop()
                taken.pop()
                left = taken[-1] if taken else 0

    def _ids(self, stray: int) -> list[int]:
        return [self.byte_id[b] for b in chr(stray - STRAY).encode()] if self.byte_id else [self.unknown]

    def _coded(self, chunk: str) -> bytes:
        if len(chunk) <= self.longest and self.known_letters.issuperset(chunk):
            return array("I", self.short_pieces(chunk)).tobytes()
        found = self.pieces(chunk)
        if max(found) >= STRAY:
            found = [i for piece in found for i in (self._ids(piece) if piece >= STRAY else [piece])]
        return array("I", found).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if len(chunk) > self.longest:  # cut again wherever two neighbours stand inside no piece
            cuts = [0, *[k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in self.joint], len(chunk)]
            if len(cuts) > 2:
                return b"".join([self._word(chunk[a:b]) for a, b in zip(cuts, cuts[1:])])
        return self._coded(chunk)

    def _word(self, chunk: str) -> bytes:
        found = self.known.get(chunk)
        if found is None:
            found = self._chunk(chunk)
            if len(chunk) <= self.longest:
                if len(self.known) > self.remembered:
                    self.known = {}
                self.known[chunk] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        first, last = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        if not text:
            return first + last
        chunks = self.chunks.findall(SPACE + text.replace(" ", SPACE))
        known = self.known
        try:
            return b"".join([first, *[known[c] for c in chunks], last])
        except KeyError:
            return b"".join([first, *map(self._word, chunks), last])

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids: pieces in turn, runs of bytes as UTF-8 with a mark for each byte that is none, and
        without the space that stands before a text."""
        ids = ids.tolist()
        first = next((i for i in ids if i not in self.silent), None)
        try:
            if not self.silent.isdisjoint(ids[1:-1]):
                raise ValueError("a control id may part the bytes of a character")
            text = b"".join(map(self.raw.__getitem__, ids)).decode()
        except ValueError:  # a run of bytes ends where a piece, or a control id, stands
            parts, run = [], []
            for i in [*ids, None]:
                if i in self.bytes:
                    run.append(i)
                    continue
                parts.append(re.sub("[\udc80-\udcff]", "�", b"".join(map(self.raw.__getitem__, run)).decode(errors="surrogateescape")))
                run = []
                if i is not None:
                    parts.append(self.raw[i].decode())
            text = "".join(parts)
        return text[1:] if first in self.spaced else text


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The codec of this worker for a model file.  It lives as long as the worker: what one task learned, the next one uses."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def _encoded(path: str):
    schema = arrow_schema(ENCODED)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = codec(path)
        for batch in batches:
            for a, b, texts in parts_of(batch.column(1), 2 * PART):
                ids = [own.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return run


def _decoded(path: str):
    schema = arrow_schema(DECODED)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = codec(path)
        for batch in batches:
            for a, b, ids in parts_of(batch.column(2), 4 * PART):
                texts = [own.decode(np.frombuffer(i or b"", "<u4")) for i in ids]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array(texts, pa.string())], schema=schema)

    return run


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every text; nothing is shuffled."""
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(_encoded(model), ENCODED)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of ``encode_pieces`` (or any doc_id, n_tokens, ids) with the text of their ids."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoded(model), DECODED)


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    texts = decode_pieces(encode_pieces(documents(spark, sf_dir), model), model)
    return texts.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
