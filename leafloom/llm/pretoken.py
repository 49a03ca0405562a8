"""Vectorised byte-level pre-tokenisation and a memoised encoder on top of the ``tokenizers`` library.

The byte-level pre-tokeniser of the vocabulary file splits a text into *pieces* by one regular expression with one
character of look-ahead.  Here the piece starts of a whole batch of texts are found with array operations on code
points.  A piece encodes to the same ids wherever it stands, so the library only has to encode each distinct piece once
per worker; the ids of a text are the concatenation of the ids of its pieces.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The code points of the White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_CLASSES: np.ndarray | None = None
_VALUES: np.ndarray | None = None
_POWERS: tuple[np.ndarray, np.ndarray] | None = None
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def classes() -> np.ndarray:
    """The class of every code point, built once per process from the Unicode categories."""
    global _CLASSES
    if _CLASSES is None:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for cp in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(cp))[0]
            if kind == "L":
                table[cp] = LETTER
            elif kind == "N":
                table[cp] = NUMBER
        table[WHITE_SPACE] = SPACE
        _CLASSES = table
    return _CLASSES


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _mixed() -> np.ndarray:
    """A 64-bit value for each code point."""
    global _VALUES
    if _VALUES is None:
        _VALUES = _mix(np.arange(sys.maxunicode + 1))
    return _VALUES


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if _POWERS is None or len(_POWERS[0]) < n:
        n = max(n, 1 << 19)
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        up, down = (np.full(n, m, np.uint64) for m in (_MULTIPLIER, inverse))
        up[0] = down[0] = 1
        _POWERS = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS


def piece_starts(cps: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """Indexes into ``cps`` at which pieces start.

    ``hard``: ascending starts of independent texts (or parts of texts between special tokens), no piece crosses them.
    Empty parts are allowed.  Returns an ascending int64 array.
    """
    n = len(cps)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = classes()[cps]
    first = np.zeros(n + 1, bool)  # a part starts here; the end counts as a start
    first[hard[hard <= n]] = True
    first[0] = first[n] = True
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= first
    start = change[:n].copy()
    at = np.flatnonzero(change[1:n] & ~first[1:n]) + 1  # class changes inside a part
    after = at[(kind[at - 1] == SPACE)]  # runs that follow white space give up their last space
    start[after - 1] = True
    start[after[cps[after - 1] == 32]] = False
    quote = np.flatnonzero((cps == 39) & change[:n] & change[1:])  # runs that are one apostrophe
    if len(quote):
        quote = quote[start[quote]]  # not joined with a space before it
        one = quote[(quote + 1 < n) & ~first[np.minimum(quote + 1, n)]]
        a = cps[one + 1]
        two = np.where((one + 2 < n) & ~first[np.minimum(one + 2, n)], cps[np.minimum(one + 2, n - 1)], 0)
        single = np.isin(a, [ord(c) for c in "stmd"])
        double = ((a == ord("r")) & (two == ord("e"))) | ((a == ord("v")) & (two == ord("e"))) | ((a == ord("l")) & (two == ord("l")))
        for hit, size in ((one[single], 1), (one[double & ~single], 2)):
            start[hit + 1] = False
            rest = hit + 1 + size
            rest = rest[rest < n]
            rest = rest[~first[rest] & (kind[rest] == LETTER)]
            start[rest] = True
    return np.flatnonzero(start)


class Batch:
    """Texts of one batch as code points with their piece starts; null texts count as empty."""

    def __init__(self, texts: list[str | None], special: str | None = None):
        texts = [t or "" for t in texts]
        self.joined = "".join(texts)
        self.cps = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.docs = np.concatenate([[0], np.cumsum(lengths)])
        marks: list[int] = []
        if special and special in self.joined:
            at = self.joined.find(special)
            while at >= 0:
                doc = int(np.searchsorted(self.docs, at, "right")) - 1
                if at + len(special) <= self.docs[doc + 1]:
                    marks.append(at)
                    at = self.joined.find(special, at + len(special))
                else:
                    at = self.joined.find(special, at + 1)
        self.special = np.array(marks, np.int64)
        hard = self.docs[:-1]
        if marks:
            hard = np.unique(np.concatenate([hard, self.special, self.special + len(special)]))
        starts = piece_starts(self.cps, hard)
        if marks:  # a special token is one piece
            which = np.searchsorted(self.special, starts, "right") - 1
            inside = (which >= 0) & (starts > self.special[which]) & (starts < self.special[which] + len(special))
            starts = starts[~inside]
        self.starts = starts
        self.ends = np.append(starts[1:], len(self.cps)) if len(starts) else starts
        self.first_piece = np.searchsorted(starts, self.docs)  # of each text, and the end

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each piece."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = _powers(len(self.cps))
        sums = np.add.reduceat(_mixed()[self.cps] * up[: len(self.cps)], self.starts)
        return sums * down[self.starts] + _mix(self.ends - self.starts)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else the next free
    code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """Ids of texts by a ``tokenizers`` file, as ``encode(text, add_special_tokens=False)`` gives them.

    ``limit`` bounds the pieces remembered in a worker; beyond it the memory is emptied.  Pieces are remembered by a 64-bit
    hash (among a million of them two agree with a probability of 3e-8).
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        if len(special) > 1:
            raise ValueError("vocabularies with more than one added token are not supported")
        self.special, self.special_id = next(((t.content, i) for i, t in special.items()), (None, -1))
        self.letters = _byte_letters()
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        from pandas._libs.hashtable import UInt64Factorizer

        self.known = UInt64Factorizer(1 << 16)
        self.pieces = self.used = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def ids_of_piece(self, piece: str) -> list[int]:
        if piece == self.special:
            return [self.special_id]
        letters = self.letters
        return [t.id for t in self.tokenizer.model.tokenize("".join([letters[b] for b in piece.encode()]))]

    def _learn(self, pieces: list[str]) -> None:
        ids = list(map(self.ids_of_piece, pieces))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, slot = int(sizes.sum()), self.pieces
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while slot + len(ids) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.flat[self.used : self.used + total] = np.array([i for x in ids for i in x], np.uint32)
        self.begin[slot : slot + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.count[slot : slot + len(ids)] = sizes
        self.used += total
        self.pieces += len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text starts (with the end)."""
        batch = Batch(texts, self.special)
        if not len(batch.starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if self.pieces > self.limit:
            self.clear()
        slots = self.known.factorize(batch.hashes())
        new = np.flatnonzero(slots >= self.pieces)
        if len(new):
            first = np.full(int(slots[new].max()) + 1 - self.pieces, -1, np.int64)
            first[slots[new[::-1]] - self.pieces] = new[::-1]
            spans = zip(batch.starts[first].tolist(), batch.ends[first].tolist(), strict=True)
            self._learn([batch.joined[a:b] for a, b in spans])
        sizes = self.count[slots]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.repeat(self.begin[slots] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.flat[at], np.concatenate([[0], ends])[batch.first_piece]


_ENCODERS: dict[str, Encoder] = {}


def forget_encoders() -> None:
    """Empties the memory of this worker's encoders: a worker lives on after its task."""
    for own in _ENCODERS.values():
        own.clear()


def encoder(path: str) -> Encoder:
    """The encoder of this worker for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Characters that an operator's arrays are made for at once; what a worker holds follows from it.
PART = 250_000


def in_parts(texts: list[str | None], most: int = PART):
    """Slices ``(from, to)`` of the list that hold about ``most`` characters; a longer text is one slice."""
    begin = size = 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > begin and size + n > most:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def parts_of(column, most: int = PART):
    """``from, to, texts`` of the slices of an Arrow column of strings that hold about ``most`` bytes: only one slice is
    in Python at a time."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for k, n in enumerate(size.tolist()):
        if k > begin and held + n > most:
            yield begin, k, column.slice(begin, k - begin).to_pylist()
            begin = k
            held = 0
        held += n
    if begin < len(size):
        yield begin, len(size), column.slice(begin).to_pylist()
