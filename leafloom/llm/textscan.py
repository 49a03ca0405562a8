"""Words, lines and sentences of a batch of texts as arrays, shared by the operators that measure texts."""

from __future__ import annotations

import numpy as np

from leafloom.llm.pretoken import _mix, _mixed, _powers

#: The separators of words.
SEPARATORS = [9, 10, 11, 12, 13, 32]


def codepoints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after another, and where each text starts (with the end)."""
    lengths = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    joined = "".join(t or "" for t in texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def separators(cps: np.ndarray) -> np.ndarray:
    return (cps == 32) | ((cps >= 9) & (cps <= 13))


def runs(member: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of members; no run crosses a text's border."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[docs] = True
    edge[0] = True
    starts = member.copy()
    starts[1:] &= ~member[:-1] | edge[1:n]
    ends = member.copy()
    ends[:-1] &= ~member[1:] | edge[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span (ascending, disjoint); code points under ``skip`` count as absent."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(cps) + 1)
    values = _mixed()[cps] * up[: len(cps)]
    if skip is not None:
        values[skip] = 0
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return (sums[ends] - sums[starts]) * down[starts] + _mix(ends - starts)
