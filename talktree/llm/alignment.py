"""Local alignment of word sequences, whole or within a band of diagonals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_LOW = -(1 << 30)


@dataclass(frozen=True)
class Alignment:
    """Score, the aligned ranges of both sequences, and how many positions match."""

    score: int
    a_start: int
    a_end: int
    b_start: int
    b_end: int
    matches: int


def _best_end(a: np.ndarray, b: np.ndarray, low: int, high: int, match: int, mismatch: int, gap: int) -> tuple[int, int, int]:
    """Best local score with its last row and column; cells have column - row in low..high."""
    width = high - low + 1
    slope = np.arange(width) * gap
    before = np.zeros(width, np.int64)
    best = (0, 0, 0)
    for i in range(len(a)):
        j = i + low + np.arange(width)
        inside = (j >= 0) & (j < len(b))
        step = np.where(b[np.clip(j, 0, len(b) - 1)] == a[i], match, -mismatch)
        now = np.maximum(before + step, 0)
        now[:-1] = np.maximum(now[:-1], before[1:] - gap)
        now = np.where(inside, now, _LOW)
        now = np.maximum(np.maximum.accumulate(now + slope) - slope, 0)
        now[~inside] = 0
        k = int(now.argmax())
        if now[k] > best[0]:
            best = (int(now[k]), i, int(j[k]))
        before = now
    return best


def align(a: np.ndarray, b: np.ndarray, low: int | None = None, high: int | None = None, match: int = 2, mismatch: int = 1, gap: int = 1) -> Alignment:
    """Smith-Waterman alignment of ``a`` and ``b`` with linear gaps, within a band of ``b`` index minus ``a`` index if given.

    The first of equally good ends is taken, and of its starts the one that the reversed sequences
    reach first.
    """
    if not len(a) or not len(b):
        return Alignment(0, 0, 0, 0, 0, 0)
    low = -len(a) + 1 if low is None else max(low, -len(a) + 1)
    high = len(b) - 1 if high is None else min(high, len(b) - 1)
    if low > high:
        return Alignment(0, 0, 0, 0, 0, 0)
    score, ai, bj = _best_end(a, b, low, high, match, mismatch, gap)
    if not score:
        return Alignment(0, 0, 0, 0, 0, 0)
    ra, rb = a[: ai + 1][::-1], b[: bj + 1][::-1]
    shift = bj - ai  # reversed diagonals: (bj - j) - (ai - i) = shift - (j - i)
    _, ri, rj = _best_end(ra, rb, shift - high, shift - low, match, mismatch, gap)
    a0, b0 = ai - ri, bj - rj
    return Alignment(score, a0, ai + 1, b0, bj + 1, _matches(a[a0 : ai + 1], b[b0 : bj + 1]))


def _matches(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of the aligned ranges."""
    before = np.zeros(len(b) + 1, np.int64)
    for x in a:
        now = np.zeros_like(before)
        now[1:] = np.maximum(before[1:], before[:-1] + (b == x))
        before = np.maximum.accumulate(now)
    return int(before[-1])


def holds_run(a: np.ndarray, b: np.ndarray, found: Alignment, length: int, share: float) -> bool:
    """Whether ``length`` or more positions in a row of an alignment, gaps included, match at ``share`` or more."""
    x, y = a[found.a_start : found.a_end], b[found.b_start : found.b_end]
    if max(len(x), len(y)) < length or found.matches < share * length - 1e-9:
        return False
    total = np.concatenate([[0.0], np.cumsum(_path(x, y) - share)])
    if len(total) <= length:
        return False
    return bool((total[length:] >= np.minimum.accumulate(total[:-length]) - 1e-9).any())


def _path(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = 1, gap: int = 1) -> np.ndarray:
    """Whether each position of the best alignment of all of ``a`` with all of ``b`` is a match."""
    slope = np.arange(len(b) + 1) * gap
    before = -slope
    moves = np.zeros((len(a), len(b)), np.uint8)  # 0 both, 1 a alone, 2 b alone
    for i in range(len(a)):
        both = before[:-1] + np.where(b == a[i], match, -mismatch)
        now = np.concatenate([[before[0] - gap], np.maximum(both, before[1:] - gap)])
        now = np.maximum.accumulate(now + slope) - slope
        moves[i] = np.where(now[1:] == both, 0, np.where(now[1:] == before[1:] - gap, 1, 2))
        before = now
    i, j, out = len(a), len(b), []
    while i or j:
        move = moves[i - 1, j - 1] if i and j else 1 if i else 2
        out.append(move == 0 and a[i - 1] == b[j - 1])
        i, j = i - (move != 2), j - (move != 1)
    return np.array(out[::-1], np.int64)
