"""Numpy helpers over the code points of many texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
#: Powers that a worker keeps for each base.
_KEPT_POWERS = 1 << 19
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads the bits of a 64-bit number."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    p = _BASES[base]
    both = []
    for x in (p, _U(pow(int(p), -1, 1 << 64))):
        a = np.full(n, x, _U)
        a[0] = 1
        both.append(np.multiply.accumulate(a))
    return both[0], both[1]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse. Short tables are kept; one for a long text is made anew, so a worker does not hold it."""
    if n > _KEPT_POWERS:
        return _power_table(base, n)
    if base not in _POWERS:
        _POWERS[base] = _power_table(base, _KEPT_POWERS)
    return _POWERS[base]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
    """A 64-bit hash of each values[start:end], in a fixed number of passes whatever the lengths."""
    if not len(starts):
        return np.empty(0, _U)
    power, inverse = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum((values.astype(_U) + _U(1)) * power[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text starts (one more entry: the end)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def word_spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space, cut at text borders), and for each text its first word (one more entry)."""
    word = (points != 32) & ((points < 9) | (points > 13))
    before = np.zeros(len(points), bool)
    before[1:] = word[:-1]
    after = np.zeros(len(points), bool)
    after[:-1] = word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(points))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def windows(words: np.ndarray, first: np.ndarray, size: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of size words inside one text: first word, end word, text. whole_if_short: a text of fewer words is one run."""
    n = np.diff(first)
    counts = np.maximum(n - size + 1, (n > 0) if whole_if_short else 0)
    text = np.repeat(np.arange(len(n)), counts)
    starts = first[:-1][text] + ranges(counts)
    return starts, np.minimum(starts + size, first[1:][text]), text
