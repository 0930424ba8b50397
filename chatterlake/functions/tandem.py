"""Passages that follow themselves, over the segments of a text between its dots.

With the text cut at dots, a passage of k segments that is directly followed by itself makes
k - 1 neighbouring segments equal to those k further on, and its first segment the end of the one in
front of them. Such a stretch of k - 1 segments holds exactly one place divisible by k - 1, so
only these places are compared for every lag: n/1 + n/2 + n/3 + ... of them, some n log n in all. From
places that are equal the stretch is measured both ways by fingerprints of ranges, in
steps that halve. Everything is done on whole arrays of places.
"""

import numpy as np
import pandas as pd

# Places compared at a time.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS = {}


def _powers(n):
    """Powers of the fingerprints' base and of its inverse modulo 2**64."""
    if _POWERS.get("n", 0) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            np.cumprod(table, out=table)
            _POWERS[name] = table
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


class Ranges:
    """Fingerprints of ranges of a sequence of numbers."""

    def __init__(self, numbers):
        up, self._down = _powers(len(numbers) + 1)
        own = (numbers.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD1342543DE82EF95)
        own = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self._sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum((own ^ (own >> np.uint64(32))) * up[: len(numbers)], out=self._sums[1:])

    def equal(self, a, b, size):
        """Whether the ranges of `size` from `a` and from `b` on are equal."""
        first = (self._sums[a + size] - self._sums[a]) * self._down[a]
        return first == (self._sums[b + size] - self._sums[b]) * self._down[b]

    def forward(self, a, b, most):
        """How far the sequence goes on alike from `a` and `b` on, up to `most`."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            same = self.equal(a, b, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low

    def backward(self, a, b, most):
        """How far it is alike up to before `a` and `b`, up to `most`."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            same = self.equal(a - half, b - half, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low


def _places(n, block=BLOCK):
    """All (lag, place) to compare among `n` segments, by rising lags, in blocks."""
    lag = 2
    while 2 * lag <= n:
        lags = np.arange(lag, min(n // 2, lag + max(1, block * (lag - 1) // n)) + 1)
        # Places m = 0, k - 1, 2 (k - 1), ... with m + k < n.
        many = (n - 1 - lags) // (lags - 1) + 1
        k = np.repeat(lags, many)
        yield k, (np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)) * (k - 1)
        lag = int(lags[-1]) + 1


def repeated_passage(text):
    """Does the text hold a passage with an inner dot, a dot, white space, and the passage and a dot again?

    A passage has no line feed. Passages without an inner dot are not looked for.
    """
    segments = text.split(".")
    n = len(segments) - 1
    if n < 4:
        return False
    numbers = pd.factorize(np.array(segments[:n], object))[0]
    broken = np.flatnonzero(["\n" in s for s in segments[:n]])
    numbers[broken] = -1 - broken      # equal to nothing
    rests = [s.lstrip() for s in segments[:n]]
    # A copy's first segment is white space and the passage's own.
    begins = np.array([len(r) < len(s) and "\n" not in r for r, s in zip(rests, segments)])
    if not begins.any():
        return False
    begun = np.concatenate([[0], np.cumsum(begins)])
    ranges = None
    for k, m in _places(n):
        # Copies begin at m + 1 to m + k - 1.
        keep = (numbers[m] == numbers[m + k]) & (begun[np.minimum(m + k, n)] > begun[m + 1])
        k, m = k[keep], m[keep]
        if not len(k):
            continue
        ranges = ranges or Ranges(numbers)
        right = ranges.forward(m, m + k, np.minimum(k - 1, n - m - k))
        left = ranges.backward(m, m + k, np.minimum(k - 1, m))
        # Stretches of k - 1 around the place start from `low` to `high`.
        low, high = m - np.minimum(left, k - 2), m + right - (k - 1)
        fits = low <= np.minimum(high, m)
        k, m, left, low, high = k[fits], m[fits], left[fits], low[fits], np.minimum(high, m)[fits]
        # Where the segment before the stretch is equal to its copy too, the copy only has to begin with white space.
        inner = np.maximum(low, m - left + 1)
        found = (inner <= high) & (begun[np.maximum(high, inner)] > begun[inner - 1])
        if found.any():
            return True
        outer = np.flatnonzero((low == m - left) & (low > 0))
        outer = outer[begins[low[outer] + k[outer] - 1]]
        for start, lag in zip(low[outer].tolist(), k[outer].tolist()):
            if segments[start - 1].endswith(rests[start + lag - 1]):
                return True
    return False
