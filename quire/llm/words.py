"""Words of UTF-8 text as numpy arrays: where they stand and a 64-bit hash of each, without a loop over words.

All classes used here are ASCII classes, so they hold byte by byte: every byte of a longer
character is 0x80 or above.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes outside words of the class [^\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z became a-z.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False

#: Bytes of ASCII letters and digits.
ALNUM = np.zeros(256, bool)
ALNUM[[c for c in range(0x80) if chr(c).isalnum()]] = True
#: Bytes after C3 in letters of U+00C0 to U+00FF, which has two signs at D7 and F7.
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_powers = np.ones(1, np.uint64)
_P = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, _P, np.uint64))])
    return _powers


class Words:
    """Words of the texts in one block: start, end (byte positions), doc (row), hash."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, outside: np.ndarray = SPACE, lower: bool = True, tails: np.ndarray | None = None):
        n_docs = len(offsets) - 1
        self.n_docs = n_docs
        self.data = low = LOWER[data] if lower else data
        inside = ~outside[low]
        first = np.zeros(len(low) + 1, bool)
        first[offsets] = True
        before = np.empty(len(low), bool)
        if len(low):
            before[0] = False
            before[1:] = inside[:-1]
            before[first[:-1]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(len(low), bool)
        if len(low):
            after[-1] = False
            after[:-1] = inside[1:]
            after[first[1:]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        if tails is not None and len(self.start):
            # A mark of ``tails`` at the end of a longer word is a word of its own if it follows a letter or digit
            # that is told by its bytes; other marks, signs and combining characters may form one piece with it.
            last = self.end - 1
            one, two = low[last - 1], low[last - 2]
            letter = (ALNUM[one] & (last > self.start)) | (LATIN[one] & (two == 0xC3) & (last > self.start + 1))
            cut = last[tails[low[last]] & letter]
            self.start = np.sort(np.concatenate([self.start, cut]))
            self.end = np.sort(np.concatenate([self.end, cut]))
        per_doc = np.searchsorted(self.start, offsets)
        self.first_word = per_doc  # n_docs + 1 entries
        self.n_words = np.diff(per_doc)
        self.doc = np.repeat(np.arange(n_docs), self.n_words)
        self.hash = self._hash(low, inside)

    def _hash(self, low: np.ndarray, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        gap = np.diff(self.start, append=len(low))
        place = np.arange(len(low) - self.start[0]) - np.repeat(self.start - self.start[0], gap)
        tail = low[self.start[0] :]
        value = _BYTE[tail]
        value *= powers(int(gap.max()) + 1)[place]
        value[~inside[self.start[0] :]] = 0
        length = (self.end - self.start).astype(np.uint64)
        return mix(np.add.reduceat(value, self.start - self.start[0]) + length)
