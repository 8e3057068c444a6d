"""Windows of texts that may be patterns: bits of the digests of very many patterns, which texts are held against."""

from __future__ import annotations

import numpy as np

from .automaton import _codes, _is_word

#: Bits for each digest, and bits in all at most: more patterns let more windows pass in vain, which costs time only.
BITS_OF_ONE, MOST_BITS = 16, 1 << 27
#: What a digest stands for: a pattern that counts anywhere, a bounded one, the beginning of a pattern.
ANYWHERE, BOUNDED, BEGINNING = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def bits_for(patterns: int) -> int:
    return min(MOST_BITS, 1 << max(6, (2 * BITS_OF_ONE * patterns - 1).bit_length()))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _places(digests: np.ndarray, size: int | np.ndarray, kind: int | np.ndarray, bits: int) -> np.ndarray:
    x = digests + np.uint64(0xD6E8FEB86659FD93) * np.asarray(size * 4 + kind).astype(np.uint64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)


class _Digests:
    """Digests of all windows of joined texts, from sums of powers modulo 2 ** 64."""

    def __init__(self, texts: list[str]):
        self.points = _codes("".join(texts))
        sizes = np.array(list(map(len, texts)), np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = len(self.points)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)])
        self.back = _powers(_BACK, n + 1)

    def of(self, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.back[at]


def _beginning(size: int) -> int:
    return 1 << (size.bit_length() - 1)


def pattern_places(patterns: list[str], bounded: list[bool], bits: int) -> np.ndarray:
    """The bits of patterns (none empty) and of their beginnings, each once."""
    found = _Digests(patterns)
    size = found.ends - found.starts
    begins = np.array([_beginning(n) for n in size.tolist()], np.int64)
    whole = _places(found.of(found.starts, size), size, np.array(bounded, np.int64), bits)
    return np.unique(np.concatenate([whole, _places(found.of(found.starts, begins), begins, BEGINNING, bits)]))


class Sieve:
    """Lets those windows of a text pass whose bits are set: all that are patterns, and a few others."""

    def __init__(self, words: np.ndarray, sizes: list[int]):
        self.words, self.classes = words, {}
        for n in sorted(sizes):
            self.classes.setdefault(_beginning(n), []).append(n)

    def _told(self, digests: np.ndarray, size: int, kind: int) -> np.ndarray:
        at = _places(digests, size, kind, 64 * len(self.words))
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0

    def windows(self, texts: list[str]) -> dict[tuple[int, str], bool]:
        """(number of the text, window): whether it stands between word boundaries somewhere in the text."""
        held = _Digests(texts)
        sizes = held.ends - held.starts
        stop, word = np.repeat(held.ends, sizes), _is_word(held.points)
        begins, ends = np.zeros((2, len(word)), bool)
        inner = np.arange(len(word)) > np.repeat(held.starts, sizes)
        begins[1:] = inner[1:] & word[1:] & word[:-1]  # a word goes on from the character before
        ends[:-1] = begins[1:]  # and to the one behind
        out: dict[tuple[int, str], bool] = {}
        every = np.arange(len(word))
        for begin, lengths in self.classes.items():
            at = every[every + begin <= stop]
            at = at[self._told(held.of(at, begin), begin, BEGINNING)]
            for n in lengths:
                here = at[at + n <= stop[at]]
                digest, free = held.of(here, n), ~(begins[here] | ends[here + n - 1])
                hit = self._told(digest, n, ANYWHERE) | (free & self._told(digest, n, BOUNDED))
                here, free = here[hit], free[hit]
                own = np.searchsorted(held.ends, here, side="right")
                for t, i, f in zip(own.tolist(), (here - held.starts[own]).tolist(), free.tolist(), strict=True):
                    key = t, texts[t][i : i + n]
                    out[key] = out.get(key, False) or f
        return out
