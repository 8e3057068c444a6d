"""Many patterns in many texts at once: an Aho-Corasick automaton in flat arrays, stepped over blocks side by side."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Characters of a block; blocks of a batch advance together.
BLOCK = 1024
#: Matches that are held before repeated ones go.
HELD = 1 << 20
#: Bytes of the arrays for each character of the patterns, at most.
BYTES_PER_CHARACTER = 40


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


#: Code points below this are looked up in a table.
_TABLE = 1 << 16


@cache
def _word_table() -> np.ndarray:
    return np.array([c == 0x5F or chr(c).isalnum() for c in range(_TABLE)], bool)


def _is_word(points: np.ndarray) -> np.ndarray:
    """Which code points belong to words: letters, numbers and the underscore."""
    out = _word_table()[np.minimum(points, _TABLE - 1)]
    far = np.flatnonzero(points >= _TABLE)
    out[far] = [chr(c).isalnum() for c in points[far].tolist()]
    return out


class Automaton:
    """Finds each pattern wherever it occurs, or, where `bounded`, only between word boundaries.

    States are numbered level by level. Edges are one sorted array of (state, character), so a step is a binary search
    for all blocks at once; where there is no edge, the state falls back to its longest suffix that is a state too.
    A bounded pattern counts where the characters around it don't go on with a word that the pattern begins or ends
    with. Empty patterns are never found. Patterns and texts are taken as they are: lower-case both for matching
    without case.
    """

    def __init__(self, patterns: list[str], bounded: list[bool]):
        order = sorted((p, b, i) for i, (p, b) in enumerate(zip(patterns, bounded, strict=True)) if p)
        self.owner = np.array([i for *_, i in order], np.int64)
        self.bounded = np.array([b for _, b, _ in order], bool)
        texts = [_codes(p) for p, *_ in order]
        self.size = np.array(list(map(len, texts)), np.int64)
        self.longest = int(self.size.max(initial=1))
        self.letters = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.int64)
        self.base = len(self.letters) + 1
        rows = np.zeros((len(texts), self.longest), np.int64)
        for row, t in zip(rows, texts, strict=True):
            row[: len(t)] = np.searchsorted(self.letters, t) + 1
        first = np.array([row[0] for row in texts], np.int64) if texts else np.zeros(0, np.int64)
        last = np.array([row[-1] for row in texts], np.int64) if texts else np.zeros(0, np.int64)
        self.opens, self.closes = self.bounded & _is_word(first), self.bounded & _is_word(last)
        # equal prefixes are neighbours, as rows are sorted: each run of them is a state
        state, changed, n = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), 1
        keys, targets, levels = [], [], []
        for d in range(self.longest):
            has = rows[:, d] > 0
            changed[1:] |= rows[1:, d] != rows[:-1, d]
            new = has & (changed | ~np.concatenate([[False], has[:-1]]))
            new[:1] = has[:1]
            ids = n + np.cumsum(new) - 1
            keys.append(state[new] * self.base + rows[new, d])
            targets.append(ids[new])
            levels.append((state[new], rows[new, d], ids[new]))
            state = np.where(has, ids, state)
            n += int(new.sum())
        key, target = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, targets))
        sort = np.argsort(key)
        self.edge, self.target = key[sort], target[sort].astype(np.int32)
        self.from_root = np.zeros(self.base, np.int32)
        at_root = self.edge < self.base
        self.from_root[self.edge[at_root]] = self.target[at_root]
        # patterns that end in a state: several only where the same text is wanted with and without boundaries
        by_state = np.argsort(state, kind="stable")
        self.ending = by_state.astype(np.int32)
        self.begin = np.searchsorted(state[by_state], np.arange(n + 1)).astype(np.int32)
        self.fall = np.zeros(n, np.int32)
        self.shorter = np.zeros(n, np.int32)  # the next suffix at which a pattern ends, 0 for none
        for d, (parent, letter, ids) in enumerate(levels):
            if d:
                self.fall[ids] = self.step(self.fall[parent], letter)
            suffix = self.fall[ids]
            self.shorter[ids] = np.where(self.begin[suffix + 1] > self.begin[suffix], suffix, self.shorter[suffix])
        self.told = (self.begin[1:] > self.begin[:-1]) | (self.shorter > 0)

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for v in vars(self).values() if isinstance(v, np.ndarray))

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next states; letter 0 is none of the patterns'."""
        out = self.from_root[letter]
        todo = np.flatnonzero((state > 0) & (letter > 0))
        state = state[todo].astype(np.int64)
        while len(todo):
            key = state * self.base + letter[todo]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            met = self.edge[at] == key
            out[todo[met]] = self.target[at[met]]
            state = self.fall[state].astype(np.int64)
            left = ~met & (state > 0)  # the root's own edges are in `out` already
            todo, state = todo[left], state[left]
        return out

    def _ends(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position of the last character, state) wherever some pattern ends.

        Blocks begin `longest` - 1 characters early, so that a state holds all that it would hold in one run;
        what ends in the lead belongs to the block before.
        """
        lead = self.longest - 1
        width = max(BLOCK, 2 * lead)
        starts = np.arange(0, len(letters), width)
        padded = np.concatenate([np.zeros(lead, np.int64), letters, np.zeros(width, np.int64)])
        state = np.zeros(len(starts), np.int32)
        for k in range(lead + width):
            state = self.step(state, padded[starts + k])
            if k >= lead:
                hit = np.flatnonzero(self.told[state])
                if len(hit):
                    yield starts[hit] + k - lead, state[hit]

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, number of the pattern) of every pattern in every text, each pair once, sorted."""
        if not texts or not len(self.owner):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        points = _codes("\x00".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        table = np.zeros(_TABLE, np.int64)
        near = self.letters[self.letters < _TABLE]
        table[near] = np.arange(1, len(near) + 1)  # letters are sorted, the near ones come first
        letters = np.where(points < _TABLE, table[np.minimum(points, _TABLE - 1)], 0)
        if len(near) < len(self.letters):
            far = np.flatnonzero(points >= _TABLE)
            at = np.minimum(np.searchsorted(self.letters, points[far]), len(self.letters) - 1)
            letters[far] = np.where(self.letters[at] == points[far], at + 1, 0)
        letters[ends[:-1] - 1] = 0  # between texts
        word = np.concatenate([[False], _is_word(points), [False]])
        word[ends[:-1]] = False
        found, held = [np.zeros(0, np.int64)], 0
        for position, state in self._ends(letters):
            while len(state):
                n = self.begin[state + 1] - self.begin[state]
                where, here = np.repeat(position, n), np.repeat(state, n)
                each = self.ending[np.arange(len(here)) - np.repeat(np.cumsum(n) - n, n) + self.begin[here]]
                good = ~(self.opens[each] & word[where - self.size[each] + 1]) & ~(self.closes[each] & word[where + 2])
                text = np.searchsorted(ends, where[good], side="right")
                found.append(text * len(self.owner) + each[good])
                held += len(text)
                state = self.shorter[state]
                position, state = position[state > 0], state[state > 0]
            if held > HELD:
                found, held = [np.unique(np.concatenate(found))], 0
        pairs = np.unique(np.concatenate(found))
        text, pattern = pairs // len(self.owner), self.owner[pairs % len(self.owner)]
        order = np.lexsort((pattern, text))
        return text[order], pattern[order]
