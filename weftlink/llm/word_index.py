"""A bidirectional FM-index over word ids: suffix order, Burrows-Wheeler transforms and interval extension."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Where the suffixes of ``seq`` begin, in ascending order, by prefix doubling.

    0 ends a piece, and the sequence must end with it. Every end counts as a symbol of its own, smaller than all words
    and ordered by place, so no suffix is compared beyond its piece. Only suffixes still tied are sorted again.
    """
    n = len(seq)
    ends = seq == 0
    symbol = np.where(ends, np.cumsum(ends) - 1, seq.astype(np.int64) + int(ends.sum()))
    # as many symbols as fit 63 bits are compared at once; what follows an end is never reached by a tie
    most = int(symbol.max()) + 1
    step = max(1, min(3, 62 // max(1, most.bit_length())))
    key = symbol.copy()
    for k in range(1, step):
        key *= most
        key[: n - k] += symbol[k:]
    order = np.argsort(key)
    key = key[order]
    new = np.diff(key, prepend=-1) != 0
    rank = symbol
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    slots = np.flatnonzero(~alone)
    while len(slots):
        at = order[slots]
        key = rank[at] * n + rank[at + step]
        by = np.argsort(key)
        at, key = at[by], key[by]
        new = np.diff(key, prepend=-1) != 0
        order[slots] = at
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        step *= 2
    return order


def transform(seq: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform: the symbol before each suffix, in suffix order."""
    return seq[suffix_order(seq) - 1].astype(np.int32)


@dataclass
class Found:
    """Patterns of one length: their words (one row of ids each), counts, and intervals in both directions.

    A direction that is not asked for is None.
    """

    words: np.ndarray
    count: np.ndarray
    forward: np.ndarray | None
    backward: np.ndarray | None

    def keep(self, mask: np.ndarray) -> Found:
        ahead, back = (None if d is None else d[mask] for d in (self.forward, self.backward))
        return Found(self.words[mask], self.count[mask], ahead, back)


class Direction:
    """One transform with the rank structure that extends intervals by the symbol before (in this direction)."""

    def __init__(self, bwt: np.ndarray) -> None:
        self.bwt = bwt

    @cached_property
    def step(self) -> np.ndarray:
        """Where each row's suffix goes when it is extended by its symbol (last-to-first mapping)."""
        n = len(self.bwt)
        out = np.empty(n, dtype=np.int64)
        out[np.argsort(self.bwt.astype(np.int64) * n + np.arange(n))] = np.arange(n)
        return out

    @cached_property
    def ends_before(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.bwt == 0)])

    def extended(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How many occurrences in each interval go on with a word of the same piece."""
        return count - (self.ends_before[start + count] - self.ends_before[start])

    def extend(self, start: np.ndarray, count: np.ndarray, other: np.ndarray | None, here: bool) -> tuple:
        """Every extension of the intervals by one word: pattern extended, word, count, interval here, interval there.

        The interval there is the pattern's one, narrowed by the occurrences that go on with smaller symbols. The interval
        here needs the mapping of all rows and is made only if asked for.
        """
        first = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(start)), count)
        rows = np.repeat(start - first, count) + np.arange(len(owner))
        width = int(self.bwt.max(initial=0)) + 1
        key = owner * width + self.bwt[rows]
        if here:
            key, at, times = np.unique(key, return_index=True, return_counts=True)
        else:
            key, times = np.unique(key, return_counts=True)
        owner, symbol = key // width, key % width
        word = symbol > 0
        there = None if other is None else (other[owner] + np.cumsum(times) - times - first[owner])[word]
        return owner[word], symbol[word], times[word], self.step[rows[at]][word] if here else None, there


class WordIndex:
    """Both directions of one sequence of word ids (1 and up; 0 ends a piece)."""

    def __init__(self, counts: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> None:
        self.counts, self.forward, self.backward = counts, Direction(forward), Direction(backward)

    @classmethod
    def build(cls, seq: np.ndarray) -> WordIndex:
        """The index of a sequence that ends with 0."""
        turned = np.append(seq[-2::-1], 0)
        return cls(np.bincount(seq), transform(seq), transform(turned))

    def single(self) -> Found:
        """All words; ids without an occurrence have empty intervals."""
        start = np.cumsum(self.counts) - self.counts
        ids = np.arange(1, len(self.counts))
        return Found(ids[:, None], self.counts[1:], start[1:], start[1:])

    def right(self, of: Found, both: bool = True) -> Found:
        """Every pattern one word longer to the right; ready for the left, and for the right again if ``both``."""
        owner, word, count, back, ahead = self.backward.extend(of.backward, of.count, of.forward, both)
        return Found(np.column_stack([of.words[owner], word]), count, ahead, back)

    def left(self, of: Found, both: bool = True) -> Found:
        """Every pattern one word longer to the left; ready for the right, and for the left again if ``both``."""
        owner, word, count, ahead, back = self.forward.extend(of.forward, of.count, of.backward, both)
        return Found(np.column_stack([word, of.words[owner]]), count, ahead, back)

    def goes_on(self, of: Found) -> tuple[np.ndarray, np.ndarray]:
        """How many occurrences of each pattern have a word to the left, and to the right."""
        return self.forward.extended(of.forward, of.count), self.backward.extended(of.backward, of.count)
