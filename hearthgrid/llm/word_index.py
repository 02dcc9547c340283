"""Bidirectional index over word ids: depth-limited n-grams and their extensions by Burrows-Wheeler intervals.

The text is a sequence of ids from 1 up; 0 separates pieces. Suffixes are sorted by their first ``DEPTH``
ids only, forwards and backwards. The occurrences of a string of fewer ids are then one interval of
either order. A step to the left maps the interval through the transform of the forward order
and narrows the interval of the backward order by the ids that sort before; a step to the right does the reverse.
"""

import numpy as np

DEPTH = 4


def transform(ids):
    """Burrows-Wheeler transform of ``ids`` (0 at both ends) by suffixes of DEPTH ids."""
    n = len(ids)
    wide = int(ids.max(initial=0)) + 1
    pairs = ids.astype(np.int64) * wide
    pairs[:-1] += ids[1:]
    _, rank = np.unique(pairs, return_inverse=True)
    rank = rank.astype(np.int64)
    both = rank * (int(rank.max(initial=0)) + 2)
    both[:-2] += rank[2:] + 1
    order = np.argsort(both, kind="stable")
    return ids[order - 1] if n else ids


class Direction:
    """One transform with what is needed to step through it."""

    def __init__(self, bwt):
        self.bwt = bwt
        by_symbol = np.argsort(bwt, kind="stable")
        self.step = np.empty(len(bwt), dtype=np.int64)
        self.step[by_symbol] = np.arange(len(bwt))

    def extended(self, left, right):
        """All one-id extensions of the intervals [left, right).

        Arrays, by interval and then id: number of the interval, id, occurrences, start of the new interval in
        this order, and by how much the interval of the other order moves. Separators do not extend anything.
        """
        size = right - left
        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        at = np.arange(int(size.sum())) + np.repeat(left - first, size)
        owner = np.repeat(np.arange(len(left)), size)
        wide = int(self.bwt.max(initial=0)) + 1
        key = owner * wide + self.bwt[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(heads, len(key)))
        owner, symbol = key[heads] // wide, key[heads] % wide
        start, moved = self.step[at[order[heads]]], heads - first[owner]
        real = symbol > 0
        return owner[real], symbol[real], count[real], start[real], moved[real]


class WordIndex:
    """Both directions of a sequence, from its two transforms."""

    def __init__(self, forward, backward):
        self.forward, self.backward = Direction(forward), Direction(backward)
        counts = np.bincount(forward, minlength=1)
        self.ends = np.cumsum(counts)

    @classmethod
    def of(cls, ids):
        return cls(transform(ids), transform(ids[::-1].copy()))

    def pairs(self):
        """Ids x, y, occurrences and both intervals' starts of every pair, by y and then x."""
        left, right = self.ends[:-1], self.ends[1:]
        owner, x, count, start, moved = self.forward.extended(left, right)
        return x, owner + 1, count, start, left[owner] + moved

    def to_the_left(self, start, back, count):
        """Extensions of strings given by their starts and occurrences: number, id, occurrences and both new starts."""
        owner, symbol, n, new, moved = self.forward.extended(start, start + count)
        return owner, symbol, n, new, back[owner] + moved

    def to_the_right(self, start, back, count):
        owner, symbol, n, new, moved = self.backward.extended(back, back + count)
        return owner, symbol, n, start[owner] + moved, new
