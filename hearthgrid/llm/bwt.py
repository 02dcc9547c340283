"""Equal windows of a collection of byte strings by interval expansion on its Burrows-Wheeler transform.

Suffixes are sorted by as many symbols as a window has. Then, breadth first, the intervals of all
strings of length 1, 2, 3, ... are extended backwards by one symbol: if the end of the new interval
has no common-prefix value yet, the value is the current length, and only then does the interval go
on to the next round. Values thus come in increasing order, and the rounds stop at the window length:
neighbours still without a value share at least a window.
"""

import numpy as np


def suffixes(symbols, depth):
    """Suffix array by at least ``depth`` symbols (0 .. 256), doubling the sorted length each round."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(7, dtype=np.int64)])
    packed = np.zeros(n, dtype=np.int64)
    for i in range(7):
        packed = (packed << 9) | padded[i:n + i]
    order = np.argsort(packed, kind="stable")
    new = np.concatenate([[True], packed[order][1:] != packed[order][:-1]])
    rank = np.empty(n, dtype=np.int64)
    head = np.flatnonzero(new)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    single = new & np.append(new[1:], True)
    open_ = np.flatnonzero(~single)
    have = 7
    while have < depth and len(open_):
        at = order[open_]
        ahead = np.where(at + have < n, rank[np.minimum(at + have, n - 1)] + 1, 0)
        pair = rank[at] * (n + 1) + ahead
        sort = np.argsort(pair, kind="stable")
        at, pair = at[sort], pair[sort]
        order[open_] = at
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        head = np.flatnonzero(new)
        rank[at] = np.repeat(open_[head], np.diff(np.append(head, len(at))))
        open_ = open_[~(new & np.append(new[1:], True))]
        have *= 2
    return order


def shared(order, symbols, length):
    """For every place of the suffix array but the first: whether it shares ``length`` symbols with the one before.

    Holds for suffixes whose first ``length`` symbols contain no 0; 0 ends a string of the collection.
    """
    n = len(symbols)
    before = symbols[order - 1]
    by_symbol = np.argsort(before.astype(np.int16), kind="stable")
    step = np.empty(n, dtype=np.int64)
    step[by_symbol] = np.arange(n)
    sorted_symbols = before[by_symbol]
    same = sorted_symbols[1:] == sorted_symbols[:-1]
    earlier, later = np.full(n, -1, dtype=np.int64), np.full(n, n, dtype=np.int64)
    earlier[by_symbol[1:][same]] = by_symbol[:-1][same]
    later[by_symbol[:-1][same]] = by_symbol[1:][same]
    known = np.zeros(n + 1, dtype=bool)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.append(first[1:], n) - 1
    known[last + 1] = True
    left, right = first, last
    for _ in range(1, length):
        if not len(left):
            break
        alone = left == right
        own = left[alone]
        own = own[before[own] != 0]
        ends_at, starts_at = [step[own]], [step[own]]
        left, right = left[~alone], right[~alone]
        if len(left):
            size = right - left + 1
            at = np.arange(size.sum()) + np.repeat(left - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            number = np.repeat(np.arange(len(left)), size)
            usable = before[at] != 0
            opens = usable & (earlier[at] < np.repeat(left, size))
            closes = usable & (later[at] > np.repeat(right, size))
            a, b = at[opens], at[closes]
            a = a[np.argsort(number[opens] * 512 + before[a], kind="stable")]
            b = b[np.argsort(number[closes] * 512 + before[b], kind="stable")]
            starts_at.append(step[a])
            ends_at.append(step[b])
        left, right = np.concatenate(starts_at), np.concatenate(ends_at)
        fresh = ~known[right + 1]
        left, right = left[fresh], right[fresh]
        known[right + 1] = True
    return ~known[1:n]


def equal_windows(texts, length):
    """Starts of windows that occur at least twice in the collection: (number of text, start), two arrays."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    symbols = np.zeros(int(sizes.sum()) + len(texts), dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    place = np.arange(len(symbols)) - starts[of]
    symbols[place < sizes[of]] = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64) + 1
    if not len(symbols):
        return of, place
    order = suffixes(symbols, length)
    group = np.concatenate([[0], np.cumsum(~shared(order, symbols, length))])
    window = (place + length <= sizes[of])[order]
    often = np.bincount(group[window], minlength=group[-1] + 1) > 1
    found = np.sort(order[window & often[group]])
    return of[found], place[found]
