"""Content-chosen positions by which equal byte windows find each other.

Of the ``GRAM``-byte strings inside a window the one with the smallest hash (the first, if several) is the
window's anchor. That depends on the window's bytes alone, so equal windows have equal anchors at equal
offsets. Consecutive windows mostly share an anchor: one row stands for all windows an anchor owns.
"""

import numpy as np

WINDOW = 200
GRAM = 64
CHUNK = 1 << 17
_MASK = np.uint64((1 << 20) - 1)


def _odd(seed):
    return np.random.default_rng(seed).integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Rolling:
    """Hashes of any substring of a chunk from prefix sums, modulo 2**64 and mixed."""

    def __init__(self, seed):
        self.byte = np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2)
        base = _odd(seed + 1)
        back = np.uint64(pow(int(base), -1, 2**64))
        n = CHUNK + 1
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]))
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, back)]))

    def prefix(self, data):
        sums = np.empty(len(data) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(self.byte[data] * self.power[:len(data)], out=sums[1:])
        return sums

    def of(self, sums, start, end):
        """Hashes of the substrings [start, end); slices give those of neighbouring ones without copying indexes."""
        return mix((sums[end] - sums[start]) * self.inverse[:len(sums)][start])


def mix(h):
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


GRAMS, SPANS = Rolling(7), Rolling(77)


def anchors(data, ends, window=WINDOW, gram=GRAM):
    """Anchor rows of one chunk of at most ``CHUNK`` bytes that holds whole pieces ending at ``ends``.

    Returns arrays (first, last, at, h, c): the anchor at ``at`` owns the windows that start at
    first .. last; h is the hash of its bytes, c that of all bytes these windows cover and of
    the anchor's place in them.
    """
    n, width = len(data), window - gram + 1
    if n < window:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = GRAMS.prefix(data)
    h = GRAMS.of(sums, slice(0, n - gram + 1), slice(gram, n + 1))
    least = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    at = (least & _MASK).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(at) + 1, dtype=np.int64)
    room = ends - starts >= window
    np.add.at(inside, starts[room], 1)
    np.add.at(inside, ends[room] - window + 1, -1)
    s = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(s):
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    cut = np.flatnonzero((np.diff(at[s]) != 0) | (np.diff(s) != 1)) + 1
    cut = np.unique(np.concatenate([cut, np.searchsorted(s, starts[1:][starts[1:] <= s[-1]])]))
    cut = cut[(cut > 0) & (cut < len(s))]
    first, last = s[np.concatenate([[0], cut])], s[np.concatenate([cut - 1, [len(s) - 1]])]
    at = at[first]
    spans = SPANS.prefix(data)
    place = ((at - first).astype(np.uint64) << np.uint64(20)) | (last - first).astype(np.uint64)
    c = mix(SPANS.of(spans, first, last + window) ^ (place * np.uint64(0x9E3779B97F4A7C15)))
    return first, last, at, h[at], c


def pieces(text, window=WINDOW):
    """Parts of a text that fit into a chunk and together hold every window once: (start, bytes)."""
    step = CHUNK - window + 1
    return [(a, text[a:a + CHUNK]) for a in range(0, max(1, len(text) - window + 1), step)]


def chunks(texts, window=WINDOW):
    """Lists of (number of text, start, bytes) whose bytes fit into one chunk."""
    held, size = [], 0
    for number, text in enumerate(texts):
        if len(text) < window:
            continue
        for start, part in pieces(text, window):
            if held and size + len(part) > CHUNK:
                yield held
                held, size = [], 0
            held.append((number, start, part))
            size += len(part)
    if held:
        yield held
