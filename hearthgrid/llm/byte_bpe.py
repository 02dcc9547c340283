"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that its encoding can end with: the
token that ends there, whose start has an encoding already, and which forms a pair with that
encoding's last token that merging in rank order would not change. Storing this token per prefix
gives the encoding of every prefix at once. Appending bytes only adds entries; after an edit the
entries before it stay right and those behind it are reused as soon as the longest token's reach is
the same again.

Null texts count as empty and encode to nothing. Rows are independent: repeated rows repeat their
answer, a null key is kept, an empty table gives an empty result, other columns are ignored.
"""

import base64
import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import types as T

from hearthgrid.llm.common import Memory, keyed_text, with_key


def load_ranks(path):
    """Token bytes to rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixEncoder:
    """Encodes byte strings with a table of ranks."""

    def __init__(self, ranks, pattern=None):
        import regex

        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.tails = {t[i:] for t in ranks for i in range(len(t))}
        self.halves, self.merged = {}, {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self._split(token, rank)
        self.split = regex.compile(pattern).findall if pattern else None
        self.fits = Memory(lambda pair: self.together(*pair), limit=1_000_000)
        self.known = Memory(self._piece)
        self.chunks = Memory(self._chunk)

    def _split(self, token, rank):
        """Which two tokens merge into this one, if merging its bytes arrives at it at all."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] >= rank:
                return
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2:
            pair = (self.ranks[parts[0]], self.ranks[parts[1]])
            self.halves[rank], self.merged[pair] = pair, rank

    def together(self, left, right):
        """Whether two neighbouring tokens stay as they are when their bytes are merged by rank.

        Undoes merges from the last to the first; a merge over the seam that comes before the one
        just undone would have kept the tokens from forming.
        """
        before = None
        while True:
            over = self.merged.get((left, right))
            if over is not None and (before is None or over < before):
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]

    def prefixes(self, data, last=None, unchanged=0):
        """Last token of every non-empty prefix of ``data``.

        ``last`` holds the answers for an earlier text whose first ``unchanged`` bytes are the same;
        they are taken over, so an append costs only its own bytes.
        """
        found = list(last[:unchanged]) if last else []
        tails, ranks, halves, fits = self.tails, self.ranks, self.halves, self.fits
        for end in range(len(found) + 1, len(data) + 1):
            start = end - 1
            while start >= 0 and (tail := data[start:end]) in tails:
                token = ranks.get(tail)
                if token is not None and (token in halves or start == end - 1) \
                        and (start == 0 or fits[found[start - 1], token]):
                    found.append(token)
                    break
                start -= 1
            else:
                raise ValueError("the table of ranks lacks a single byte")
        return found

    def edit(self, old, last, new):
        """Answers for ``new`` from those for ``old``, reusing both ends.

        Entries before the first changed byte are kept. Behind the change, an entry depends only on
        the bytes and entries within the longest token before it; once as many entries in a row
        agree with the old ones, all that follow do.
        """
        same = 0
        for same, (a, b) in enumerate(itertools.zip_longest(old, new)):
            if a != b:
                break
        else:
            return list(last)
        tail, most = 0, min(len(old), len(new)) - same
        while tail < most and old[-1 - tail] == new[-1 - tail]:
            tail += 1
        found, shift = list(last[:same]), len(old) - len(new)
        need, first_tail = self.longest, len(new) - tail
        while len(found) < len(new):
            found = self.prefixes(new[:max(len(found), first_tail) + need], found, len(found))
            at = len(found)
            if at - need >= first_tail and found[at - need:] == list(last[at - need + shift:at + shift]):
                return found + list(last[at + shift:])
        return found

    def tokens_of(self, data, last):
        """The encoding of ``data``, read backwards from its last prefix."""
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def _piece(self, piece):
        data = piece.encode() if isinstance(piece, str) else piece
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(self.tokens_of(data, self.prefixes(data)))

    def _pieces(self, text):
        return itertools.chain.from_iterable(map(self.known.__getitem__, self.split(text)))

    def _chunk(self, chunk):
        """Ids of a blank and what follows up to the next one; None if white space borders on it."""
        return None if not chunk or chunk[0].isspace() or chunk[-1].isspace() else tuple(self._pieces(" " + chunk))

    def encode(self, text):
        """Ids of a text; each match of the pattern is encoded by itself.

        A match never goes on from text into a blank, so a text whose blanks all stand between two
        other characters can be looked up from blank to blank.
        """
        first, *others = text.split(" ")
        found = list(map(self.chunks.__getitem__, others))
        if None in found or not first or first[-1].isspace():
            return list(self._pieces(text))
        found.insert(0, self._pieces(first))
        return list(itertools.chain.from_iterable(found))

    def decode(self, ids):
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS = {}


def encoder_for(path, pattern):
    """One encoder per Python worker and table."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = PrefixEncoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs, ranks_path, pattern, key="doc_id", text="text"):
    """doc_id and ``ids``, the token ids of every whole text."""
    slim = keyed_text(docs, key, text)

    def run(batches):
        encoder = encoder_for(ranks_path, pattern)
        for batch in batches:
            ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["doc_id", "ids"])

    return slim.mapInArrow(run, with_key(slim, ("ids", T.ArrayType(T.IntegerType()))))


def decode_documents(encoded, ranks_path):
    """doc_id and ``data``, the bytes that the column ``ids`` stands for (null ids: no bytes)."""
    slim = encoded.select("doc_id", "ids")

    def run(batches):
        tokens = encoder_for(ranks_path, None).tokens
        for batch in batches:
            data = [b"".join(map(tokens.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())],
                                             names=["doc_id", "data"])

    return slim.mapInArrow(run, with_key(slim, ("data", T.BinaryType())))


def round_trip(docs, ranks_path, pattern, key="doc_id", text="text"):
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256.

    Encodes and decodes in the same task, so that neither ids nor texts travel.
    """
    slim = keyed_text(docs, key, text)
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]

    def run(batches):
        encoder = encoder_for(ranks_path, pattern)
        written = {r: str(r) for r in encoder.tokens}
        for batch in batches:
            counts, hashes, decoded = [], [], []
            for content in batch.column(1).to_pylist():
                ids = encoder.encode(content or "")
                counts.append(len(ids))
                hashes.append(hashlib.sha256(" ".join(map(written.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)],
                names=["doc_id", *(n for n, _ in fields)])

    return slim.mapInArrow(run, with_key(slim, *fields))
