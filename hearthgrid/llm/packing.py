"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Every class holds pieces of up to ``capacity // k`` tokens and its sequences take exactly ``k`` of
them, so a worker fills sequences without knowing what others do. Documents are cut so that a piece
fills nearly all of its class's slot. What a worker cannot complete (fewer than ``k`` pieces of
class ``k``) goes, with the rests of up to 255 other workers, to a next round of the same kind; the
last round puts what is left, at most a few thousand pieces, into mixed sequences.

Null texts count as empty: such a document is the end token alone. Repeated rows are packed as
often as they occur; a null key is kept; an empty table gives no pieces. Other columns of the
input are ignored.
"""

import itertools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.llm.common import Memory, keyed_text, slices, with_key
from hearthgrid.session import materialize

FAN_IN = 256
SMALL_CLASSES = (80, 96, 128, 160, 192, 256, 320, 384, 512)


#: Characters that the normalizer only lower-cases and that no white-space or combining rule touches.
PLAIN = re.compile("[!-~\u00a1-\u00ff]+")
#: Signs that end many chunks; after letters each is a piece of its own.
CLOSING = frozenset(".,;:!?")


class WordTokenizer:
    """Ids of a tokenizer that never joins text over a blank, found once per distinct chunk.

    Chunks of plain Latin characters are lower-cased and split by the tokenizer's own pattern, and
    the distinct pieces go to its model; all other chunks go through the whole tokenizer. A word,
    and one sign behind it, need no pattern to be told apart.
    """

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        special = [re.escape(t["content"]) for t in described["added_tokens"]]
        self.special = re.compile("|".join(special) if special else "(?!)").search
        self.split = regex.compile(described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        spelled = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.codes = [i.to_bytes(4, "little") for i in range(1 + max(described["model"]["vocab"].values()))]
        self.letters = {i: spelled(chr(i))[0][0] for i in range(0xA1, 0x100)}
        self.pieces = Memory(self._piece)
        self.known = Memory(self._chunk)

    def _piece(self, piece):
        spelled = piece if piece.isascii() else piece.translate(self.letters)
        return b"".join([self.codes[t.id] for t in self.model.tokenize(spelled)])

    def _chunk(self, chunk):
        if PLAIN.fullmatch(chunk) and not self.special(chunk):
            low = chunk.lower()
            if low.isalpha():
                return self.pieces[low]
            if low[-1] in CLOSING and low[:-1].isalpha():
                return self.pieces[low[:-1]] + self.pieces[low[-1]]
            return b"".join(map(self.pieces.__getitem__, self.split(low)))
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text):
        """Ids of the whole text as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


_TOKENIZERS = {}


def tokenizer_for(path):
    """One tokenizer per Python worker and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Classes:
    """Reciprocal-capacity classes and the rule that cuts a document into pieces."""

    def __init__(self, capacity=4096, fill=0.97):
        most = max(1, min(64, capacity // 64))
        counts = [*range(1, most + 1), *(k for k in SMALL_CLASSES if most < k <= capacity)]
        self.capacity, self.fill = capacity, fill
        self.counts = np.array(counts)
        self.slots = capacity // self.counts
        self.fine = min(64, capacity)

    def cut(self, length):
        """Pieces of a document as (start, length, class), whatever its length."""
        pieces, start, up = [], 0, self.slots[::-1]
        while length - start >= self.capacity:
            pieces.append((start, self.capacity, 1))
            start += self.capacity
        while start < length:
            rest = length - start
            at = len(up) - 1 - int(np.searchsorted(up, rest))  # the narrowest slot that holds the rest
            slot = int(self.slots[at])
            if rest < self.fill * slot and slot > self.fine and at + 1 < len(self.slots):
                at, rest = at + 1, int(self.slots[at + 1])
            pieces.append((start, rest, int(self.counts[at])))
            start += rest
        return pieces


def _sequences(level, worker):
    """Sequence ids that no other worker or level uses."""
    return itertools.count((level << 52) | (worker << 32))


def pack(docs, tokenizer_path, capacity=4096, end_id=2, key="doc_id", text="text", with_ids=False, remember=True):
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    ``ids_crc32`` is the checksum of the piece's ids as little-endian unsigned 32-bit numbers. Workers
    ``remember`` the ids of words from one partition to the next; where packing is one step among
    others, they had better free that memory.
    """
    slim = keyed_text(docs, key, text)
    fields = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()),
              ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()),
              ("class", T.IntegerType()), ("worker", T.IntegerType())]
    if with_ids:
        fields.append(("ids", T.ArrayType(T.IntegerType())))
    schema = with_key(slim, *fields)
    names = schema.fieldNames()
    classes = Classes(capacity)

    def fill(batches):
        worker = TaskContext.get().partitionId()
        tokenizer, number, waiting = tokenizer_for(tokenizer_path), _sequences(0, worker), {}
        end = int(end_id).to_bytes(4, "little")
        arrow = None
        for batch in slices(batches):
            done = []
            arrow = arrow or pa.schema([batch.schema.field(0), *_arrow_fields(with_ids)])
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(tokenizer.encode(content or "") + end, dtype="<u4")
                for start, length, k in classes.cut(len(ids)):
                    part = ids[start:start + length]
                    row = [doc_id, start, length, zlib.crc32(part.tobytes()), len(ids), None, 0, k, worker]
                    if with_ids:
                        row.append(part.astype(np.int32))
                    group = waiting.setdefault(k, [])
                    group.append(row)
                    if len(group) == k:
                        done += _close(group, next(number))
                        waiting[k] = []
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
        if not remember:
            _TOKENIZERS.clear()
        rest = [row for group in waiting.values() for row in group]
        if rest:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rest), arrow)], schema=arrow)

    pieces = materialize(slim.mapInArrow(fill, schema), "packing")
    finished = [pieces.filter("sequence_id IS NOT NULL")]
    rest = pieces.filter("sequence_id IS NULL")
    workers = (pieces.agg(F.max("worker")).first()[0] or 0) + 1
    level = 0
    while True:
        level, last = level + 1, workers <= FAN_IN
        rest = materialize(
            rest.withColumn("worker", F.expr(f"CAST(worker DIV {FAN_IN} AS INT)"))
            .groupBy("worker").applyInPandas(_merge(level, last, capacity), schema), "packing_rest")
        finished.append(rest.filter("sequence_id IS NOT NULL"))
        if last:
            break
        rest, workers = rest.filter("sequence_id IS NULL"), -(-workers // FAN_IN)
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    keep = [n for n in names if n not in ("class", "worker")]
    return out.select(*keep)


def _arrow_fields(with_ids):
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [pa.field(n, pa.int64()) for n in longs] + [pa.field(n, pa.int32()) for n in ("class", "worker")]
    return fields + ([pa.field("ids", pa.list_(pa.int32()))] if with_ids else [])


def _close(group, sequence):
    """Put a complete group of pieces behind one another."""
    offset = 0
    for row in group:
        row[5], row[6] = sequence, offset
        offset += row[2]
    return group


def _merge(level, last, capacity):
    """Fill sequences from the rests of up to ``FAN_IN`` workers; the last round leaves nothing."""

    def merge(rows):
        rows = rows.sort_values(["class", "doc_id", "start"], kind="stable", ignore_index=True)
        number = _sequences(level, int(rows["worker"].iloc[0]))
        within = rows.groupby("class").cumcount()
        size = rows.groupby("class")["class"].transform("size")
        full = within < size - size % rows["class"]
        ids, offsets = [None] * len(rows), np.zeros(len(rows), dtype=np.int64)
        lengths = rows["length"].to_numpy()
        now = None
        for i in np.flatnonzero(full):
            if within[i] % rows.at[i, "class"] == 0:
                now, offset = next(number), 0
            ids[i], offsets[i] = now, offset
            offset += lengths[i]
        if last:
            left = np.flatnonzero(~full)
            room, names = np.empty(0, dtype=np.int64), []
            for i in left[np.argsort(-lengths[left], kind="stable")]:
                fits = np.flatnonzero(room >= lengths[i])
                if len(fits) == 0:
                    room, fits = np.append(room, capacity), [len(room)]
                    names.append(next(number))
                at = fits[0]
                ids[i], offsets[i] = names[at], capacity - room[at]
                room[at] -= lengths[i]
        import pandas as pd

        rows["sequence_id"] = pd.array(ids, dtype="Int64")
        rows["offset"] = offsets
        return rows

    return merge
