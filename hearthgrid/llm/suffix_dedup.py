"""Removal of byte strings of a minimum length that occur more than once in the corpus.

1. Every window of ``length`` bytes has an anchor inside it that depends on its bytes alone (see
   ``anchors``), so equal windows meet under the hash of their anchor. One row stands for all windows
   that an anchor owns in its document. Tasks merge equal rows before the shuffle.
2. Rows with equal hashes of all bytes they cover are repeats as a whole. Where different rows remain
   under one anchor, one of each kind goes on with its bytes.
3. Tasks take such rows by whole anchors, build the Burrows-Wheeler transform of their bytes and find
   the windows that occur twice by threshold-bounded interval expansion (see ``bwt``). An anchor with
   more kinds than fit one task is settled window by window instead: its windows' 128-bit
   hashes are counted like the rows of step 1.
4. The covered stretches of each document are joined with it and cut out.

Null texts count as empty; texts shorter than the window keep all bytes. Matches never cross documents
and are judged on the input. A document is told apart by its key and a hash of its text, so
null and repeated keys are handled; rows alike in both are copies of each other, and all their bytes
go if they are long enough. Empty tables give empty results; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.llm import anchors as A
from hearthgrid.llm.blocks import whole_groups
from hearthgrid.llm.bwt import equal_windows
from hearthgrid.llm.common import keyed_text, slices, with_key
from hearthgrid.session import materialize

KINDS = 2048
BATCH = 1 << 19
HELD = 500_000


def _gram(length):
    return max(1, length * A.GRAM // A.WINDOW)


def _rows(names, **columns):
    """A record batch with the given columns in the order of ``names``."""
    return pa.RecordBatch.from_arrays(
        [columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n]) for n in names], names=names)


ANCHOR_ROWS = ["doc_id", "tag", "h", "c", "start", "last", "many", "cover"]


def _merged_rows(ids, tags, doc, start, last, h, c):
    """Batches of anchor rows, equal ones merged; ``doc`` numbers the documents of ``ids`` and ``tags``.

    ``many``: the row stands for two or more equal ones, whose own stretches are emitted as rows with
    ``cover``. Those are spread by an arbitrary h, for nothing is looked up with them.
    """
    order = np.lexsort((c, h))
    doc, start, last, h, c = (x[order] for x in (doc, start, last, h, c))
    same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    again, more = np.append(False, same), np.append(same, False)
    for rows, many, cover in ((np.flatnonzero(~again), more[~again], False),
                              (np.flatnonzero(again | more), None, True)):
        spread = h[rows] if not cover else A.mix(h[rows] + np.arange(len(rows), dtype=np.uint64))
        yield _rows(ANCHOR_ROWS, doc_id=ids.take(pa.array(doc[rows])), tag=tags[doc[rows]],
                    h=spread.view(np.int64), c=c[rows].view(np.int64), start=start[rows], last=last[rows],
                    many=np.zeros(len(rows), dtype=bool) if many is None else many,
                    cover=np.full(len(rows), cover))


def _anchor_rows(length):
    """Anchor rows of all documents of a task, equal ones merged."""

    def flush(held, ids, tags):
        yield from _merged_rows(pa.concat_arrays(ids), np.concatenate(tags), *(np.concatenate(x) for x in zip(*held)))

    def run(batches):
        held, ids, tags, n, seen = [], [], [], 0, 0
        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            ids.append(batch.column(0))
            tags.append(batch.column(2).to_numpy())
            for part in A.chunks(texts, length):
                data = np.frombuffer(b"".join(p for _, _, p in part), dtype=np.uint8)
                ends = np.cumsum([len(p) for _, _, p in part])
                first, last, _, h, c = A.anchors(data, ends, length, _gram(length))
                piece = np.searchsorted(ends, first, side="right")
                shift = np.array([s for _, s, _ in part]) - np.concatenate([[0], ends[:-1]])
                doc = np.array([d for d, _, _ in part])[piece] + seen
                held.append((doc, first + shift[piece], last + shift[piece], h, c))
                n += len(first)
            seen += len(texts)
            if n > HELD:
                yield from flush(held, ids, tags)
                held, ids, tags, n, seen = [], [], [], 0, 0
        if n:
            yield from flush(held, ids, tags)

    return run


class Lookahead:
    """Batches sorted by (h, c), each with whether the row before or after it is equal in both.

    Holds back one row, whatever the size of a group.
    """

    def __init__(self, batches):
        self.batches = batches

    def __iter__(self):
        held, before = None, None
        for batch in self.batches:
            if not batch.num_rows:
                continue
            now = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = now.slice(now.num_rows - 1)
            if now.num_rows > 1:
                yield self._marked(now, before, now.num_rows - 1)
                last = now.num_rows - 2
                before = now.column("h")[last].as_py(), now.column("c")[last].as_py()
        if held is not None:
            yield self._marked(held, before, 1)

    @staticmethod
    def _marked(rows, before, n):
        h, c = rows.column("h").to_numpy(), rows.column("c").to_numpy()
        same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        again = np.append(before is not None and (h[0], c[0]) == before, same)[:n]
        more = np.append(same, False)[:n]
        return rows.slice(0, n), h[:n], again, more


SETTLED = ["doc_id", "tag", "h", "start", "end", "rank"]


def _settle(length):
    """Repeats and open cases among anchor rows sorted by (h, c).

    Rows out: covered stretches (rank null), and one row per kind of an anchor that has several, with
    rank 0, 1, 2, ... within the anchor. The first kind waits until a second one shows up.
    """

    def run(batches):
        anchor, rank, waiting = None, 0, None
        for rows, h, again, more in Lookahead(batches):
            start, last = rows.column("start").to_numpy(), rows.column("last").to_numpy()
            cover = rows.column("cover").to_numpy(zero_copy_only=False)
            many = rows.column("many").to_numpy(zero_copy_only=False)
            repeat = np.flatnonzero(cover | ((again | more) & ~many))
            if len(repeat):
                yield _settled(rows, repeat, h, start, last + length, None)
            kinds = np.flatnonzero(~again & ~cover)
            if not len(kinds):
                continue
            new = np.append(anchor is None or h[kinds[0]] != anchor, h[kinds][1:] != h[kinds][:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(kinds)), -1))
            ranks = np.where(head >= 0, np.arange(len(kinds)) - head, np.arange(len(kinds)) + rank)
            if waiting is not None and not new[0]:
                yield waiting
            waiting = None
            followed = np.append(~new[1:], False)
            out = (ranks > 0) | followed
            if out.any():
                yield _settled(rows, kinds[out], h, start, last + length, ranks[out])
            if ranks[-1] == 0:
                waiting = _settled(rows, kinds[-1:], h, start, last + length, ranks[-1:])
            anchor, rank = h[kinds[-1]], int(ranks[-1]) + 1

    return run


def _settled(rows, chosen, h, start, end, ranks):
    taken = pa.array(chosen)
    return _rows(SETTLED, doc_id=rows.column("doc_id").take(taken), tag=rows.column("tag").take(taken),
                 h=h[chosen], start=start[chosen], end=end[chosen],
                 rank=pa.nulls(len(chosen), pa.int64()) if ranks is None else pa.array(ranks, pa.int64()))


def _bytes_of(batches):
    """The bytes of the open rows of each document: one row (h, hot, doc_id, tag, start, bytes) per open row."""
    names = ["h", "hot", "doc_id", "tag", "start", "bytes"]
    for batch in slices(batches):
        out, ids = [], []
        rows = zip(batch.column("text").to_pylist(), batch.column("tag").to_pylist(), batch.column("open").to_pylist())
        for i, (text, tag, cases) in enumerate(rows):
            data = (text or "").encode()
            for case in cases:
                ids.append(i)
                out.append((case["h"], bool(case["hot"]), tag, case["start"], data[case["start"]:case["end"]]))
        if out:
            h, hot, tag, start, data = zip(*out)
            yield _rows(names, h=pa.array(h, pa.int64()), hot=pa.array(hot), start=pa.array(start, pa.int64()),
                        doc_id=batch.column("doc_id").take(pa.array(ids)), tag=pa.array(tag, pa.int64()),
                        bytes=pa.array(data, pa.binary()))


def _compare(length):
    """Repeats among the open rows of whole anchors, by the Burrows-Wheeler transform of their bytes."""

    def found(rows):
        number, at = equal_windows(rows.column("bytes").to_pylist(), length)
        if not len(number):
            return
        cut = np.flatnonzero((np.diff(number) != 0) | (np.diff(at) > length)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(at) - 1]])
        taken = pa.array(number[first])
        begin = rows.column("start").to_numpy()[number[first]]
        yield _rows(["doc_id", "tag", "start", "end"], doc_id=rows.column("doc_id").take(taken).combine_chunks(),
                    tag=rows.column("tag").take(taken).combine_chunks(),
                    start=begin + at[first], end=begin + at[last] + length)

    def run(batches):
        held, size = [], 0
        for rows, change in whole_groups(batches, 1):
            heads = [0, *np.flatnonzero(change).tolist(), rows.num_rows]
            weight = np.cumsum([0, *pa.compute.binary_length(rows.column("bytes")).to_pylist()])
            begin = 0
            for head in heads[1:]:
                if size + weight[head] - weight[begin] >= BATCH or head == rows.num_rows:
                    held.append(rows.slice(begin, head - begin))
                    size += weight[head] - weight[begin]
                    begin = head
                    if size >= BATCH:
                        yield from found(pa.concat_tables(held))
                        held, size = [], 0
        if held:
            yield from found(pa.concat_tables(held))

    return run


def _window_rows(length):
    """A row like an anchor row for every single window, under two independent hashes of its bytes, merged alike."""

    def run(batches):
        for batch in batches:
            starts, held = batch.column("start").to_numpy(), []
            for i, data in enumerate(batch.column("bytes").to_pylist()):
                data = np.frombuffer(data, dtype=np.uint8)
                n = len(data) - length + 1
                begin, end = slice(0, n), slice(length, length + n)
                at = starts[i] + np.arange(n)
                held.append((np.full(n, i), at, at, A.GRAMS.of(A.GRAMS.prefix(data), begin, end),
                             A.SPANS.of(A.SPANS.prefix(data), begin, end)))
            if held:
                yield from _merged_rows(batch.column("doc_id"), batch.column("tag").to_numpy(),
                                        *(np.concatenate(x) for x in zip(*held)))

    return run


def _by_anchor(rows):
    return rows.repartition("h").sortWithinPartitions("h", "c")


def keyed_documents(docs, key="doc_id", text="text"):
    """doc_id, text and tag, the hash that tells documents with the same key apart."""
    return keyed_text(docs, key, text).withColumn("tag", F.xxhash64("text"))


def repeated_stretches(slim, length=200, kinds=KINDS):
    """(doc_id, tag, spans) for the documents of ``keyed_documents`` that have repeats; spans may overlap."""
    longs = [(n, T.LongType()) for n in ("tag", "h", "c", "start", "last")]
    anchor_type = with_key(slim, *longs, ("many", T.BooleanType()), ("cover", T.BooleanType()))
    settled_type = with_key(slim, *((n, T.LongType()) for n in SETTLED[1:]))
    found = slim.mapInArrow(_anchor_rows(length), anchor_type)
    settled = materialize(_by_anchor(found).mapInArrow(_settle(length), settled_type), "anchors")
    covers = [settled.filter("rank IS NULL").select("doc_id", "tag", "start", "end")]
    cases = settled.filter("rank IS NOT NULL")
    crowded = cases.filter(F.col("rank") == kinds).select("h", F.lit(True).alias("hot"))
    wanted = cases.join(crowded, "h", "left").groupBy("doc_id", "tag") \
        .agg(F.collect_list(F.struct("h", "start", "end", "hot")).alias("open")) \
        .withColumnsRenamed({"doc_id": "_doc", "tag": "_tag"})
    bytes_type = T.StructType([T.StructField("h", T.LongType()), T.StructField("hot", T.BooleanType()),
                               *with_key(slim, ("tag", T.LongType()), ("start", T.LongType()),
                                         ("bytes", T.BinaryType())).fields])
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag"))
    # Rows alike in key and tag are copies of each other, and whole repeats already.
    opened = materialize(slim.join(wanted, same).select("doc_id", "tag", "text", "open")
                         .mapInArrow(_bytes_of, bytes_type), "bytes")
    cover_type = with_key(slim, *((n, T.LongType()) for n in ("tag", "start", "end")))
    compared = opened.filter("NOT hot").select("h", "doc_id", "tag", "start", "bytes") \
        .repartition("h").sortWithinPartitions("h").mapInArrow(_compare(length), cover_type)
    windows = opened.filter("hot").mapInArrow(_window_rows(length), anchor_type)
    counted = _by_anchor(windows).mapInArrow(_settle(length), settled_type) \
        .filter("rank IS NULL").select("doc_id", "tag", "start", "end")
    covers += [compared, counted]
    return covers[0].unionByName(covers[1]).unionByName(covers[2]) \
        .groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans):
    """Maximal covered runs of possibly overlapping or touching (start, end)."""
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def without(data, runs):
    """The bytes outside the given runs."""
    ends = [0, *(e for _, e in runs)]
    starts = [*(s for s, _ in runs), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends, starts))


def with_spans(slim, found):
    """``slim`` with the column ``spans`` (null: none), whatever keys are null or repeated."""
    renamed = found.withColumnsRenamed({"doc_id": "_doc", "tag": "_tag"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("tag").eqNullSafe(F.col("_tag"))
    return slim.join(renamed, same, "left").drop("_doc", "_tag")


def remove_repeats(docs, length=200, key="doc_id", text="text", kinds=KINDS):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``runs``, the removed (start, end) in bytes."""
    slim = keyed_documents(docs, key, text)
    joined = with_spans(slim, repeated_stretches(slim, length, kinds)).select("doc_id", "text", "spans")
    runs_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [*((n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")),
              ("kept_sha256", T.StringType()), ("runs", runs_type)]

    def cut(batches):
        for batch in slices(batches):
            out = []
            for content, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (content or "").encode()
                runs = merged((s["start"], s["end"]) for s in spans or ())
                out.append((len(data), sum(e - s for s, e in runs), len(runs),
                            hashlib.sha256(without(data, runs)).hexdigest(),
                            [{"start": s, "end": e} for s, e in runs]))
            columns = list(zip(*out)) if out else [[]] * 5
            arrow = [pa.int64(), pa.int64(), pa.int64(), pa.string(),
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, arrow))],
                                             names=["doc_id", *(n for n, _ in fields)])

    return joined.mapInArrow(cut, with_key(slim, *fields))


def cut_repeats(docs, length=200, key="doc_id", text="text", count=None):
    """``docs`` with the repeats cut out of the text; ``count`` names a column to hold its new length in characters.

    A character of which some bytes are cut goes as a whole. Null texts stay null.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = keyed_documents(docs, key, text)
    marked = docs.select(whole, F.col(key).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("tag"))
    joined = with_spans(marked, repeated_stretches(keyed, length)).select("row", "spans")
    names, at, counted = docs.columns, docs.columns.index(text), docs.columns.index(count) if count else None

    def cut(batches):
        for batch in slices(batches):
            texts = []
            columns = batch.column(0).flatten()  # the row's own columns, whatever their names
            for content, spans in zip(columns[at].to_pylist(), batch.column(1).to_pylist()):
                if content is not None and spans:
                    runs = merged((s["start"], s["end"]) for s in spans)
                    content = without(content.encode(), runs).decode(errors="ignore")
                texts.append(content)
            columns[at] = pa.array(texts, columns[at].type)
            if counted is not None:
                lengths = [len(t) if t is not None else None for t in texts]
                columns[counted] = pa.array(lengths, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, docs.schema)
