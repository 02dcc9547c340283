"""One large GeoJSON document over many tasks.

Spark cuts the file into byte ranges at closing braces. Where a range starts, a task cannot tell whether it is inside a
string or how deep. So every range is first read under both assumptions about strings, and reports the depth it
adds and where it ends. Ranges in order then tell each other's start, which takes one small row each. With that every range finds its own
features: the objects that lie directly in an array of the document's top object. Only a feature that a range boundary
cuts is put together from its parts afterwards.
"""

import re

import pyarrow as pa
from pyspark.sql import functions as F

# A closing brace ends a record of the text reader; strings with their escapes, and what opens and closes.
CLOSING = "}"
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}\[\]"]', re.S)
_STRING_END = re.compile(r'(?:[^"\\]++|\\.)*+"', re.S)
#: Ranges whose starts are worked out on the driver, one small row each.
MOST_RANGES = 100_000


class _Reader:
    """Reads records of a range one after another and keeps where it is: in a string, and in what.

    ``stack`` has the braces and brackets that are open, ``closed`` counts those that were open before the range.
    """

    def __init__(self, in_string=False, stack=""):
        self.in_string, self.stack, self.closed = in_string, list(stack), 0

    def tokens(self, record):
        """Positions and kinds of what opens and closes outside strings."""
        at = 0
        if self.in_string:
            ended = _STRING_END.match(record)
            if ended is None:
                return
            at, self.in_string = ended.end(), False
        for found in _TOKEN.finditer(record, at):
            kind = record[found.start()]
            if kind == '"':
                self.in_string = found.end() - found.start() == 1
                if self.in_string:
                    return
                continue
            if kind in "{[":
                self.stack.append(kind)
            elif self.stack:
                self.stack.pop()
            else:
                self.closed += 1
            yield found.start(), kind

    def in_feature(self):
        return self.stack[:3] == ["{", "[", "{"]


def _records(spark, paths):
    """Rows ``file, start, text`` in the order of the file within every range."""
    return spark.read.option("lineSep", CLOSING).text(paths) \
        .select("_metadata.file_path", "_metadata.file_block_start", "value")


def _ranges(batches):
    """The records of a task by range: (file, start), and then each record with the brace that ended it."""
    for batch in batches:
        for file, start, text in zip(*(c.to_pylist() for c in batch.columns)):
            yield (file, start), text + CLOSING


def _summaries(batches):
    """Per range and assumption (is its start in a string?): whether its end is, what it closes and what it leaves open."""
    found = {}
    for where, record in _ranges(batches):
        both = found.setdefault(where, (_Reader(False), _Reader(True)))
        for reader in both:
            for _ in reader.tokens(record):
                pass
    rows = [(*where, *[v for r in both for v in (r.in_string, r.closed, "".join(r.stack))]) for where, both in found.items()]
    types = [pa.string(), pa.int64(), *[pa.bool_(), pa.int64(), pa.string()] * 2]
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                     names=["file", "start", "s0", "n0", "open0", "s1", "n1", "open1"])


def _starts(summaries):
    """{(file, start): (in a string, what is open)} from the ranges' summaries."""
    out, state, file = {}, None, None
    for r in sorted(summaries, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, state = r["file"], (False, "")
        out[r["file"], r["start"]] = state
        in_string, stack = state
        end, closed, opened = (r["s1"], r["n1"], r["open1"]) if in_string else (r["s0"], r["n0"], r["open0"])
        state = (end, stack[:max(0, len(stack) - closed)] + opened)
    return out


def _parts(starts):
    """Rows ``file, start, number, open, closed, text``: whole features, parts of cut ones, and the text between features.

    A part that is not ``open`` at its begin continues the one before; ``number`` is null for the text between features.
    """
    names = ["file", "start", "number", "opened", "closed", "text"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]

    def run(batches):
        open_ranges, rows = {}, []
        for where, record in _ranges(batches):
            if where not in open_ranges:
                if where not in starts:
                    raise ValueError(f"the file was cut in other places than before: {where}")
                reader = _Reader(*starts[where])
                open_ranges[where] = [reader, reader.in_feature(), False, [], [], 0]
            reader, inside, opened, text, between, number = open_ranges[where]
            at = 0
            for place, kind in reader.tokens(record):
                if kind == "{" and not inside and len(reader.stack) == 3 and reader.in_feature():
                    between.append(record[at:place].strip(" ,\r\n\t"))
                    at, inside, opened = place, True, True
                elif kind == "}" and inside and len(reader.stack) == 2:
                    text.append(record[at:place + 1])
                    rows.append((*where, number, opened, True, "".join(text)))
                    at, inside, opened, number = place + 1, False, False, number + 1
                    text.clear()
            if inside:
                text.append(record[at:])
            else:
                between.append(record[at:].strip(" ,\r\n\t"))
            open_ranges[where][1:] = [inside, opened, text, between, number]
            if len(rows) >= 1024:
                yield batch(rows)
                rows = []
        for where, (reader, inside, opened, text, between, number) in open_ranges.items():
            if inside and text:
                rows.append((*where, number, opened, False, "".join(text)))
            rows.append((*where, None, False, False, "".join(between)))
        yield batch(rows)

    def batch(rows):
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def document_features(spark, paths):
    """Two tables of documents read by many tasks: ``file, text`` of every feature, and ``file, text`` of what stands between.

    One row per byte range comes to the driver; more than ``MOST_RANGES`` of them are an error.
    """
    records = _records(spark, paths)
    kind = "file string, start long, s0 boolean, n0 long, open0 string, s1 boolean, n1 long, open1 string"
    summaries = records.mapInArrow(_summaries, kind).limit(MOST_RANGES + 1).collect()
    if len(summaries) > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} byte ranges; raise spark.sql.files.maxPartitionBytes")
    parts = records.mapInArrow(_parts(_starts(summaries)), "file string, start long, number long, opened boolean, closed boolean, text string")
    features = parts.filter("number IS NOT NULL")
    whole = features.filter("opened AND closed").select("file", "text")
    # Parts of cut features, few per range: each belongs to the last one opened before it.
    cut = features.filter("NOT (opened AND closed)")
    order = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    cut = cut.withColumn("first", F.expr(f"sum(if(opened, 1, 0)) OVER (PARTITION BY file ORDER BY start, number {order})"))
    joined = cut.groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("start", "number", "text"))).alias("parts")) \
        .select("file", F.expr("array_join(transform(parts, p -> p.text), '')").alias("text"))
    # Little is left between features: the document's head and tail.
    between = parts.filter("number IS NULL").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts")) \
        .select("file", F.expr("array_join(transform(parts, p -> p.text), '')").alias("text"))
    return whole.unionByName(joined), between
