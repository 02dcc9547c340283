"""Phrase collocations from word indexes of shards, with exact counts summed over all shards.

A task numbers the words of its documents and cuts them into shards of about ``SHARD`` words; consecutive shards share
their numbers until these reach ``NUMBERS``. Words that are frequent enough in the whole corpus come back to the
shards, which drop the others and build an index (``word_index``) of what is left. Its intervals, extended to the left,
give all pairs with their counts. Counts are summed, first over shards with the same numbers and then over
all; the pairs frequent everywhere together come back, and are extended to the left to three words and
to the right to four, as long as every pair inside is frequent. No part of a frequent phrase is rarer than the
phrase, so nothing is lost by that. Only phrases with at least ``least`` occurrences are scored.

Per language; a null language is ``und``. A null or empty text has no words. Repeated rows count again. Words of very
long texts are read piece by piece, and a text lies in one shard. Keys and other columns are not
read, and an empty table gives an empty result. Ties of scores go to the more frequent phrase, then to
byte order, so the result does not depend on the order of rows.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthgrid.llm.common import byte_slices
from hearthgrid.llm.word_index import WordIndex
from hearthgrid.session import materialize

SHARD = 500_000
NUMBERS = 500_000
PENDING = 1_000_000
SALTS = 64
TOP = 2000

# What ends a piece; all of it becomes a full stop, and a tab becomes a space.
STOPS = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans(STOPS + b"\t", b"." * len(STOPS) + b" ")
SEGMENT = 1 << 20


def words_of(text):
    """The words of a text as bytes, in lists; a full stop stands between pieces."""
    data = text.encode().lower().translate(PLAIN)  # bytes: only A to Z change
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SEGMENT)
        end = len(data) if end < 0 else end
        yield data[at:end].replace(b".", b" . ").split()
        at = end


class _Numbers:
    """Numbers of (language, word), from 1 in the order they come; the full stop is 0 in all languages."""

    def __init__(self):
        self.count, self.of = 0, {}

    def language(self, lang):
        if lang not in self.of:
            self.of[lang] = _Language(self)
        return self.of[lang]


class _Language(dict):
    def __init__(self, shared):
        super().__init__({b".": 0})
        self.shared = shared

    def __missing__(self, word):
        self.shared.count += 1
        self[word] = self.shared.count
        return self.shared.count


def _packed(ids):
    """Ids as bytes: all first bytes, all second bytes and so on, compressed."""
    planes = ids.astype("<i4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=6).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data):
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _cut_shards(size, most):
    fields = ["dict", "lang", "word", "id", "n", "ids"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def sequence(number, parts):
        ids = np.concatenate([*parts, np.zeros(1, np.int32)])
        return ids, pa.RecordBatch.from_arrays([pa.array([number], types[0]), *(pa.nulls(1, t) for t in types[1:5]),
                                                pa.array([_packed(ids)], types[5])], names=fields)

    def words(number, numbers, counts):
        for lang, known in numbers.of.items():
            mine = np.fromiter((i for i in known.values() if i), np.int32)
            names = [w.decode() for w, i in known.items() if i]
            for at in range(0, len(names), 1 << 16):
                some = mine[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), number), types[0]), pa.array([lang] * len(some), types[1]),
                     pa.array(names[at:at + (1 << 16)], types[2]), pa.array(some, types[3]),
                     pa.array(counts[some], types[4]), pa.nulls(len(some), types[5])], names=fields)

    def run(batches):
        task = TaskContext.get().partitionId()
        if task >= 1 << 20:
            raise ValueError("more than 2^20 input partitions: word numbers would not fit")
        number, numbers, counts = task << 12, _Numbers(), np.zeros(1, np.int64)
        parts, have = [np.zeros(1, np.int32)], 0
        for batch in byte_slices(batches, 1, 4 << 20):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = numbers.language(lang)
                for found in words_of(text):
                    parts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                    have += len(found)
                parts.append(np.zeros(1, np.int32))
                if have >= size:
                    ids, row = sequence(number, parts)
                    counts = np.bincount(ids, minlength=numbers.count + 1) + np.pad(counts, (0, numbers.count + 1 - len(counts)))
                    parts, have = [np.zeros(1, np.int32)], 0
                    yield row
                    if numbers.count >= most and number + 1 & 4095:
                        yield from words(number, numbers, counts)
                        number, numbers, counts = number + 1, _Numbers(), np.zeros(1, np.int64)
        if have:
            ids, row = sequence(number, parts)
            counts = np.bincount(ids, minlength=numbers.count + 1) + np.pad(counts, (0, numbers.count + 1 - len(counts)))
            yield row
        yield from words(number, numbers, counts)

    return run


def shards(docs, lang="lang", text="text", size=SHARD, most=NUMBERS):
    """Words with their numbers and counts, and one row per shard with its ids (``ids`` is null for words).

    ``dict`` tells which rows share their numbers.
    """
    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text).cast("string").alias("text")).filter("text <> ''")
    return slim.mapInArrow(_cut_shards(size, most), "dict long, lang string, word string, id int, n long, ids binary")


class _Sums:
    """Counts by rows of whole numbers; rows are added up whenever many have come together."""

    def __init__(self, width):
        self.rows, self.counts, self.waiting = [np.zeros((0, width), np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, counts, *columns):
        self.rows.append(np.stack(columns, axis=1))
        self.counts.append(counts)
        self.waiting += len(counts)
        if self.waiting > PENDING:
            self.total()

    def total(self):
        rows, counts = np.concatenate(self.rows), np.concatenate(self.counts)
        order = np.lexsort(rows.T)
        rows, counts = rows[order], counts[order]
        if len(rows):
            heads = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
            rows, counts = rows[heads], np.add.reduceat(counts, heads)
        self.rows, self.counts, self.waiting = [rows], [counts], 0
        return rows, counts


class _Frequent:
    """The frequent words of some shards: their numbers there and everywhere, in the order of the latter."""

    def __init__(self, local, word):
        order = np.argsort(word, kind="stable")
        self.local, self.word = local[order], word[order]

    def index(self, data):
        """Index of a shard's frequent words, numbered from 1; all others have become separators."""
        ids = _unpacked(data)
        known = np.zeros(max(int(ids.max()), int(self.local.max())) + 1, dtype=np.int32)
        known[self.local] = np.arange(1, len(self.local) + 1)
        ids = known[ids]
        return WordIndex.of(ids[np.concatenate([[True], (ids[1:] != 0) | (ids[:-1] != 0)])])


def _columns(right, *names):
    return [right.column(n).to_numpy() for n in names]


def _pairs(left, right):
    """Pairs of frequent words of the shards that share their numbers."""
    sums, number = _Sums(1), left.column("here")[0].as_py() if left.num_rows else 0
    frequent = _Frequent(*_columns(right, "id", "gid"))
    wide = len(frequent.word) + 1
    if left.num_rows and right.num_rows:
        for data in left.column("ids"):
            x, y, count, _, _ = frequent.index(data.as_py()).pairs()
            sums.add(count, x.astype(np.int64) * wide + y)
    rows, counts = sums.total()
    g1, g2 = (frequent.word[i - 1] for i in np.divmod(rows[:, 0], wide))
    return pa.Table.from_arrays([pa.array(np.full(len(rows), number), pa.int64()), pa.array(g1, pa.int64()),
                                 pa.array(g2, pa.int64()), pa.array(counts, pa.int64())], names=["dict", "g1", "g2", "n"])


def _longer(left, right):
    """Phrases of three and four words, all pairs of which are frequent, of the shards that share their numbers; -1: no fourth."""
    sums = _Sums(2)
    is_word = right.column("id").is_valid()
    words, pairs = right.filter(is_word), right.filter(pc.invert(is_word))
    frequent = _Frequent(*_columns(words, "id", "gid"))
    wide = len(frequent.word) + 1
    if left.num_rows and words.num_rows and pairs.num_rows:
        first, second = (np.searchsorted(frequent.word, c) + 1 for c in _columns(pairs, "gid", "g2"))
        known = np.sort(first.astype(np.int64) * wide + second)

        def key(a, b):
            return a.astype(np.int64) * wide + b

        def is_pair(a, b):
            found = key(a, b)
            return known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found

        for data in left.column("ids"):
            index = frequent.index(data.as_py())
            x, y, n, start, back = index.pairs()
            ok = is_pair(x, y)
            x, y, n, start, back = (a[ok] for a in (x, y, n, start, back))
            of, before, n, start, back = index.to_the_left(start, back, n)
            ok = is_pair(before, x[of])
            of, before, n, start, back = (a[ok] for a in (of, before, n, start, back))
            two, third = key(before, x[of]), y[of]
            sums.add(n, two, key(third, 0))
            of4, after, n4, _, _ = index.to_the_right(start, back, n)
            ok = is_pair(third[of4], after)
            of4, after, n4 = of4[ok], after[ok], n4[ok]
            sums.add(n4, two[of4], key(third[of4], after))
    rows, counts = sums.total()
    ids = [i for column in rows.T for i in np.divmod(column, wide)]
    # Number 0 stands for no fourth word.
    named = np.concatenate([[-1], frequent.word])
    return pa.Table.from_arrays([*(pa.array(named[i], pa.int64()) for i in ids), pa.array(counts, pa.int64())],
                                names=["g1", "g2", "g3", "g4", "n"])


def _by_numbers(rows, name):
    """Grouped by the dictionary under a name of its own, as both sides of a cogroup come from one table."""
    return rows.withColumnRenamed("dict", name).groupBy(name)


def _frequent(rows, least, *key):
    """The rows whose key has at least ``least`` occurrences: with that number, ``f``, and whether a row is its key's ``first``.

    One shuffle finds the sums and keeps the rows they belong to. A key has one row per dictionary at most.
    """
    same = Window.partitionBy(*key)
    return rows.withColumns({"f": F.sum("n").over(same), "first": F.min("dict").over(same) == F.col("dict")}) \
        .filter(F.col("f") >= least)


def phrases(docs, least=30, lang="lang", text="text", size=SHARD, most=NUMBERS):
    """Two tables: lang, words (array of 1 to 4) and f of everything with at least ``least`` occurrences; lang and n."""
    cut = materialize(shards(docs, lang, text, size, most), "shards")
    counted = cut.filter("ids IS NULL").drop("ids")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    named = _frequent(counted, least, "lang", "word") \
        .withColumn("gid", F.min(F.expr("shiftleft(dict, 31) | CAST(id AS BIGINT)")).over(Window.partitionBy("lang", "word")))
    named = materialize(named.drop("n"), "vocabulary")
    sequences = cut.filter("ids IS NOT NULL").select("dict", "ids")
    back = named.select("dict", "id", "gid")
    local = _by_numbers(sequences, "here").cogroup(_by_numbers(back, "there")) \
        .applyInArrow(_pairs, "dict long, g1 long, g2 long, n long")
    pairs = materialize(_frequent(local, least, "g1", "g2").drop("n"), "pairs")
    sent = back.withColumn("g2", F.lit(None).cast("long")).unionByName(
        pairs.select("dict", F.lit(None).cast("int").alias("id"), F.col("g1").alias("gid"), "g2"))
    longer = _by_numbers(sequences, "here").cogroup(_by_numbers(sent, "there")) \
        .applyInArrow(_longer, "g1 long, g2 long, g3 long, g4 long, n long")
    longer = longer.groupBy("g1", "g2", "g3", "g4").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    word = named.filter("first").select("gid", "lang", "word", "f")

    def spelled(rows, *ids):
        """Word ids as words; -1 is none."""
        for i, g in enumerate(ids):
            names = word.select(F.col("gid").alias(g), F.col("word").alias(f"w{i}"), *(["lang"] if not i else []))
            rows = rows.join(names, g, "left" if g == "g4" else "inner")
        words = F.filter(F.array(*[f"w{i}" for i in range(len(ids))]), lambda w: w.isNotNull())
        return rows.select("lang", words.alias("words"), "f")

    two = spelled(pairs.filter("first").select("g1", "g2", "f"), "g1", "g2")
    more = spelled(longer, "g1", "g2", "g3", "g4")
    one = word.select("lang", F.array("word").alias("words"), "f")
    return materialize(one.unionByName(two).unionByName(more), "phrases"), materialize(totals, "totals")


def collocations(docs, least=30, share=80, top=TOP, scale=2_000_000, lang="lang", text="text", size=SHARD, most=NUMBERS):
    """lang, rank, phrase, a, l, r, n and score of the best ``top`` phrases of every language.

    A phrase that lies in a longer one with at least ``share`` percent of its occurrences is dropped.
    """
    counted, totals = phrases(docs, least, lang, text, size, most)
    found = counted.filter("size(words) > 1").withColumnRenamed("f", "a")

    def part(name):
        return counted.select("lang", F.col("words").alias(f"{name}_words"), F.col("f").alias(name))

    cuts = found.selectExpr("lang", "words", "a", "explode(sequence(1, size(words) - 1)) AS k") \
        .selectExpr("*", "slice(words, 1, k) AS l_words", "slice(words, k + 1, size(words)) AS r_words")
    cuts = cuts.join(part("l"), ["lang", "l_words"]).join(part("r"), ["lang", "r_words"])
    # Decimals of up to 38 digits: exact far beyond 64 bits.
    scored = cuts.withColumn("score", F.expr(
        f"(CAST(a AS DECIMAL(20, 0)) * CAST({scale} AS DECIMAL(10, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"))
    lowest = scored.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # A longer phrase has no part rarer than itself, so the phrases one word longer decide.
    inside = found.filter("size(words) > 2").selectExpr(
        "lang", "a AS longer", "explode(array(slice(words, 1, size(words) - 1), slice(words, 2, size(words) - 1))) AS words") \
        .groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    free = lowest.join(inside, ["lang", "words"], "left").filter(
        f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {share}")
    ready = free.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score") \
        .withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    # The best of every salt first, so that no task ranks a whole language.
    first = _ranked(ready, ["lang", "salt"], top)
    return _ranked(first, ["lang"], top).join(totals, "lang") \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _ranked(rows, by, top):
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
