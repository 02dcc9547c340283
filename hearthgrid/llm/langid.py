"""Language identification with bit-sliced Bloom filters over character n-grams.

Every language has a Bloom filter of the n-grams that make up at least ``least_share`` of its n-grams
of that order, so a filter holds at most ``1 / least_share`` of them per order however large the
corpus is. The filters are stored sliced: one word of bits per position, a bit per language. ANDing
the words at an n-gram's positions gives all languages that contain it. A document adds up
these bits per language; ``n`` n-grams with ``c`` hits in a filter whose false-positive rate is ``f``
stand for ``(c - f n) / (1 - f)`` true hits, and the language with most of them wins (ties: the
first name in sort order).

Learning skips rows whose text or label is null. Prediction gives ``und`` and score 0 for null
texts and texts without a letter. If a text has letters but no known n-gram, or nothing could be
learned, the first learned language or ``und`` is returned with score 0. Repeated rows count as
often as they occur, a null key is kept, empty tables give empty results, other columns are ignored.
"""

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.llm.common import Memory, keyed_text, with_key

ORDERS = (3, 4)
HASHES = 3
FLUSH = 400_000
LANE = 40


def grams_of(word):
    """N-grams of the letter runs of a word, with the ends of a run marked."""
    lowered = word.lower()
    if lowered.isalpha():
        runs = [lowered]
    else:
        runs = "".join(c if c.isalpha() else " " for c in lowered).split()
    return [p[i:i + n] for run in runs for p in (f"^{run}$",) for n in ORDERS for i in range(len(p) - n + 1)]


def gram_counts(docs, label, text="text"):
    """Rows (lang, gram, n) over all labelled texts, added up in each task before they are shuffled."""
    slim = docs.select(F.col(label).cast("string").alias("lang"), F.col(text).cast("string").alias("text")) \
        .filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches):
        words, n = {}, 0

        def flush():
            rows = []
            for lang, counted in words.items():
                grams = Counter()
                for word, times in counted.items():
                    for gram in grams_of(word):
                        grams[gram] += times
                rows += [(lang, g, c) for g, c in grams.items()]
            words.clear()
            cols = list(zip(*rows)) if rows else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                                               pa.array(cols[2], pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counted = words.setdefault(lang, Counter())
                before = len(counted)
                counted.update(content.split())
                n += len(counted) - before
                if n > FLUSH:
                    n = 0
                    yield flush()
        yield flush()

    return slim.mapInArrow(count, "lang string, gram string, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs, label="lang", text="text", least_share=2e-4, bits_per_gram=16):
    """Bit-sliced filters learned from all rows given.

    What reaches the driver is bounded by languages x orders / ``least_share`` rows.
    """
    counts = gram_counts(docs, label, text).withColumn("order", F.length("gram"))
    totals = counts.groupBy("lang", "order").agg(F.sum("n").alias("total"))
    common = counts.join(F.broadcast(totals), ["lang", "order"]).filter(F.col("n") >= least_share * F.col("total"))
    rows = common.select("lang", "gram").collect()
    langs = sorted({r.lang for r in rows})
    sizes = Counter(r.lang for r in rows)
    size = 1 << max(10, int(max(sizes.values(), default=1) * bits_per_gram - 1).bit_length())
    slices = np.zeros((size, -(-len(langs) // 64) or 1), dtype=np.uint64)
    number = {lang: i for i, lang in enumerate(langs)}
    for row in rows:
        i = number[row.lang]
        slices[_positions(row.gram, size), i // 64] |= np.uint64(1 << (i % 64))
    return BitSlicedFilters(langs, slices)


def _positions(gram, size):
    h = xxhash.xxh3_64_intdigest(gram.encode())
    step = (h >> 32) | 1
    return [(h + i * step) & (size - 1) for i in range(HASHES)]


class BitSlicedFilters:
    """All languages' Bloom filters, a bit per language in the word of each position."""

    def __init__(self, langs, slices):
        self.langs, self.slices, self.name = langs, slices, uuid.uuid4().hex
        fill = np.array([self._bit(slices, i).mean() for i in range(len(langs))])
        self.false_rate = fill ** HASHES

    @staticmethod
    def _bit(words, i):
        return (words[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    def containing(self, gram):
        """The bits of all languages whose filter has the n-gram."""
        words = np.bitwise_and.reduce(self.slices[_positions(gram, len(self.slices))], axis=0)
        return sum(int(w) << (64 * i) for i, w in enumerate(words))

    def counter(self, gram):
        """The same bits spread to one counter of ``LANE`` bits each, so that adding numbers adds up all
        languages; the counter behind the last language counts the n-grams."""
        mask = self.containing(gram)
        return sum(1 << (LANE * i) for i in range(len(self.langs)) if mask >> i & 1) | 1 << (LANE * len(self.langs))

    def decide(self, counters):
        """Language and score from a document's added counters."""
        hits = np.array([counters >> (LANE * i) & ((1 << LANE) - 1) for i in range(len(self.langs) + 1)], dtype=float)
        n = hits[-1]
        if not self.langs:
            return "und", 0.0
        if n == 0:
            return self.langs[0], 0.0
        true = (hits[:-1] - self.false_rate * n) / np.maximum(1 - self.false_rate, 1e-9)
        best = int(np.argmax(true))
        return self.langs[best], float(min(1.0, max(0.0, true[best] / n)))


_WORDS = {}


def _word_counters(model):
    """Counters of words, kept for as long as a Python worker serves the same model."""
    if model.name not in _WORDS:
        _WORDS.clear()
        counter = Memory(model.counter)
        _WORDS[model.name] = Memory(lambda w: sum(map(counter.__getitem__, grams_of(w))))
    return _WORDS[model.name]


def predict(docs, filters, key="doc_id", text="text"):
    """doc_id, lang_pred, score for every whole text."""
    slim = keyed_text(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType())]

    def run(batches):
        model = shared.value
        words = _word_counters(model)
        for batch in batches:
            langs, scores = [], []
            for content in batch.column(1).to_pylist():
                if not content or not any(map(str.isalpha, content)):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                lang, score = model.decide(sum(map(words.__getitem__, content.split())))
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, with_key(slim, *fields))
