"""Small helpers that several of the operators share."""

import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark, sf_dir, name):
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs, key="doc_id", text="text"):
    """Only the key and the text, under fixed names, so that no other column can clash."""
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))


def with_key(df, *fields):
    """Schema of results that carry the key of ``df`` and the given (name, type) fields."""
    return T.StructType([df.schema["doc_id"], *(T.StructField(n, t) for n, t in fields)])


class Memory(dict):
    """Answers for distinct words, computed when first asked for.

    Holds at most twice ``limit`` of them: when it is full, those not asked for since the last time
    go. That bounds memory and never changes an answer.
    """

    def __init__(self, answer, limit=400_000, longest=200):
        super().__init__()
        self.answer, self.limit, self.longest, self.older = answer, limit, longest, {}

    def __missing__(self, word):
        found = self.older.get(word, self)
        if found is self:
            found = self.answer(word)
        self.put(word, found)
        return found

    def put(self, word, found):
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = found


def slices(batches, rows=1024):
    """The batches in pieces of at most ``rows`` rows, so that few texts at a time exist as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_slices(batches, column, limit=16 << 20):
    """The batches in pieces whose strings in ``column`` take about ``limit`` bytes, one row at least."""
    for batch in batches:
        start, size = 0, 0
        for at, more in enumerate(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)):
            more = 0 if more != more else int(more)
            if at > start and size + more > limit:
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += more
        if batch.num_rows > start:
            yield batch.slice(start)
