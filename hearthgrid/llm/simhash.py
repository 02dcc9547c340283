"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into the fewest segments for which the bound on differing bits
leaves one segment with at most one of them (three segments for four bits). For every segment the
index holds its value and, for each of its bits, the value without that bit, tagged with the bit. Two
segments that are equal meet under the value; two that differ in one bit meet under the variant that
lacks it, once with either value of the bit. So equality joins find every pair within the bound, and the
full fingerprints verify it. Equal fingerprints are collapsed first, and a task returns only a
spanning forest of the links it finds.

Null texts count as empty. A text without words has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle of all of them. A null key gets a fingerprint and takes
part in linking, but cannot name a component unless it has no other member. Rows with a
repeated key stay separate rows in the same component only if their texts link. Empty tables give
empty results; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.llm.blocks import shifts, split_groups, whole_groups
from hearthgrid.llm.common import keyed_text, slices, with_key
from hearthgrid.llm.components import Trees, connected
from hearthgrid.session import materialize

BITS = 64


def fingerprint(text, length=4, seed=42):
    """Signed 64-bit SimHash of a text's shingles, repeats included."""
    words = text.encode().lower().split() if text else []  # on bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    h, data = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= length:
        hashes = [h(data, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-length].tolist()]
        hashes = [h(data[a:b], seed) for a, b in zip(starts, (ends[length - 1:] - 1).tolist())]
    counts, n = np.zeros(BITS, dtype=np.int64), len(hashes)
    for at in range(0, n, 65536):
        part = np.array(hashes[at:at + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs, length=4, key="doc_id", text="text"):
    """doc_id and fp (signed long) of every whole text."""
    slim = keyed_text(docs, key, text)

    def run(batches):
        for batch in slices(batches):
            found = [fingerprint(t, length) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return slim.mapInArrow(run, with_key(slim, ("fp", T.LongType())))


def segments(distance):
    """(first bit, bits) of the fewest segments of which one differs in at most one bit."""
    n = distance // 2 + 1
    ends = [BITS * (i + 1) // n for i in range(n)]
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


def _signatures(distance):
    """Index every fingerprint under its segments and their one-wildcard variants.

    The key packs segment, wildcard (0: none, else bit + 1) and the remaining value.
    """
    cut = segments(distance)

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            keys = []
            for s, (first, width) in enumerate(cut):
                value = (fp >> np.uint64(first)) & np.uint64((1 << width) - 1)
                tag = s * (BITS + 1)
                for bit in range(-1, width):
                    rest = value if bit < 0 else value & ~np.uint64(1 << bit)
                    keys.append(rest | np.uint64((tag + bit + 1) << 48) if width <= 48 else
                                _mix(rest, tag + bit + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp.view(np.int64), len(keys)))],
                names=["sig", "fp"])

    return run


def _mix(rest, tag):
    """For segments too wide to pack: spread tag and value over 64 bits (a clash costs a verification)."""
    return (rest ^ np.uint64(tag * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)


def _verify(distance):
    def run(batches):
        for rows, change in whole_groups(batches, 3):
            i, j, part = (rows.column(c).to_numpy() for c in ("i", "j", "part"))
            values, at = np.unique(rows.column("fp").to_numpy(), return_inverse=True)
            fp, trees = values.view(np.uint64)[at], Trees(len(values))
            for a, b in shifts(change):
                ok = np.bitwise_count(fp[a] ^ fp[b]) <= distance
                ok &= (part[a] != part[b]) | (i[a] == j[a])
                trees.link(at[a[ok]], at[b[ok]])
            yield trees.links(values)

    return run


def near_classes(prints, distance=4, limit=4096):
    """(fp, class) for the distinct fingerprints of ``prints``: links at ``distance`` bits or fewer, followed through."""
    distinct = materialize(prints.select("fp").distinct(), "fingerprints")
    indexed = distinct.mapInArrow(_signatures(distance), "sig long, fp long")
    dealt = split_groups(indexed, "sig", "fp", limit).select("sig", "i", "j", "part", "fp")
    links = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j") \
        .mapInArrow(_verify(distance), "a long, b long")
    found = connected(materialize(links, "links"))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", F.coalesce("component", "fp").alias("class"))


def near_duplicates(docs, length=4, distance=4, key="doc_id", text="text"):
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest key linked with the row."""
    prints = materialize(fingerprints(docs, length, key, text), "prints")
    classes = near_classes(prints, distance)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = materialize(classes.join(least, "fp"), "classes")
    names = named.groupBy("class").agg(F.min("least").alias("component_id"))
    by_print = named.join(names, "class").select("fp", "component_id")
    return prints.join(by_print, "fp") \
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs, length=4, distance=4, key="doc_id", text="text"):
    """One row of every group of linked documents, the one with the smallest key, with all its columns.

    Of rows with that key in one group the one with the smallest hash stays; a null key comes last.
    """
    mark = F.xxhash64(F.col(key), F.col(text))
    named = F.struct(F.col(key).isNull().alias("late"), F.col(key).alias("name"), mark.alias("mark"))
    found = near_duplicates(docs.select(named.alias("_named"), F.col(text).alias("_text")), length, distance,
                            "_named", "_text")
    first = found.filter("doc_id = component_id") \
        .select(F.col("doc_id.name").alias("first_name"), F.col("doc_id.mark").alias("first_mark")).distinct()
    # The row travels in one column, so that its own names cannot clash with these.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(whole, F.col(key).alias("row_name"), mark.alias("row_mark"))
    same = (F.col("row_mark") == F.col("first_mark")) & F.col("row_name").eqNullSafe(F.col("first_name"))
    return marked.join(first, same, "left_semi").dropDuplicates(["row_mark", "row_name"]).select("row.*")
