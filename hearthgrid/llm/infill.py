"""Fill-in-the-middle transformation of texts, as a pipeline of Arrow kernels per batch.

A text is cut into lines (its units). Two cuts drawn from a hash of the key divide the units into prefix,
middle and suffix, which are written in one of two orders behind marks, so that a model reads the middle last.
Per batch: the texts are split into a list array of units; the list is flattened beside the index of
the row each unit came from; a unit's ordinal is its place less that of its row's first unit; the units of
each role are filtered out and rebuilt into one list array per role; the joined pieces
are put together with their marks. No text becomes a Python object.

A null text counts as empty, and an empty text stays plain. So does one that holds a mark, which could not
be told from the marks that are added. A null key draws its cuts from the seed alone; rows with the same
key draw the same numbers. An empty table gives an empty result, and only the key and the text are
read, so other columns may have any names.
"""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.llm.common import byte_slices, keyed_text, with_key

# The marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

DRAWS = ("h1", "h2", "h3", "h4")


def drawn(seed, key="doc_id"):
    """The first four groups of eight hex digits of the hash of seed and key, as whole numbers from 0."""
    digits = f"sha2(concat('{seed}:', coalesce(CAST(`{key}` AS STRING), '')), 256)"
    return [F.expr(f"CAST(conv(substr({digits}, {8 * i + 1}, 8), 16, 10) AS BIGINT)").alias(h) for i, h in enumerate(DRAWS)]


def _large(texts):
    """Strings with 64-bit offsets, so that no batch of long texts can overflow them."""
    return pc.fill_null(texts.cast(pa.large_string()), "")


def units(texts):
    """Parents, ordinals and values of all lines, each with its line end, and the number of lines per text."""
    pieces = pc.split_pattern(texts, "\n")
    ends_open = pc.and_(pc.invert(pc.ends_with(texts, "\n")), pc.greater(pc.binary_length(texts), 0))
    counts = pc.add(pc.subtract(pc.list_value_length(pieces), 1), pc.cast(ends_open, pa.int64()))
    parents, values = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    firsts = pieces.offsets.slice(0, len(texts))
    places = pa.array(range(0), pa.int64()) if not len(values) else pc.subtract(pc.cumulative_sum(pa.repeat(1, len(values))), 1)
    ordinals = pc.subtract(places, pc.take(pc.subtract(firsts, pieces.offsets[0]), parents))
    # What follows the last line end is a unit only if it holds something.
    real = pc.less(ordinals, pc.take(counts, parents))
    closed = pc.or_(pc.less(ordinals, pc.subtract(pc.take(counts, parents), 1)), pc.invert(pc.take(ends_open, parents)))
    parents, ordinals, values, closed = (pc.filter(a, real) for a in (parents, ordinals, values, closed))
    ending = pc.if_else(closed, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    whole = pc.binary_join_element_wise(values, ending, pa.scalar("", pa.large_string()))
    return parents, ordinals, whole, counts


def _joined(values, parents, rows):
    """The values of each row put together: one string per row, empty where a row has none."""
    sizes = pc.value_counts(parents)
    have, size = sizes.field("values"), sizes.field("counts")
    row = pc.index_in(pa.array(range(rows), parents.type), value_set=have)
    ends = pc.cumulative_sum(pc.fill_null(pc.take(size, row), 0)) if rows else pa.array([], pa.int64())
    lists = pa.LargeListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int64()), ends]), values)
    return pc.binary_join(lists, pa.scalar("", pa.large_string()))


def _concat(*parts):
    fixed = [pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts]
    return pc.binary_join_element_wise(*fixed, pa.scalar("", pa.large_string()))


def _modulo(a, n):
    return pc.subtract(a, pc.multiply(pc.divide(a, n), n))


def transform_batch(texts, h1, h2, h3, h4, rate, spm_rate):
    """n, form, prefix, middle, suffix and output of every text of a batch."""
    texts = _large(texts)
    parents, ordinals, whole, n = units(texts)
    room = pc.add(n, 1)
    one, two = _modulo(h1, room), _modulo(h2, room)
    start, end = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    before = pc.less(ordinals, pc.take(start, parents))
    behind = pc.greater_equal(ordinals, pc.take(end, parents))
    inside = pc.invert(pc.or_(before, behind))
    prefix, middle, suffix = (_joined(pc.filter(whole, role), pc.filter(parents, role), len(texts))
                              for role in (before, inside, behind))
    marked = pc.equal(pc.binary_length(texts), 0)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = pc.or_(marked, pc.match_substring(texts, mark))
    plain = pc.or_(marked, pc.greater_equal(_modulo(h3, pa.scalar(100, pa.int64())), rate))
    spm = pc.less(_modulo(h4, pa.scalar(100, pa.int64())), spm_rate)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    psm_text = _concat(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    spm_text = _concat(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    output = pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text))
    return n, form, prefix, middle, suffix, output


def restore_batch(outputs, forms):
    """The texts that the outputs were made from."""
    outputs = _large(outputs)
    plain = pc.equal(forms, "plain")
    # A mark occurs once in an output that is not plain; plain ones are not cut at all.
    cuttable = pc.if_else(plain, pa.scalar("", pa.large_string()), outputs)

    def around(strings, mark):
        halves = pc.split_pattern(strings, mark, max_splits=1)
        first = pc.list_element(halves, 0)
        # A second half is there unless the string does not hold the mark: a padded copy always has one.
        padded = pc.split_pattern(_concat(strings, pc.if_else(pc.match_substring(strings, mark), pa.scalar("", pa.large_string()),
                                                              pa.scalar(mark, pa.large_string()))), mark, max_splits=1)
        return first, pc.list_element(padded, 1)

    head, middle = around(cuttable, MIDDLE)
    left, right = around(head, SUFFIX)  # psm: <P>prefix | suffix; spm: nothing | suffix<P>prefix
    psm_prefix = around(left, PREFIX)[1]
    spm_suffix, spm_prefix = around(right, PREFIX)
    rebuilt = pc.if_else(pc.equal(forms, "spm"), _concat(spm_prefix, middle, spm_suffix), _concat(psm_prefix, middle, right))
    return pc.if_else(plain, outputs, rebuilt)


def infill(docs, seed=7, rate=100, spm_rate=50, key="doc_id", text="text"):
    """doc_id, n, form, prefix_chars, middle_chars and output of every row.

    ``rate`` is the percentage of texts to transform, ``spm_rate`` the percentage of those with the suffix first.
    """
    slim = keyed_text(docs, key, text).select("doc_id", "text", *drawn(seed))

    def run(batches):
        for batch in byte_slices(batches, 1):
            n, form, prefix, middle, _, output = transform_batch(*batch.columns[1:], rate, spm_rate)
            plain = pc.equal(form, "plain")
            none = pa.scalar(None, pa.int64())
            chars = [pc.if_else(plain, none, pc.cast(pc.utf8_length(p), pa.int64())) for p in (prefix, middle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n, form, *chars, output.cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    long, string = T.LongType(), T.StringType()
    return slim.mapInArrow(run, with_key(slim, ("n", long), ("form", string), ("prefix_chars", long),
                                         ("middle_chars", long), ("output", string)))


def restore(transformed, output="output", form="form"):
    """``transformed`` with the column ``restored``: the text rebuilt from its output and form alone."""
    at, of = transformed.columns.index(output), transformed.columns.index(form)
    schema = T.StructType([*transformed.schema, T.StructField("restored", T.StringType())])

    def run(batches):
        for batch in byte_slices(batches, at):
            back = restore_batch(batch.column(at), batch.column(of)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, back], names=[*batch.schema.names, "restored"])

    return transformed.mapInArrow(run, schema)
