"""Compare all members of each group, however large, without one task holding a whole group."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hearthgrid.session import materialize


def split_groups(rows, key, spread, limit):
    """``rows`` with part, i and j: the members of a group that share a block (key, i, j) are to be compared.

    A group of at most ``limit`` rows is one block. A larger one is cut into parts by a hash of the column
    ``spread``, and every pair of parts is a block of about twice ``limit`` rows: members of different
    parts meet in one block, members of the same part where i = j. Sizes are counted before the
    shuffle; only rows of large groups are multiplied.
    """
    large = materialize(rows.groupBy(key).agg(F.count("*").alias("_size")).filter(F.col("_size") > limit)
                        .select(key, F.ceil(F.col("_size") / F.lit(limit)).cast("int").alias("_parts")), "large_groups")
    zero = F.lit(0)
    small = rows.join(large, key, "left_anti").withColumns({"part": zero, "i": zero, "j": zero})
    dealt = rows.join(large, key).withColumn("part", F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int")) \
        .withColumn("_other", F.explode(F.expr("sequence(0, _parts - 1)")))
    dealt = dealt.withColumns({"i": F.least("part", "_other"), "j": F.greatest("part", "_other")})
    return small.unionByName(dealt.drop("_parts", "_other"))


def whole_groups(batches, n_keys):
    """Record batches of rows sorted by their first ``n_keys`` columns, regrouped so that no group is cut."""
    rest = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
        keys = [now.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(now.num_rows, dtype=bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last:
            yield now.slice(0, last), change[:last]
        rest = now.slice(last)
    if rest is not None and rest.num_rows:
        keys = [rest.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(rest.num_rows, dtype=bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        yield rest, change


def shifts(change):
    """Pairs of row numbers within groups: for s = 1, 2, ... rows r and r + s of the same group.

    ``change`` is true where a new group begins (the first row aside).
    """
    starts = np.concatenate([[0], np.flatnonzero(change[1:]) + 1]).astype(int)
    ends = np.append(starts[1:], len(change))
    room = np.repeat(ends, ends - starts) - 1 - np.arange(len(change))
    at = np.flatnonzero(room > 0)
    s = 1
    while len(at):
        yield at, at + s
        s += 1
        at = at[room[at] >= s]
