"""Scaling, splitting and target statistics ahead of model training."""

import math

from pyspark.sql import functions as F

from hearthgrid.config import FOLDS, SEED, TARGET, TEST_SIZE
from hearthgrid.functions.sql import num
from hearthgrid.operators.columns import finite_or_zero

_HASH_BITS = 15 * 4


def scale_facts(df, columns):
    """Mean and population standard deviation of the cleaned columns: one pass, one row."""
    facts = []
    for i, c in enumerate(columns):
        v = finite_or_zero(c)
        facts += [F.expr(f"avg({v}) AS m{i}"), F.expr(f"stddev_pop({v}) AS s{i}")]
    row = df.agg(*facts).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, c in enumerate(columns)}


def scaled(column, facts):
    """The cleaned and scaled column as SQL text; a constant column becomes 0."""
    mean, std = facts[column]
    if std == 0.0:
        return "0D"
    return f"({finite_or_zero(column)} - {num(mean)}) / {num(std)}"


def standard_scale(df, columns, facts=None):
    """Columns cleaned of non-finite values, with mean 0 and population deviation 1."""
    facts = facts or scale_facts(df, columns)
    return df.selectExpr(*[f"{scaled(c, facts)} AS `{c}`" if c in facts else f"`{c}`"
                           for c in df.columns])


def hash_whole(key, seed=SEED):
    """A whole number of 60 bits that depends on the seed and the key only, as SQL text."""
    digits = f"substr(md5(concat('{seed}', ':', CAST(`{key}` AS STRING))), 1, 15)"
    return f"CAST(conv({digits}, 16, 10) AS BIGINT)"


def hash_unit(key, seed=SEED):
    """A number in [0, 1) that depends on the seed and the key only, as SQL text.

    The same row gets the same number under any partitioning, and on any engine with md5.
    """
    return f"CAST({hash_whole(key, seed)} AS DOUBLE) / {num(2.0 ** _HASH_BITS)}"


def split_flag(df, key, test_size=TEST_SIZE, seed=SEED):
    """Add ``is_test``, true for about ``test_size`` of the rows."""
    return df.selectExpr("*", f"{hash_unit(key, seed)} < {num(test_size)} AS is_test")


def split(df, key, test_size=TEST_SIZE, seed=SEED):
    """Train and test frames."""
    flagged = split_flag(df, key, test_size, seed)
    return (flagged.filter("NOT is_test").drop("is_test"), flagged.filter("is_test").drop("is_test"))


def test_rows(rows, test_size=TEST_SIZE):
    """How many of so many rows a split of exact size puts to the test side: the share, rounded up."""
    share = test_size * rows
    whole = round(share)
    return whole if abs(share - whole) < 1e-9 * max(1, rows) else math.ceil(share)


def split_exact(df, key, test_size=TEST_SIZE, seed=SEED):
    """Add ``is_test``, true for exactly ``test_size`` of the rows, rounded up: those first by hash, then by key.

    The last of them is found as an order statistic of the hashes, in two passes and without sorting the table. Rows with
    equal hash and key cannot be told apart; if the boundary falls among them, none of them is taken.
    """
    # A null key comes last.
    hashed = df.withColumn("_hash", F.coalesce(F.expr(hash_whole(key, seed)), F.lit(2**_HASH_BITS - 1)))
    wanted, limit, before = _boundary(hashed.select("_hash"), test_size)
    if wanted == 0:
        return df.withColumn("is_test", F.lit(False))
    # Few rows share the hash at the boundary, and the smallest keys among them are taken.
    tied = hashed.filter(F.col("_hash") == limit).groupBy(key).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col(key).asc_nulls_first()).limit(wanted - before).collect()
    taken, last = 0, None
    for r in tied:
        if taken + r["n"] > wanted - before:
            break
        taken, last = taken + r["n"], r
    here = F.lit(False)
    if last is not None:
        value = last[key]
        here = F.col(key).isNull() if value is None else F.coalesce(F.col(key) <= F.lit(value), F.lit(True))
    out = hashed.withColumn("is_test", F.coalesce((F.col("_hash") < limit) | ((F.col("_hash") == limit) & here), F.lit(False)))
    return out.drop("_hash")


def _boundary(hashes, test_size, digits=12):
    """How many test rows there are, the hash of the last one, and how many hashes are smaller.

    The hash's leading and trailing bits are counted in turn, each time in at most 2 ^ ``digits`` classes, so that what comes
    to the driver does not grow with the table.
    """
    rows, below, prefix, bits = None, 0, 0, _HASH_BITS
    inside = hashes
    while bits > 0:
        step = min(digits, bits)
        bits -= step
        counts = inside.groupBy(F.shiftright("_hash", bits).alias("part")).count().orderBy("part").collect()
        if rows is None:
            rows = sum(r["count"] for r in counts)
            wanted = test_rows(rows, test_size)
            if wanted == 0:
                return 0, None, 0
        for r in counts:
            prefix = r["part"]
            if below + r["count"] >= wanted:
                last = r["count"]
                break
            below += r["count"]
        if last <= 1 and bits:
            return wanted, inside.filter(F.shiftright("_hash", bits) == prefix).first()[0], below
        inside = hashes.filter(F.shiftright("_hash", bits) == prefix)
    return wanted, prefix, below


def with_fold(df, key, folds=FOLDS, seed=SEED):
    """Add ``fold``, 0 to ``folds - 1``, by the same kind of hash as the split."""
    unit = hash_unit(key, f"fold-{seed}")
    return df.selectExpr("*", f"CAST(floor({unit} * {folds}) AS INT) AS fold")


def target_stats(df, column=TARGET):
    """Mean, minimum, maximum and population deviation of the target."""
    return df.agg(F.avg(column).alias("mean"), F.min(column).alias("min"),
                  F.max(column).alias("max"), F.stddev_pop(column).alias("std"))
