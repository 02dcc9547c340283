"""Joins that hold when a few keys own a large share of the rows."""

from pyspark.sql import functions as F

from hearthgrid.session import materialize

CELL = ["gx", "gy"]

# Pair tests one task may be given by one cell before the cell is split or searched on finer
# grids: a few seconds of work for points, some more for edges.
PAIR_BUDGET = 500_000_000
# A hot key holds more than this share of all rows, so there are fewer than 1 / share of them,
# whatever the size of the data.
HOT_KEY_SHARE = 1e-3
HOT_KEY_ROWS = 100_000


def cell_loads(points, pieces):
    """Points, pieces and pair tests of every cell that has both."""
    left = points.groupBy(CELL).agg(F.count(F.lit(1)).alias("n_points"))
    right = pieces.groupBy(CELL).agg(F.count(F.lit(1)).alias("n_pieces"))
    return left.join(right, CELL).withColumn(
        "tests", F.col("n_points").cast("double") * F.col("n_pieces"))


def hot_cells(points, pieces, budget=PAIR_BUDGET):
    """The crowded cells and the number of parts to split each into, written out; None if there are none."""
    parts = F.ceil(F.col("tests") / F.lit(float(budget))).cast("int")
    return written(cell_loads(points, pieces).filter(F.col("tests") > F.lit(float(budget)))
                   .select(*CELL, parts.alias("parts")))


def written(hot):
    """The crowded cells, written out; None, and nothing written, in the usual case that there are none."""
    return None if hot.isEmpty() else materialize(hot, "hot_cells")


def join_cells(points, pieces, point_xy, budget=PAIR_BUDGET):
    """Inner join on ``(gx, gy)``; crowded cells are split over several tasks.

    The points of a crowded cell are dealt out by a hash of ``point_xy`` and its pieces repeated
    for every part, so each pair still meets exactly once. There may be any number of crowded
    cells: whether their table is broadcast is left to Spark, which sees its size.
    """
    hot = hot_cells(points, pieces, budget)
    if hot is None:
        return points.join(pieces, CELL)
    parts = F.coalesce(F.col("parts"), F.lit(1))
    part = F.pmod(F.xxhash64(*point_xy), parts)
    points = points.join(hot, CELL, "left").withColumn("part", part.cast("int")).drop("parts")
    pieces = pieces.join(hot, CELL, "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return points.join(pieces, CELL + ["part"]).drop("part")


def hot_keys(sizes, keys, min_rows=HOT_KEY_ROWS):
    """Keys of ``sizes`` (``keys`` and ``n``) that own more than the hot share of all rows, and in how many ``parts``
    of at most ``min_rows`` rows to deal each out."""
    total = sizes.agg(F.sum("n")).scalar()
    floor = F.greatest(F.lit(float(min_rows)), F.lit(HOT_KEY_SHARE) * total)
    parts = F.ceil(F.col("n") / F.lit(min_rows)).cast("int")
    return sizes.filter(F.col("n") > floor).select(*keys, parts.alias("parts"))


def attach(left, right, keys, sizes, row_id, min_rows=HOT_KEY_ROWS):
    """Left join of rows with a frame that has one row per key.

    Rows of a hot key are dealt out by a hash of ``row_id``, over as many parts as its rows ask for; the right side
    repeats its one row per part. Rows whose key is null match nothing and need no such row: they are dealt out over all tasks.
    """
    hot = F.broadcast(hot_keys(sizes, keys, min_rows))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    dealt = F.xxhash64(row_id)
    left = left.join(hot, keys, "left").withColumn(
        "salt", F.when(missing, dealt).otherwise(F.pmod(dealt, F.coalesce(F.col("parts"), F.lit(1)).cast("long")))).drop("parts")
    right = right.join(hot, keys, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts"), F.lit(1)).cast("long") - 1))).drop("parts")
    return left.join(right, keys + ["salt"], "left").drop("salt")
