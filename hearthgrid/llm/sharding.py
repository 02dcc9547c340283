"""K-d tree partitioning of documents into shards of near-equal bytes.

A tree over the documents' metadata splits each node along its widest dimension, at the weighted
median of the sizes (weighted by the shards on either side, if their number is odd), until a leaf is one
shard. Medians are found by histograms: each pass adds up the sizes of all open nodes' documents in
at most ``BINS`` bins per node, and the bin with the median is divided again by the next pass. So a
pass is one aggregate with a bounded result, and no documents are sorted or moved.

A coordinate is a number whose leading bits are the dimension's value, then a hash of the text, then a
hash of the row. Equal texts thus stay neighbours in every dimension that they agree in: a
split goes between groups of equal texts and only cuts a group that is larger than a split allows.

Null texts have no bytes (their size is the overhead alone); null dimensions count as the smallest value.
Null keys and repeated rows are placed like any others. An empty table gives an empty result. Dimensions
are read before anything else, so other columns may have any names.
"""

from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.session import materialize

VALUE, GROUP, ROW = 24, 20, 18
BITS = VALUE + GROUP + ROW
BINS = 2048
OVERHEAD = 16
#: A group of equal texts is cut only if it is larger than this many times the tolerance.
GROUP_SLACK = 200


def _value(column, kind):
    """Order-preserving whole number of ``VALUE`` bits: text by its first three bytes, numbers by logarithm."""
    if isinstance(kind, T.StringType):
        first = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 3)), 6, "0")
        return F.coalesce(F.conv(first, 16, 10).cast("long"), F.lit(0))
    number = F.log2(F.greatest(column.cast("double"), F.lit(0.0)) + 1) * (1 << (VALUE - 6))
    return F.least(F.coalesce(F.floor(number).cast("long"), F.lit(0)), F.lit((1 << VALUE) - 1))


@dataclass
class Node:
    """Shards first .. first + shards - 1; split along ``dim`` at ``at``, or a leaf."""

    first: int
    shards: int
    dim: str | None = None
    at: int | None = None
    left: "Node | None" = None
    right: "Node | None" = None

    def expression(self, leaf):
        """SQL that maps a row's coordinates to ``leaf`` of the node it falls into."""
        if self.dim is None:
            return str(leaf(self))
        return f"IF({self.dim} < {self.at}L, {self.left.expression(leaf)}, {self.right.expression(leaf)})"

    def leaves(self):
        return [self] if self.dim is None else [*self.left.leaves(), *self.right.leaves()]


def grow(points, dims, shards, tolerance=1e-4):
    """The tree over ``points`` (size and a coordinate per dimension). The driver sees bounded histograms only."""
    root = Node(0, shards)
    ranges = points.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    whole = {d: max(1, ((ranges[f"hi_{d}"] or 0) >> (GROUP + ROW)) - ((ranges[f"lo_{d}"] or 0) >> (GROUP + ROW)))
             for d in dims}
    allowed = None
    while open_ := {n.first: n for n in root.leaves() if n.shards > 1}:
        node = F.expr(root.expression(lambda n: n.first))
        facts = points.groupBy(node.alias("node")).agg(
            F.sum("size").alias("size"),
            *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        found = {r["node"]: r for r in facts}
        allowed = allowed or sum(r["size"] for r in facts) * tolerance / shards
        search = {}
        for first, n in open_.items():
            n.left = Node(first, n.shards // 2)
            n.right = Node(first + n.shards // 2, n.shards - n.shards // 2)
            r = found.get(first)
            if r is None:  # nothing here: any place will do
                n.dim, n.at = dims[0], 0
                continue
            wide = {d: ((r[f"hi_{d}"] >> (GROUP + ROW)) - (r[f"lo_{d}"] >> (GROUP + ROW))) / whole[d] for d in dims}
            dim = max(dims, key=lambda d: (wide[d], r[f"hi_{d}"] - r[f"lo_{d}"]))
            group = (1 << ROW) - 1
            search[first] = {"dim": dim, "lo": r[f"lo_{dim}"] & ~group, "hi": (r[f"hi_{dim}"] | group) + 1, "below": 0,
                             "goal": r["size"] * n.left.shards / n.shards, "node": n}
        _medians(points, node, search, allowed)
        for s in search.values():
            s["node"].dim, s["node"].at = s["dim"], s["at"]
    return root


def _medians(points, node, search, allowed):
    """Set ``at`` of every search: the coordinate below which the sizes come nearest to the goal."""
    todo = dict(search)
    while todo:
        bins = {}
        for first, s in todo.items():
            whole = 1 << ROW if s["hi"] - s["lo"] > 1 << ROW else 1  # bins hold whole groups until one is left
            s["step"] = max(whole, 1 << max(0, -(-(s["hi"] - s["lo"]) // BINS) - 1).bit_length())
            bins[first] = f"CASE WHEN {s['dim']} >= {s['lo']}L AND {s['dim']} < {s['hi']}L " \
                          f"THEN ({s['dim']} - {s['lo']}L) DIV {s['step']}L END"
        chosen = "CASE node " + " ".join(f"WHEN {f} THEN {b}" for f, b in bins.items()) + " END"
        counted = points.withColumn("node", node).withColumn("bin", F.expr(chosen)).filter("bin IS NOT NULL") \
            .groupBy("node", "bin").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        hists = {}
        for r in counted:
            hists.setdefault(r["node"], []).append((r["bin"], r["size"], r["n"]))
        for first in list(todo):
            s = todo[first]
            for at, size, n in sorted(hists.get(first, [])):
                if s["below"] + size < s["goal"]:
                    s["below"] += size
                    continue
                begin = s["lo"] + at * s["step"]
                slack = allowed * GROUP_SLACK if s["step"] == 1 << ROW else allowed
                if size <= slack or n == 1 or s["step"] == 1:
                    nearer_end = s["below"] + size - s["goal"] < s["goal"] - s["below"]
                    s["at"] = begin + s["step"] if nearer_end else begin
                    del todo[first]
                else:
                    s["lo"], s["hi"] = begin, begin + s["step"]
                break
            else:
                s["at"] = s["hi"]
                del todo[first]


def shard(docs, dims, shards=40, key="doc_id", text="text"):
    """doc_id, size, text_crc32, law ("bytes"), shard, slot (gapless from 0 in each shard), grown_shard (null).

    ``dims`` names the metadata dimensions and gives their columns.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kinds = docs.select(*[c.alias(n) for n, c in dims.items()]).schema
    values = {f"dim{i}": _value(c, kinds[n].dataType) for i, (n, c) in enumerate(dims.items())}
    spark = docs.sparkSession
    slim = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(content) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"), F.xxhash64(content).alias("group"),
        F.monotonically_increasing_id().alias("row"), *[v.alias(n) for n, v in values.items()])
    tail = (F.shiftright(F.col("group"), 64 - GROUP).bitwiseAND((1 << GROUP) - 1) * (1 << ROW)
            + F.pmod(F.xxhash64("doc_id", "row"), F.lit(1 << ROW)))
    points = materialize(slim.withColumns({n: F.col(n) * (1 << (GROUP + ROW)) + tail for n in values}).drop("group"),
                         "points")
    tree = grow(points, list(values), shards)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = points.select("doc_id", "size", "text_crc32", "row",
                           F.expr(tree.expression(lambda n: n.first)).cast("int").alias("shard")) \
        .withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    # At most shards x shuffle partitions rows: small enough to send everywhere.
    before = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")) \
        .withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row"))
    return placed.withColumn("within", within).join(F.broadcast(before), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
