"""Connected components of a link table, as repeated joins and minimum aggregates.

Alternates two steps until nothing changes: every node sends its larger neighbours to its smallest
one, then its smaller neighbours. Tasks first reduce their own links to a spanning forest, so what
is shuffled is linear in the nodes a task sees. Each round is written to the shared folder.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hearthgrid.session import materialize


class Trees:
    """Union-find over the numbers 0 .. n - 1, for arrays of links."""

    def __init__(self, n):
        self.up = np.arange(n)

    def roots(self, x):
        found = self.up[x]
        while (above := self.up[found]).size and (above != found).any():
            found = above
        return found

    def link(self, a, b):
        while len(a):
            a, b = self.roots(a), self.roots(b)
            new = a != b
            a, b = a[new], b[new]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def links(self, names):
        """One link (a, b) from every number to its root, if that is another, under the given names."""
        root = self.roots(np.arange(len(self.up)))
        kept = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(names[kept]), pa.array(names[root[kept]])], names=["a", "b"])


def _forests(batches):
    """Reduce each batch of links to a spanning forest."""
    for batch in batches:
        names, at = np.unique(np.concatenate([batch.column(i).to_numpy() for i in (0, 1)]), return_inverse=True)
        trees, n = Trees(len(names)), batch.num_rows
        trees.link(at[:n], at[n:])
        yield trees.links(names)


def connected(links):
    """(node, component) for all nodes of ``links`` (a, b: long, neither null); component is the smallest node.

    Self-links count as nodes. Repeated links change nothing. An empty table gives an empty result.
    """
    loops = links.filter("a = b").select(F.col("a").alias("node"))
    edges = materialize(links.filter("a <> b").mapInArrow(_forests, "a long, b long")
                        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (now := _digest(edges)) != before:
        edges, before = materialize(_star(_star(edges, True), False), "links"), now
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    alone = loops.distinct().join(out.unionByName(roots).select("node"), "node", "left_anti") \
        .select("node", F.col("node").alias("component"))
    return out.unionByName(roots).unionByName(alone)


def _digest(edges):
    """A row that is equal for equal sets of links, for all practical purposes."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def _star(edges, larger):
    """Connect every node's larger (or smaller) neighbours to the smallest of itself and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if larger:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")) \
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()
