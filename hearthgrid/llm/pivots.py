"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order. Every pivot has an inverted list of
the vectors that name it among their first ``named`` ones. Within a list, pairs that share at least
``shared`` pivots are verified by their cosine in double precision. A pair with the same nearest pivot is dealt
with in that pivot's list, any other in the list of the smallest pivot it shares, so it is counted once. Long
lists are cut into parts that are compared pairwise in separate tasks, so nothing is left out and no task
holds a whole list. Vectors of a crowd name the same pivots; they meet each other in one list only.

Equal vectors are collapsed first. Pivots are fitted on a bounded sample: the distinct vectors with the
smallest hashes, without those within the cosine ``APART`` of a chosen one. So a crowd has few pivots whatever its
share of the rows, and its vectors do not pick theirs out of many that are almost tied. Their number grows with the square root of the vectors up to ``most_pivots``, which keeps
lists short; beyond it lists get longer, not lossy. A task returns counts and a spanning forest, never pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: no links, a
component of their own, kept. Vectors of different lengths never link. A null id takes part but names a
component only if no other member has an id. Empty tables give empty results, other columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.llm.blocks import whole_groups
from hearthgrid.llm.components import Trees, connected
from hearthgrid.session import materialize

LIMIT = 512
APART = 0.8


def _unit(vectors):
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def spaced(sample, wanted, apart=APART):
    """At most ``wanted`` of the unit vectors, in their order, leaving out those within ``apart`` of a chosen one."""
    chosen = np.empty((wanted, sample.shape[1]))
    n = 0
    for at in range(0, len(sample), 256):
        some = sample[at:at + 256]
        some = some[(some @ chosen[:n].T).max(axis=1, initial=-1.0) < apart]
        near, free = some @ some.T >= apart, np.ones(len(some), dtype=bool)
        for i in range(len(some)):
            if free[i]:
                free[i + 1:] &= ~near[i, i + 1:]
        some = some[free][:wanted - n]
        chosen[n:n + len(some)] = some
        n += len(some)
        if n == wanted:
            break
    return chosen[:n]


def fit_pivots(vectors, most_pivots=16384):
    """{length: array of unit vectors}; the sample is the distinct vectors with the smallest hashes, two for a pivot."""
    pivots = {}
    for row in vectors.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect():
        wanted = min(most_pivots, max(32, 1 << math.ceil(math.log2(2 * math.sqrt(row["n"])))))
        chosen = vectors.filter(F.col("size") == row["size"]).select("vector") \
            .orderBy(F.xxhash64("vector"), "vector").limit(2 * wanted).collect()
        pivots[row["size"]] = spaced(_unit(np.array([r["vector"] for r in chosen], dtype=np.float64)), wanted)
    return pivots


def _matrix(column, size):
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(),
                      dtype=np.float64).reshape(-1, size)


def _describe(pivots, named):
    """One row per vector and pivot it names: (pivot, nearest, size, node, copies, vector, names)."""

    def run(batches):
        known = pivots.value
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                x = _unit(_matrix(rows.column("vector"), size))
                k = min(named, len(known[size]))
                near = x @ known[size].T
                names = np.argpartition(-near, k - 1, axis=1)[:, :k]
                names = np.take_along_axis(names, np.argsort(-np.take_along_axis(near, names, 1), axis=1, kind="stable"), 1)
                at = pa.array(np.repeat(np.arange(len(x)), k))
                lists = pa.ListArray.from_arrays(np.arange(0, len(x) * k + 1, k, dtype=np.int32),
                                                 pa.array(names.ravel().astype(np.int32)))
                pivot = names.ravel().astype(np.int64) * 65536 + int(size)
                nearest = np.repeat(names[:, 0].astype(np.int64) * 65536 + int(size), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pivot), pa.array(nearest), pa.array(np.full(len(x) * k, size, np.int32)), rows.column("node").take(at),
                     rows.column("copies").take(at), rows.column("vector").take(at), lists.take(at)],
                    names=["pivot", "nearest", "size", "node", "copies", "vector", "names"])

    return run


def _deal(described, limit):
    """``described`` with part, i and j: the rows of a block (pivot, i, j) are to be compared.

    Vectors of a list with the same nearest pivot, if more than ``limit``, have parts of their own, and the others of
    the list are cut into parts by a hash. Every pair of parts is a block, except two of vectors that
    share a nearest pivot other than the list's: these meet in that one's list.
    """
    sizes = materialize(described.groupBy("pivot", "nearest").agg(F.count("*").alias("_n")), "list_sizes")
    crowd = F.when(F.col("_n") > limit, F.col("nearest"))
    parts = sizes.groupBy("pivot", crowd.alias("_crowd")).agg(F.ceil(F.sum("_n") / F.lit(limit)).cast("int").alias("_parts")) \
        .groupBy("pivot").agg(F.array_sort(F.collect_list(F.struct("_crowd", "_parts"))).alias("_groups"))
    parts = materialize(parts.withColumn("_all", F.expr("aggregate(_groups, 0, (n, g) -> n + g._parts)")).filter("_all > 1"), "lists")
    laid = parts.select("pivot", "_all", F.posexplode("_groups").alias("_at", "_group"), "_groups").selectExpr(
        "pivot", "_all", "_group._crowd AS _crowd", "_group._parts AS _parts",
        "aggregate(slice(_groups, 1, _at), 0, (n, g) -> n + g._parts) AS _first")
    big = sizes.filter(F.col("_n") > limit).select("pivot", "nearest", F.col("nearest").alias("_crowd"))
    zero = F.lit(0)
    small = described.join(parts.select("pivot"), "pivot", "left_anti").withColumns({"part": zero, "i": zero, "j": zero})
    dealt = described.join(big, ["pivot", "nearest"], "left").alias("d").join(
        laid.alias("l"), F.expr("d.pivot = l.pivot AND d._crowd <=> l._crowd")) \
        .select("d.*", "_all", "_parts", "_first") \
        .withColumn("part", F.expr("_first + CAST(pmod(xxhash64(node), _parts) AS INT)")) \
        .withColumn("_other", F.explode(F.expr("sequence(0, _all - 1)"))) \
        .filter("_crowd IS NULL OR _crowd = pivot OR _other < _first OR _other >= _first + _parts")
    dealt = dealt.withColumns({"i": F.least("part", "_other"), "j": F.greatest("part", "_other")})
    return small.unionByName(dealt.drop("_all", "_parts", "_first", "_crowd", "_other"))


def _verify(least, shared):
    """Links among the vectors of each block of an inverted list: (a, b) forest edges and (a, a, n) counts."""

    def block(rows, pivot, i, j):
        size = rows.column("size")[0].as_py()
        x = _unit(_matrix(rows.column("vector"), size))
        names = _matrix(rows.column("names"), len(rows.column("names")[0])).astype(np.int64)
        part = rows.column("part").to_numpy()
        used, local = np.unique(names, return_inverse=True)
        has = np.zeros((len(x), len(used)), dtype=np.float32)
        np.put_along_axis(has, local.reshape(names.shape), 1.0, axis=1)
        one, two = np.flatnonzero(part == i), np.flatnonzero(part == j)
        lower = has[:, :np.searchsorted(used, pivot // 65536)]
        nearest = names[:, 0]
        here = np.where(nearest[one][:, None] == nearest[two][None, :], (nearest[one] == pivot // 65536)[:, None],
                        lower[one] @ lower[two].T == 0)
        ok = (has[one] @ has[two].T >= shared) & here
        ok &= x[one] @ x[two].T >= least
        if i == j:
            ok &= ~np.eye(len(one), dtype=bool)
        return one, two, ok

    def run(batches):
        for rows, change in whole_groups(batches, 3):
            cuts = [0, *np.flatnonzero(change).tolist(), rows.num_rows]
            node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
            pivot, i, j = (rows.column(c).to_numpy() for c in ("pivot", "i", "j"))
            values, at = np.unique(node, return_inverse=True)
            trees, counts = Trees(len(values)), np.zeros(len(values), dtype=np.int64)
            for a, b in zip(cuts, cuts[1:]):
                if b - a < 2:
                    continue
                one, two, ok = block(rows.slice(a, b - a), pivot[a], i[a], j[a])
                if not ok.any():
                    continue
                first, second = np.nonzero(ok)
                trees.link(at[a + one[first]], at[a + two[second]])
                np.add.at(counts, at[a + one], ok @ copies[a + two])
                if i[a] != j[a]:
                    np.add.at(counts, at[a + two], ok.T @ copies[a + one])
            edges = trees.links(values)
            linked = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([edges.column(0), pa.array(values[linked])]),
                 pa.concat_arrays([edges.column(1), pa.array(values[linked])]),
                 pa.array(np.concatenate([np.zeros(edges.num_rows, np.int64), counts[linked]]))], names=["a", "b", "n"])

    return run


def near_duplicates(embeddings, least=0.9, named=8, shared=1, key="vec_id", vector="embedding", limit=LIMIT):
    """vec_id, n_links, component_id, kept for every row."""
    slim = embeddings.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0.0)
    good = slim.filter(F.coalesce(usable, F.lit(False)))
    bad = slim.filter(~F.coalesce(usable, F.lit(False)))
    classes = materialize(good.groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
                          .withColumns({"size": F.size("vector"), "node": F.monotonically_increasing_id()}), "classes")
    fitted = embeddings.sparkSession.sparkContext.broadcast(fit_pivots(classes))
    described = materialize(classes.select("size", "node", "copies", "vector").mapInArrow(
        _describe(fitted, named),
        "pivot long, nearest long, size int, node long, copies long, vector array<double>, names array<int>"), "described")
    dealt = _deal(described, limit) \
        .select("pivot", "i", "j", "part", "size", "node", "copies", "vector", "names")
    links = materialize(dealt.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
                        .mapInArrow(_verify(least, shared), "a long, b long, n long"), "links")
    counts = links.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    component = connected(links.filter("n = 0").select("a", "b"))
    known = classes.select("node", "vector", "copies", "least").join(component, "node", "left") \
        .withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left")
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    by_vector = known.join(names, "component").select(
        "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = good.join(by_vector, "vector").select("vec_id", "n_links", "component_id")
    return linked.unionByName(bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
