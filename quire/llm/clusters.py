"""Linking at scale, shared by the near-duplicate operators.

Buckets give star edges to one leader each; a cheap test with slack removes accidental ones; components of the rest are coarse
clusters. Mates of a bucket that this leaves in different clusters are tested with each other, all of them. The exact test then
runs inside every cluster, on whole rows that were shipped there once. A cluster above the block weight is dealt out as pairs of
blocks, so that no task ever holds more than two blocks; where only components are asked for, one side of the pairs needs only
the rows that aren't yet known to be with the cluster's largest component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import release, small, written

MATES = 4096  # members of a block of a bucket


def apart(rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows and classes (written tables with node and check, 128 bits together) such that different classes have different nodes: where several share the first 64 bits, all 128 make new ones."""
    while True:
        clash = written(classes.groupBy("node").count().filter("count > 1").select("node", F.lit(True).alias("clash")), "node-clashes")
        if clash.isEmpty():
            return rows, classes

        def renamed(df: DataFrame) -> DataFrame:
            node = F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))
            return written(df.join(small(clash), "node", "left").withColumn("node", node).select(df.columns), "node-renamed")  # noqa: B023

        rows, classes = renamed(rows), renamed(classes)


def coarse_clusters(members: DataFrame, tested: Callable[[DataFrame], DataFrame], values: DataFrame, near: Callable, block: int = MATES) -> DataFrame:
    """(node, root) of coarse clusters: no pair of bucket mates is left that is neither in one cluster nor tested. members: (key, node: long).

    tested(pairs (a, b)) gives the pairs that pass; values (node, value: binary) and near(values) -> test(k, others) are for mates
    whom their leader did not bring together.
    """
    lead = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("key", "a")
    lead = written(lead, "leaders")  # joined as a table, a bucket with many members can be split
    mates = written(members.join(lead, "key").filter("node > a").select("key", "a", "node"), "mates")
    pairs = written(mates.select("a", F.col("node").alias("b")).distinct(), "pairs")
    coarse = components(tested(pairs))
    more = written(_mate_edges(mates.select("key", "node"), coarse, values, near, block), "mate-edges")
    return coarse if more.isEmpty() else components(coarse.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))


def _mate_edges(mates: DataFrame, coarse: DataFrame, values: DataFrame, near: Callable, block: int) -> DataFrame:
    """Distinct (a, b) that pass among mates (key, node) of different components; a bucket above the block size is dealt out as pairs of blocks."""
    named = written(mates.join(small(coarse), "node", "left").select("key", "node", F.coalesce("root", "node").alias("home")), "mates-named")
    mixed = named.groupBy("key").agg(F.min("home").alias("lo"), F.max("home").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    mixed = written(mixed.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "mates-mixed")
    rest = named.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rest = rest.join(values.select("node", "value"), "node").select("key", "i", "j", "block", "home", "node", "value")

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        halves = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        nodes, part, home = (table.column(c).to_numpy() for c in ("node", "block", "home"))
        test = near(table.column("value").to_pylist())
        root = np.unique(home, return_inverse=True)[1]
        hub = int(np.argmax(np.bincount(root)[root]))
        a, b = [], []
        for k in range(len(nodes)):
            if root[k] == root[hub]:  # who isn't with the largest component asks its members, and they need not ask
                continue
            others = np.flatnonzero((root != root[k]) & (part != part[k]) if halves else root != root[k])
            hit = others[test(k, others)]
            if len(hit):
                a.append(np.full(len(hit), nodes[k]))
                b.append(nodes[hit])
                root[np.isin(root, root[hit])] = root[k]
        if not a:
            return None
        x, y = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return by_group(rest, ["key", "i", "j"], solve, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) to (node, root): the smallest node of each component, for every node with an edge. Contracts every node into its smallest neighbour until no edge is left."""
    edges = written(edges.select("a", "b").filter("a <> b"), "edges")
    names = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent")), "parents")
        names = parent.withColumnRenamed("parent", "root") if names is None else written(_renamed(names, parent), "roots")
        up = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        down = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        lifted = edges.join(up, "a").select("pa", "b").join(down, "b").filter("pa <> pb")
        edges = written(lifted.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return edges.sparkSession.createDataFrame([], "node long, root long") if names is None else names


def _renamed(names: DataFrame, parent: DataFrame) -> DataFrame:
    return names.join(parent.select(F.col("node").alias("root"), "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))


def block_pairs(nodes: DataFrame, block_weight: int) -> DataFrame:
    """nodes (root, node, weight) to the same with i, j, block, blocks: once for a cluster of one block, else once for each pair of blocks that holds the node's own."""
    size = nodes.groupBy("root").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).filter("n > 1")
    size = written(size.select("root", F.ceil(F.col("w") / block_weight).cast("int").alias("blocks")), "cluster-sizes")
    got = nodes.join(small(size), "root").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    return got.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")


def open_pairs(nodes: DataFrame, block_weight: int) -> DataFrame:
    """nodes (root, node, weight, open) to the same with i, j, blocks: pairs of a block of the cluster's open rows and a block of all its rows. Clusters without open rows give none."""
    sums = nodes.groupBy("root").agg(F.sum("weight").alias("w"), F.sum(F.when(F.col("open"), F.col("weight"))).alias("o")).filter("o is not null")
    sums = written(sums.select("root", F.ceil(F.col("w") / block_weight).cast("int").alias("blocks"), F.ceil(F.col("o") / block_weight).cast("int").alias("asking")), "open-sizes")
    got = nodes.join(small(sums), "root")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    asked = got.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("asking") - 1)), "j": own})
    asking = got.filter("open").withColumns({"i": F.pmod(F.xxhash64("node", F.lit(4)), F.col("asking")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    return asked.unionByName(asking).drop("asking")


def by_group(rows: DataFrame, keys: list[str], solve: Callable[[list[pa.Table]], Iterator[pa.RecordBatch]] | Callable, schema: str) -> DataFrame:
    """solve(table of one group) -> RecordBatch or None, over rows dealt and sorted by keys; many groups share a task, so small ones cost little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        last = None

        def closed():
            return solve(pa.Table.from_batches(held)) if held else None

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(keys))]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(c[lo] for c in columns)
                if key != last:
                    if (out := closed()) is not None:
                        yield out
                    held, last = [], key
                held.append(batch.slice(lo, hi - lo))
        if (out := closed()) is not None:
            yield out

    rest = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component, of edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def joined_roots(local: DataFrame) -> DataFrame:
    """(node, root, blocks) as the groups found them to (node, root) of whole clusters: components where a cluster had several blocks."""
    local = written(local, "local-roots")
    single = local.filter("blocks = 1").select("node", "root")
    split = local.filter("blocks > 1").select(F.col("root").alias("a"), F.col("node").alias("b"))
    return single if split.isEmpty() else single.unionByName(components(split))
