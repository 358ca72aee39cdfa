"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A table rotates a unit vector K times by three rounds of random signs and a fast Hadamard transform; each rotation's hash is the
axis (with sign) nearest to the result. A vector enters the bucket of its own hashes and, as a probe, the buckets its next
nearest axes name, so that near vectors meet even where a coordinate is about to change places. Bucket mates are compared with the
bucket's leader with slack, and those it does not bring together with each other; within the clusters that this gives, cosines of
all members are computed in double precision.

Exactly equal vectors of a label are one class with a multiplicity, so copies are never paired. A class's links are its own copies
and those of the classes linked with it.

Edge cases: rows whose label, vec_id or vector is null, whose vector is zero, empty, or holds null or non-finite components link with
nothing, are their own component and are kept. Vectors of different lengths don't link. Rows that repeat a vec_id are
vectors of their own that share a component where they are linked. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.clusters import apart, block_pairs, by_group, coarse_clusters, joined_roots, local_roots
from quire.llm.common import small, written

COSINE = 0.93
SLACK = 0.75  # cosine with a bucket's leader
TABLES = 8
ROTATIONS = 3  # hashes of a table
PROBES = 6  # buckets of a table beside the vector's own
BLOCK = 4096  # classes of a block
SEED = 6


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the columns, whose length is a power of two, in place."""
    h = 1
    while h < len(x):
        y = x.reshape(len(x) // (2 * h), 2, h, -1)
        low = y[:, 0] - y[:, 1]
        y[:, 0] += y[:, 1]
        y[:, 1] = low
        h *= 2
    return x


def buckets(unit: np.ndarray, tables: int = TABLES, rotations: int = ROTATIONS, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Codes of each row: tables x (1 + probes); the first of a table is the row's own."""
    n, d = unit.shape
    wide = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((wide, n))
    padded[:d] = unit.T
    rng = np.random.default_rng(seed)
    out = np.empty((n, tables, 1 + probes), np.int64)
    rows, depth = np.arange(n), min(3, wide)
    # for each hash the nearest axes; a probe changes some of the hashes to a farther axis, the cheapest changes first
    moves = np.array(np.meshgrid(*[np.arange(depth)] * rotations, indexing="ij")).reshape(rotations, -1).T
    for t in range(tables):
        axes, loss = [], []
        for _ in range(rotations):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], wide)[:, None]) / np.sqrt(wide)
            left = np.abs(x).T.copy()
            top, size = np.empty((n, depth), np.int64), np.empty((n, depth))
            for k in range(depth):
                top[:, k] = left.argmax(axis=1)
                size[:, k] = left[rows, top[:, k]]
                left[rows, top[:, k]] = -1
            axes.append(top * 2 + (x[top, rows[:, None]] < 0))
            loss.append((size[:, :1] - size) ** 2)
        total = sum(loss[r][:, moves[:, r]] for r in range(rotations))
        best = np.argsort(total, axis=1, kind="stable")[:, : 1 + probes]
        code = np.zeros((n, 1 + probes), np.int64)
        for r in range(rotations):
            code = code * (2 * wide) + np.take_along_axis(axes[r][:, moves[:, r]], best, 1)
        out[:, t] = code
    return out


def _unit(column: pa.ListArray) -> list[tuple[bytes, bytes] | None]:
    """Each vector's own components and its unit vector, as doubles; None for those that link with nothing."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()  # null components are NaN
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    out: list = [None] * len(sizes)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        x = flat[ends[at][:, None] + np.arange(size)].astype(np.float64) + 0.0  # no negative zero
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            unit = x / norm[:, None]
        for j in np.flatnonzero(np.isfinite(x).all(axis=1) & (norm > 0)):
            out[at[j]] = x[j].tobytes(), unit[j].tobytes()
    return out


def _classes(vectors: DataFrame, node_bits: int = 64) -> DataFrame:
    """vec_id, node and check (128 bits of label and vector; null: links with nothing), unit (doubles as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, checks, units = [], [], []
            for v, label, own in zip(_unit(batch.column(1)), batch.column(2).to_pylist(), batch.column(0).to_pylist(), strict=True):
                if v is None or label is None or own is None:
                    nodes.append(None)
                    checks.append(None)
                    units.append(None)
                else:
                    digest = hashlib.blake2b(f"{label}|".encode() + v[0], digest_size=16).digest()
                    nodes.append(int.from_bytes(digest[:8], "little", signed=True) >> 64 - node_bits)
                    checks.append(int.from_bytes(digest[8:], "little", signed=True))
                    units.append(v[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), batch.column(2), pa.array(units, pa.binary())], names=["vec_id", "node", "check", "label", "unit"])

    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    return given.mapInArrow(run, "vec_id long, node long, check long, label string, unit binary")


def _members(classes: DataFrame, **how) -> DataFrame:
    """key, node: the buckets of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, units, labels = batch.column(0).to_numpy(), batch.column(2).to_pylist(), batch.column(1).to_pylist()
            sizes = np.array([len(u) for u in units])
            tags = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in labels], np.uint64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                codes = buckets(np.frombuffer(b"".join(units[k] for k in at), np.float64).reshape(len(at), -1), **how)
                table = np.arange(codes.shape[1], dtype=np.uint64)[None, :, None]
                key = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (table * np.uint64(0xC2B2AE3D27D4EB4F)) ^ tags[at][:, None, None] ^ np.uint64(int(size) * 0x165667B19E3779F9 & (1 << 64) - 1)
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(nodes[at], codes[0].size))], names=["key", "node"])

    return classes.select("node", "label", "unit").mapInArrow(run, "key long, node long")


def _near(pairs: DataFrame, units: DataFrame, slack: float) -> DataFrame:
    """The pairs whose cosine is at least slack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (batch.column(k).to_pylist() for k in (2, 3))
            ok = [len(x) == len(y) and np.frombuffer(x) @ np.frombuffer(y) >= slack for x, y in zip(u, v, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = pairs.join(units.select(F.col("node").alias("b"), F.col("unit").alias("v")), "b")
    return one.join(units.select(F.col("node").alias("a"), F.col("unit").alias("u")), "a").select("a", "b", "u", "v").mapInArrow(run, "a long, b long")


def _mates_near(cosine: float):
    """The test among mates themselves needs no slack but for rounding."""

    def near(raw: list[bytes]):
        sizes = np.array([len(r) for r in raw])
        x = np.frombuffer(b"".join(r.ljust(sizes.max(), b"\0") for r in raw), np.float64).reshape(len(raw), -1)
        return lambda k, others: (sizes[others] == sizes[k]) & (x[others] @ x[k] >= cosine - 1e-9)

    return near


def _linked(cosine: float):
    """Links inside one pair of blocks: node, its smallest linked relative, and how many vectors it links with here."""

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        i, j, blocks = (table.column(c)[0].as_py() for c in ("i", "j", "blocks"))
        nodes, block, copies = (table.column(c).to_numpy() for c in ("node", "block", "copies"))
        by_node = np.argsort(nodes)
        nodes, block, copies = nodes[by_node], block[by_node], copies[by_node]
        raw = [table.column("unit")[int(k)].as_py() for k in by_node]
        sizes = np.array([len(r) for r in raw])
        n_links, ends = np.zeros(len(nodes), np.int64), []
        for size in np.unique(sizes):
            of = np.flatnonzero(sizes == size)
            x = np.frombuffer(b"".join(raw[k] for k in of), np.float64).reshape(len(of), -1)
            for lo in range(0, len(of), 1024):
                near = x[lo : lo + 1024] @ x.T >= cosine
                near[np.arange(near.shape[0]), np.arange(lo, lo + near.shape[0])] = False
                if i != j:
                    near &= block[of][lo : lo + 1024, None] != block[of][None, :]
                n_links[of[lo : lo + 1024]] += near.astype(np.int64) @ copies[of]
                a, b = np.nonzero(near)
                up = of[b] > of[lo + a]
                ends.append((of[lo + a][up], of[b][up]))
        a, b = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
        has = n_links > 0
        if not has.any():
            return None
        root = nodes[local_roots(len(nodes), a, b)]
        return pa.RecordBatch.from_arrays([pa.array(nodes[has]), pa.array(root[has]), pa.array(n_links[has]), pa.array(np.full(has.sum(), blocks, np.int32))], names=["node", "root", "links", "blocks"])

    return solve


def dedup(vectors: DataFrame, cosine: float = COSINE, slack: float = SLACK, block: int = BLOCK, node_bits: int = 64, **how) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    rows = written(_classes(vectors, node_bits), "vectors")
    classes = rows.filter(F.col("node").isNotNull()).groupBy("node", "check").agg(F.min("label").alias("label"), F.min("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    rows, classes = apart(rows.select("vec_id", "node", "check"), written(classes, "vector-classes"))
    values = classes.select("node", F.col("unit").alias("value"))
    members = written(_members(classes, **how), "vector-buckets")  # read twice, hashed once
    coarse = coarse_clusters(members, lambda pairs: _near(pairs, classes, slack), values, _mates_near(cosine))
    nodes = coarse.join(classes, "node").select("root", "node", "unit", "copies", F.lit(1).alias("weight"))
    dealt = block_pairs(nodes, block).select("root", "i", "j", "node", "block", "blocks", "copies", "unit")
    local = written(by_group(dealt, ["root", "i", "j"], _linked(cosine), "node long, root long, links long, blocks int"), "vector-links")
    links = local.groupBy("node").agg(F.sum("links").alias("links"))
    roots = joined_roots(local.select("node", "root", "blocks"))
    named = roots.join(classes.select("node", "first"), "node").select("root", "first").groupBy("root").agg(F.min("first").alias("component"))
    found = classes.select("node", "copies", "first").join(links, "node", "left").join(roots, "node", "left").join(named, "root", "left")
    found = written(found.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component")), "vector-result")
    out = rows.join(small(found), "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
