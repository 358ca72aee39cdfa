"""MinHash near-dedup by min-max hashing.

Each permutation gives two values of a shingle set, its minimum and its maximum, so half the hash evaluations fill the signature.
Values are banded; equal sets are one class, and only classes enter bands. A band's mates are tested against the band's
leader by one byte of every value (an unbiased estimate of the similarity) with slack, and those it does not bring together
with each other; in the clusters that this gives, whole texts are cut into full shingle sets again, and links are decided on those by counting common shingles through postings.
A row counts as linked if the sets' intersection is at least 80 % of their union.

Within a cluster only rows that aren't yet connected with the first, most typical one are compared with all others: every link
that could still join two components is examined, and links inside a component change nothing. A cluster above the block size
does the same in Spark: a few of its rows, hubs, are compared with all others in parts, and only rows outside the largest
component that this makes are dealt out against all rows. So a group of near copies of any size costs a few passes over it.

Edge cases: null and empty texts and texts without words have an empty set and link with nothing; texts with fewer words than a
shingle have one shingle, the whole sequence; texts of any length are used whole. Repeated rows belong to one class; a
null doc_id comes after every other, so a component of null ids has a null component_id and keeps them all. An empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.clusters import apart, by_group, coarse_clusters, components, open_pairs
from quire.llm.common import release, small, written

WIDTH = 5  # words of a shingle
PERCENT = 80
BANDS = 36
ROWS = 7  # values of a band
SLACK = 0.55  # estimated similarity of a band's mates
BLOCK = 1_000_000  # bytes of text of a block
HUBS = 3  # rows of a cluster above a block that are compared with all others first
WORDS = 150_000  # words whose hash a worker remembers
SEED = 7
LAST = np.iinfo(np.int64).max


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: A-Z lower-cased, cut at ASCII white space. bytes.lower and bytes.split do just that."""
    return (text or b"").lower().split()


class Hasher:
    """64-bit hashes of words, then of shingles; signatures of shingle sets."""

    def __init__(self, width: int, bands: int = BANDS, rows: int = ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        half = -(-bands * rows // 2)
        self.width, self.bands, self.rows = width, bands, rows
        self.flip = rng.integers(0, 1 << 32, half, dtype=np.uint32)[:, None]
        self.factor = (rng.integers(0, 1 << 32, half, dtype=np.uint32) | np.uint32(1))[:, None]
        self.places = rng.integers(1, 1 << 63, width, dtype=np.uint64) | np.uint64(1)
        self.weights = rng.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)
        self.known: dict[bytes, int] = {}

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Sorted different hashes of the shingles."""
        if not words:
            return np.zeros(0, np.uint64)
        known, new = self.known, set(words).difference(self.known)
        if len(known) + len(new) > WORDS:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
        n = len(h) - self.width + 1
        mixed = np.zeros(n, np.uint64)
        for k in range(self.width):
            mixed = (mixed ^ h[k : k + n]) * self.places[k]
            mixed ^= mixed >> np.uint64(31)
        return np.unique(mixed)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Minimum and maximum under each permutation."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low, high = None, None
        for at in range(0, len(x), 2048):
            y = (x[at : at + 2048][None, :] ^ self.flip) * self.factor
            lo, hi = y.min(axis=1), y.max(axis=1)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        return np.stack([low, high], axis=1).reshape(-1)[: self.bands * self.rows]

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """A 64-bit key of every band of every signature."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        key = (parts * self.weights[None]).sum(axis=2, dtype=np.uint64)
        key ^= key >> np.uint64(32)
        return (key * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(self.bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[None, :]


def _signed(docs: DataFrame, width: int, bands: int, rows: int, node_bits: int = 64) -> DataFrame:
    """doc_id, th (hash of the text), n_bytes, n_shingles, node and check (128 bits of the set; null without words), keys (bands), sketch (a byte of each value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = Hasher(width, bands, rows)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sizes, nodes, checks, marks = [], [], [], []
                for text in batch.column(2).to_pylist():
                    got = own.shingles(tokens(text))
                    sizes.append(len(got))
                    raw = xxhash.xxh3_128_digest(got.tobytes()) if len(got) else None
                    nodes.append(int.from_bytes(raw[:8], "little", signed=True) >> 64 - node_bits if raw else None)
                    checks.append(int.from_bytes(raw[8:], "little", signed=True) if raw else None)
                    marks.append(own.signature(got) if len(got) else np.zeros(bands * rows, np.uint32))
                marks = np.array(marks)
                full = np.array(sizes) > 0
                keys = own.band_keys(marks).view(np.int64)
                sketch = (marks >> np.uint32(8)).astype(np.uint8)
                keys_list = pa.array([k if f else None for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), keys_list, pa.array([s.tobytes() if f else None for s, f in zip(sketch, full, strict=True)], pa.binary())], names=["doc_id", "th", "n_shingles", "node", "check", "keys", "sketch"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, th long, n_shingles long, node long, check long, keys array<long>, sketch binary")


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row."""
    return ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _mates_similar(slack: float):
    """The same test among the mates of a band."""

    def near(raw: list[bytes]):
        x = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        return lambda k, others: _share(x[others], x[k]) >= slack

    return near


def _similar(pairs: DataFrame, reps: DataFrame, slack: float) -> DataFrame:
    """The pairs whose estimated similarity is at least slack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(_share(a, b) >= slack))

    one = pairs.join(reps.select(F.col("node").alias("b"), F.col("sketch").alias("v")), "b")
    return one.join(reps.select(F.col("node").alias("a"), F.col("sketch").alias("u")), "a").select("a", "b", "u", "v").mapInArrow(run, "a long, b long")


def full_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Shingle sets as sorted numbers, the same number for the same shingle: exact, without hashing."""
    word_of: dict[bytes, int] = {}
    number: dict[bytes, int] = {}
    out = []
    for text in texts:
        ids = [word_of.setdefault(w, len(word_of)) for w in tokens(text)]
        if len(ids) < width:
            out.append(np.array([number.setdefault(b"short" + np.array(ids, np.int64).tobytes(), len(number))] if ids else [], np.int64))
            continue
        h = np.array(ids, np.int64)
        n = len(h) - width + 1
        if width == 2:
            out.append(np.unique(h[:-1] << 31 | h[1:]) | 1 << 62)
        else:
            rows = np.unique(np.stack([h[k : k + n] for k in range(width)], axis=1), axis=0)
            out.append(np.sort(np.array([number.setdefault(r.tobytes(), len(number)) for r in rows], np.int64)))
    return out


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest index of each set's component, of links with 100 * intersection >= percent * union."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.zeros(2, int) if size.all() and 100 * both >= percent * (size.sum() - both) else np.arange(2)
    shingle, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(place, kind="stable")
    posting, start = owner[order], np.searchsorted(place[order], np.arange(len(shingle) + 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    common = np.diff(start)
    typical = np.add.reduceat(np.append(common[place], 0), np.minimum(begin[:-1], len(place))) / np.maximum(size, 1)
    root = np.arange(n)
    asked = np.zeros(n, bool)
    hub = int(np.argmax(np.where(size > 0, typical, -1)))
    at = hub
    while at is not None:
        asked[at] = True
        own = place[begin[at] : begin[at + 1]]
        lengths = common[own]
        where = np.repeat(start[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.bincount(posting[where], minlength=n)
        linked = np.flatnonzero((size > 0) & (100 * both >= percent * (size[at] + size - both)))
        if len(linked):
            joined = np.unique(root[linked])
            root[np.isin(root, joined)] = joined[0]
        rest = np.flatnonzero((root != root[hub]) & ~asked & (size > 0))
        at = int(rest[0]) if len(rest) else None
    low = np.full(n, n)
    np.minimum.at(low, root, np.arange(n))
    return low[root]


def _solved(width: int, percent: int):
    def solve(table: pa.Table) -> pa.RecordBatch | None:
        nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)
        if len(nodes) < 2:
            return None
        root = exact_links(full_sets(table.column("text").take(pa.array(at)).to_pylist(), width), percent)
        linked = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[root[linked]]), pa.array(nodes[linked])], names=["a", "b"]) if linked.any() else None

    return solve


def _shingled(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    """Shingles as tuples of words."""
    words = tokens(text)
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else {tuple(words)}


def _with_hubs(width: int, percent: int):
    def solve(table: pa.Table) -> pa.RecordBatch | None:
        """Links between the group's hubs and its other rows."""
        is_hub = table.column("is_hub").to_numpy()
        nodes, root = table.column("node").to_numpy(), table.column("root")[0].as_py()
        hubs = [(int(nodes[k]), _shingled(table.column("text")[int(k)].as_py(), width)) for k in np.flatnonzero(is_hub)]
        ends: list[tuple[int, int]] = []
        for k in np.flatnonzero(~is_hub):
            node, own = int(nodes[k]), _shingled(table.column("text")[int(k)].as_py(), width)
            for hub, other in hubs:
                both = len(own & other)
                if node != hub and 100 * both >= percent * (len(own) + len(other) - both):
                    ends.append((hub, node))
        if not ends:
            return None
        return pa.RecordBatch.from_arrays([pa.array([root] * len(ends), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*ends, strict=True))], names=["root", "a", "b"])

    return solve


def _large_clusters(rows: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Edges (a, b) that make the components of clusters (root, node, text, weight, blocks) above a block."""
    picked = F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(HUBS))))
    picked = written(rows.groupBy("root").agg(picked.alias("hubs")).select("root", F.explode("hubs").alias("node")), "minhash-hubs")
    hubs = rows.join(small(picked), ["root", "node"], "left_semi").withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "is_hub": F.lit(True)})
    asked = rows.withColumns({"part": F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"), "is_hub": F.lit(False)})
    columns = ["root", "part", "is_hub", "node", "text"]
    found = written(by_group(hubs.select(columns).unionByName(asked.select(columns)), ["root", "part"], _with_hubs(width, percent), "root long, a long, b long"), "minhash-hub-links")
    # the largest component that the hubs make of a cluster
    names = components(found).withColumnRenamed("root", "name")
    ends = written(found.select("root", F.col("a").alias("node")).unionByName(found.select("root", F.col("b").alias("node"))).distinct().join(names, "node"), "minhash-hub-ends")
    most = ends.groupBy("root", "name").count().groupBy("root").agg(F.max_by("name", F.struct("count", "name")).alias("name"))
    known = ends.join(most, ["root", "name"], "left_semi").select("node", F.lit(True).alias("known"))
    rest = rows.join(known, "node", "left").withColumn("open", F.col("known").isNull())
    dealt = open_pairs(written(rest.select("root", "node", "text", "weight", "open"), "minhash-open"), block).select("root", "i", "j", "node", "text")
    more = by_group(dealt, ["root", "i", "j"], _solved(width, percent), "a long, b long")
    return found.select("a", "b").unionByName(more)


def _linked(fetched: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """(node, root) of components: fetched (root, node, text, weight) are whole texts in coarse clusters."""
    size = fetched.groupBy("root").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).filter("n > 1")
    size = written(size.select("root", F.ceil(F.col("w") / block).cast("int").alias("blocks")), "minhash-sizes")
    sized = fetched.join(small(size), "root")
    edges = by_group(sized.filter("blocks <= 1").select("root", "node", "text"), ["root"], _solved(width, percent), "a long, b long")
    if not size.filter("blocks > 1").isEmpty():
        edges = edges.unionByName(_large_clusters(written(sized.filter("blocks > 1"), "minhash-large"), width, percent, block))
    return components(edges)


def dedup(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, slack: float = SLACK, block: int = BLOCK, node_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and th (a hash of the text) for every document."""
    signed = written(_signed(docs, width, bands, rows, node_bits), "minhash-signed")
    full = signed.filter(F.col("node").isNotNull())
    reps = full.groupBy("node", "check").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(int(LAST))).alias("doc_id"), "th")).alias("one"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    reps = written(reps.select("node", "check", "one.doc_id", "one.th", "keys", "sketch"), "minhash-classes")
    signed, reps = apart(signed.select("doc_id", "th", "n_shingles", "node", "check"), reps)
    members, values = reps.select("node", F.explode("keys").alias("key")), reps.select("node", F.col("sketch").alias("value"))
    coarse = coarse_clusters(members, lambda pairs: _similar(pairs, reps, slack), values, _mates_similar(slack))
    wanted = written(coarse.join(reps.select("node", "doc_id", "th"), "node"), "minhash-wanted")
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    fetched = text.join(small(wanted), ["doc_id", "th"]).dropDuplicates(["node"]).select("root", "node", "text", F.octet_length("text").alias("weight"))
    roots = _linked(written(fetched, "minhash-texts"), width, percent, block)
    named = roots.join(reps.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component"))
    found = written(reps.select("node", "doc_id").join(roots, "node", "left").join(named, "root", "left").select("node", F.coalesce("component", "doc_id").alias("component")), "minhash-result")
    out = signed.select("doc_id", "th", "n_shingles", "node").join(small(found), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.when(F.col("component") != int(LAST), F.col("component")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "th")


def kept_documents(docs: DataFrame, width: int = WIDTH, **how) -> DataFrame:
    """docs with one document of each component. Rows that repeat the one that stays, id and text, stay with it."""
    gone = written(dedup(docs, width, **how).filter(~F.col("kept")).select(F.col("doc_id").alias("gone"), F.col("th").alias("gone_th")).distinct(), "minhash-gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").alias("own"), F.xxhash64("text").alias("own_th"))
    return rows.join(small(gone), F.col("own").eqNullSafe(F.col("gone")) & (F.col("own_th") == F.col("gone_th")), "left_anti").select("doc.*")
