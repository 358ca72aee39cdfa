"""Exact dedup: a log-structured merge index over SHA-256 digests.

Map tasks gather (digest, id) in a memtable, one entry a digest, and flush it as sorted runs with a Bloom filter each, one run a
digest range. Runs are compacted level by level: a level's tasks merge a bounded number of entries of one range, two runs at a
time, smallest first, and flush them as runs of FANOUT narrower ranges, until a range is narrow enough for one task to merge
all its runs. So runs keep thousands of entries at every size. In a merge, entries that the other run's filter surely lacks pass
through, the others are searched for, and of equal digests the preferred identifier stays and the counts add up. A digest
with a third of all rows is thus one entry of each run. Hits (rows of a digest with more than one) are verified byte by byte
against the row that stays; the rare rows that only share a digest are grouped by their text itself.

keep='max' orders identifiers downwards, so compaction's smallest is the largest doc_id. Edge cases: a null text counts as empty; a
null doc_id comes last and stays only where all of its group are null; of repeated rows (same doc_id and text) one is kept; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import release, small, written

MEMTABLE = 200_000  # entries
RANGE_ROWS = 200_000  # rows of the table for each digest range of the last level
FANOUT = 64  # ranges of the first level, and narrower ranges of each at the next
SALTS = 1024  # parts of a group of repeated rows that are counted apart
FILTER_BITS = 10  # of a run's filter, for each entry
HASHES = 4
WIDTH = 32  # bytes of a digest


class Filter:
    """A Bloom filter over digests, whose own bytes serve as hashes."""

    def __init__(self, digests: np.ndarray, bits: np.ndarray | None = None):
        self.bits = np.zeros(max(8, -(-len(digests) * FILTER_BITS // 8)), np.uint8) if bits is None else bits
        if bits is None and len(digests):
            at = self._places(digests).ravel()
            np.bitwise_or.at(self.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def _places(self, digests: np.ndarray) -> np.ndarray:
        parts = np.ascontiguousarray(digests).view(np.uint64).reshape(len(digests), WIDTH // 8)[:, :HASHES]
        return (parts % np.uint64(len(self.bits) * 8)).astype(np.int64)

    def may_have(self, digests: np.ndarray) -> np.ndarray:
        if not len(digests):
            return np.zeros(0, bool)
        at = self._places(digests)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


class Run:
    """Entries sorted by digest: digests (fixed width), ids (smallest preferred), counts, and the filter."""

    def __init__(self, digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, bits: np.ndarray | None = None):
        self.digests, self.ids, self.counts, self.filter = digests, ids, counts, Filter(digests, bits)


def merge(a: Run, b: Run) -> Run:
    """One run of both; of an entry in both, the smaller identifier."""
    if len(a.digests) < len(b.digests):
        a, b = b, a
    asked = np.flatnonzero(a.filter.may_have(b.digests))
    at = np.searchsorted(a.digests, b.digests[asked])
    inside = at < len(a.digests)
    hit = np.zeros(len(asked), bool)
    hit[inside] = a.digests[at[inside]] == b.digests[asked[inside]]
    ids, counts = a.ids.copy(), a.counts.copy()
    ids[at[hit]] = np.minimum(ids[at[hit]], b.ids[asked[hit]])
    counts[at[hit]] += b.counts[asked[hit]]
    new = np.ones(len(b.digests), bool)
    new[asked[hit]] = False
    place = np.searchsorted(a.digests, b.digests[new])
    return Run(*(np.insert(x, place, y[new]) for x, y in ((a.digests, b.digests), (ids, b.ids), (counts, b.counts))))


def compact(runs: list[Run]) -> Run:
    import heapq

    heap = [(len(r.digests), k, r) for k, r in enumerate(runs)]
    heapq.heapify(heap)
    k = len(heap)
    while len(heap) > 1:
        one = merge(heapq.heappop(heap)[2], heapq.heappop(heap)[2])
        heapq.heappush(heap, (len(one.digests), k := k + 1, one))
    return heap[0][2]


#: An identifier that sorts behind every other: a null doc_id's.
LAST = np.iinfo(np.int64).max


RUNS = "range int, n int, digests binary, ids binary, counts binary, filter binary"
RUN_KIND = pa.schema([("range", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("digests", "ids", "counts", "filter"))])


def _flushed(digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Sorted entries as runs, one for each of `parts` digest ranges."""
    raw = digests.view(np.uint8).reshape(-1, WIDTH)
    lead = raw[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
    of = lead * parts >> 32  # rises with the digest
    cuts = np.flatnonzero(np.diff(of, prepend=-1, append=parts))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        bits = Filter(digests[lo:hi]).bits
        yield pa.RecordBatch.from_arrays([pa.array([of[lo]], pa.int32()), pa.array([hi - lo], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (digests[lo:hi], ids[lo:hi], counts[lo:hi], bits))], schema=RUN_KIND)


def flush(parts: int, memtable: int):
    """(digest, id) to runs."""

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        best = table.group_by("digest").aggregate([("id", "min"), ("n", "sum")]).sort_by("digest")
        digests = np.frombuffer(b"".join(best.column("digest").to_pylist()), f"V{WIDTH}").view(f"S{WIDTH}")
        yield from _flushed(digests, best.column("id_min").to_numpy(), best.column("n_sum").to_numpy(), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, n = [], 0
        for batch in batches:
            ids = batch.column(1).fill_null(LAST)
            held.append(pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), ids, pa.array(np.ones(batch.num_rows, np.int64))], names=["digest", "id", "n"]))
            n += batch.num_rows
            if n >= memtable:
                merged = pa.Table.from_batches(held).group_by("digest").aggregate([("id", "min"), ("n", "sum")]).rename_columns(["digest", "id", "n"])
                if merged.num_rows >= memtable // 2:
                    yield from out(merged)
                    held, n = [], 0
                else:  # mostly copies: the memtable has room left
                    held, n = merged.combine_chunks().to_batches(), merged.num_rows
        if held:
            yield from out(pa.Table.from_batches(held))

    return run


def _merged(runs: pd.DataFrame) -> Run:
    return compact([Run(np.frombuffer(d, f"S{WIDTH}"), np.frombuffer(i, np.int64), np.frombuffer(c, np.int64), np.frombuffer(f, np.uint8)) for d, i, c, f in zip(runs["digests"], runs["ids"], runs["counts"], runs["filter"], strict=True)])


def _narrowed(parts: int):
    def run(runs: pd.DataFrame) -> pd.DataFrame:
        one = _merged(runs)
        return pa.Table.from_batches(list(_flushed(one.digests, one.ids, one.counts, parts)), RUN_KIND).to_pandas()

    return run


def _compacted(runs: pd.DataFrame) -> pd.DataFrame:
    one = _merged(runs)
    raw = one.digests.tobytes()
    return pd.DataFrame({"digest": [raw[k : k + WIDTH] for k in range(0, len(raw), WIDTH)], "id": one.ids, "group_size": one.counts})


def build_index(rows: DataFrame, memtable: int = MEMTABLE, range_rows: int = RANGE_ROWS, fanout: int = FANOUT) -> DataFrame:
    """rows (digest binary, id long; the smallest id is preferred) to digest, id, group_size."""
    n = rows.count()
    last = max(1, -(-n // range_rows), min(fanout, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = min(last, fanout)
    runs = rows.select("digest", "id").mapInArrow(flush(parts, memtable), RUNS)
    while parts < last:
        # a range's runs are dealt out so that a task merges about 4 memtables of entries
        tasks = max(1, -(-n // (parts * 4 * memtable)))
        finer = min(last, parts * fanout)
        dealt = runs.withColumn("deal", F.pmod(F.xxhash64("digests"), F.lit(tasks)).cast("int"))
        runs, parts = dealt.groupBy("range", "deal").applyInPandas(_narrowed(finer), RUNS), finer
    return runs.groupBy("range").applyInPandas(_compacted, "digest binary, id long, group_size long")


def digest_of(text: Column, digest_bytes: int = WIDTH) -> Column:
    """SHA-256, or for tests its first bytes and zeros, so that digests collide."""
    whole = F.unhex(F.sha2(text, 256))
    return whole if digest_bytes == WIDTH else F.rpad(F.substring(whole, 1, digest_bytes), WIDTH, F.lit(b"\0"))


def _assigned(docs: DataFrame, keep: str, digest_bytes: int) -> tuple[DataFrame, DataFrame, bool, bool]:
    """(hits: digest, id, group_size of digests with several rows; odd rows: digest, own, text, differs; whether some differ in spite of their digest; whether some repeat the row that stays)."""
    sign = -1 if keep == "max" else 1
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(digest_of(text, digest_bytes).alias("digest"), (F.col("doc_id").cast("long") * sign).alias("id"))
    hits = written(build_index(rows).filter("group_size > 1"), "dedup-hits")
    some = docs.select(digest_of(text, digest_bytes).alias("digest"), F.coalesce(F.col("doc_id").cast("long") * sign, F.lit(int(LAST))).alias("own"), text.alias("text")).join(small(hits), "digest")
    stays = some.filter(F.col("own") == F.col("id")).groupBy("digest").agg(F.min("text").alias("stays"), F.count("*").alias("n"))
    stays = written(stays, "dedup-stays")  # joined as a table, a digest with many rows can be split
    differs = F.col("text") != F.col("stays")
    odd = some.join(stays, "digest").filter(differs | ((F.col("n") > 1) & (F.col("own") == F.col("id")))).select("digest", "own", F.when(differs, F.col("text")).alias("text"), differs.alias("differs"))
    odd = written(odd, "dedup-odd")
    found = {r[0] for r in odd.select("differs").distinct().collect()}
    return hits, odd.filter("differs"), True in found, bool(found)


def assign(docs: DataFrame, keep: str = "min", digest_bytes: int = WIDTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document."""
    sign = -1 if keep == "max" else 1
    hits, odd, differ, repeat = _assigned(docs, keep, digest_bytes)
    text = F.coalesce("text", F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("long") * sign, F.lit(int(LAST)))
    base = docs.select("doc_id", own.alias("own"), F.sha2(text, 256).alias("text_sha256"), *([] if digest_bytes == WIDTH else [digest_of(text, digest_bytes).alias("digest")]))
    if digest_bytes == WIDTH:
        base = base.withColumn("digest", F.unhex("text_sha256"))
    got = base.join(small(hits), "digest", "left").select("digest", "doc_id", "own", "text_sha256", F.coalesce("id", "own").alias("id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    if differ:  # digests that several texts share: count their rows by text
        apart = odd.groupBy("digest", F.sha2("text", 256).alias("text_sha256")).agg(F.min("own").alias("id2"), F.count("*").alias("n2"))
        less = apart.groupBy("digest").agg(F.sum("n2").alias("less"))
        got = got.join(apart, ["digest", "text_sha256"], "left").join(less, "digest", "left")
        got = got.select("digest", "doc_id", "own", "text_sha256", F.coalesce("id2", "id").alias("id"), F.coalesce("n2", F.col("group_size") - F.coalesce("less", F.lit(0))).alias("group_size"))
    if repeat:  # of rows that repeat the one that stays, one is kept; they are alike in all that is asked for, so it is enough to count them
        own = ["doc_id", "id", "group_size", "text_sha256"]
        rest = got.filter((F.col("group_size") > 1) & (F.col("own") == F.col("id"))).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        counted = rest.groupBy(*own, "salt").count().withColumn("nth", F.row_number().over(Window.partitionBy("text_sha256").orderBy("salt")))  # SALTS rows a text at most
        first = (F.col("nth") == 1) & (F.col("copy") == 1)
        rest = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).select(*own, first.alias("kept"))
        out = got.filter((F.col("group_size") == 1) | (F.col("own") != F.col("id"))).select(*own, (F.col("group_size") == 1).alias("kept")).unionByName(rest)
    else:
        out = got.withColumn("kept", F.col("own") == F.col("id"))
    keep_id = F.when(F.col("id") != int(LAST), F.col("id") * sign)
    return out.select("doc_id", keep_id.alias("keep_id"), "group_size", "kept", "text_sha256")


def kept_documents(docs: DataFrame, keep: str = "min", digest_bytes: int = WIDTH) -> DataFrame:
    """docs without the copies: of equal texts one row stays."""
    sign = -1 if keep == "max" else 1
    hits, _, differ, repeat = _assigned(docs, keep, digest_bytes)
    own_columns = docs.columns
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own_columns)).alias("doc"), digest_of(text, digest_bytes).alias("digest"), F.coalesce(F.col("doc_id").cast("long") * sign, F.lit(int(LAST))).alias("own"))
    got = rows.join(small(hits), "digest", "left")
    # partial aggregation leaves a row for each task and text, so a group of any size meets nowhere; ties go by the other columns
    tie = F.xxhash64(*(F.col("doc")[f.name].cast("string") for f in docs.schema.fields if f.dataType.typeName() != "map"))
    if differ:  # digests that several texts share: their rows are told apart by text
        single = got.filter(F.col("group_size").isNull())
        first = got.filter(F.col("group_size").isNotNull()).groupBy("digest", F.coalesce("doc.text", F.lit(""))).agg(F.min_by("doc", F.struct("own", tie)).alias("doc"))
        return single.select("doc.*").unionByName(first.select("doc.*"))
    if repeat:
        first = got.filter(F.col("own") == F.col("id")).groupBy("digest").agg(F.min_by("doc", tie).alias("doc"))
        return got.filter(F.col("group_size").isNull()).select("doc.*").unionByName(first.select("doc.*"))
    return got.filter(F.col("group_size").isNull() | (F.col("own") == F.col("id"))).select("doc.*")
