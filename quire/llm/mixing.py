"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source gets a share of the mix by weight, but at most max_epochs times its own size; what a source can't take is shared
anew by weight among the others until none is above its cap: rounds of one small aggregation each, over a row for each source.
A document is taken floor(epochs) times, and once more if its seeded hash is at or below its source's threshold. The threshold
comes from sums over hash buckets, over parts of the one bucket that the target falls into, and over the rows of one part, so no
source is ever sorted as a whole and the taken words meet the target to within one document.

Edge cases: a null text has size 0; a null source is a source of its own, the last; an empty table gives no rows; rows alike in
doc_id and text have one hash and are taken together; a source of size 0 has target 0 and its documents are taken 0 times.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import small, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
HASH_BITS, BUCKET_BITS = 60, (12, 24)


def seeded_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits that depend on the seed, the id and the text."""
    of = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(of), 1, 15), 16, 10).cast("long")


def _measured(docs: DataFrame, seed: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.col("source").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), seeded_hash(F.col("doc_id"), F.col("text"), seed).alias("h"))


def _ranked(per: DataFrame) -> DataFrame:
    """per with `nth`, the place of its source by code point from 0, null last: ranges are sorted and counted apart."""
    order = F.col("source").asc_nulls_last()
    placed = per.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, "mix-placed")
    sizes = sorted(placed.groupBy(F.shiftright("at", 33).alias("part")).count().collect())  # a row for each range
    before = np.cumsum([0, *(r[1] for r in sizes)]).tolist()
    starts = per.sparkSession.createDataFrame([(r[0], n) for r, n in zip(sizes, before, strict=False)], "part long, start long")
    got = placed.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("part"))
    return got.withColumn("nth", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "start")


def _water(per: DataFrame) -> float | None:
    """The level of the sources below their caps: those above it are clamped and the rest shared anew, until none is above. None: all are clamped."""
    rate = F.col("cap") / F.col("weight")
    level, n_before = None, 0
    while True:
        above = F.lit(False) if level is None else rate < F.lit(level)
        total, n, clamped, weight = per.agg(F.max("total"), F.count_if(above), F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if not weight:
            return None
        if level is not None and n == n_before:
            return level
        level, n_before = (total - clamped) / weight, n


def plan(measured: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """A row for each source: source, source_size, target, whole (repetitions of every document), h_star (highest hash that is taken once more; -1: none)."""

    def top(bits: int) -> Column:
        return F.shiftright("h", HASH_BITS - bits)

    sums = written(measured.groupBy("source", top(BUCKET_BITS[0]).alias("bucket")).agg(F.sum("size").alias("words")), "mix-buckets")
    per = _ranked(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    per = per.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(max_epochs)), "total": F.lit(float(total)) * F.lit(float(share))})
    level = _water(per)
    per = per.withColumn("target", F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("weight")))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.withColumn("whole", F.floor(epochs)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).select("source", "source_size", "target", "whole", "rest")
    per = written(per, "mix-sources")
    # the bucket in which a source's running sum meets its rest, then the part of that bucket, then the rows of that part
    open_ = per.select("source", "rest", F.lit(0).cast("long").alias("before"))
    for k, bits in enumerate(BUCKET_BITS):
        if k:
            inside = measured.alias("m").join(small(open_).alias("e"), F.col("m.source").eqNullSafe(F.col("e.source")) & (top(BUCKET_BITS[k - 1]) == F.col("e.bucket")))
            sums = inside.groupBy(F.col("m.source").alias("source"), top(bits).alias("bucket")).agg(F.sum("size").alias("words"))
            open_ = open_.drop("bucket")
        running = Window.partitionBy("s.source").orderBy("s.bucket").rowsBetween(Window.unboundedPreceding, -1)
        met = sums.alias("s").join(small(open_).alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")))
        met = met.select(F.col("s.source").alias("source"), "rest", F.col("s.bucket").alias("bucket"), "words", (F.col("before") + F.coalesce(F.sum("words").over(running), F.lit(0))).alias("before"))
        open_ = written(met.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))).drop("words"), "mix-edge")  # one a source at most
    same = F.col("m.source").eqNullSafe(F.col("e.source")) & (top(BUCKET_BITS[-1]) == F.col("e.bucket"))
    rows = measured.alias("m").join(small(open_).alias("e"), same).groupBy(F.col("m.source").alias("source"), "h", "bucket", "before", "rest").agg(F.sum("size").alias("words"))
    within = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cum = F.col("before") + F.coalesce(F.sum("words").over(within), F.lit(0))
    stop = rows.withColumn("cum", cum).groupBy("source", "bucket").agg(F.max(F.when(F.col("cum") + F.col("words") / 2.0 <= F.col("rest"), F.col("h"))).alias("h_in"))
    stop = stop.select(F.col("source").alias("s_source"), F.coalesce("h_in", F.shiftleft(F.col("bucket"), HASH_BITS - BUCKET_BITS[-1]) - 1).alias("h_stop"))
    out = per.join(stop, F.col("source").eqNullSafe(F.col("s_source")), "left")
    # without an edge bucket the rest is nothing, or all of the source to the last word
    h_star = F.coalesce("h_stop", F.when((F.col("rest") >= F.col("source_size")) & (F.col("source_size") > 0), F.lit(1 << HASH_BITS)).otherwise(F.lit(-1)).cast("long"))
    return written(out.select("source", "source_size", "target", "whole", h_star.alias("h_star")), "mix-plan")


def _with_copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (source, h, size, ...) with their source's figures and `copies`."""
    kept = [c for c in rows.columns]
    got = rows.alias("r").join(small(sources).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    once_more = ((F.col("r.h") <= F.col("p.h_star")) & (F.col("r.size") > 0)).cast("long")
    copies = F.when(F.col("p.source_size") > 0, F.col("p.whole") + once_more).otherwise(F.lit(0)).cast("long")
    return got.select(*(F.col(f"r.`{c}`") for c in kept), F.col("p.source_size").alias("source_size"), F.col("p.target").alias("target"), copies.alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each document."""
    measured = written(_measured(docs, seed), "mix-measured")
    out = _with_copies(measured, plan(measured, weights, share, max_epochs))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with docs' own columns."""
    sources = plan(written(_measured(docs, seed), "mix-measured"), weights, share, max_epochs)
    has_words = F.coalesce("text", F.lit("")).rlike(WORD)  # copies depend on the size only by whether it is 0
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("source").alias("source"), has_words.cast("long").alias("size"), seeded_hash(F.col("doc_id"), F.col("text"), seed).alias("h"))
    taken = _with_copies(rows, sources).filter(F.col("copies") > 0)
    return taken.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
