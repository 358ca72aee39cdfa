"""Sharding: extendible hashing over a 60-bit key hash.

The directory is indexed by a prefix of the hash. A bucket whose bytes exceed the limit splits on its next bit, alone, until it
fits; here a bucket's bytes at every depth come from one histogram over prefixes, and only prefixes that still overflow get a
deeper histogram. The histogram and the directory grow with the number of shards, never with the rows, and stay distributed.

The hash covers the id and the text, so a null or repeated doc_id doesn't make a hot bucket. Rows that are alike in both can't be
parted by bits; their bucket stops splitting and is chained into pages of as many rows as fit (a single row above the limit has a
page of its own). Null texts count as empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import small, written

LIMIT_BYTES = 1 << 20
BITS = 60
SPARE_BITS = 4  # of the first histogram, beyond what even buckets need
STEP_BITS = 4  # of each deeper one
SALTS = 1024  # parts of a chain that are numbered apart


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, h."""
    text = F.coalesce("text", F.lit(""))
    of = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.conv(F.substring(F.md5(of), 1, 15), 16, 10).cast("long").alias("h"))


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """[(bits, entries)]: entries hold slot (prefix of that many bits), depth, bucket_bytes, alone (one hash only).

    A bucket is a prefix that fits while the one a bit shorter doesn't; so each prefix's bytes are summed, and siblings meet to
    see whether their parent fits. Nothing is joined, and rows are counted in partial sums, so no prefix is hot.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits, low, left, out = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS), 0, None, []
    fits = (F.col("b") <= limit) | (F.col("lo") == F.col("hi"))
    while True:
        mine = rows if left is None else rows.join(small(left), F.shiftright("h", BITS - low) == F.col("over"), "left_semi")
        slots = written(mine.groupBy(F.shiftright("h", BITS - bits).alias("slot")).agg(F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi")), "shard-slots")
        # below `low` the bucket is known to overflow
        first = 0 if left is None else low + 1
        spread = slots.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(bits)))).withColumn("prefix", F.expr(f"shiftright(slot, {bits} - depth)"))
        nodes = spread.groupBy("depth", "prefix").agg(F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        nodes = written(nodes, "shard-nodes")
        family = nodes.groupBy("depth", F.shiftright("prefix", 1).alias("up")).agg(F.collect_list(F.struct("prefix", "b", "lo", "hi")).alias("kids"), F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        split = family.filter(~fits | (F.col("depth") == first)).select("depth", F.inline("kids"))  # two siblings at most
        leaves = split.filter(fits).select("depth", "prefix", F.col("b").alias("bucket_bytes"), (F.col("lo") == F.col("hi")).alias("alone"))
        start = F.expr(f"shiftleft(prefix, {bits} - depth)")
        wide = F.expr(f"shiftleft(1L, {bits} - depth)")
        entries = leaves.select(F.explode(F.sequence(start, start + wide - 1)).alias("slot"), "depth", "bucket_bytes", "alone")
        out.append((bits, written(entries, "shard-directory")))
        left = nodes.filter((F.col("depth") == bits) & ~fits).select(F.col("prefix").alias("over"))
        if bits >= BITS or left.isEmpty():
            return out
        low, bits = bits, min(BITS, bits + STEP_BITS)


def shards(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, n_bytes, depth, prefix, page, shard_bytes: shard (depth, prefix, page) of every document, and the bytes in it."""
    rows = written(hashed(docs).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "shard-rows")
    out = None
    for bits, entries in directory(rows, limit):
        got = rows.withColumn("slot", F.shiftright("h", BITS - bits)).join(small(entries), "slot").drop("slot")
        out = got if out is None else out.unionByName(got)
    out = out.withColumn("prefix", F.expr(f"CASE WHEN depth = 0 THEN 0L ELSE shiftright(h, {BITS} - depth) END"))
    chained = F.col("alone") & (F.col("bucket_bytes") > limit)
    plain = out.filter(~chained).select("doc_id", "n_bytes", "depth", "prefix", F.lit(0).cast("long").alias("page"), F.col("bucket_bytes").alias("shard_bytes"))
    # rows of a chain are alike, so any numbering will do: within each salt, after the rows of the salts before it
    over = out.filter(chained)
    per = over.groupBy("h", "salt").count()
    before = per.select("h", "salt", F.coalesce(F.sum("count").over(Window.partitionBy("h").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("h", "salt").orderBy("doc_id")) - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("n_bytes")))
    pages = over.withColumn("nth", nth).join(before, ["h", "salt"]).withColumn("room", room).withColumn("page", F.floor((F.col("nth") + F.col("before")) / F.col("room")))
    in_page = F.least(F.col("room"), F.floor(F.col("bucket_bytes") / F.col("n_bytes")) - F.col("page") * F.col("room")) * F.col("n_bytes")
    return plain.unionByName(pages.select("doc_id", "n_bytes", "depth", "prefix", "page", in_page.alias("shard_bytes")))
