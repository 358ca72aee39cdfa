"""URL filter: a blocked Bloom filter of listed URL prefixes, then an exact hash join.

Native: DataFrame functions only. Every page yields the keys a listed rule could have: for each shape that occurs in the list, as
many last labels of its host as the rule's host has, and as many characters of its path. The filter, built once and a literal of
the plan, discards nearly all keys inside the scan; what passes is joined with the list, which removes false positives, so results
never depend on the filter's size. Pages without a hit are decided where they lie, and only hits are shuffled: the url column
is read for both, which costs less than a shuffle of all rows. The work on a url is linear in its length, whatever its labels.

Edge cases: a url that is null or has no `://` has an empty host and path and no rule; a host's port and user stay part of the
host, so such a host meets no rule unless the rule lists them. Repeated rows and equal page_ids are judged row by row. Columns
of the input that aren't asked for are ignored, whatever their names. An empty list gives every page the default verdict.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_ROWS, lower_az

WORDS = 8  # 64-bit words of a block; each key sets one bit in every word
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 16  # 4 MB; a longer list only raises the share of false positives, which the join removes


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://` up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_az(raw), path


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def _bit(h: Column, word: int) -> Column:
    """The mask of a key's bit in a word; eight runs of six bits of the second hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * word).bitwiseAND(F.lit(63)).cast("int"))


def block_count(n_keys: int) -> int:
    need = max(1, n_keys * BITS_PER_KEY // (64 * WORDS))
    return min(MAX_BLOCKS, 1 << (need - 1).bit_length())


def build_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row, one column `words`: the filter over column `key`, block after block."""
    place, bits = _hashes(F.col("key"))
    hit = keys.select(F.pmod(place, F.lit(blocks)).alias("block"), bits.alias("bits"))
    full = hit.groupBy("block").agg(*(F.bit_or(_bit(F.col("bits"), i)).alias(f"w{i}") for i in range(WORDS)))
    every = keys.sparkSession.range(blocks).withColumnRenamed("id", "block").join(full, "block", "left")
    packed = every.select("block", F.array(*(F.coalesce(f"w{i}", F.lit(0).cast("long")) for i in range(WORDS))).alias("ws"))
    return packed.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "ws"))), lambda x: x["ws"])).alias("words"))


def maybe_listed(key: Column, words: Column, blocks: int) -> Column:
    """False only if the key is surely not in the filter."""
    place, bits = _hashes(key)
    start = (F.pmod(place, F.lit(blocks)) * WORDS).cast("int")
    out = None
    for i in range(WORDS):
        mask = _bit(bits, i)
        one = F.get(words, start + i).bitwiseAND(mask) == mask
        out = one if out is None else out & one
    return out


def filter_words(keys: DataFrame, blocks: int) -> Column:
    """The filter over column `key` as one literal (4 MB at most), which every use of it in a plan shares."""
    words = build_filter(keys, blocks).first()[0]
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages. rules: host, path, verdict; the longest fitting rule wins."""
    labels = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
    listed = rules.select(F.concat("host", "path").alias("key"), labels.alias("k"), F.length("path").alias("n"), F.col("verdict").alias("says")).dropDuplicates(["key"])
    n_keys = listed.count()
    host, path = url_parts(F.col(url_col))
    found = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    none = F.lit(None).cast("string")
    if not n_keys:
        return found.withColumns({"rule": none, "verdict": F.lit(default)})
    blocks = block_count(n_keys)
    # a rule's shape: labels of its host, characters of its path; at most as many shapes as names have labels times paths have lengths
    shapes = sorted(tuple(r) for r in listed.select("k", "n").distinct().collect())
    every = F.from_json(F.lit(json.dumps([{"k": k, "n": n} for k, n in shapes])), "array<struct<k:int,n:int>>")
    fits = F.filter(every, lambda s: (s["k"] <= labels) & (s["n"] <= F.length("path")))
    keys = F.transform(fits, lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["k"]), F.substring(F.col("path"), F.lit(1), s["n"])))
    words = filter_words(listed.select("key"), blocks)
    sifted = found.withColumn("keys", F.filter(keys, lambda k: maybe_listed(k, words, blocks)))
    clear = sifted.filter(F.size("keys") == 0).select("page_id", "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    hits = sifted.filter(F.size("keys") > 0).withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.explode("keys")).drop("keys")
    exact = hits.join(F.broadcast(listed) if n_keys <= BROADCAST_ROWS else listed.hint("merge"), "key", "left")
    won = exact.groupBy("row").agg(*(F.first(c).alias(c) for c in ("page_id", "host", "path")), F.max(F.when(F.col("says").isNotNull(), F.struct(F.length("key").alias("n"), "key", "says"))).alias("best"))
    decided = won.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.says", F.lit(default)).alias("verdict"))
    return clear.unionByName(decided)
