"""Splitting documents into articles at one heading level.

The boundary predicate's running sum over a document's order is the article: one window, one exchange on doc_id, and the
aggregation by article that follows needs no second one. Two routes exist and differ by design:

- html (over top-level nodes): articles are numbered 1..N, what precedes the first is number 0 and kept only if it isn't blank;
  a title is the boundary heading's text; a document without a boundary is article 1 with no title.
- blocks: chunks are numbered from 1 with what precedes the first boundary included; a title is the chunk's first block's
  text if that is a heading of whatever level, as it stands; anchors back to the source come with it.

A document without rows has one empty article; pass `docs` to have those restored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.expr import is_blank, tag_level


def check_level(level: int) -> int:
    if not 1 <= level <= 6:
        raise ValueError(f"level must be from 1 to 6, not {level}")
    return level


def is_boundary(level: int) -> Column:
    return F.coalesce((F.col("kind") == "heading") & (F.col("level") == level), F.lit(False))


def membership(rows: DataFrame, boundary: Column, order: str) -> DataFrame:
    """rows with `part`: how many boundaries the document had up to and with this row."""
    running = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("part", F.sum(F.coalesce(boundary, F.lit(False)).cast("int")).over(running).cast("int"))


def _ordered(value: Column, order: str) -> Column:
    """Values of a group in order; collected as (order, value)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def _present(value: Column, order: str) -> Column:
    got = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v")))))
    return F.transform(got, lambda x: x["v"])


def split_nodes(nodes: DataFrame, level: int = 1, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, number, title, html of nodes (doc_id, node_idx, node_type, tag, html, strings): the html route."""
    check_level(level)
    real = nodes.filter((F.col("node_type") == "tag") | ~is_blank(F.col("html")))
    part = membership(real, F.col("tag") == f"h{level}", "node_idx")
    from quire.functions.expr import ws_strip

    words = F.array_join(F.filter(F.transform("strings", lambda s: ws_strip(s)), lambda s: s != ""), " ")
    got = part.groupBy("doc_id", "part").agg(F.array_join(_ordered(F.col("html"), "node_idx"), "").alias("html"), F.min_by(words, F.col("node_idx")).alias("heading"), F.max("part").alias("top"))
    most = F.max("part").over(Window.partitionBy("doc_id"))
    got = got.withColumn("most", most).filter((F.col("part") > 0) | (F.col("most") == 0) | ~is_blank(F.col("html")))
    out = got.select("doc_id", F.when(F.col("most") == 0, 1).otherwise(F.col("part")).alias("number"), F.when(F.col("part") > 0, F.col("heading")).otherwise("").alias("title"), "html")
    return _restored(out, docs, {"number": F.lit(1), "title": F.lit(""), "html": F.lit("")})


def split_blocks(blocks: DataFrame, level: int = 1, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, number, title, block_indices, docx_para_indices, docx_table_indices of blocks: the blocks route."""
    check_level(level)
    have = set(blocks.columns)
    para = F.when(F.col("kind").isin("paragraph", "heading"), F.col("docx_para_idx")) if "docx_para_idx" in have else F.lit(None).cast("int")
    tab = F.when(F.col("kind") == "table", F.col("docx_table_idx")) if "docx_table_idx" in have else F.lit(None).cast("int")
    part = membership(blocks, is_boundary(level), "idx")
    title = F.when(F.col("kind") == "heading", F.col("text")).otherwise("")
    got = part.groupBy("doc_id", "part").agg(F.min_by(title, F.col("idx")).alias("title"), _ordered(F.col("idx"), "idx").alias("block_indices"), _present(para, "idx").alias("docx_para_indices"), _present(tab, "idx").alias("docx_table_indices"))
    least = F.min("part").over(Window.partitionBy("doc_id"))
    out = got.select("doc_id", F.when(least == 0, F.col("part") + 1).otherwise(F.col("part")).alias("number"), "title", "block_indices", "docx_para_indices", "docx_table_indices")
    none = F.array().cast("array<int>")
    return _restored(out, docs, {"number": F.lit(1), "title": F.lit(""), "block_indices": none, "docx_para_indices": none, "docx_table_indices": none})


def _restored(articles: DataFrame, docs: DataFrame | None, empty: dict[str, Column]) -> DataFrame:
    if docs is None:
        return articles
    lost = docs.select("doc_id").join(articles.select("doc_id"), "doc_id", "left_anti")
    return articles.unionByName(lost.withColumns({k: v.cast(articles.schema[k].dataType) for k, v in empty.items()}).select(articles.columns))


def node_levels(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("level", tag_level(F.col("tag")))


def is_preamble() -> Column:
    return F.col("number") == 0


def has_anchors() -> Column:
    return F.size("block_indices") > 0
