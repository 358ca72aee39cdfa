"""Counts and reports over documents and their articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heading_counts(headings: DataFrame) -> DataFrame:
    """(doc_id, level, n) of rows with a level from 1 to 6; levels that don't occur are absent."""
    return headings.filter(F.col("level").between(1, 6)).groupBy("doc_id", F.col("level").cast("int").alias("level")).agg(F.count("*").alias("n"))


def counts_map(counts: DataFrame) -> DataFrame:
    """doc_id, counts: map of level to n."""
    pairs = F.array_sort(F.collect_list(F.struct("level", "n")))
    return counts.groupBy("doc_id").agg(F.map_from_entries(pairs).alias("counts"))


def levels_text(counts: DataFrame, docs: DataFrame, indent: str = "") -> DataFrame:
    """doc_id, report: a line `h<level>: <n>` for each level in ascending order, or that there are none."""
    # fixed values: a level's line, and the one of a document without headings
    lines = F.transform(F.array_sort(F.collect_list(F.struct("level", "n"))), lambda x: F.format_string(f"{indent}h%d: %d", x["level"], x["n"]))
    got = counts.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("report"))
    return docs.select("doc_id").distinct().join(got, "doc_id", "left").select("doc_id", F.coalesce("report", F.lit("no headings found")).alias("report"))


def split_report(articles: DataFrame) -> DataFrame:
    """doc_id, articles, has_preamble, left_whole: a document counts as left whole if its one article has no title."""
    return articles.groupBy("doc_id").agg(F.count("*").alias("articles"), F.bool_or(F.col("number") == 0).alias("has_preamble"), ((F.count("*") == 1) & (F.max("title") == "")).alias("left_whole"))


def split_report_text(articles: DataFrame, counts: DataFrame, docs: DataFrame, level: int, indent: str = "") -> DataFrame:
    """doc_id, report: what a split did, with the level inventory."""
    # fixed values: the report's lines
    got = split_report(articles).join(levels_text(counts, docs, indent).withColumnRenamed("report", "levels"), "doc_id")
    lines = [
        F.concat(F.lit("source: "), F.col("doc_id").cast("string")),
        F.lit(f"level: {level}"),
        F.format_string("articles: %d", F.col("articles")),
        F.when(F.col("has_preamble"), F.lit("preamble: yes (content before the first heading)")),
        F.when(F.col("left_whole"), F.lit(f"note: no heading at level {level}; document left whole")),
        F.concat(F.lit("heading levels in document:\n"), F.col("levels")),
    ]
    return got.select("doc_id", F.concat_ws("\n", *lines).alias("report"))


def document_counters(blocks: DataFrame) -> DataFrame:
    """doc_id, blocks, paragraphs (with headings), tables."""
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind").isin("paragraph", "heading")).alias("paragraphs"), F.count_if(F.col("kind") == "table").alias("tables"))
