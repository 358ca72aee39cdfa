"""Corpora as blocks: conversations, lines of documents, articles of web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.expr import html_escape

LEVEL1, LEVEL2 = 40, 80  # characters of a line that counts as a heading, at most


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_blocks(conversations: DataFrame, role: str = "user") -> DataFrame:
    """A conversation is a document, a turn a block, turns of one role are headings of level 1."""
    heading = F.col("role") == role
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("idx"), F.when(heading, "heading").otherwise("paragraph").alias("kind"), F.when(heading, 1).alias("level"), "text")


def line_blocks(documents: DataFrame) -> DataFrame:
    """A line is a block; short lines are headings of level 1, and longer ones of level 2. Null texts have no lines."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))
    n = F.length("text")
    level = F.when(n.between(1, LEVEL1), 1).when(n.between(LEVEL1 + 1, LEVEL2), 2)
    return lines.select("doc_id", "idx", F.when(level.isNotNull(), "heading").otherwise("paragraph").alias("kind"), level.alias("level"), "text")


def block_nodes(blocks: DataFrame) -> DataFrame:
    """Blocks as the top-level nodes of an HTML fragment."""
    tag = F.when(F.col("kind") == "heading", F.concat(F.lit("h"), F.col("level").cast("string"))).otherwise("p")
    html = F.concat(F.lit("<"), tag, F.lit(">"), html_escape(F.col("text")), F.lit("</"), tag, F.lit(">"))
    return blocks.select("doc_id", F.col("idx").alias("node_idx"), F.lit("tag").alias("node_type"), tag.alias("tag"), html.alias("html"), F.array("text").alias("strings"))


def page_articles(pages: DataFrame) -> DataFrame:
    """doc_id, fragment: the insides of each page's article elements, one after the other, or the whole page where there is none."""
    inside = F.array_join(F.regexp_extract_all("html", F.lit("(?s)<article[^>]*>(.*?)</article>"), F.lit(1)), "")
    return pages.select(F.col("page_id").alias("doc_id"), F.when(inside != "", inside).otherwise(F.col("html")).alias("fragment"))


def event_rows(events: DataFrame) -> DataFrame:
    """A user's events as runs of text in the order of time, with the event's type as their format."""
    return events.select(F.col("user_id").alias("doc_id"), "ts", "event_id", F.col("event_type").alias("font_name"), F.col("event_id").cast("string").alias("text"))


def order_runs(lineitem: DataFrame) -> DataFrame:
    """An order's lines as an array of runs, sorted by flag-independent columns, with the return flag as their format."""
    run = F.struct(F.col("l_partkey").cast("string").alias("text"), F.lit(None).cast("boolean").alias("bold"), F.lit(None).cast("boolean").alias("italic"), F.lit(None).cast("boolean").alias("underline"), F.col("l_returnflag").alias("font_name"), F.lit(None).cast("double").alias("font_size_pt"), F.lit(None).cast("string").alias("color_rgb"))
    got = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", run.alias("run")))).alias("all"))
    return got.select(F.col("l_orderkey").alias("doc_id"), F.transform("all", lambda x: x["run"]).alias("runs"))
