"""Rendering: inspection rows and pages, article pages, the index. Row-level projections come first; pages are ordered concatenations of them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.expr import article_filename, confidence_class, file_name, html_escape, kind_label, or_else, shortened, two_decimals
from quire.operators import page_formats as fixed


def filled(template: str, **values: Column) -> Column:
    """A template with columns in its places; null counts as empty."""
    parts = re.split(r"\$(\w+)", template)
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts) if p))


def block_inspection(blocks: DataFrame) -> DataFrame:
    """doc_id, idx, label, page, confidence, confidence_class, text, signals: what the inspection page shows of each block, unescaped."""
    signals = or_else(F.array_join("signals", ", "), F.lit("—"))
    return blocks.select("doc_id", "idx", kind_label(F.col("kind"), F.col("level")).alias("label"), F.col("page_index").alias("page"), two_decimals(F.col("kind_confidence")).alias("confidence"), confidence_class(F.col("kind_confidence")).alias("confidence_class"), shortened(F.col("text")).alias("text"), F.coalesce(signals, F.lit("—")).alias("signals"))


def in_order(line: Column, order: str, between: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("v")))), lambda x: x["v"]), between)


def document(fragment: Column, title: Column) -> Column:
    """A fragment as a whole page; the title is escaped."""
    return filled(fixed.DOCUMENT, title=html_escape(title), fragment=fragment)


def inspection_html(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, html: a table of each document's blocks under a header with format, number of blocks and path."""
    shown = ("idx", "label", "page", "confidence", "text", "signals")
    row = filled(fixed.INSPECTION_ROW, confidence_class=F.col("confidence_class"), **{c: html_escape(F.col(c).cast("string")) for c in shown})
    tables = block_inspection(blocks).groupBy("doc_id").agg(in_order(row, "idx").alias("rows"), F.count("*").alias("n"))
    got = docs.select("doc_id", "source_path", "source_format").join(tables, "doc_id", "left")
    title = F.concat(F.lit(fixed.TITLE), html_escape(file_name(F.col("source_path"))))
    page = filled(fixed.INSPECTION, title=title, format=html_escape(F.col("source_format")), count=F.coalesce("n", F.lit(0)), path=html_escape(F.col("source_path")), rows=F.col("rows"))
    return got.select("doc_id", page.alias("html"))


def _named(name: Column | None) -> Column:
    return F.col("doc_id").cast("string") if name is None else name


def article_pages(articles: DataFrame, name: Column | None = None) -> DataFrame:
    """doc_id, number, file, page: each article as a page named after it; untitled ones bear the document's name."""
    return articles.select("doc_id", "number", article_filename(F.col("number"), F.col("title")).alias("file"), document(F.col("html"), or_else(F.col("title"), _named(name))).alias("page"))


def article_index(articles: DataFrame, name: Column | None = None) -> DataFrame:
    """doc_id, index: a page with the document's name, how many articles there are, and links to their pages. Any untitled article is labelled preamble."""
    label = html_escape(or_else(F.col("title"), F.lit("preamble")))
    item = filled(fixed.INDEX_ITEM, file=article_filename(F.col("number"), F.col("title")), label=label)
    got = articles.withColumn("name", _named(name)).groupBy("doc_id").agg(in_order(item, "number").alias("items"), F.count("*").alias("n"), F.first("name").alias("name"))
    body = filled(fixed.INDEX, name=html_escape(F.col("name")), count=F.col("n"), items=F.col("items"))
    return got.select("doc_id", document(body, F.concat(F.lit(fixed.INDEX_TITLE), F.col("name"))).alias("index"))


def _unsupported(fmt: str) -> Callable:
    def render(blocks: DataFrame, docs: DataFrame) -> DataFrame:
        raise NotImplementedError(f"no {fmt} renderer yet")

    return render


RENDERERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"html": inspection_html, "markdown": _unsupported("markdown"), "json": _unsupported("json")}


def register_renderer(fmt: str, renderer: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """The last registration of a format wins."""
    RENDERERS[fmt] = renderer


def render(blocks: DataFrame, docs: DataFrame, fmt: str = "html") -> DataFrame:
    if fmt not in RENDERERS:
        raise NotImplementedError(f"unknown format {fmt!r}; there are {', '.join(sorted(RENDERERS))}")
    return RENDERERS[fmt](blocks, docs)
