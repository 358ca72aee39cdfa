"""Word documents as relations, by the standard library's zip and XML readers.

body_rows() parses whole files in tasks: one row for each paragraph and table of the body, in order; everything else in the
body (section properties, content controls) is skipped. Block typing, formats and counters are column expressions over those rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions.expr import file_format, is_blank, style_level
from quire.functions.spans import extract_spans, table_text
from quire.schema import BBOX, CELL, SPAN

#: Fixed value: the namespace of word-processing markup.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Paragraph alignments; all others are none.
ALIGN = {"left": "left", "start": "left", "center": "center", "right": "right", "end": "right", "both": "justify", "distribute": "justify"}
#: What a document's metadata and a block's signals say about how they were read.
READER, PARAGRAPH_COUNT, TABLE_COUNT, SIGNAL = "python-docx", "python_docx_para_count", "python_docx_table_count", "python_docx_reader"
TWENTIETHS = 20.0  # of a point, the markup's unit of length
PARAGRAPH_CELLS = f"array<array<array<struct<runs:array<{SPAN}>>>>>"
BODY = f"body_pos int, tag string, text string, style_id string, runs array<{SPAN}>, align string, first_line double, left double, line_spacing double, space_before double, space_after double, cells {PARAGRAPH_CELLS}"


def _flag(properties, name: str) -> bool | None:
    """A toggle: None where it isn't given, else whether it is on."""
    found = None if properties is None else properties.find(W + name)
    return None if found is None else found.get(W + "val", "true") not in ("0", "false", "none", "off")


def run_text(run) -> str:
    out = []
    for part in run:
        if part.tag == W + "t":
            out.append(part.text or "")
        elif part.tag == W + "tab":
            out.append("\t")
        elif part.tag in (W + "br", W + "cr"):
            out.append("\n")
        elif part.tag == W + "noBreakHyphen":
            out.append("-")
    return "".join(out)


def parse_run(run) -> dict:
    p = run.find(W + "rPr")
    get = lambda name, key="val": None if p is None or p.find(W + name) is None else p.find(W + name).get(W + key)
    size, colour, line = get("sz"), get("color"), get("u")
    return {"text": run_text(run), "bold": _flag(p, "b"), "italic": _flag(p, "i"), "underline": None if line is None else line != "none", "font_name": get("rFonts", "ascii"), "font_size_pt": float(size) / 2 if size else None, "color_rgb": None if colour in (None, "auto") else colour.upper()}


def parse_paragraph(p) -> dict:
    props = p.find(W + "pPr")
    find = lambda name: None if props is None else props.find(W + name)

    def points(node, *keys) -> float | None:
        for key in keys:
            if node is not None and node.get(W + key) is not None:
                return float(node.get(W + key)) / TWENTIETHS
        return None

    style, jc, ind, spacing = find("pStyle"), find("jc"), find("ind"), find("spacing")
    first, hanging = points(ind, "firstLine"), points(ind, "hanging")
    line = None if spacing is None else spacing.get(W + "line")
    exact = spacing is not None and spacing.get(W + "lineRule") in ("exact", "atLeast")
    texts = [run_text(r) for r in p.iter(W + "r")]  # runs inside hyperlinks count for the text
    return {
        "text": "".join(texts),
        "style_id": None if style is None else style.get(W + "val"),
        "runs": [parse_run(r) for r in p.findall(W + "r")],
        "align": None if jc is None else ALIGN.get(jc.get(W + "val")),
        "first_line": first if hanging is None else -hanging,
        "left": points(ind, "left", "start"),
        "line_spacing": None if line is None else float(line) / (TWENTIETHS if exact else 240.0),
        "space_before": points(spacing, "before"),
        "space_after": points(spacing, "after"),
    }


def parse_body(data: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
    rows = []
    for pos, node in enumerate(body if body is not None else ()):
        if node.tag == W + "p":
            rows.append({"body_pos": pos, "tag": "p", **parse_paragraph(node), "cells": None})
        elif node.tag == W + "tbl":
            cells = [[[{"runs": [parse_run(r) for r in p.findall(W + "r")]} for p in c.findall(W + "p")] for c in row.findall(W + "tc")] for row in node.findall(W + "tr")]
            rows.append({"body_pos": pos, "tag": "tbl", "cells": cells})
    return rows


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """docs and their bytes: doc_id (the path), source_path, source_format, content. Only files ending in .docx."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("doc_id"), F.col("path").alias("source_path"), file_format(F.col("path")).alias("source_format"), "content")


def body_rows(files: DataFrame) -> DataFrame:
    """files (doc_id, content) to one row for each paragraph and table of the body."""
    schema = f"doc_id string, {BODY}"
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{"doc_id": doc_id, **r} for r in parse_body(content)]
                if rows:
                    yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in kind.names} for r in rows], schema=kind)

    return files.select("doc_id", "content").mapInArrow(run, schema)


def _cells(cells: Column) -> Column:
    """Parsed cells to cells with spans: a cell's paragraphs one after the other, merged within each."""
    spans = lambda c: F.flatten(F.transform(c, lambda p: extract_spans(p["runs"])))
    return F.transform(cells, lambda row: F.transform(row, lambda c: F.struct(spans(c).alias("spans"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))))


def blocks(body: DataFrame) -> DataFrame:
    """Body rows to blocks. Paragraphs without text and runs are dropped, but count in docx_para_idx."""
    w = Window.partitionBy("doc_id").orderBy("body_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_p = F.col("tag") == "p"
    nth = lambda c: (F.sum(c.cast("int")).over(w) - 1).cast("int")
    keep = ~is_p | ~is_blank(F.col("text")) | (F.coalesce(F.size("runs"), F.lit(0)) > 0)
    got = body.withColumns({"p_idx": nth(is_p), "t_idx": nth(~is_p), "keep": keep}).withColumn("idx", nth(F.col("keep"))).filter("keep")
    level = F.when(is_p, style_level(F.col("style_id")))
    heading = F.coalesce(level.isNotNull(), F.lit(False))
    rows = F.when(~is_p, _cells(F.col("cells"))).cast(f"array<array<{CELL}>>")
    style = F.concat(F.lit("style_id:"), F.coalesce("style_id", F.lit("None")))
    indent = F.coalesce(F.col("first_line") - F.col("left"), F.col("first_line"))
    return got.withColumn("rows", rows).select(
        "doc_id", "idx", F.when(~is_p, "table").when(heading, "heading").otherwise("paragraph").alias("kind"),
        F.when(is_p, F.col("text")).otherwise(table_text(F.col("rows"))).alias("text"),
        F.lit(0).alias("page_index"), F.lit(False).alias("has_image"), (~is_p).alias("in_table"), F.lit(None).cast(BBOX).alias("bbox"), F.lit(1.0).alias("kind_confidence"),
        F.array(F.lit(SIGNAL), F.when(is_p, style).otherwise("tag:tbl")).alias("signals"),
        F.when(is_p, extract_spans(F.col("runs"))).alias("spans"), "align", F.when(is_p, indent).alias("indent_first_line_pt"), "line_spacing",
        F.col("space_before").alias("space_before_pt"), F.col("space_after").alias("space_after_pt"), F.col("style_id").alias("style_hint"),
        F.when(is_p, F.col("p_idx")).alias("docx_para_idx"), F.when(heading, level).alias("level"), F.when(heading, 1.0).alias("level_confidence"),
        "rows", F.when(~is_p, F.col("t_idx")).alias("docx_table_idx"), F.lit(None).cast("string").alias("image_format"),
    )


def documents(files: DataFrame, body: DataFrame) -> DataFrame:
    """docs with metadata: the reader, and how many paragraphs and tables the body has."""
    n = body.groupBy("doc_id").agg(F.count_if(F.col("tag") == "p").alias("p"), F.count_if(F.col("tag") == "tbl").alias("t"))
    got = files.select("doc_id", "source_path", "source_format").join(n, "doc_id", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return got.select("doc_id", "source_path", "source_format", F.create_map(F.lit("reader"), F.lit(READER), F.lit(PARAGRAPH_COUNT), text("p"), F.lit(TABLE_COUNT), text("t")).alias("metadata"))


def _inline(spans: Column) -> Column:
    from quire.functions.expr import html_escape

    def one(s: Column) -> Column:
        text = html_escape(s["text"])
        text = F.replace(text, F.lit("\n"), F.lit("<br />"))
        text = F.when(s["italic"], F.concat(F.lit("<em>"), text, F.lit("</em>"))).otherwise(text)
        return F.when(s["bold"], F.concat(F.lit("<strong>"), text, F.lit("</strong>"))).otherwise(text)

    return F.array_join(F.transform(spans, one), "")


def html_nodes(body: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Body rows as top-level HTML nodes: h1 to h6, p, table, with strong, em and br. Empty paragraphs stay or go; a document's nodes in order are its HTML fragment."""
    is_p = F.col("tag") == "p"
    level = style_level(F.col("style_id"))
    tag = F.when(~is_p, "table").when(level.between(1, 6), F.concat(F.lit("h"), level.cast("string"))).otherwise("p")
    cells = F.transform(_cells(F.col("cells")), lambda row: F.concat(F.lit("<tr>"), F.array_join(F.transform(row, lambda c: F.concat(F.lit("<td><p>"), _inline(c["spans"]), F.lit("</p></td>"))), ""), F.lit("</tr>")))
    inner = F.when(is_p, _inline(extract_spans(F.col("runs")))).otherwise(F.array_join(cells, ""))
    got = body.withColumns({"html_tag": tag, "inner": F.coalesce(inner, F.lit(""))})
    if not keep_empty:
        got = got.filter(~is_p | (F.col("inner") != ""))
    html = F.concat(F.lit("<"), F.col("html_tag"), F.lit(">"), F.col("inner"), F.lit("</"), F.col("html_tag"), F.lit(">"))
    strings = F.when(is_p, F.array("text")).otherwise(F.array().cast("array<string>"))
    return got.select("doc_id", F.col("body_pos").alias("node_idx"), F.lit("tag").alias("node_type"), F.col("html_tag").alias("tag"), html.alias("html"), strings.alias("strings"))


def source_fragment(body: DataFrame, keep_empty: bool = True) -> DataFrame:
    """doc_id, fragment: each document as one HTML fragment."""
    from quire.operators.render import in_order

    return html_nodes(body, keep_empty).groupBy("doc_id").agg(in_order(F.col("html"), "node_idx", "").alias("fragment"))


def split_with_anchors(body: DataFrame, level: int = 1) -> DataFrame:
    """The blocks route over documents: articles with anchors, and as html what their anchors refer to, without empty paragraphs."""
    from quire.operators.split import is_boundary, membership, split_blocks

    made = blocks(body)
    articles = split_blocks(made, level)
    part = membership(made, is_boundary(level), "idx").select("doc_id", "part", "docx_para_idx", "docx_table_idx")
    low = F.min("part").over(Window.partitionBy("doc_id"))
    part = part.withColumn("number", F.when(low == 0, F.col("part") + 1).otherwise(F.col("part")))
    w = Window.partitionBy("doc_id").orderBy("body_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_p = F.col("tag") == "p"
    at = body.withColumns({"is_p": is_p, "p_idx": F.sum(is_p.cast("int")).over(w) - 1, "t_idx": F.sum((~is_p).cast("int")).over(w) - 1}).select("doc_id", F.col("body_pos").alias("node_idx"), "is_p", "p_idx", "t_idx")
    key = at.select("doc_id", "node_idx", F.when(F.col("is_p"), F.col("p_idx")).cast("int").alias("docx_para_idx"), F.when(~F.col("is_p"), F.col("t_idx")).cast("int").alias("docx_table_idx"))
    numbered = key.join(part, (key["doc_id"] == part["doc_id"]) & key["docx_para_idx"].eqNullSafe(part["docx_para_idx"]) & key["docx_table_idx"].eqNullSafe(part["docx_table_idx"])).select(key["doc_id"], "node_idx", "number")
    from quire.operators.render import in_order

    html = html_nodes(body, keep_empty=False).join(numbered, ["doc_id", "node_idx"]).groupBy("doc_id", "number").agg(in_order(F.col("html"), "node_idx", "").alias("html"))
    return articles.join(html, ["doc_id", "number"], "left").withColumn("html", F.coalesce("html", F.lit("")))
