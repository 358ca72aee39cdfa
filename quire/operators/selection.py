"""Selecting parts of a document by index, with the indices checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def body_counters(body: DataFrame) -> DataFrame:
    """body (doc_id, body_pos, tag) with kind_idx: how many elements of the same tag precede, and total: how many there are."""
    order = Window.partitionBy("doc_id", "tag").orderBy("body_pos")
    return body.withColumn("kind_idx", (F.row_number().over(order) - 1).cast("int"))


def block_counters(body: DataFrame) -> DataFrame:
    """body (doc_id, body_pos, keep) with docx_para_idx, which counts every row, and idx, which counts kept rows only; kept rows."""
    w = Window.partitionBy("doc_id").orderBy("body_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keep = F.coalesce(F.col("keep"), F.lit(False))
    counted = body.withColumns({"docx_para_idx": (F.count("*").over(w) - 1).cast("int"), "idx": (F.sum(keep.cast("int")).over(w) - 1).cast("int")})
    return counted.filter(keep)


def select_elements(body: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of body (doc_id, body_pos, tag, kind_idx) that wanted (doc_id, tag, kind_idx) names, each once, whatever order they were asked for in; sort by body_pos for the body's order."""
    return body.join(wanted.select("doc_id", "tag", "kind_idx").distinct(), ["doc_id", "tag", "kind_idx"], "left_semi")


def invalid_indices(body: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, tag, bad: the requested indices below 0 or beyond the last, ascending; only where there are some."""
    size = body.groupBy("doc_id", "tag").agg(F.count("*").alias("n"))
    bad = wanted.join(size, ["doc_id", "tag"], "left").filter((F.col("kind_idx") < 0) | (F.col("kind_idx") >= F.coalesce("n", F.lit(0))))
    return bad.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set("kind_idx")).alias("bad"))


def checked_selection(body: DataFrame, wanted: DataFrame, documents: int = 20) -> DataFrame:
    """select_elements, or an error that lists all bad indices of some documents and says how many more documents have some."""
    bad = invalid_indices(body, wanted)
    rows = bad.orderBy("doc_id", "tag").limit(documents).collect()
    if rows:
        more = bad.count() - len(rows) if len(rows) == documents else 0
        said = [f"{r.doc_id}: {r.tag} indices out of range: {list(r.bad)}" for r in rows]
        raise ValueError("; ".join(said + [f"and {more} more (invalid_indices lists them)"] * (more > 0)))
    return select_elements(body, wanted)
