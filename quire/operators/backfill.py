"""Writing edited texts back onto the original paragraphs: an update join with last-wins keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.spans import spans_text

COLOUR = "^[0-9A-Fa-f]{6}$"


def latest(edits: DataFrame, value: str = "text") -> DataFrame:
    """Of edits with the same key the one with the highest idx."""
    rest = [c for c in edits.columns if c not in ("doc_id", "docx_para_idx", "idx")]
    got = edits.filter(F.col("docx_para_idx").isNotNull()).groupBy("doc_id", "docx_para_idx").agg(F.max_by(F.struct(*rest), F.col("idx")).alias("last"))
    return got.select("doc_id", "docx_para_idx", "last.*")


def update_text(original: DataFrame, edits: DataFrame) -> DataFrame:
    """original (doc_id, docx_para_idx, text) with the texts of the edits; edits of paragraphs that don't exist are ignored."""
    new = latest(edits).select("doc_id", "docx_para_idx", F.col("text").alias("new_text"))
    got = original.join(new, ["doc_id", "docx_para_idx"], "left")
    return got.withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def replaced_runs(runs: Column, spans: Column, text: Column) -> Column:
    """A paragraph's runs after an edit: as many spans as runs keep the runs' formats and take the spans' texts; another number of spans rebuilds the runs; none puts the text into one plain run."""
    kept = F.zip_with(runs, spans, lambda r, s: r.withField("text", s["text"]))

    def rebuilt(s: Column) -> Column:
        return s.withField("color_rgb", F.when(s["color_rgb"].rlike(COLOUR), s["color_rgb"]))

    plain = F.array(F.struct(text.alias("text"), *(F.lit(None).cast(t).alias(f) for f, t in (("bold", "boolean"), ("italic", "boolean"), ("underline", "boolean"), ("font_name", "string"), ("font_size_pt", "double"), ("color_rgb", "string")))))
    some = F.coalesce(F.size(spans), F.lit(0)) > 0
    return F.when(some & (F.size(spans) == F.size(runs)), kept).when(some, F.transform(spans, rebuilt)).otherwise(plain)


def backfill(original: DataFrame, blocks: DataFrame) -> DataFrame:
    """original (doc_id, docx_para_idx, runs) with runs replaced by blocks (doc_id, idx, kind, docx_para_idx, text, spans); images and tables have no paragraph and change nothing."""
    edits = blocks.filter(F.col("kind").isin("paragraph", "heading")).select("doc_id", "idx", "docx_para_idx", "text", "spans")
    got = original.join(latest(edits).withColumnRenamed("text", "new_text"), ["doc_id", "docx_para_idx"], "left")
    runs = F.when(F.col("new_text").isNull() & F.col("spans").isNull(), F.col("runs")).otherwise(replaced_runs(F.col("runs"), F.col("spans"), F.col("new_text")))
    return got.select("doc_id", "docx_para_idx", runs.alias("runs")).withColumn("text", spans_text(F.col("runs")))
