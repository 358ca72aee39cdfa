"""Inline fragments of text and table cells: higher-order functions over arrays, no shuffle and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.schema import FORMAT_FIELDS, SPAN


def has_text(spans: Column) -> Column:
    return F.filter(spans, lambda s: F.length(s["text"]) > 0)


def _format(s: Column) -> Column:
    return F.struct(*(s[f].alias(f) for f in FORMAT_FIELDS))


def merge_adjacent(spans: Column) -> Column:
    """Neighbours with the same format become one span, their texts joined in order; null formats equal each other. Linear in the array's length; merge_rows does the same for long runs of rows."""

    def merged(all_: Column) -> Column:
        n = F.size(all_)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | ~_format(F.get(all_, k)).eqNullSafe(_format(F.get(all_, k - 1))))
        ends = lambda s: F.concat(F.slice(s, 2, F.size(s)), F.array(n))
        one = lambda lo, hi: F.struct(spans_text(F.slice(all_, lo + 1, hi - lo)).alias("text"), *(F.get(all_, lo)[f].alias(f) for f in FORMAT_FIELDS))
        return F.when(n > 0, F.get(F.transform(F.array(starts), lambda s: F.zip_with(s, ends(s), one)), F.lit(0))).when(n == 0, F.array().cast(f"array<{SPAN}>"))

    # as an element of an array the spans are worked out once, not at every use
    return F.get(F.transform(F.array(spans), merged), F.lit(0))


def merge_rows(rows: DataFrame, by: str, order: list[str], format_columns: list[str]) -> DataFrame:
    """rows (by, order..., format columns, text) to islands (by, idx, format columns, text): one exchange on `by` for the window and the aggregation."""
    w = Window.partitionBy(by).orderBy(*order)
    own = F.struct(*format_columns)
    starts = F.when(F.row_number().over(w) == 1, True).otherwise(~F.lag(own).over(w).eqNullSafe(own))
    marked = rows.withColumn("starts", starts.cast("int"))
    island = marked.withColumn("idx", (F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), "")
    return island.groupBy(by, "idx").agg(*(F.first(c).alias(c) for c in format_columns), text.alias("text"))


def extract_spans(runs: Column) -> Column:
    """Runs to spans: empty ones go, three-valued flags become two-valued, equal neighbours merge."""

    def plain(r: Column) -> Column:
        flags = [F.coalesce(r[f], F.lit(False)).alias(f) for f in ("bold", "italic", "underline")]
        return F.struct(r["text"].alias("text"), *flags, *(r[f].alias(f) for f in ("font_name", "font_size_pt", "color_rgb")))

    return merge_adjacent(F.transform(has_text(runs), plain))


def is_plain(s: Column) -> Column:
    """No flag and no font, size or colour; an empty string is a value."""
    return ~(F.coalesce(s["bold"], F.lit(False)) | F.coalesce(s["italic"], F.lit(False)) | F.coalesce(s["underline"], F.lit(False))) & s["font_name"].isNull() & s["font_size_pt"].isNull() & s["color_rgb"].isNull()


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: s["text"]), "")


def cells_text(rows: Column) -> Column:
    """A table's text from its cells' texts (array of arrays of strings): cells joined by ` | `, rows by line feeds."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def table_text(rows: Column) -> Column:
    """The same from cells that hold spans."""
    return cells_text(F.transform(rows, lambda r: F.transform(r, lambda c: spans_text(c["spans"]))))


def widest_row(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def spans_match_text(spans: Column, text: Column) -> Column:
    """Data-quality check: whether the spans spell the block's text."""
    return spans_text(spans) == text
