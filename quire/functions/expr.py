"""Scalar expressions over columns: all of them built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Unicode-aware stripping removes, for Java's regular expressions.
WS = r"\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
TEXT_LIMIT = 200
SLUG_LIMIT = 30
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.8, 0.5
EMU_PER_POINT = 12700.0


def ws_strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only strings."""
    return F.coalesce(~c.rlike(f"[^{WS}]"), F.lit(True))


def or_else(c: Column, other: Column) -> Column:
    """c, or other where c is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def slug(title: Column, limit: int = SLUG_LIMIT) -> Column:
    """A title as part of a file name. The cut comes last, so a slug may end in a dash."""
    dashed = F.regexp_replace(title, rf"[<>:\"/\\|?*{WS}]+", "-")
    return or_else(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, limit), F.lit("untitled"))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def style_level(style_id: Column) -> Column:
    """Heading level of a paragraph style: the digit right after `Heading` at its start, in any case; else null."""
    return F.nullif(F.regexp_extract(style_id, f"(?i)^Heading[{WS}]*([0-9])", 1), F.lit("")).cast("int")


def tag_level(tag: Column) -> Column:
    """1 to 6 for h1 to h6, else null."""
    return F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))


def kind_label(kind: Column, level: Column) -> Column:
    short = F.when(kind == "table", "TBL").when(kind == "image", "IMG").when(kind == "paragraph", "para").otherwise(or_else(kind, F.lit("?")))
    return F.when(kind == "heading", F.concat(F.lit("H"), level.cast("string"))).otherwise(short)


def confidence_class(c: Column) -> Column:
    """Class of a row of the inspection page. NaN compares above every number in Spark, but counts as low here."""
    return F.when(F.isnan(c), "conf-low").when(c >= HIGH_CONFIDENCE, "conf-high").when(c >= MEDIUM_CONFIDENCE, "conf-med").otherwise("conf-low")


def two_decimals(c: Column) -> Column:
    """Rounds half to even, as the binary value stands."""
    return F.call_function("format_number", c, F.lit("0.00"))


def shortened(text: Column, limit: int = TEXT_LIMIT) -> Column:
    """Line feeds as spaces, and an ellipsis after the first `limit` characters of a longer text."""
    flat = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(flat)


def article_filename(number: Column, title: Column) -> Column:
    return F.when(number == 0, F.lit("000-preamble.html")).otherwise(F.format_string("%03d-%s.html", number, slug(title)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_format(path: Column) -> Column:
    """Lower-cased extension without its dot; '' for a name without one or a dotfile."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def emu_to_pt(c: Column) -> Column:
    return c / F.lit(EMU_PER_POINT)


def local_name(tag: Column) -> Column:
    """A namespaced tag without its namespace."""
    return F.regexp_replace(tag, r"^.*\}", "")


def utc_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def flatten_content(blocks: Column) -> Column:
    """The texts of a message's blocks (array of structs with `text`), one after the other; blocks without text add nothing."""
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "")
