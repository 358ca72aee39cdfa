"""The operations as functions from text to text, for callers that work with names and strings: scripts, or an assistant's tool list."""

from __future__ import annotations

import os
import webbrowser
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire import api
from quire.operators import aggregates, page_formats, split
from quire.sources import registry, sinks


@dataclass(frozen=True)
class Settings:
    """What an assistant's client is configured with. The variables' names and the model's default."""

    openai_api_key: str | None
    openai_model: str
    openai_base_url: str | None


def load_settings() -> Settings:
    get = os.environ.get
    return Settings(get("OPENAI_API_KEY"), get("OPENAI_MODEL", "gpt-4o-mini"), get("OPENAI_BASE_URL"))


def get_current_time(timezone_name: str = "UTC") -> str:
    """The time in a named zone, ISO 8601; an empty name is UTC."""
    try:
        return datetime.now(ZoneInfo(timezone_name or "UTC")).isoformat()
    except ZoneInfoNotFoundError:
        raise ValueError(f"Unknown timezone: {timezone_name!r}") from None


def open_in_browser(path: str) -> str:
    """Never raises: a machine without a browser is told of in the answer."""
    try:
        opened = webbrowser.open(path if "://" in path else f"file://{os.path.abspath(path)}")
    except (webbrowser.Error, OSError) as e:
        return f"could not open browser ({e}); open manually: {path}"
    return f"opened: {path}" if opened else f"no browser opener found; open manually: {path}"


def _spark(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.builder.appName("quire").getOrCreate()


def list_docx_heading_levels(file_path: str, spark: SparkSession | None = None) -> str:
    """A line for each level that the document has, or that it has none."""
    return "\n".join(r.report for r in api.list_levels(registry.read(_spark(spark), file_path)).orderBy("doc_id").toLocalIterator())


def convert_docx_to_html(file_path: str, open_browser: bool = True, folder: str = ".tmp", spark: SparkSession | None = None) -> str:
    """Writes the document as one page; answers with the source and the page's place."""
    corpus = registry.read(_spark(spark), file_path)
    made = [f"{folder}/{r.file}" for r in sinks.write_pages(api.convert(corpus), folder, page_formats.SOURCE_FILES).toLocalIterator()]
    lines = [f"source: {file_path}", *(f"html: {p}" for p in made)]
    return "\n".join(lines + [open_in_browser(p) for p in made if open_browser])


def split_docx_by_headings(file_path: str, level: int = 1, open_browser: bool = True, folder: str = ".tmp", spark: SparkSession | None = None) -> str:
    """Writes a page for each article and an index; answers with the report of the split, its level inventory indented by two spaces."""
    corpus = registry.read(_spark(spark), file_path)
    articles = api.split_articles(corpus, level)
    files = sinks.write_articles(articles, folder).filter(F.col("file").endswith("/index.html"))
    indexes = [f"{folder}/{r.file}" for r in files.toLocalIterator()]
    counts = aggregates.heading_counts(split.node_levels(corpus.nodes))
    reports = aggregates.split_report_text(articles, counts, corpus.docs, level, indent="  ").orderBy("doc_id")
    lines = [r.report.replace("\nno headings found", "\n  no headings found") for r in reports.toLocalIterator()]
    lines += [f"index: {p}" for p in indexes]
    return "\n".join(lines + [open_in_browser(p) for p in indexes if open_browser])


def default_tools() -> list[Callable[..., str]]:
    return [get_current_time, list_docx_heading_levels, convert_docx_to_html, split_docx_by_headings]
