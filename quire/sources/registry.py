"""Readers and writers by format."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import docx, docx_writer, sinks


@dataclass
class Corpus:
    """Documents of one format: docs, blocks, top-level HTML nodes, and for files their bytes."""

    docs: DataFrame
    blocks: DataFrame
    nodes: DataFrame
    files: DataFrame | None = None
    body: DataFrame | None = None


def read_docx(spark: SparkSession, path: str) -> Corpus:
    files = docx.read_files(spark, path).filter("source_format = 'docx'")
    body = docx.body_rows(files)
    return Corpus(docx.documents(files, body), docx.blocks(body), docx.html_nodes(body), files, body)


def read_html(spark: SparkSession, path: str) -> Corpus:
    """Files that hold HTML fragments; they have nodes, but no blocks."""
    from quire.schema import BLOCKS
    from quire.sources.html_nodes import parse_nodes

    files = docx.read_files(spark, path)
    nodes = parse_nodes(files.select("doc_id", F.decode("content", "UTF-8").alias("fragment")))
    docs = files.select("doc_id", "source_path", "source_format", F.create_map(F.lit("reader"), F.lit("html")).alias("metadata"))
    return Corpus(docs, spark.createDataFrame([], BLOCKS), nodes, files)


READERS: dict[str, Callable[[SparkSession, str], Corpus]] = {"docx": read_docx, "html": read_html}


def write_docx(corpus: Corpus, folder: str, original: DataFrame | None = None) -> DataFrame:
    """With the original files, edits go back into them; without, packages are built from the blocks."""
    made = docx_writer.build(corpus.blocks) if original is None else docx_writer.put_back(original, corpus.blocks)
    stem = F.regexp_replace(F.element_at(F.split("doc_id", "/"), -1), r"\.docx$", "")
    name = F.concat(stem, F.lit("-"), F.lower(F.hex(F.xxhash64("doc_id"))), F.lit(".docx"))
    return sinks.write_files(made.select(name.alias("file"), "content"), folder)


WRITERS: dict[str, Callable[..., DataFrame]] = {"docx": write_docx}


def register_reader(fmt: str, reader: Callable[[SparkSession, str], Corpus]) -> None:
    """The last registration of a format wins."""
    READERS[fmt.lower()] = reader


def register_writer(fmt: str, writer: Callable[..., DataFrame]) -> None:
    WRITERS[fmt.lower()] = writer


def _of(path: str, fmt: str | None) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return (fmt or (name.rsplit(".", 1)[-1] if "." in name[1:] else "")).lower()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, which may be a pattern, names something in its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def read(spark: SparkSession, path: str, fmt: str | None = None) -> Corpus:
    """A file, folder or pattern. A path that doesn't exist is found out before its format."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    fmt = _of(path, fmt)
    if fmt not in READERS:
        raise NotImplementedError(f"no reader for {fmt!r}; there are {', '.join(sorted(READERS))}")
    return READERS[fmt](spark, path)


def write(corpus: Corpus, folder: str, fmt: str, original: DataFrame | None = None) -> DataFrame:
    if fmt.lower() not in WRITERS:
        raise NotImplementedError(f"no writer for {fmt!r}; there are {', '.join(sorted(WRITERS))}")
    return WRITERS[fmt.lower()](corpus, folder, **({} if original is None else {"original": original}))
