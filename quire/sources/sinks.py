"""Files with chosen names: written by the tasks into a temporary name, then moved into place, so a repeated task leaves one whole file."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.expr import slug
from quire.operators import page_formats as fixed
from quire.operators.render import article_index, article_pages, inspection_html


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """rows (file, content: binary or string) to files under folder; returns file, n_bytes of each. Names may hold slashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)
        mark = f"{TaskContext.get().taskAttemptId()}.{uuid.uuid4().hex}"
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ".." in name.split("/"):
                    raise ValueError(f"a file name must stay in its folder: {name!r}")
                target = f"{root}/{name}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{target}.{mark}") as out:
                    out.write(content)
                fs.move(f"{target}.{mark}", target)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["file", "n_bytes"])

    return rows.select("file", F.col("content").cast("binary").alias("content")).mapInArrow(run, "file string, n_bytes long")


def _folder(doc_id: Column) -> Column:
    """A document's own folder: its name, and a hash that tells equal names apart."""
    name = slug(F.element_at(F.split(doc_id.cast("string"), "/"), -1))
    return F.concat(F.lit(fixed.ARTICLE_FOLDERS), name, F.lit("-"), F.lower(F.hex(F.xxhash64(doc_id.cast("string")))))


def write_articles(articles: DataFrame, folder: str) -> DataFrame:
    """A folder for each document with a page for each article and an index; returns file, n_bytes."""
    at, name = _folder(F.col("doc_id")), F.element_at(F.split(F.col("doc_id").cast("string"), "/"), -1)
    pages = article_pages(articles, name).select(F.concat(at, F.lit("/"), F.col("file")).alias("file"), F.col("page").alias("content"))
    index = article_index(articles, name).select(F.concat(at, F.lit("/index.html")).alias("file"), F.col("index").alias("content"))
    return write_files(pages.unionByName(index), folder)


def write_pages(pages: DataFrame, folder: str, prefix: str = fixed.INSPECTION_FILES) -> DataFrame:
    """pages (doc_id, html) as one file each, with names that don't clash."""
    name = F.concat(F.lit(re.sub(r"[^\w-]", "-", prefix)), F.lower(F.hex(F.xxhash64(F.col("doc_id").cast("string")))), F.lit(".html"))
    return write_files(pages.select(name.alias("file"), F.col("html").alias("content")), folder)


def write_inspection(blocks: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """Each document's inspection page as a file of its own."""
    return write_pages(inspection_html(blocks, docs), folder)
