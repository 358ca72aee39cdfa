"""What users call: read, list levels, convert, split, write; and the same as a command."""

from __future__ import annotations

import argparse
import sys
import traceback

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import aggregates, page_formats, render, split
from quire.sources import docx, registry, sinks
from quire.sources.registry import Corpus, read, register_reader, register_writer, write  # noqa: F401


def list_levels(corpus: Corpus) -> DataFrame:
    """doc_id, report."""
    return aggregates.levels_text(aggregates.heading_counts(split.node_levels(corpus.nodes)), corpus.docs)


def convert(corpus: Corpus) -> DataFrame:
    """doc_id, html: each document as a page."""
    fragment = corpus.nodes.groupBy("doc_id").agg(render.in_order(F.col("html"), "node_idx", "").alias("fragment"))
    got = corpus.docs.select("doc_id", "source_path").join(fragment, "doc_id", "left")
    title = F.concat(F.lit(page_formats.TITLE), F.element_at(F.split("source_path", "/"), -1))
    return got.select("doc_id", render.document(F.coalesce("fragment", F.lit("")), title).alias("html"))


def split_articles(corpus: Corpus, level: int = 1, route: str = "html") -> DataFrame:
    """Articles by the html route, or by the blocks route with anchors back to the source."""
    if route == "html":
        return split.split_nodes(corpus.nodes, level, corpus.docs)
    if route != "blocks":
        raise ValueError(f"route must be html or blocks, not {route!r}")
    return split.split_blocks(corpus.blocks, level, corpus.docs) if corpus.body is None else docx.split_with_anchors(corpus.body, level)


def split_report(corpus: Corpus, level: int = 1) -> DataFrame:
    counts = aggregates.heading_counts(split.node_levels(corpus.nodes))
    return aggregates.split_report_text(split_articles(corpus, level), counts, corpus.docs, level)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    # fixed values: the options' names, the messages of misuse and the lines of the report
    parser = argparse.ArgumentParser(prog="quire", description="Inspects, converts and splits structured documents in bulk.")
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("--list-levels", metavar="PATH")
    what.add_argument("--convert", metavar="PATH")
    what.add_argument("--split", metavar="PATH")
    parser.add_argument("--level", type=int, choices=range(1, 7))
    parser.add_argument("--out", help="folder for the files that --convert and --split write", default=".tmp")
    parser.add_argument("--format")
    parser.add_argument("--quiet", action="store_true", help="print no list of the files")
    args = parser.parse_args(argv)
    if args.level and not args.split:
        print("error: --level goes with --split", file=sys.stderr)
        return 1
    if args.quiet and args.list_levels:
        print("error: --quiet goes with --convert or --split", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    try:
        corpus = registry.read(spark, args.list_levels or args.convert or args.split, args.format)
        if args.list_levels:
            for row in list_levels(corpus).orderBy("doc_id").toLocalIterator():
                print(f"{row.doc_id}\n{row.report}")
            return 0
        if args.convert:
            files = sinks.write_pages(convert(corpus), args.out, page_formats.SOURCE_FILES)
        else:
            level = args.level or 1
            files = sinks.write_articles(split_articles(corpus, level), args.out)
            for row in split_report(corpus, level).orderBy("doc_id").toLocalIterator():
                print(row.report)
        for row in files.toLocalIterator():
            if not args.quiet:
                print(f"html: {args.out}/{row.file}")
    except (FileNotFoundError, NotImplementedError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        traceback.print_exc()
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
