"""Top-level nodes of HTML fragments, by the standard library's parser.

Only a fragment's outermost nodes matter for splitting: headings inside other elements count as their content. An end tag closes
everything up to the innermost open element of its name and is ignored where none is open; void elements hold nothing.
Nodes are written out again with `&`, `<` and `>` escaped in text. Nodes that are white space only aren't emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: HTML's void elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def escape_text(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class TopNodes(HTMLParser):
    """Collects (type, tag, html, strings) of the top-level nodes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, str | None, str, list[str]]] = []
        self.open: list[str] = []
        self.html: list[str] = []
        self.strings: list[str] = []

    def _done(self, tag: str) -> None:
        if not self.open:
            self.nodes.append(("tag", tag, "".join(self.html), self.strings))
            self.html, self.strings = [], []

    @staticmethod
    def _spelled(tag: str, attrs) -> str:
        return "<" + " ".join([tag, *(f'{k}="{escape_text(v or "").replace(chr(34), "&quot;")}"' for k, v in attrs)])

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.handle_startendtag(tag, attrs)
            return
        self.open.append(tag)
        self.html.append(self._spelled(tag, attrs) + ">")

    def handle_startendtag(self, tag, attrs):
        self.html.append(self._spelled(tag, attrs) + "/>")
        self._done(tag)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while True:
            top = self.open.pop()
            self.html.append(f"</{top}>")
            if top == tag:
                return self._done(tag)

    def handle_data(self, data):
        raw = self.open and self.open[-1] in ("script", "style")
        if self.open:
            self.html.append(data if raw else escape_text(data))
            self.strings.append(data)
        elif data.strip():
            self.nodes.append(("text", None, escape_text(data), [data]))

    def handle_comment(self, data):
        if self.open:
            self.html.append(f"<!--{data}-->")
        elif data.strip():
            self.nodes.append(("text", None, data, [data]))

    def close(self):
        super().close()
        if self.open:
            first = self.open[0]
            self.handle_endtag(first) if self.open.count(first) == 1 else self._close_all()

    def _close_all(self):
        first = self.open[0]
        while self.open:
            self.html.append(f"</{self.open.pop()}>")
        self._done(first)


def top_nodes(fragment: str | None) -> list[tuple[str, str | None, str, list[str]]]:
    parser = TopNodes()
    parser.feed(fragment or "")
    parser.close()
    return parser.nodes


def parse_nodes(fragments: DataFrame, with_html: bool = True) -> DataFrame:
    """fragments (doc_id, fragment) to nodes (doc_id, node_idx, node_type, tag, html, strings); without html (null), rows are light enough for counting."""
    kind = fragments.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for k, fragment in enumerate(batch.column(1).to_pylist()):
                nodes = top_nodes(fragment)
                owner += [k] * len(nodes)
                rows += [(i, *n) for i, n in enumerate(nodes)]
            idx, types, tags, html, strings = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(idx, pa.int32()), pa.array(types, pa.string()), pa.array(tags, pa.string()), pa.array(html if with_html else [None] * len(html), pa.string()), pa.array(strings, pa.list_(pa.string()))], names=["doc_id", "node_idx", "node_type", "tag", "html", "strings"])

    return fragments.select("doc_id", "fragment").mapInArrow(run, f"doc_id {kind}, node_idx int, node_type string, tag string, html string, strings array<string>")
