"""HTML extraction by removal of a site's template.

Every page is parsed into elements. Subtrees are hashed from their leaves up (element names and text, not attributes, which often
differ from page to page), Spark counts on how many pages of a host each occurs, and those that recur on many of them are
template: they are deleted, with what is by its nature no text (scripts, menus, headers, footers, sidebars, notices, adverts,
forms, reader comments, hidden parts). What is left of the article is the main text; pages without an article element give
the main element, or else the body, where nothing but recurrence tells unmarked template from text.

Copies of a page count as one. Inside an article, blocks of text, lists, tables and what holds them are never deleted for
recurring (articles do share passages); boxes are. A page that would lose all its text that way keeps it.

Edge cases: null or empty html and pages without text give ''; a null url counts as host ''; unclosed, misnested and cut-off
markup is read as browsers do in the common cases; a page of any length is read whole, in time linear in its length, however
deep, unclosed or misnested its markup. Repeated rows are rows; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_ROWS, small, written
from quire.llm.url_filter import url_parts

MIN_PAGES = 5  # of a host that hold a subtree, at least
MIN_SHARE = 0.1  # and this share of the host's pages

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Groups of element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th tr tbody thead caption figcaption article main body html ul ol dl table tfoot".split())
NO_TEXT = frozenset("head script style noscript template nav aside form footer button select option textarea input svg math iframe object embed applet canvas audio video dialog menu map title noembed noframes datalist".split())
#: An element of the first kind ends an open one of the second, unless one of the third lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
#: Words in a class, id or role that mark what is no part of an article.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar sidebars complementary footer contentinfo masthead topbar toolbar comment comments commentlist disqus respond replies share sharing social related recommended recommendations search searchbox skip widget widgets toc".split())


class Page:
    """Elements in page order (tag, parent, last: the last element inside, marked) and pieces of text with the element they lie in."""

    def __init__(self, text: str):
        self.tags, self.parent, self.last, self.marked = ["#"], [0], [0], [False]
        self.pieces: list[tuple[int, str | None]] = []  # None: a block begins or ends
        self.stack = [0]  # open elements
        self.open: dict[str, list[int]] = {}  # their places in the stack, by tag
        self.blocks: list[int] = []  # places of those that aren't inline
        self.quoted = True
        at = pos = 0
        while (lt := text.find("<", pos)) >= 0:
            two = text[lt + 1 : lt + 3]
            closing = two[:1] == "/"
            letter = two[closing : closing + 1]
            if text.startswith("<!--", lt):
                end = lt + 5 if text.startswith(">", lt + 4) else text.find("-->", lt + 4) + 3
                self._piece(text[at:lt])
                at = pos = len(text) if end < lt + 5 else end
                continue
            if not (letter.isascii() and letter.isalpha()):
                if two[:1] not in ("!", "?", "/"):
                    pos = lt + 1  # an ordinary character
                    continue
                gt, tag, name_end = text.find(">", lt), None, lt
            else:
                tag = NAME.match(text, lt + 1 + closing)
                name_end = tag.end()
                tag = tag[0].lower()
                gt = self._tag_end(text, name_end)
            self._piece(text[at:lt])
            if gt < 0:  # the end of the page cuts it off
                at = len(text)
                break
            at = pos = gt + 1
            if tag and closing:
                self._end_tag(tag)
            elif tag and self._start_tag(tag, text[name_end:gt]):
                found = RAW_END[tag].search(text, pos)
                stop = text.find(">", found.start()) if found else -1
                at = pos = len(text) if stop < 0 else stop + 1
        self._piece(text[at:])
        while len(self.stack) > 1:
            self._pop()
        self.last[0] = len(self.tags) - 1

    def _tag_end(self, text: str, pos: int) -> int:
        """Where the tag ends: the first `>` outside a quoted value; once a page's quotes don't match, the first one at all."""
        at = pos
        while self.quoted:
            m = QUOTE_OR_END.search(text, at)
            if m and not m[1]:
                return m.start()
            at = text.find(m[1], m.end()) + 1 if m else 0
            self.quoted = at > 0
        return text.find(">", pos)

    def _piece(self, text: str) -> None:
        if text:
            self.pieces.append((self.stack[-1], text))

    def _start_tag(self, tag: str, attributes: str) -> bool:
        """Opens an element; whether what follows is raw text."""
        if tag in ENDS_P and self.blocks and self.tags[self.stack[self.blocks[-1]]] == "p":
            self._close("p")
        if tag in ENDS:
            ended, between = ENDS[tag]
            while (hit := self._innermost(ended)) > self._innermost(between):
                self._close(self.tags[self.stack[hit]])
        if tag not in INLINE:
            self.pieces.append((self.stack[-1], None))
        elif tag == "br":
            self.pieces.append((self.stack[-1], " "))
        if tag in VOID:
            return False
        self.tags.append(tag)
        self.parent.append(self.stack[-1])
        self.last.append(len(self.tags) - 1)
        self.marked.append(bool(attributes) and is_marked(attributes))
        if tag in RAW:
            return True
        if not (attributes.endswith("/") and tag in ("svg", "path")):
            self.open.setdefault(tag, []).append(len(self.stack))
            if tag not in INLINE:
                self.blocks.append(len(self.stack))
            self.stack.append(len(self.tags) - 1)
        return False

    def _innermost(self, tags: set[str]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _end_tag(self, tag: str) -> None:
        if self.open.get(tag):
            self._close(tag)
        elif tag in ("br", "p"):
            self.pieces.append((self.stack[-1], " " if tag == "br" else None))

    def _close(self, tag: str) -> None:
        """Ends the innermost open element of that tag and all inside it."""
        place = self.open[tag][-1]
        while len(self.stack) > place:
            self._pop()

    def _pop(self) -> None:
        k = self.stack.pop()
        self.open[self.tags[k]].pop()
        self.last[k] = len(self.tags) - 1
        if self.tags[k] not in INLINE:
            self.blocks.pop()
            self.pieces.append((self.stack[-1], None))

    def roots(self) -> list[bool]:
        """For each element, whether it is in the main part: the articles, else main elements, else all."""
        n = len(self.tags)
        gone = [False] * n
        for k in range(1, n):
            gone[k] = gone[self.parent[k]] or self.tags[k] in NO_TEXT or (self.marked[k] and self.tags[k] in ("article", "main"))
        for want in ("article", "main"):
            tops = {k for k in range(1, n) if self.tags[k] == want and not gone[k]}
            if tops:
                inside = [False] * n
                for k in range(1, n):
                    inside[k] = k in tops or inside[self.parent[k]]
                return inside
        return [True] * n

    def hashes(self, inside: list[bool]) -> dict[int, int]:
        """Hashes of the subtrees that may be template and have text: blocks outside the article, and inside it boxes that aren't blocks of text. Elements around the article are not."""
        n, whole = len(self.tags), all(inside)
        holds = [tag in TEXT_BLOCKS for tag in self.tags]
        around = list(inside)
        parts: list[list[bytes]] = [[] for _ in range(n)]
        for k, piece in self.pieces:
            if piece and (words := piece.split()):
                parts[k].append(xxhash.xxh3_64_digest(" ".join(words)))
        out = {}
        for k in range(n - 1, 0, -1):  # whatever lies inside an element comes after it
            tag, up = self.tags[k], self.parent[k]
            holds[up] |= holds[k]
            around[up] |= around[k]
            if not parts[k]:
                continue
            digest = xxhash.xxh3_64_digest(f"{tag}>".encode("utf-8", "replace") + b"".join(parts[k]))
            parts[up].append(digest)
            exempt = tag in INLINE or tag in ("html", "body", "head", "article", "main")
            if not exempt and (whole or not (holds[k] if inside[k] else around[k])):
                out[k] = int.from_bytes(digest, "big") >> 1
        return out

    def text(self, recurring: frozenset[int] | set[int]) -> str:
        inside = self.roots()
        doomed = {k for k, h in self.hashes(inside).items() if h in recurring} if recurring else ()
        n, whole = len(self.tags), all(inside)
        titles = [k for k in range(n) if self.tags[k] == "h1"]
        gone = [False] * n
        for k in range(1, n):
            tag = self.tags[k]
            main = tag in ("article", "main", "body", "html") and not (self.marked[k] and tag in ("article", "main"))
            gone[k] = gone[self.parent[k]] and not (inside[k] and not inside[self.parent[k]]) or (not main and (tag in NO_TEXT or self.marked[k] or (tag == "header" and (whole or not holds_one(titles, k, self.last[k]))))) or k in doomed
        blocks, held = [], []
        for k, piece in self.pieces:
            if piece is None:
                if held:
                    blocks.append("".join(held))
                    held = []
            elif inside[k] and not gone[k]:
                held.append(entities.unescape(piece) if "&" in piece else piece)
        blocks.append("".join(held))
        text = "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)
        return text if text or not doomed else self.text(frozenset())


def holds_one(places: list[int], k: int, last: int) -> bool:
    """Whether one of the sorted places is beyond k and not beyond last."""
    at = bisect_right(places, k)
    return at < len(places) and places[at] <= last


def is_marked(attributes: str) -> bool:
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role") and not MARKS.isdisjoint(re.split(r"[\s_-]+", value)):
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def page_hashes(text: str | None) -> list[int]:
    """Different hashes of the page's subtrees that may be template."""
    if not text:
        return []
    page = Page(text)
    return sorted(set(page.hashes(page.roots()).values()))


def _hosted(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", url_parts(F.col("url"))[0].alias("host"), F.col("html").cast("string").alias("html"))


def recurring(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of the subtrees on at least min_pages pages and min_share of a host's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_hashes(t) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(f) + 1 for f in found], np.int64)
            hosts = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes)))
            flat = np.array([h for f in found for h in (-1, *f)], np.int64)  # -1: the page itself
            yield pa.RecordBatch.from_arrays([hosts, pa.array(flat)], names=["host", "hash"])

    rows = _hosted(pages).select("host", "html", F.xxhash64("host", "html").alias("page"))
    copied = small(written(rows.groupBy("page").count().filter("count > 1").select("page"), "pages-copied"))
    different = rows.join(copied, "page", "left_anti").unionByName(rows.join(copied, "page", "left_semi").dropDuplicates(["page"]))
    counts = different.select("host", "html").mapInArrow(run, "host string, hash long").groupBy("host", "hash").agg(F.count("*").alias("n"))
    counts = written(counts.filter((F.col("hash") < 0) | (F.col("n") >= min_pages)), "subtree-counts")
    size = counts.filter("hash < 0").select("host", F.col("n").alias("pages"))
    often = counts.filter("hash >= 0").join(size, "host").filter(F.col("n") >= min_share * F.col("pages"))
    return written(often.select("host", "hash"), "subtrees-recurring")


def _text_of(html: str | None, doomed) -> str:
    return Page(html).text(doomed) if html else ""


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    often = recurring(pages, min_pages, min_share)
    rows = _hosted(pages)
    schema = "page_id long, url string, text string, n_chars long"
    if often.count() <= broadcast_rows:  # a bounded list, which every task gets
        by_host: dict[str | None, set[int]] = {}
        for host, h in often.toLocalIterator():
            by_host.setdefault(host, set()).add(h)
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none: set[int] = set()
            for batch in batches:
                texts = [_text_of(h, shared.value.get(host, none)) for host, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "host", "html").mapInArrow(run, schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([page_hashes(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["page", "host", "found"])

    def run_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_text_of(h, set(d or ())) for h, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    # each page gets its own part of the list: what a host's pages share is never gathered in one place
    keyed = rows.withColumn("page", F.xxhash64("host", "html"))
    own = keyed.select("page", "host", "html").mapInArrow(listed, "page long, host string, found array<long>").dropDuplicates(["page"]).select("page", "host", F.explode("found").alias("hash"))
    doomed = own.join(often, ["host", "hash"]).groupBy("page").agg(F.collect_set("hash").alias("doomed"))
    return keyed.join(doomed, "page", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "doomed").mapInArrow(run_listed, schema)
