"""Writing Word documents: minimal packages from blocks, edits put back into the original package, and fragments cut out of one."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from copy import deepcopy
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.backfill import COLOUR
from quire.sources.docx import W, run_text

#: The parts of a package that every reader expects.
TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
JC = {"center": "center", "right": "right", "justify": "both"}
SPACE = "{http://www.w3.org/XML/1998/namespace}space"
ElementTree.register_namespace("w", W[1:-1])


def run_xml(span: dict) -> str:
    """A run with the attributes that are set; a colour that isn't six hexadecimal digits is left out."""
    p = []
    if span.get("font_name"):
        p.append(f'<w:rFonts w:ascii="{escape(span["font_name"], {chr(34): "&quot;"})}"/>')
    p += [f"<w:{tag}/>" for key, tag in (("bold", "b"), ("italic", "i")) if span.get(key)]
    if span.get("color_rgb") and re.match(COLOUR, span["color_rgb"]):
        p.append(f'<w:color w:val="{span["color_rgb"]}"/>')
    if span.get("font_size_pt"):
        p.append(f'<w:sz w:val="{round(span["font_size_pt"] * 2)}"/>')
    if span.get("underline"):
        p.append('<w:u w:val="single"/>')
    text = escape(span["text"]).replace("\t", "</w:t><w:tab/><w:t xml:space=\"preserve\">").replace("\n", "</w:t><w:br/><w:t xml:space=\"preserve\">")
    return f'<w:r>{"<w:rPr>" + "".join(p) + "</w:rPr>" if p else ""}<w:t xml:space="preserve">{text}</w:t></w:r>'


def paragraph_xml(spans: Iterable[dict], style: str | None = None, align: str | None = None) -> str:
    p = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:jc w:val="{JC[align]}"/>' if align in JC else "")
    return f'<w:p>{"<w:pPr>" + p + "</w:pPr>" if p else ""}{"".join(map(run_xml, spans))}</w:p>'


def block_xml(block: dict) -> str:
    """Headings keep their text only, tables become a grid as wide as their widest row (empty ones nothing), images a line of text."""
    kind, text = block["kind"], block.get("text") or ""
    if kind == "heading":
        return paragraph_xml([{"text": text}], style=f"Heading{block['level']}")
    if kind == "image":
        return paragraph_xml([{"text": f"[image placeholder: {text!r}]"}])
    if kind == "table":
        rows = block.get("rows")
        wide = max((len(r) for r in rows), default=0) if rows is not None else 0
        if not wide:
            return ""
        # the spans of a cell stand in paragraphs of their own
        cell = lambda c: "<w:tc>" + ("".join(paragraph_xml([s]) for s in (c["spans"] if c else ())) or "<w:p/>") + "</w:tc>"
        return "<w:tbl>" + "".join("<w:tr>" + "".join(cell(r[k] if k < len(r) else None) for k in range(wide)) + "</w:tr>" for r in rows) + "</w:tbl>"
    spans = block.get("spans")
    return paragraph_xml(spans if spans is not None and len(spans) else [{"text": text}], align=block.get("align"))


def package(body_xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", TYPES)
        z.writestr("_rels/.rels", RELS)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body_xml}<w:sectPr/></w:body></w:document>')
    return out.getvalue()


MAIN, MAIN_RELATIONS = "word/document.xml", "word/_rels/document.xml.rels"
#: Fixed value: the namespace of references to a package's relations.
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _spelled(root, original: bytes) -> bytes:
    """A main part with the prefixes of the original, declared even where unused: markup names some of them in attribute values."""
    known = dict(found for _, found in ElementTree.iterparse(io.BytesIO(original), events=["start-ns"]))
    for prefix, uri in known.items():
        if prefix and not re.match(r"ns\d+$", prefix):
            ElementTree.register_namespace(prefix, uri)
    text = ElementTree.tostring(root, encoding="unicode")
    head = text[: text.index(">")]
    lost = "".join(f' xmlns:{p}="{escape(u, {chr(34): "&quot;"})}"' for p, u in known.items() if p and f"xmlns:{p}=" not in head)
    at = len(head) - head.endswith("/")
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{text[:at]}{lost}{text[at:]}'.encode()


def _unused_images(package_: zipfile.ZipFile, root) -> tuple[bytes | None, set[str]]:
    """The main part's relations without images that it no longer refers to, and the names of parts that only those were for."""
    names = set(package_.namelist())
    if MAIN_RELATIONS not in names:
        return None, set()
    used = {v for node in root.iter() for k, v in node.attrib.items() if k.startswith(R)}
    relations = ElementTree.fromstring(package_.read(MAIN_RELATIONS))
    target = lambda r, base: posixpath.normpath(posixpath.join("/", base, r.get("Target"))).lstrip("/")
    gone = [r for r in relations if r.get("Type", "").endswith("/image") and r.get("Id") not in used and r.get("TargetMode") != "External"]
    for r in gone:
        relations.remove(r)
    kept = {target(r, "word") for r in relations}
    for name in names:
        if name.endswith(".rels") and name != MAIN_RELATIONS:
            base = posixpath.dirname(posixpath.dirname(name))
            kept |= {target(r, base) for r in ElementTree.fromstring(package_.read(name)) if r.get("Target")}
    ElementTree.register_namespace("", "http://schemas.openxmlformats.org/package/2006/relationships")
    return ElementTree.tostring(relations, encoding="UTF-8", xml_declaration=True), {target(r, "word") for r in gone} - kept


def _with_document(original: bytes, root, trim: bool = False) -> bytes:
    """The package with another main part; styles, numbering and all else stay as they are, but for images without a reference if trim is set."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(original)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        relations, gone = _unused_images(old, root) if trim else (None, set())
        for item in old.infolist():
            if item.filename == MAIN:
                new.writestr(MAIN, _spelled(root, old.read(MAIN)))
            elif item.filename == MAIN_RELATIONS and relations is not None:
                new.writestr(MAIN_RELATIONS, relations)
            elif item.filename not in gone:
                new.writestr(item.filename, old.read(item.filename))
    return out.getvalue()


def _body(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return root, root.find(W + "body")


def fill(original: bytes, edits: dict[int, dict]) -> bytes:
    """The package with the edited paragraphs (by index); runs keep their formats where their number is the spans'."""
    root, body = _body(original)
    paragraphs = body.findall(W + "p")
    for k, edit in edits.items():
        if not 0 <= k < len(paragraphs):
            continue
        p, spans = paragraphs[k], edit.get("spans")
        runs, spans = p.findall(W + "r"), [] if spans is None else list(spans)
        with_text = [r for r in runs if run_text(r)]  # runs that hold images or nothing stay where they are
        if spans and len(spans) == len(with_text):
            for r, s in zip(with_text, spans, strict=True):
                _set_text(r, s["text"])
            continue
        for r in with_text:
            p.remove(r)
        for s in spans or [{"text": edit.get("text") or ""}]:
            p.append(ElementTree.fromstring(f'<w:p xmlns:w="{W[1:-1]}">{run_xml(s)}</w:p>')[0])
    return _with_document(original, root)


def _set_text(run, text: str) -> None:
    for part in [x for x in run if x.tag in {W + t for t in ("t", "tab", "br", "cr", "noBreakHyphen")}]:
        run.remove(part)
    t = ElementTree.SubElement(run, W + "t", {SPACE: "preserve"})
    t.text = text


def fragment(original: bytes, paragraphs: Iterable[int], tables: Iterable[int] = ()) -> bytes:
    """A package with only the asked paragraphs and tables and the images they refer to, each once, in the body's order; indices out of range are an error."""
    root, body = _body(original)
    want = {W + "p": set(paragraphs), W + "tbl": set(tables)}
    bad = {tag[len(W) :]: sorted(i for i in ids if not 0 <= i < len(body.findall(tag))) for tag, ids in want.items()}
    if any(bad.values()):
        raise ValueError("indices out of range: " + ", ".join(f"{t} {v}" for t, v in bad.items() if v))
    seen = {tag: 0 for tag in want}
    for node in list(body):
        if node.tag in want:
            keep = seen[node.tag] in want[node.tag]
            seen[node.tag] += 1
        else:
            keep = node.tag == W + "sectPr"
        if not keep:
            body.remove(node)
    last = body.find(W + "sectPr")
    if last is not None:
        body.remove(last)
    body.append(deepcopy(last) if last is not None else ElementTree.Element(W + "sectPr"))
    return _with_document(original, root, trim=True)


OUT = "doc_id string, content binary"


def build(blocks: DataFrame) -> DataFrame:
    """doc_id, content: a package made of each document's blocks."""

    def make(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["idx"])
        return pa.table({"doc_id": [rows[0]["doc_id"]], "content": [package("".join(map(block_xml, rows)))]}, schema=pa.schema([("doc_id", pa.string()), ("content", pa.binary())]))

    need = blocks.select(F.col("doc_id").cast("string").alias("doc_id"), *(c for c in ("idx", "kind", "text", "level", "spans", "align", "rows") if c in blocks.columns))
    return need.groupBy("doc_id").applyInArrow(make, OUT)


def _each(rows: DataFrame, make) -> DataFrame:
    """doc_id, content: make(row as a dict) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]], pa.string()), pa.array([make(row)], pa.binary())], names=["doc_id", "content"])

    return rows.mapInArrow(run, OUT)


def put_back(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, content: the original packages (doc_id, content) with the texts of their blocks."""
    edits = blocks.filter(F.col("kind").isin("paragraph", "heading") & F.col("docx_para_idx").isNotNull())
    last = edits.groupBy("doc_id", "docx_para_idx").agg(F.max_by(F.struct("text", "spans"), F.col("idx")).alias("e"))
    per = last.groupBy("doc_id").agg(F.collect_list(F.struct("docx_para_idx", "e.text", "e.spans")).alias("edits"))
    rows = files.select("doc_id", "content").join(per, "doc_id", "left")
    return _each(rows, lambda r: fill(r["content"], {e["docx_para_idx"]: e for e in r["edits"] or ()}))


def cut_fragments(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, content: of each file what wanted (doc_id, docx_para_indices, docx_table_indices) names."""
    rows = files.select("doc_id", "content").join(wanted.select("doc_id", "docx_para_indices", "docx_table_indices"), "doc_id")
    return _each(rows, lambda r: fragment(r["content"], r["docx_para_indices"], r["docx_table_indices"]))
