import io
import zipfile

import pytest

from quire import api
from quire.sources import docx, docx_writer, registry, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
BODY = (
    "<w:p><w:r><w:t>before</w:t></w:r></w:p><w:p/>"
    '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>One</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:jc w:val="both"/><w:ind w:firstLine="400" w:left="100"/><w:spacing w:line="360" w:before="240"/></w:pPr>'
    '<w:r><w:rPr><w:b/><w:sz w:val="24"/></w:rPr><w:t>bo</w:t></w:r><w:r><w:rPr><w:b/><w:sz w:val="24"/></w:rPr><w:t>ld</w:t></w:r><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:t> &lt;x&gt;</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Two</w:t></w:r></w:p>'
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("docx")
    (at / "one.docx").write_bytes(docx_writer.package(BODY))
    (at / "empty.docx").write_bytes(docx_writer.package(""))
    return at


@pytest.fixture(scope="module")
def corpus(spark, folder):
    return registry.read(spark, str(folder), "docx")


def test_blocks(corpus):
    rows = corpus.blocks.orderBy("idx").collect()
    assert [(r.kind, r.text, r.docx_para_idx, r.docx_table_idx, r.level) for r in rows] == [("paragraph", "before", 0, None, None), ("heading", "One", 2, None, 1), ("paragraph", "bold <x>", 3, None, None), ("table", "a | b\nc", None, 0, None), ("heading", "Two", 4, None, 1)]
    p = rows[2]
    assert [(s.text, s.bold, s.font_size_pt) for s in p.spans] == [("bold", True, 12.0), (" <x>", False, None)]
    assert (p.align, p.indent_first_line_pt, p.line_spacing, p.space_before_pt) == ("justify", 15.0, 1.5, 12.0)
    assert rows[3].rows[0][1].spans[0].text == "b" and rows[3].in_table


def test_documents_and_levels(corpus):
    docs = {r.doc_id.rsplit("/", 1)[-1]: r for r in corpus.docs.collect()}
    assert docs["one.docx"].metadata["python_docx_para_count"] == "5" and docs["empty.docx"].metadata["python_docx_table_count"] == "0"
    levels = {r.doc_id.rsplit("/", 1)[-1]: r.report for r in api.list_levels(corpus).collect()}
    assert levels == {"one.docx": "h1: 2", "empty.docx": "no headings found"}


def test_both_routes(corpus):
    html = [(r.number, r.title, r.html) for r in api.split_articles(corpus, 1).filter("doc_id like '%one.docx'").orderBy("number").collect()]
    assert html[0] == (0, "", "<p>before</p><p></p>")
    assert html[1][:2] == (1, "One") and "<strong>bold</strong> &lt;x&gt;" in html[1][2] and "<table>" in html[1][2]
    blocks = api.split_articles(corpus, 1, "blocks").orderBy("number").collect()
    assert [(r.number, r.title, r.html[:14], r.docx_para_indices, r.docx_table_indices) for r in blocks] == [(1, "", "<p>before</p>", [0], []), (2, "One", "<h1>One</h1><p", [2, 3], [0]), (3, "Two", "<h1>Two</h1>", [4], [])]


def test_fragment_and_fill():
    data = docx_writer.package(BODY)
    cut = docx.parse_body(docx_writer.fragment(data, [4, 2, 2], [0]))
    assert [(r["tag"], r.get("text")) for r in cut] == [("p", "One"), ("tbl", None), ("p", "Two")]
    with pytest.raises(ValueError, match=r"p \[-1, 5\]"):
        docx_writer.fragment(data, [-1, 5])
    filled = docx.parse_body(docx_writer.fill(data, {0: {"text": "new", "spans": []}, 3: {"text": "", "spans": [{"text": "X"}, {"text": "Y"}, {"text": "Z"}]}, 9: {"text": "lost"}}))
    assert filled[0]["text"] == "new" and [(r["text"], r["bold"]) for r in filled[3]["runs"]] == [("X", True), ("Y", True), ("Z", False)]


def test_cut_packages_keep_what_they_refer_to():
    """Images go with the paragraphs that show them, unless another part does; prefixes named in attributes stay declared."""
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    picture = lambda k: f'<w:p><w:r><w:drawing><a:blip r:embed="rId{k}"/></w:drawing></w:r></w:p>'
    main = f'<w:document {W} xmlns:r="{r}" xmlns:a="urn:a" xmlns:mc="urn:mc" xmlns:w14="urn:w14" mc:Ignorable="w14"><w:body>{picture(1)}{picture(2)}<w:p><w:r><w:t>t</w:t></w:r></w:p>{picture(3)}</w:body></w:document>'
    one = lambda k, target: f'<Relationship Id="rId{k}" Type="{r}/image" Target="{target}"/>'
    rels = lambda inner: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", main)
        z.writestr("word/_rels/document.xml.rels", rels(one(1, "media/a.png") + one(2, "media/b.png") + one(3, "/word/media/c.png") + f'<Relationship Id="rId9" Type="{r}/styles" Target="styles.xml"/>'))
        z.writestr("word/_rels/header1.xml.rels", rels(one(1, "media/c.png")))
        for name in ("styles.xml", "media/a.png", "media/b.png", "media/c.png"):
            z.writestr(f"word/{name}", name)
    with zipfile.ZipFile(io.BytesIO(docx_writer.fragment(out.getvalue(), [1, 2]))) as cut:
        assert {n for n in cut.namelist() if "_rels" not in n} == {"word/document.xml", "word/styles.xml", "word/media/b.png", "word/media/c.png"}
        relations = cut.read("word/_rels/document.xml.rels").decode()
        assert "rId2" in relations and "rId9" in relations and "rId1" not in relations and "rId3" not in relations
        again = cut.read("word/document.xml").decode()
        assert 'xmlns:w14="urn:w14"' in again and 'mc:Ignorable="w14"' in again and 'r:embed="rId2"' in again
    assert [p["text"] for p in docx.parse_body(docx_writer.fragment(out.getvalue(), [1, 2]))] == ["", "t"]
    with zipfile.ZipFile(io.BytesIO(docx_writer.fill(out.getvalue(), {2: {"text": "new"}}))) as whole:
        assert "word/media/a.png" in whole.namelist()


def test_write_and_put_back(spark, corpus, tmp_path):
    files = registry.write(corpus, str(tmp_path / "new"), "docx").collect()
    again = docx.parse_body((tmp_path / "new" / files[0].file).read_bytes())
    assert [r["tag"] for r in again] == ["p", "p", "p", "tbl", "p"] and again[1]["style_id"] == "Heading1"
    edited = corpus.blocks.selectExpr("doc_id", "idx", "kind", "docx_para_idx", "concat('[TR] ', text) AS text", "transform(spans, s -> struct(concat('[TR] ', s.text) AS text, s.bold, s.italic, s.underline, s.font_name, s.font_size_pt, s.color_rgb)) AS spans")
    back = {r.doc_id.rsplit("/", 1)[-1]: bytes(r.content) for r in docx_writer.put_back(corpus.files, edited).collect()}
    assert docx.parse_body(back["one.docx"])[2]["text"] == "[TR] One"
    assert zipfile.ZipFile(io.BytesIO(back["empty.docx"])).testzip() is None


def test_article_files(corpus, tmp_path):
    made = sorted(r.file for r in sinks.write_articles(api.split_articles(corpus, 1), str(tmp_path)).collect())
    assert [f.rsplit("/", 1)[-1] for f in made if "-one.docx-" in f] == ["000-preamble.html", "001-One.html", "002-Two.html", "index.html"]
    index = (tmp_path / next(f for f in made if "-one.docx-" in f and f.endswith("index.html"))).read_text()
    assert "<title>Articles: one.docx</title>" in index and "<h1>one.docx</h1>\n<p>3 article(s) split at heading level.</p>\n<ul>\n<li><a href=\"000-preamble.html\">preamble</a></li>" in index
    assert all((tmp_path / f).exists() for f in made) and not [p for p in tmp_path.rglob("*") if p.is_file() and p.suffix != ".html"]


def test_unknown_formats(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError):
        registry.read(spark, str(tmp_path / "missing.pdf"))
    (tmp_path / "x.pdf").write_bytes(b"")
    with pytest.raises(NotImplementedError, match="docx, html"):
        registry.read(spark, str(tmp_path / "x.pdf"))
    with pytest.raises(NotImplementedError):
        registry.write(None, str(tmp_path), "pdf")


def test_command(spark, folder, tmp_path, capsys):
    assert api.main(["--list-levels", str(folder / "one.docx")], spark) == 0
    assert "h1: 2" in capsys.readouterr().out
    assert api.main(["--split", str(folder / "one.docx"), "--out", str(tmp_path), "--quiet"], spark) == 0
    out = capsys.readouterr().out
    assert "articles: 3" in out and "preamble: yes" in out
    assert api.main(["--list-levels", "x.docx", "--level", "2"], spark) == 1
    assert api.main(["--convert", str(tmp_path / "none.docx")], spark) == 1


def test_stream_splits_whole_documents(spark, tmp_path):
    from quire.streaming.batches import split_stream

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "<h1>A</h1><p>x</p><h1>B</h1>")], "doc_id string, fragment string").write.parquet(str(tmp_path / "in" / "0"))
    source = spark.readStream.schema("doc_id string, fragment string").parquet(str(tmp_path / "in" / "*"))
    got = []
    query = split_stream(source, lambda df, nth: got.extend((r.number, r.title) for r in df.collect()), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert sorted(got) == [(1, "A"), (2, "B")]


def test_inspection_files(corpus, tmp_path):
    files = sinks.write_inspection(corpus.blocks, corpus.docs, str(tmp_path)).collect()
    pages = [(tmp_path / r.file).read_text() for r in files]
    assert len(pages) == 2 and any("style_id:Heading1" in p and "bold &lt;x&gt;" in p for p in pages) and any("<strong>Blocks:</strong> 0 " in p for p in pages)
    assert all(r.file.startswith("docproj-") for r in files)


def test_tools(spark, folder, tmp_path, monkeypatch):
    from quire import tools

    assert [t.__name__ for t in tools.default_tools()] == ["get_current_time", "list_docx_heading_levels", "convert_docx_to_html", "split_docx_by_headings"]
    assert tools.get_current_time("").endswith("+00:00") and "T" in tools.get_current_time("Europe/Berlin")
    with pytest.raises(ValueError, match="Unknown timezone: 'Mars/X'"):
        tools.get_current_time("Mars/X")
    one = str(folder / "one.docx")
    assert tools.list_docx_heading_levels(one, spark) == "h1: 2"
    said = tools.convert_docx_to_html(one, False, str(tmp_path), spark).split("\n")
    assert said[0] == f"source: {one}" and "<title>DocProj: one.docx</title>" in open(said[1].removeprefix("html: ")).read()
    monkeypatch.setattr(tools.webbrowser, "open", lambda url: False)
    said = tools.split_docx_by_headings(one, 2, True, str(tmp_path), spark)
    assert "note: no heading at level 2; document left whole\nheading levels in document:\n  h1: 2\nindex: " in said and "no browser opener found" in said
    said = tools.split_docx_by_headings(str(folder / "empty.docx"), 1, False, str(tmp_path), spark)
    assert "heading levels in document:\n  no headings found" in said
    with pytest.raises(ValueError):
        tools.split_docx_by_headings(one, 7, False, str(tmp_path), spark)
    monkeypatch.delenv("OPENAI_MODEL", raising=False)
    assert tools.load_settings().openai_model == "gpt-4o-mini"
