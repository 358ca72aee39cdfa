"""Small cases with known results, and a model in plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import expr, spans
from quire.operators import aggregates, backfill, render, selection, split
from quire.schema import SPAN
from quire.sources.html_nodes import parse_nodes, top_nodes


def html_split(spark, fragment, level=1):
    docs = spark.createDataFrame([("d", fragment)], "doc_id string, fragment string")
    return [(r.number, r.title, r.html) for r in split.split_nodes(parse_nodes(docs), level, docs).orderBy("number").collect()]


@pytest.mark.parametrize(
    "fragment, level, expected",
    [
        ("", 1, [(1, "", "")]),
        ("<p>a</p>", 1, [(1, "", "<p>a</p>")]),
        ("<p>x</p><h1>A</h1><p>a</p><h1>B</h1>", 1, [(0, "", "<p>x</p>"), (1, "A", "<h1>A</h1><p>a</p>"), (2, "B", "<h1>B</h1>")]),
        ("<div><h1>A</h1></div>", 1, [(1, "", "<div><h1>A</h1></div>")]),
        ("<h1>A</h1><h2>b</h2><h1>C</h1>", 2, [(0, "", "<h1>A</h1>"), (1, "b", "<h2>b</h2><h1>C</h1>")]),
        ("<h1> He<b>llo</b> </h1>", 1, [(1, "He llo", "<h1> He<b>llo</b> </h1>")]),
        ("<h1></h1><p>a</p>", 1, [(1, "", "<h1></h1><p>a</p>")]),
        ("<p>a</p> \n <h1>B</h1>", 1, [(0, "", "<p>a</p>"), (1, "B", "<h1>B</h1>")]),
    ],
)
def test_html_route(spark, fragment, level, expected):
    assert html_split(spark, fragment, level) == expected


def test_counts_only_top_level(spark):
    docs = spark.createDataFrame([(1, "<p>x</p><h1>A</h1><h1>B</h1><h3>c</h3>"), (2, "<div><h1>A</h1></div>")], "doc_id long, fragment string")
    counts = aggregates.heading_counts(split.node_levels(parse_nodes(docs)))
    assert sorted(map(tuple, counts.collect())) == [(1, 1, 2), (1, 3, 1)]
    assert sorted(map(tuple, aggregates.levels_text(counts, docs).collect())) == [(1, "h1: 2\nh3: 1"), (2, "no headings found")]
    assert aggregates.counts_map(counts).first().counts == {1: 2, 3: 1}


def test_an_untitled_single_article_counts_as_left_whole(spark):
    rows = spark.createDataFrame([(1, 1, ""), (2, 0, ""), (2, 1, "A")], "doc_id int, number int, title string")
    assert sorted(map(tuple, aggregates.split_report(rows).collect())) == [(1, 1, False, True), (2, 2, True, False)]


BLOCKS = "doc_id string, idx int, kind string, level int, text string, docx_para_idx int, docx_table_idx int"


def test_blocks_route(spark):
    rows = [("a", 0, "paragraph", None, "p", 0, None), ("a", 1, "heading", 1, " A ", 1, None), ("a", 2, "table", None, "t", None, 0), ("a", 3, "heading", 1, "B", 2, None), ("b", 0, "heading", 2, "H2", 0, None), ("b", 1, "paragraph", None, "p", 1, None), ("b", 2, "heading", 1, "H1", 2, None)]
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    got = split.split_blocks(spark.createDataFrame(rows, BLOCKS), 1, docs).orderBy("doc_id", "number").collect()
    assert [tuple(r) for r in got] == [("a", 1, "", [0], [0], []), ("a", 2, " A ", [1, 2], [1], [0]), ("a", 3, "B", [3], [2], []), ("b", 1, "H2", [0, 1], [0, 1], []), ("b", 2, "H1", [2], [2], []), ("c", 1, "", [], [], [])]


@pytest.mark.parametrize("level", [0, 7])
def test_level_is_checked(spark, level):
    with pytest.raises(ValueError):
        split.split_blocks(spark.createDataFrame([], BLOCKS), level)


def column(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("style, level", [("Heading1", 1), ("heading 2", 2), ("Heading10", 1), ("Heading0", 0), ("Heading7", 7), ("Title", None), (None, None), ("Heading1Char", 1)])
def test_style_level(spark, style, level):
    assert column(spark, style, "string", expr.style_level) == level


@pytest.mark.parametrize("title, slug", [("  A: b/c d?  ", "A-b-c-d"), ("***", "untitled"), ("", "untitled"), ("x" * 29 + " yz", "x" * 29 + "-"), ("第一章　总则", "第一章-总则")])
def test_slug(spark, title, slug):
    assert column(spark, title, "string", expr.slug) == slug


@pytest.mark.parametrize("c, name", [(0.8, "conf-high"), (0.79, "conf-med"), (0.5, "conf-med"), (0.49, "conf-low"), (float("nan"), "conf-low")])
def test_confidence(spark, c, name):
    assert column(spark, c, "double", expr.confidence_class) == name


def test_decimals_and_short_text(spark):
    assert column(spark, 0.125, "double", expr.two_decimals) == "0.12"
    assert column(spark, "a\n" * 100 + "b", "string", expr.shortened) == "a " * 100 + "…"
    assert column(spark, "<'&\">", "string", expr.html_escape) == "&lt;&#x27;&amp;&quot;&gt;"


def test_strip_equals_python(spark):
    every = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert column(spark, every + "a b" + every, "string", expr.ws_strip) == "a b"
    assert column(spark, every, "string", expr.is_blank) is True


def run(text, bold=None, size=None):
    return (text, bold, None, None, None, size, None)


def test_merging_runs(spark):
    made = spark.createDataFrame([([run("a", True), run("", False), run("b", True), run("c"), run("d", True)],), ([run("x", size=12.0), run("y"), run("z")],), ([],)], f"r array<{SPAN}>")
    got = [[(s.text, s.bold, s.font_size_pt) for s in r[0]] for r in made.select(spans.extract_spans(F.col("r"))).collect()]
    assert got == [[("ab", True, None), ("c", False, None), ("d", True, None)], [("x", False, 12.0), ("yz", False, None)], []]


def test_merging_thousands_of_runs(spark):
    rng = random.Random(12)
    runs = [run(rng.choice(["a", "b", ""]), rng.choice([True, False, None]), rng.choice([None, 12.0])) for _ in range(20000)]
    got = spark.createDataFrame([(runs,)], f"r array<{SPAN}>").select(spans.extract_spans(F.col("r"))).first()[0]
    want = []
    for r in runs:
        if not r[0]:
            continue
        if want and want[-1][1:] == [bool(r[1]), r[5]]:
            want[-1][0] += r[0]
        else:
            want.append([r[0], bool(r[1]), r[5]])
    assert [[s.text, s.bold, s.font_size_pt] for s in got] == want
    assert column(spark, None, f"array<{SPAN}>", spans.merge_adjacent) is None


def test_plain_and_table_text(spark):
    assert column(spark, run("a", False), SPAN, spans.is_plain) is True
    assert column(spark, ("a", False, False, False, "", None, None), SPAN, spans.is_plain) is False
    assert column(spark, [["a", "b"], ["c", "d"]], "array<array<string>>", spans.cells_text) == "a | b\nc | d"


def test_selection_and_bad_indices(spark):
    body = selection.body_counters(spark.createDataFrame([("d", k, "tbl" if k == 3 else "p") for k in range(7)], "doc_id string, body_pos int, tag string"))
    wanted = spark.createDataFrame([("d", "p", 5), ("d", "p", 2), ("d", "p", 2), ("d", "tbl", 0)], "doc_id string, tag string, kind_idx int")
    assert [r.body_pos for r in selection.checked_selection(body, wanted).orderBy("body_pos").collect()] == [2, 3, 6]
    bad = spark.createDataFrame([("d", "p", -1), ("d", "p", 6)], "doc_id string, tag string, kind_idx int")
    with pytest.raises(ValueError, match=r"\[-1, 6\]"):
        selection.checked_selection(body, bad)
    many = spark.createDataFrame([(f"d{k}", "p", k) for k in range(30)], "doc_id string, tag string, kind_idx int")
    with pytest.raises(ValueError, match="and 10 more"):
        selection.checked_selection(body, many)


def test_backfill(spark):
    original = spark.createDataFrame([("d", 0, [run("a", True), run("b")]), ("d", 1, [run("c")]), ("d", 2, [run("e")])], f"doc_id string, docx_para_idx int, runs array<{SPAN}>")
    edits = [("d", 0, "paragraph", 0, "old", None), ("d", 1, "paragraph", 0, "XY", [run("X"), run("Y")]), ("d", 2, "heading", 1, "new", []), ("d", 3, "paragraph", 9, "lost", []), ("d", 4, "image", None, "i", None)]
    blocks = spark.createDataFrame(edits, f"doc_id string, idx int, kind string, docx_para_idx int, text string, spans array<{SPAN}>")
    got = backfill.backfill(original, blocks).orderBy("docx_para_idx").collect()
    assert [(r.text, [s.bold for s in r.runs]) for r in got] == [("XY", [True, None]), ("new", [None]), ("e", [None])]


def test_rendering(spark):
    schema = "doc_id string, idx int, kind string, level int, text string, page_index int, kind_confidence double, signals array<string>"
    blocks = spark.createDataFrame([("d", 0, "heading", 2, "<A>", 0, 1.0, ["s", "t"]), ("d", 1, "", None, "x", 0, 0.4, [])], schema)
    rows = render.block_inspection(blocks).orderBy("idx").collect()
    assert [(r.label, r.signals) for r in rows] == [("H2", "s, t"), ("?", "—")]
    docs = spark.createDataFrame([("d", "/x/a&b.docx", "docx"), ("e", "/x/e.docx", "docx")], "doc_id string, source_path string, source_format string")
    pages = {r.doc_id: r.html for r in render.render(blocks, docs).collect()}
    assert "&lt;A&gt;" in pages["d"] and "<title>DocProj: a&amp;b.docx</title>" in pages["d"] and "<strong>Blocks:</strong> 0 " in pages["e"]
    assert '<tr class="conf-low"><td>1</td><td class="muted">?</td><td class="muted">0</td><td class="muted">0.40</td><td class="text">x</td><td class="muted">—</td></tr>\n</tbody>' in pages["d"]
    for fmt, error in (("markdown", "markdown"), ("pdf", "html, json, markdown")):
        with pytest.raises(NotImplementedError, match=error):
            render.render(blocks, docs, fmt)


TAGS = st.sampled_from(["<p>a</p>", "<h1>A</h1>", "<h2>B</h2>", " ", "t&amp;", "<div><h1>n</h1></div>", "<br>", "<!-- c -->", "<h1>x<p>y"])


def test_articles_hold_all_nodes(spark):
    rng = random.Random(5)
    some = ["".join(rng.choice(["<p>a</p>", "<h1>A</h1>", "<h2>B</h2>", " ", "t&amp;", "<div><h1>n</h1></div>", "<br>"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id int, fragment string")
    got = {}
    for r in split.split_nodes(parse_nodes(docs), 1, docs).orderBy("doc_id", "number").collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, fragment in enumerate(some):
        nodes = top_nodes(fragment)
        assert "".join(r.html for r in got[k]) == "".join(n[2] for n in nodes)
        heads = sum(n[1] == "h1" for n in nodes)
        assert sum(r.number > 0 for r in got[k]) == max(1, heads) if heads or len(got[k]) == 1 else True


@settings(max_examples=200, deadline=None)
@given(st.lists(TAGS, max_size=12))
def test_parser_never_fails_and_has_whole_nodes(parts):
    for kind, tag, html, strings in top_nodes("".join(parts)):
        assert html and kind in ("tag", "text") and (tag is None) == (kind == "text") and isinstance(strings, list)


def test_table_function(spark):
    from quire.functions.sql import register

    register(spark)
    spark.createDataFrame([("<h1>A <b>b</b></h1><p>x",)], "fragment string").createOrReplaceTempView("fragments")
    got = spark.sql("SELECT node_idx, tag, title FROM fragments, LATERAL html_top_nodes(fragment) ORDER BY node_idx").collect()
    assert [tuple(r) for r in got] == [(0, "h1", "A b"), (1, "p", "x")]


def test_message_content(spark):
    assert column(spark, [("a",), (None,), ("b",)], "array<struct<text:string>>", expr.flatten_content) == "ab"
