"""Registered queries of the document operators over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import expr, spans
from quire.operators import aggregates, backfill, render, selection, split
from quire.operators.split import is_boundary, membership
from quire.schema import CELL
from quire.sources import docx, docx_writer
from quire.sources.adapters import block_nodes, conversation_blocks, event_rows, line_blocks, load, order_runs, page_articles
from quire.sources.html_nodes import parse_nodes

REGISTERED: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        REGISTERED[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: The characters that Unicode-aware stripping removes, for RE2.
WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


TEXT_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def slug_sql(c: str) -> str:
    return f"coalesce(nullif(substr(regexp_replace(regexp_replace({c}, '[<>:\"/\\\\|?*{WS}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30), ''), 'untitled')"


def file_sql(number: str, title: str) -> str:
    return f"CASE WHEN {number} = 0 THEN '000-preamble.html' ELSE printf('%03d', {number}) || '-' || {slug_sql(title)} || '.html' END"


CONV = "SELECT conv_id AS doc_id, turn::INTEGER AS idx, role = 'user' AS head, CASE WHEN role = 'user' THEN 1 END AS level, text FROM conversations"
LINES = """SELECT doc_id, idx::INTEGER AS idx, text, CASE WHEN length(text) BETWEEN 1 AND 40 THEN 1 WHEN length(text) BETWEEN 41 AND 80 THEN 2 END AS level
FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS idx FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def parts_sql(blocks: str, boundary: str) -> str:
    return f"b AS ({blocks}), p AS (SELECT *, (sum(CASE WHEN {boundary} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx))::INTEGER AS part FROM b)"


def html_split_sql(blocks: str, level: int) -> str:
    node = f"'<h' || level || '>' || {ESC.format('text')} || '</h' || level || '>'"
    return f"""
WITH {parts_sql(blocks, f"level = {level}")},
n AS (SELECT *, CASE WHEN level IS NOT NULL THEN {node} ELSE '<p>' || {ESC.format("text")} || '</p>' END AS html FROM p),
g AS (SELECT doc_id, part, string_agg(html, '' ORDER BY idx) AS html, {strip_sql("arg_min(text, idx)")} AS head FROM n GROUP BY doc_id, part),
m AS (SELECT *, max(part) OVER (PARTITION BY doc_id) AS most FROM g)
SELECT doc_id, (CASE WHEN most = 0 THEN 1 ELSE part END)::INTEGER AS number, CASE WHEN part > 0 THEN head ELSE '' END AS title, html FROM m"""


def block_split_sql(blocks: str, level: int) -> str:
    return f"""
WITH {parts_sql(blocks, f"level = {level}")},
g AS (SELECT doc_id, part, arg_min(CASE WHEN level IS NOT NULL THEN text ELSE '' END, idx) AS title, string_agg(idx, ',' ORDER BY idx) AS block_indices FROM p GROUP BY doc_id, part)
SELECT doc_id, (CASE WHEN min(part) OVER (PARTITION BY doc_id) = 0 THEN part + 1 ELSE part END)::INTEGER AS number, title, block_indices FROM g"""


def _conv(spark: SparkSession, d: str) -> DataFrame:
    return conversation_blocks(load(spark, d, "conversations"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return line_blocks(load(spark, d, "documents"))


def _joined(articles: DataFrame) -> DataFrame:
    return articles.select("doc_id", "number", "title", F.array_join(F.transform("block_indices", lambda i: i.cast("string")), ",").alias("block_indices"))


@query(html_split_sql(CONV, 1))
def split_conversations(spark, d):
    return split.split_nodes(block_nodes(_conv(spark, d)), 1)


@query(block_split_sql(CONV, 1))
def split_conversations_blocks_route(spark, d):
    return _joined(split.split_blocks(_conv(spark, d), 1))


@query(html_split_sql(CONV, 6))
def split_no_boundary(spark, d):
    return split.split_nodes(block_nodes(_conv(spark, d)), 6)


@query(html_split_sql(LINES, 1))
def split_documents_l1(spark, d):
    return split.split_nodes(block_nodes(_lines(spark, d)), 1)


@query(html_split_sql(LINES, 2))
def split_documents_l2(spark, d):
    return split.split_nodes(block_nodes(_lines(spark, d)), 2)


@query(block_split_sql(LINES, 1))
def split_anchors(spark, d):
    return _joined(split.split_blocks(_lines(spark, d), 1))


@query(f"WITH {parts_sql(LINES, 'level = 1')} SELECT doc_id, idx, part FROM p")
def article_membership(spark, d):
    return membership(_lines(spark, d), is_boundary(1), "idx").select("doc_id", "idx", "part")


@query(f"SELECT level::INTEGER AS level, count(*)::BIGINT AS n FROM ({LINES}) WHERE level IS NOT NULL GROUP BY level")
def heading_counts(spark, d):
    return aggregates.heading_counts(_lines(spark, d)).groupBy("level").agg(F.sum("n").alias("n"))


@query(f"SELECT doc_id, level::INTEGER AS level, count(*)::BIGINT AS n FROM ({LINES}) WHERE level IS NOT NULL GROUP BY ALL")
def heading_counts_by_doc(spark, d):
    return aggregates.heading_counts(_lines(spark, d))


def levels_sql(indent: str) -> str:
    return f"""c AS (SELECT doc_id, level, count(*) AS n FROM ({LINES}) WHERE level IS NOT NULL GROUP BY ALL),
t AS (SELECT doc_id, string_agg('{indent}h' || level || ': ' || n, chr(10) ORDER BY level) AS r FROM c GROUP BY doc_id),
lv AS (SELECT DISTINCT d.doc_id, coalesce(r, 'no headings found') AS report FROM documents d LEFT JOIN t USING (doc_id))"""


@query(f"WITH {levels_sql('')} SELECT doc_id, report FROM lv")
def list_levels_text(spark, d):
    return aggregates.levels_text(heading_counts_by_doc(spark, d), load(spark, d, "documents"))


def report_sql(blocks: str, level: int) -> str:
    return f"""a AS ({html_split_sql(blocks, level)}),
r AS (SELECT doc_id, count(*)::BIGINT AS articles, bool_or(number = 0) AS has_preamble, count(*) = 1 AND max(title) = '' AS left_whole FROM a GROUP BY doc_id)"""


@query(f"WITH {report_sql(LINES, 1)} SELECT doc_id, articles, has_preamble, left_whole FROM r")
def split_report(spark, d):
    return aggregates.split_report(split_documents_l1(spark, d))


@query(f"WITH {report_sql(CONV, 1)} SELECT doc_id, articles, has_preamble, left_whole FROM r")
def split_report_conversations(spark, d):
    return aggregates.split_report(split_conversations(spark, d))


@query(f"""WITH {levels_sql("")}, {report_sql(LINES, 1)}
SELECT doc_id, concat_ws(chr(10), 'source: ' || doc_id, 'level: 1', 'articles: ' || articles, CASE WHEN has_preamble THEN 'preamble: yes (content before the first heading)' END,
  CASE WHEN left_whole THEN 'note: no heading at level 1; document left whole' END, 'heading levels in document:' || chr(10) || report) AS report FROM r JOIN lv USING (doc_id)""")
def split_report_text(spark, d):
    return aggregates.split_report_text(split_documents_l1(spark, d), heading_counts_by_doc(spark, d), load(spark, d, "documents"), 1)


@query(f"SELECT doc_id, number, title, {file_sql('number', 'title')} AS file FROM ({html_split_sql(LINES, 1)})")
def article_filename(spark, d):
    return split_documents_l1(spark, d).select("doc_id", "number", "title", expr.article_filename(F.col("number"), F.col("title")).alias("file"))


@query(f"SELECT doc_id, idx, {slug_sql('text')} AS slug FROM ({LINES})")
def slug_titles(spark, d):
    return _lines(spark, d).select("doc_id", "idx", expr.slug(F.col("text")).alias("slug"))


@query(f"SELECT doc_id, idx, {strip_sql('text')} AS stripped, NOT regexp_matches(text, '[^{WS}]') AS blank FROM ({LINES})")
def strip_text(spark, d):
    return _lines(spark, d).select("doc_id", "idx", expr.ws_strip(F.col("text")).alias("stripped"), expr.is_blank(F.col("text")).alias("blank"))


@query(f"""SELECT doc_id, idx, CASE WHEN level IS NOT NULL THEN 'H' || level ELSE 'para' END AS label, 0 AS page,
  CASE idx % 4 WHEN 0 THEN '1.00' WHEN 1 THEN '0.75' WHEN 2 THEN '0.50' ELSE '0.25' END AS confidence, CASE idx % 4 WHEN 0 THEN 'conf-high' WHEN 1 THEN 'conf-med' WHEN 2 THEN 'conf-med' ELSE 'conf-low' END AS confidence_class,
  CASE WHEN length(replace(text, chr(10), ' ')) > 200 THEN left(replace(text, chr(10), ' '), 200) || '…' ELSE replace(text, chr(10), ' ') END AS text,
  CASE WHEN level IS NOT NULL THEN 'line, short' ELSE '—' END AS signals FROM ({LINES})""")
def block_inspection(spark, d):
    return render.block_inspection(_inspected(_lines(spark, d)))


def _inspected(blocks: DataFrame) -> DataFrame:
    signals = F.when(F.col("level").isNotNull(), F.array(F.lit("line"), F.lit("short"))).otherwise(F.array().cast("array<string>"))
    return blocks.withColumns({"page_index": F.lit(0), "kind_confidence": 1 - (F.col("idx") % 4) * F.lit(0.25), "signals": signals})


@query(f"SELECT page_id, {ESC.format('html')} AS escaped FROM pages")
def html_escape_text(spark, d):
    return load(spark, d, "pages").select("page_id", expr.html_escape(F.col("html")).alias("escaped"))


#: The pages' text as the SQL spells it, apart from the renderer's own templates. Line feeds are written as they are.
PAGE_HEAD = "<!doctype html>\n<html lang=\"en\">\n<head>\n<meta charset=\"utf-8\">\n<title>"
PAGE_STYLE = "</title>\n<style>\n  /* Empty <p> elements (preserved from the source docx) collapse to\n     zero height by default; force them to take a full line. */\n  p:empty { margin: 1em 0; }\n</style>\n</head>\n<body>\n"
PAGE_FOOT = "\n</body>\n</html>\n"


def page_sql(title: str, fragment: str) -> str:
    return f"'{PAGE_HEAD}' || {title} || '{PAGE_STYLE}' || {fragment} || '{PAGE_FOOT}'"


_ITEM = f"""'<li><a href="' || {file_sql("number", "title")} || '">' || {ESC.format("coalesce(nullif(title, ''), 'preamble')")} || '</a></li>'"""
_LIST = f"""'<h1>' || doc_id || '</h1>' || chr(10) || '<p>' || count(*) || ' article(s) split at heading level.</p>' || chr(10) || '<ul>' || chr(10) || string_agg({_ITEM}, chr(10) ORDER BY number) || chr(10) || '</ul>'"""


@query(f"SELECT doc_id, {page_sql("'Articles: ' || doc_id", _LIST)} AS index FROM ({html_split_sql(CONV, 1)}) GROUP BY doc_id")
def article_index_html(spark, d):
    return render.article_index(split_conversations(spark, d))


@query(f"""SELECT doc_id, number, {file_sql("number", "title")} AS file, {page_sql(ESC.format("coalesce(nullif(title, ''), doc_id::VARCHAR)"), "html")} AS page
FROM ({html_split_sql(CONV, 1)})""")
def article_pages(spark, d):
    return render.article_pages(split_conversations(spark, d))


_SHOWN = "CASE WHEN length(replace(text, chr(10), ' ')) > 200 THEN left(replace(text, chr(10), ' '), 200) || '…' ELSE replace(text, chr(10), ' ') END"
_ROW = f"""'<tr class="conf-' || CASE idx % 4 WHEN 0 THEN 'high' WHEN 3 THEN 'low' ELSE 'med' END || '"><td>' || idx || '</td><td class="muted">' || CASE WHEN level IS NULL THEN 'para' ELSE 'H' || level END
|| '</td><td class="muted">0</td><td class="muted">' || CASE idx % 4 WHEN 0 THEN '1.00' WHEN 1 THEN '0.75' WHEN 2 THEN '0.50' ELSE '0.25' END || '</td><td class="text">' || {ESC.format(_SHOWN)}
|| '</td><td class="muted">' || CASE WHEN level IS NULL THEN '—' ELSE 'line, short' END || '</td></tr>'"""
#: The style sheet is left out of the comparison: what lies between its tags is cosmetic and long.
_REST = f"""'<body>' || chr(10) || '<h1>DocProj: d' || doc_id || '.conv</h1>' || chr(10) || '<p class="meta"><strong>Format:</strong> conv &middot; <strong>Blocks:</strong> ' || count(*) || ' &middot; <strong>Path:</strong> /corpus/d' || doc_id || '.conv</p>' || chr(10)
|| '<table>' || chr(10) || '<thead><tr><th>idx</th><th>kind</th><th>page</th><th>conf</th><th>text</th><th>signals</th></tr></thead>' || chr(10) || '<tbody>' || chr(10) || string_agg({_ROW}, chr(10) ORDER BY idx) || chr(10) || '</tbody>' || chr(10) || '</table>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)"""


@query(f"SELECT doc_id, '{PAGE_HEAD}' || 'DocProj: d' || doc_id || '.conv</title>' AS head, {_REST} AS body FROM ({CONV}) GROUP BY doc_id")
def inspection_pages(spark, d):
    blocks = _conv(spark, d)
    path = F.concat(F.lit("/corpus/d"), F.col("doc_id").cast("string"), F.lit(".conv"))
    docs = blocks.select("doc_id").distinct().select("doc_id", path.alias("source_path"), F.lit("conv").alias("source_format"))
    pages = render.inspection_html(_inspected(blocks), docs)
    return pages.select("doc_id", F.regexp_extract("html", "(?s)^(.*?</title>)", 1).alias("head"), F.regexp_extract("html", "(?s)<body>.*$", 0).alias("body"))


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY k) OR k = 1 AS starts FROM o),
g AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY user_id ORDER BY k) AS island FROM f)
SELECT user_id AS doc_id, (island - 1)::INTEGER AS idx, any_value(event_type) AS font_name, string_agg(event_id::VARCHAR, '' ORDER BY k) AS text FROM g GROUP BY user_id, island""")
def merge_adjacent_spans(spark, d):
    return spans.merge_rows(event_rows(load(spark, d, "events")), "doc_id", ["ts", "event_id"], ["font_name"])


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS k FROM lineitem),
f AS (SELECT *, l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY k) OR k = 1 AS starts FROM o),
g AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY k) AS island FROM f)
SELECT l_orderkey AS doc_id, (island - 1)::INTEGER AS idx, any_value(l_returnflag) AS font_name, false AS bold, string_agg(l_partkey::VARCHAR, '' ORDER BY k) AS text FROM g GROUP BY l_orderkey, island""")
def merge_adjacent_nested(spark, d):
    runs = order_runs(load(spark, d, "lineitem"))
    merged = runs.select("doc_id", F.posexplode(spans.extract_spans(F.col("runs"))).alias("idx", "span"))
    return merged.select("doc_id", "idx", "span.font_name", "span.bold", "span.text")


@query("""
SELECT l_orderkey, string_agg(r, chr(10) ORDER BY r) AS text, max(n)::INTEGER AS widest FROM (SELECT l_orderkey, 1 + l_partkey % 4 AS n,
array_to_string([l_linenumber::VARCHAR, l_partkey::VARCHAR, l_returnflag, l_linestatus][1 : 1 + l_partkey % 4], ' | ') AS r FROM lineitem) GROUP BY l_orderkey""")
def table_text(spark, d):
    """An order as a table whose rows have one to four cells."""
    cells = F.slice(F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag", "l_linestatus"), F.lit(1), (1 + F.col("l_partkey") % 4).cast("int"))
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.array_join(cells, " | ").alias("r"), cells.alias("cells"))).alias("rows"))
    ordered = F.transform(F.array_sort("rows"), lambda r: r["cells"])
    return rows.select("l_orderkey", spans.cells_text(ordered).alias("text"), spans.widest_row(ordered).alias("widest"))


_BODY = f"SELECT doc_id, idx AS body_pos, CASE WHEN level IS NULL THEN 'p' ELSE 'tbl' END AS tag, (row_number() OVER (PARTITION BY doc_id, level IS NULL ORDER BY idx) - 1)::INTEGER AS kind_idx, text FROM ({LINES})"


def _body(spark, d) -> DataFrame:
    rows = _lines(spark, d).select("doc_id", F.col("idx").alias("body_pos"), F.when(F.col("level").isNull(), "p").otherwise("tbl").alias("tag"), "text")
    return selection.body_counters(rows)


def _wanted(spark, d) -> DataFrame:
    """Paragraphs 0, 3 and 3 again and table 1 of each document with a label."""
    one = F.struct(F.lit("p").alias("tag"), F.lit(0).alias("kind_idx"))
    asked = F.array(one, F.struct(F.lit("p").alias("tag"), F.lit(3).alias("kind_idx")), F.struct(F.lit("p").alias("tag"), F.lit(3).alias("kind_idx")), F.struct(F.lit("tbl").alias("tag"), F.lit(1).alias("kind_idx")))
    return load(spark, d, "labels").select("doc_id", F.inline(asked))


_WANTED = "SELECT doc_id, tag, kind_idx FROM labels, (VALUES ('p', 0), ('p', 3), ('p', 3), ('tbl', 1)) v(tag, kind_idx)"


@query(f"SELECT doc_id, body_pos, tag, kind_idx, text FROM ({_BODY}) b WHERE EXISTS (SELECT 1 FROM ({_WANTED}) w WHERE w.doc_id = b.doc_id AND w.tag = b.tag AND w.kind_idx = b.kind_idx)")
def extract_selection(spark, d):
    return selection.select_elements(_body(spark, d), _wanted(spark, d)).select("doc_id", "body_pos", "tag", "kind_idx", "text")


@query(f"""SELECT w.doc_id, w.tag, string_agg(DISTINCT w.kind_idx::VARCHAR, ',' ORDER BY w.kind_idx::VARCHAR) AS bad FROM ({_WANTED}) w
LEFT JOIN (SELECT doc_id, tag, count(*) AS n FROM ({_BODY}) GROUP BY ALL) s ON w.doc_id = s.doc_id AND w.tag = s.tag WHERE w.kind_idx < 0 OR w.kind_idx >= coalesce(n, 0) GROUP BY ALL""")
def invalid_indices(spark, d):
    got = selection.invalid_indices(_body(spark, d), _wanted(spark, d))
    return got.select("doc_id", "tag", F.array_join(F.transform("bad", lambda i: i.cast("string")), ",").alias("bad"))


@query(f"""WITH b AS ({LINES}), e AS (SELECT l.doc_id, 0 AS docx_para_idx, i AS idx, '[' || i || ':' || coalesce(l.quality, -1) || ']' AS new FROM labels l, range(0, 3) t(i)),
last AS (SELECT doc_id, docx_para_idx, arg_max(new, idx) AS new FROM e GROUP BY ALL)
SELECT b.doc_id, b.idx AS docx_para_idx, coalesce(new, b.text) AS text FROM b LEFT JOIN last ON b.doc_id = last.doc_id AND b.idx = last.docx_para_idx""")
def backfill_update(spark, d):
    original = _lines(spark, d).select("doc_id", F.col("idx").alias("docx_para_idx"), "text")
    some = load(spark, d, "labels").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("idx"))
    edits = some.select("doc_id", F.lit(0).alias("docx_para_idx"), "idx", F.format_string("[%d:%d]", F.col("idx"), F.col("q")).alias("text"))
    return backfill.update_text(original, edits)


@query(f"""SELECT doc_id, body_pos, docx_para_idx::INTEGER AS docx_para_idx, (row_number() OVER (PARTITION BY doc_id ORDER BY body_pos) - 1)::INTEGER AS idx FROM
(SELECT doc_id, idx AS body_pos, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS docx_para_idx, length(text) % 5 <> 0 AS keep FROM ({LINES})) WHERE keep""")
def block_anchor_counters(spark, d):
    body = _lines(spark, d).select("doc_id", F.col("idx").alias("body_pos"), (F.length("text") % 5 != 0).alias("keep"))
    return selection.block_counters(body).select("doc_id", "body_pos", "docx_para_idx", "idx")


@query(f"""SELECT doc_id, count(*)::BIGINT AS blocks, count(*) FILTER (level IS NOT NULL OR length(text) % 7 NOT IN (0, 1))::BIGINT AS paragraphs, count(*) FILTER (level IS NULL AND length(text) % 7 = 0)::BIGINT AS tables
FROM ({LINES}) GROUP BY doc_id""")
def document_counters(spark, d):
    """Some lines count as tables and some as images."""
    lines = _lines(spark, d)
    rest = F.length("text") % 7
    return aggregates.document_counters(lines.withColumn("kind", F.when(F.col("level").isNull() & (rest == 0), "table").when(F.col("level").isNull() & (rest == 1), "image").otherwise(F.col("kind"))))


_TAG = "CASE WHEN level IS NULL THEN 'p' ELSE 'h' || level END"


@query(f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::INTEGER AS node_idx, 'tag' AS node_type, {_TAG} AS tag,
'<' || {_TAG} || '>' || {TEXT_ESC.format("text")} || '</' || {_TAG} || '>' AS html, text FROM ({LINES})""")
def fragment_top_nodes(spark, d):
    """Each document as one HTML fragment, parsed back into its top-level nodes."""
    fragment = block_nodes(_lines(spark, d)).groupBy("doc_id").agg(render.in_order(F.col("html"), "node_idx", "").alias("fragment"))
    return parse_nodes(fragment).select("doc_id", "node_idx", "node_type", "tag", "html", F.array_join("strings", "").alias("text"))


@query("""SELECT page_id AS doc_id, 0::INTEGER AS node_idx, 'tag' AS node_type, 'html' AS tag FROM pages""")
def page_top_nodes(spark, d):
    nodes = parse_nodes(load(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("fragment")), with_html=False)
    return nodes.select("doc_id", "node_idx", "node_type", "tag")


@query("SELECT page_id AS doc_id, 1::INTEGER AS level, len(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?s)<article[^>]*>(.*?)</article>', 1), ''), '<h1'))::BIGINT AS n FROM pages")
def page_heading_counts(spark, d):
    nodes = parse_nodes(page_articles(load(spark, d, "pages")), with_html=False)
    return aggregates.heading_counts(split.node_levels(nodes))


@query()
def page_article_split(spark, d):
    return split.split_nodes(parse_nodes(page_articles(load(spark, d, "pages"))), 1)


def _word_files(spark, d) -> DataFrame:
    """Each conversation as a Word package: turns as paragraphs and headings, and after every third one a table of two rows, of which the shorter one is filled up."""
    turns = _conv(spark, d).withColumn("doc_id", F.col("doc_id").cast("string"))
    cell = lambda *texts: F.struct(F.array(*(F.struct(t.alias("text"), *(F.lit(None).cast(k).alias(f) for f, k in (("bold", "boolean"), ("italic", "boolean"), ("underline", "boolean"), ("font_name", "string"), ("font_size_pt", "double"), ("color_rgb", "string")))) for t in texts)).alias("spans"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))
    role, n = F.col("kind"), F.col("idx").cast("string")
    rows = F.array(F.array(cell(F.lit("turn")), cell(n)), F.array(cell(role)))
    given = turns.select("doc_id", (F.col("idx") * 2).alias("idx"), "kind", "text", "level", F.lit(None).cast(rows_type := f"array<array<{CELL}>>").alias("rows"))
    tables = turns.filter("idx % 3 = 2").select("doc_id", (F.col("idx") * 2 + 1).alias("idx"), F.lit("table").alias("kind"), F.lit("").alias("text"), F.lit(None).cast("int").alias("level"), rows.cast(rows_type).alias("rows"))
    return docx_writer.build(given.unionByName(tables))


#: The same corpus in SQL: doc_id, pos (place in the body), level, text, p (paragraphs so far), t (tables so far); tables have no turn of their own.
_WORD = f"""SELECT *, (row_number() OVER w - 1)::INTEGER AS pos, (sum((NOT tab)::INTEGER) OVER w - 1)::INTEGER AS p, (sum(tab::INTEGER) OVER w - 1)::INTEGER AS t FROM
(SELECT doc_id::VARCHAR AS doc_id, 2 * idx AS place, false AS tab, level, text FROM ({CONV})
UNION ALL SELECT doc_id::VARCHAR, 2 * idx + 1, true, NULL, 'turn | ' || idx || chr(10) || CASE WHEN head THEN 'heading' ELSE 'paragraph' END || ' | ' FROM ({CONV}) WHERE idx % 3 = 2) WINDOW w AS (PARTITION BY doc_id ORDER BY place)"""


@query(f"""SELECT doc_id, pos AS idx, CASE WHEN tab THEN 'table' WHEN level IS NULL THEN 'paragraph' ELSE 'heading' END AS kind, level::INTEGER AS level, text,
CASE WHEN NOT tab THEN p END AS docx_para_idx, CASE WHEN tab THEN t END AS docx_table_idx, CASE WHEN tab THEN 'tag:tbl' ELSE 'style_id:' || coalesce('Heading' || level, 'None') END AS signal FROM ({_WORD})""")
def word_blocks(spark, d):
    """Word packages written and read back as blocks with their anchors."""
    made = docx.blocks(docx.body_rows(_word_files(spark, d)))
    return made.select("doc_id", "idx", "kind", "level", "text", "docx_para_idx", "docx_table_idx", F.get("signals", F.lit(1)).alias("signal"))


_WORD_HTML = f"""CASE WHEN tab THEN '<table><tr><td><p>' || replace(replace(text, ' | ', '</p></td><td><p>'), chr(10), '</p></td></tr><tr><td><p>') || '</p></td></tr></table>'
ELSE '<' || {_TAG} || '>' || replace({ESC.format("text")}, chr(10), '<br />') || '</' || {_TAG} || '>' END"""


@query(f"""WITH b AS ({_WORD}), c AS (SELECT *, sum((level IS NOT DISTINCT FROM 1)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM b),
g AS (SELECT doc_id, part, arg_min(CASE WHEN level IS NOT NULL THEN text ELSE '' END, pos) AS title, string_agg({_WORD_HTML}, '' ORDER BY pos) AS html, string_agg(pos, ',' ORDER BY pos) AS block_indices,
coalesce(string_agg(p, ',' ORDER BY pos) FILTER (NOT tab), '') AS paragraphs, coalesce(string_agg(t, ',' ORDER BY pos) FILTER (tab), '') AS tables FROM c GROUP BY doc_id, part)
SELECT doc_id, (part + CASE WHEN min(part) OVER (PARTITION BY doc_id) = 0 THEN 1 ELSE 0 END)::INTEGER AS number, title, html, block_indices, paragraphs, tables FROM g""")
def word_split_anchors(spark, d):
    """The blocks route over Word packages: articles with their html and their anchors."""
    got = docx.split_with_anchors(docx.body_rows(_word_files(spark, d)), 1)
    joined = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return got.select("doc_id", "number", "title", "html", joined("block_indices").alias("block_indices"), joined("docx_para_indices").alias("paragraphs"), joined("docx_table_indices").alias("tables"))


@query(f"SELECT doc_id, count(*) FILTER (NOT tab)::VARCHAR AS paragraphs, count(*) FILTER (tab)::VARCHAR AS tables, string_agg({_WORD_HTML}, '' ORDER BY pos) AS fragment FROM ({_WORD}) GROUP BY doc_id")
def word_documents(spark, d):
    """The documents of Word packages with their metadata and their html."""
    files = _word_files(spark, d).withColumns({"source_path": F.col("doc_id"), "source_format": F.lit("docx")})
    body = docx.body_rows(files)
    docs = docx.documents(files, body).select("doc_id", F.col("metadata")["python_docx_para_count"].alias("paragraphs"), F.col("metadata")["python_docx_table_count"].alias("tables"))
    return docs.join(docx.source_fragment(body), "doc_id")


@query(f"SELECT doc_id, pos, CASE WHEN tab THEN NULL WHEN p % 2 = 0 THEN '[TR] ' || text ELSE text END AS text FROM ({_WORD})")
def word_put_back(spark, d):
    """Every other paragraph edited, put back into its package, and read again."""
    files = _word_files(spark, d)
    made = docx.blocks(docx.body_rows(files)).filter("docx_para_idx % 2 = 0")
    text = lambda c: F.concat(F.lit("[TR] "), c)
    edited = made.select("doc_id", "idx", "kind", "docx_para_idx", text(F.col("text")).alias("text"), F.transform("spans", lambda s: s.withField("text", text(s["text"]))).alias("spans"))
    return docx.body_rows(docx_writer.put_back(files, edited)).select("doc_id", F.col("body_pos").alias("pos"), "text")


@query(f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS pos, CASE WHEN NOT tab THEN text END AS text FROM ({_WORD}) WHERE (NOT tab AND p IN (0, 2)) OR (tab AND t = 0)")
def word_fragments(spark, d):
    """Paragraphs 0 and 2 and table 0 of the packages that have them, cut out as packages of their own and read again."""
    files = _word_files(spark, d)
    has = docx.body_rows(files).groupBy("doc_id").agg(F.count_if(F.col("tag") == "p").alias("p"), F.count_if(F.col("tag") == "tbl").alias("t"))
    some = lambda n, *ks: F.filter(F.array(*map(F.lit, ks)), lambda k: k < F.col(n))
    wanted = has.select("doc_id", some("p", 2, 0, 2).alias("docx_para_indices"), some("t", 0).alias("docx_table_indices"))
    return docx.body_rows(docx_writer.cut_fragments(files, wanted)).select("doc_id", F.col("body_pos").alias("pos"), "text")


def queries() -> dict:
    return dict(REGISTERED)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
