"""Titles, file prefixes and page templates of rendered documents. `$name` marks a place to fill."""

TITLE = "DocProj: "
INDEX_TITLE = "Articles: "
INSPECTION_FILES, SOURCE_FILES, ARTICLE_FOLDERS = "docproj-", "docproj-source-", "articles-"

DOCUMENT = """\
<!doctype html>
<html lang="en">
<head>
<meta charset="utf-8">
<title>$title</title>
<style>
  /* Empty <p> elements (preserved from the source docx) collapse to
     zero height by default; force them to take a full line. */
  p:empty { margin: 1em 0; }
</style>
</head>
<body>
$fragment
</body>
</html>
"""

INDEX = "<h1>$name</h1>\n<p>$count article(s) split at heading level.</p>\n<ul>\n$items\n</ul>"
INDEX_ITEM = '<li><a href="$file">$label</a></li>'

INSPECTION = """\
<!doctype html>
<html lang="en">
<head>
<meta charset="utf-8">
<title>$title</title>
<style>
body { font-family: -apple-system, BlinkMacSystemFont, "Segoe UI", sans-serif;
       max-width: 960px; margin: 1.5em auto; padding: 0 1em; color: #222; }
h1 { border-bottom: 1px solid #ccc; padding-bottom: 0.3em; }
table { border-collapse: collapse; width: 100%; font-size: 0.9em; }
th, td { border: 1px solid #ddd; padding: 4px 8px; text-align: left;
         vertical-align: top; }
th { background: #f3f3f3; }
tr.conf-high { background: #e8f5e9; }
tr.conf-med  { background: #fff8e1; }
tr.conf-low  { background: #ffebee; }
td.text { font-family: ui-monospace, "SF Mono", Menlo, monospace;
          font-size: 0.85em; word-break: break-word; }
td.muted { color: #888; font-size: 0.85em; }
.meta { color: #555; font-size: 0.9em; }
</style>
</head>
<body>
<h1>$title</h1>
<p class="meta"><strong>Format:</strong> $format &middot; <strong>Blocks:</strong> $count &middot; <strong>Path:</strong> $path</p>
<table>
<thead><tr><th>idx</th><th>kind</th><th>page</th><th>conf</th><th>text</th><th>signals</th></tr></thead>
<tbody>
$rows
</tbody>
</table>
</body>
</html>
"""
INSPECTION_ROW = '<tr class="$confidence_class"><td>$idx</td><td class="muted">$label</td><td class="muted">$page</td><td class="muted">$confidence</td><td class="text">$text</td><td class="muted">$signals</td></tr>'
