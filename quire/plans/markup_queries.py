"""Markup conversion over ``pages``, ``documents`` and ``lineitem``."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import markup as M
from quire.plans import fixtures as X
from quire.plans.fixtures import FILES
from quire.plans.registry import query

WS = "' ' || chr(9) || chr(13) || chr(10)"


def _html(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", "html")


@query(
    "h1_strip_html",
    r"""SELECT page_id, replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<script[\s\S]*?</script>|<style[\s\S]*?</style>', ' ', 'gi'),
   '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') AS text FROM pages""",
)
def h1(spark, sf):
    return _html(spark, sf).select("page_id", M.strip_html(F.col("html")).alias("text"))


BODY = """p0 AS (SELECT page_id, {html} AS html FROM pages),
p1 AS (SELECT *, lower(html) AS low FROM p0),
p2 AS (SELECT *, instr(low, '<body') AS apos, length(html) - instr(reverse(low), '>ydob/<') - 5 AS close FROM p1),
p3 AS (SELECT *, CASE WHEN apos > 0 AND contains(low, '</body>') THEN instr(substr(html, apos), '>') + apos - 1 END AS start FROM p2),
bodies AS (SELECT page_id, CASE WHEN start > 0 AND close > start THEN substr(html, start + 1, close - start - 1) ELSE html END AS body FROM p3)"""


@query("h2_html_body", f"WITH {BODY.format(html='html')} SELECT page_id, body FROM bodies")
def h2(spark, sf):
    return _html(spark, sf).select("page_id", M.html_body(F.col("html")).alias("body"))


# The references that occur in the pages.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _decoded(c):
    for entity, char in ENTITIES.items():
        c = f"replace({c}, '{entity}', '{char}')"
    return c


# The pages use few tags; their Markdown is spelled out tag by tag. An open <b> ends with its paragraph.
PIECES = r"""list_transform(regexp_extract_all(regexp_replace(regexp_replace(html, '<b>([^<]*)<br>', '<b>\1<br></b>', 'g'), '\s+((</a>)?</(h1|li)>)', '\1', 'g'), '<[^>]*>|[^<]+'), lambda t: CASE
  WHEN t IN ('<b>', '</b>') THEN '**' WHEN t = '<br>' THEN chr(10) WHEN t = '<li>' THEN chr(10) || '- ' WHEN t = '<h1>' THEN chr(10) || chr(10) || '# '
  WHEN regexp_matches(t, '^</?(h1|p|div|article|ul)[ >]') THEN chr(10) || chr(10) WHEN starts_with(t, '<') THEN ''
  ELSE regexp_replace({text}, '([\\`*_\[\]])', '\\\1', 'g') END)"""


@query(
    "h3_html_to_markdown",
    f"""WITH seen AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<head>.*?</head>', '') AS html FROM pages),
md AS (SELECT page_id, array_to_string({PIECES.format(text=_decoded("t"))}, '') AS m FROM seen)
SELECT page_id, trim(regexp_replace(regexp_replace(m, '\\n[ \\t]+', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS}) || chr(10) AS markdown FROM md""",
)
def h3(spark, sf):
    return M.html_to_markdown(_html(spark, sf))


def _plain(c):
    inner = _decoded("regexp_replace(" + c + ", '<[^>]*>', '', 'g')")
    return f"trim(regexp_replace({inner}, '[ \t\r\n]+', ' ', 'g'), ' ')"


# The four dropped elements that occur in the pages, one by one: RE2 has no
# back-references.
VISIBLE = BODY.format(html="regexp_replace(html, '(?s)<!--.*?-->', '', 'g')") + """,
vis AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(body, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'),
   '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '(?is)<head\\b[^>]*>.*?</head\\s*>', '', 'g') AS html FROM bodies)"""


# Constructs of the HTML fixture: source with a line's words for §, its Markdown, and its links, stated by hand.
PAGE_PARTS = [
    ('<A Title="x > y" href=https://x.test/a?b=1&amp;c=(2)>§ <i>z</i></a>', "[§ *z*](https://x.test/a?b=1&c=(2%29)", [("https://x.test/a?b=1&c=(2)", "§ z")]),
    ('<a href="http://x.y"><div>§</div></a> <a href="javascript:1">n</a>', "[\n\n§\n\n](http://x.y) n", [("http://x.y", "§"), ("javascript:1", "n")]),
    ("<ul><li>§<ul><li>b<ol><li>c<li>d</ol></ul><li><p>e</p><p>§</p></ul>", "- §\n\n  - b\n\n    1. c\n    1. d\n- e\n\n  §", []),
    ("<div hidden>a<div>b</div><a href='#'>§</a>LEAK</div>§<p hidden=''>no<p>yes", "§\n\nyes", []),
    ("<code>§ <b>*z*</b> `</code> 1 < 2 &lt;§&gt; a_b", "`§ *z* \\`` 1 < 2 <§> a\\_b", []),
    ("<table><caption>no</caption><tfoot><tr><td>f<tbody><tr><td>§|x<td><p>1</p><p>2</p><thead><tr><th>A<th>B<th>C</table>",
     "| A | B | C |\n| --- | --- | --- |\n| §\\|x | 1 2 |  |\n| f |  |  |", []),
    ("<blockquote><p>§<br>z<blockquote>q</blockquote></blockquote>", "> §\n> z\n> \n> \n> \n> > q", []),
    ("<pre>\n§ ``` <b>z</b></pre><hr><img alt='§' src=x><img>", "````\n§ ``` z\n````\n\n---\n\n[图片：§][图片：未提供替代文字]", []),
    ("<h2><div>§</div></h2><p><b>open<p>§</b><script>if (a</b) '<p>no'</script><style>p{}</style><!-- <p>no -->", "## §\n\n**open**\n\n§", []),
]


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzäöüßéèêáíóúñ"


def _others(signs):
    """Pattern of one sign that is not among ``signs``, as ranges: a negated class takes eight times as long."""
    at = sorted(map(ord, signs))
    gaps = [(a + 1, b - 1) for a, b in zip([-1, *at], [*at, 0x110000]) if b - a > 1]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in gaps) + "]"


def _line_words():
    """The words of each line, joined by blanks; the whole text passes the pattern once."""
    lines = F.split(F.regexp_replace("text", _others(LETTERS + "\n") + "+", " "), "\n")
    return F.transform(lines, lambda t: F.coalesce(F.nullif(F.trim(t), F.lit("")), F.lit("none")))


def _built_pages(spark, sf):
    """Documents turned into pages: each line becomes a construct by its number."""
    made = F.array(*[F.lit(c[0]) for c in PAGE_PARTS])
    parts = F.transform(_line_words(), lambda t, i: F.replace(F.get(made, i % len(PAGE_PARTS)), F.lit("§"), t))
    html = F.concat(F.lit("<!doctype html><html><head><title>t</title><body><section>"), F.array_join(parts, "</section>\n<section>"), F.lit("</section></html>"))
    return X.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html"))


LINES = (
    "src AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS t FROM documents),\n"
    "ln AS (SELECT doc_id, pos, coalesce(nullif(trim(regexp_replace(t, '[^A-Za-zäöüßéèêáíóúñ]+', ' ', 'g'), ' '), ''), 'none') AS t FROM src)"
)


def _lit(v):
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


@query(
    "h3_page_constructs",
    f"""WITH {LINES},
con(c, m) AS (VALUES {", ".join(f"({i}, {_lit(c[1])})" for i, c in enumerate(PAGE_PARTS))})
SELECT doc_id AS page_id, string_agg(replace(m, '§', t), chr(10) || chr(10) ORDER BY pos) || chr(10) AS markdown FROM ln JOIN con ON c = pos % {len(PAGE_PARTS)} GROUP BY doc_id""",
)
def h3_constructs(spark, sf):
    return M.html_to_markdown(_built_pages(spark, sf))


@query(
    "h4_link_constructs",
    f"""WITH {LINES},
con(c, sub, href, text) AS (VALUES {", ".join(f"({i}, {j}, {_lit(h)}, {_lit(t)})" for i, c in enumerate(PAGE_PARTS) for j, (h, t) in enumerate(c[2]))})
SELECT doc_id AS page_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) AS ordinal, href, replace(text, '§', t) AS text, starts_with(href, 'http') AS kept
FROM ln JOIN con ON c = pos % {len(PAGE_PARTS)}""",
)
def h4_link_constructs(spark, sf):
    return M.html_links(_built_pages(spark, sf))


@query(
    "h4_html_blocks",
    f"""WITH {VISIBLE},
sg AS (SELECT page_id, list_concat([''], list_transform(regexp_extract_all(html, '(?i)</?(?:h[1-6]|p|div|section|article|ul|ol|li|blockquote|pre|table|tr|td|th|hr)(?:\\s[^>]*)?/?>'), lambda t: lower(regexp_extract(t, '^<(/?[A-Za-z0-9]+)', 1)))) AS tags,
   regexp_split_to_array(html, '(?i)</?(?:h[1-6]|p|div|section|article|ul|ol|li|blockquote|pre|table|tr|td|th|hr)(?:\\s[^>]*)?/?>') AS texts FROM vis),
ex AS (SELECT page_id, unnest(range(1, len(texts) + 1)) AS i, unnest(tags) AS tag, unnest(texts) AS t FROM sg),
tx AS (SELECT page_id, i, CASE WHEN tag = '' OR starts_with(tag, '/') THEN 'text' ELSE tag END AS kind, {_plain('t')} AS text FROM ex)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS ordinal, kind, text FROM tx WHERE text <> ''""",
)
def h4_blocks(spark, sf):
    return M.html_blocks(_html(spark, sf))


@query(
    "h4_html_links",
    f"""WITH {VISIBLE},
a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>')) AS a, unnest(range(1, len(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>')) + 1)) AS ordinal FROM vis),
h AS (SELECT page_id, ordinal, regexp_extract(a, '(?i)^<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1) AS href, {_plain('a')} AS text FROM a)
SELECT page_id, ordinal, href, text, regexp_matches(href, '(?i)^(https?:|mailto:|#)') AS kept FROM h""",
)
def h4_links(spark, sf):
    return M.html_links(_html(spark, sf))


def _grid(spark, sf):
    """Documents as ragged table rows, one table per source."""
    t = F.when(F.col("doc_id") % 4 == 0, F.replace(F.col("text"), F.lit(" "), F.lit("|"))).otherwise(F.col("text"))
    cells = F.array(F.col("doc_id").cast("string"), F.col("lang"), t)
    return X.table(spark, sf, "documents").select(
        F.col("source").alias("table_id"), F.col("doc_id").alias("row_no"),
        F.slice(cells, F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")).alias("cells"),
    )


GRID = """grid AS (SELECT source AS table_id, doc_id AS row_no, ([doc_id::VARCHAR, lang, CASE WHEN doc_id % 4 = 0 THEN replace(text, ' ', '|') ELSE text END])[1:doc_id % 3 + 1] AS cells FROM documents),
e AS (SELECT table_id, max(len(cells)) AS w, min(row_no) AS first, max(row_no) AS last, count(*) AS n FROM grid GROUP BY table_id)"""


@query(
    "h5_table_to_markdown",
    f"""WITH {GRID},
l AS (SELECT g.table_id, row_no, w, first, '| ' || array_to_string(list_concat(list_transform(cells, lambda c: replace(replace(c, '|', '\\|'), chr(10), '<br>')),
     list_transform(range(0, w - len(cells)), lambda i: '')), ' | ') || ' |' AS line FROM grid g JOIN e USING (table_id))
SELECT table_id, row_no, 0 AS part, line FROM l
UNION ALL SELECT table_id, first, 1, '| ' || array_to_string(list_transform(range(0, w), lambda i: '---'), ' | ') || ' |' FROM e""",
)
def h5(spark, sf):
    return M.table_to_markdown(_grid(spark, sf))


@query(
    "h5_nation_markdown",
    """WITH l AS (SELECT 'nation' AS table_id, n_nationkey + 1 AS row_no, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation)
SELECT table_id, row_no::BIGINT AS row_no, 0 AS part, line FROM l UNION ALL SELECT 'nation', 0, 0, '| key | name | region |' UNION ALL SELECT 'nation', 0, 1, '| --- | --- | --- |'""",
)
def h5_nation(spark, sf):
    n = X.table(spark, sf, "nation").select(
        F.lit("nation").alias("table_id"), (F.col("n_nationkey") + 1).cast("bigint").alias("row_no"),
        F.array(F.col("n_nationkey").cast("string"), F.col("n_name"), F.col("n_regionkey").cast("string")).alias("cells"),
    )
    head = spark.range(1).select(
        F.lit("nation").alias("table_id"), F.col("id").alias("row_no"), F.array(F.lit("key"), F.lit("name"), F.lit("region")).alias("cells")
    )
    return M.table_to_markdown(head.unionByName(n))


@query(
    "h5_table_limits",
    f"WITH {GRID} SELECT table_id, w AS columns, n AS rows, CASE WHEN w > 128 OR n > 8 THEN 'too_large' ELSE 'ok' END AS verdict FROM e",
)
def h5_limits(spark, sf):
    return M.table_limits(_grid(spark, sf), max_rows=8)


def _esc(c):
    return f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _esc_web(c):
    return f"replace({_esc(c)}, '''', '&#x27;')"


@query(
    "h6_table_to_html",
    f"""WITH {GRID}
SELECT g.table_id, row_no, CASE WHEN row_no = first THEN '<table><thead><tr>' || array_to_string(list_transform(cells, lambda c: '<th>' || {_esc_web('c')} || '</th>'), '') || '</tr></thead><tbody>'
  ELSE '<tr>' || array_to_string(list_transform(cells, lambda c: '<td>' || {_esc_web('c')} || '</td>'), '') || '</tr>' END || CASE WHEN row_no = last THEN '</tbody></table>' ELSE '' END AS html
FROM grid g JOIN e USING (table_id)""",
)
def h6(spark, sf):
    return M.table_to_html(_grid(spark, sf))


MARKED = "replace(replace(replace(replace(text, ' the ', ' <b>*the_*</b> '), 'in', '[in]'), ' a ', ' & ''a'' `b` '), ' re', ' \\')"


def _marked():
    out = F.replace(F.col("text"), F.lit(" the "), F.lit(" <b>*the_*</b> "))
    out = F.replace(out, F.lit("in"), F.lit("[in]"))
    out = F.replace(out, F.lit(" a "), F.lit(" & 'a' `b` "))
    return F.replace(out, F.lit(" re"), F.lit(" \\"))


@query(
    "h7_escape_markup",
    f"""WITH m AS (SELECT doc_id, {MARKED} AS t FROM documents)
SELECT doc_id, {_esc('t')} AS html, {_esc_web('t')} AS html_web, regexp_replace(t, '([\\\\`*_\\[\\]])', '\\\\\\1', 'g') AS markdown FROM m""",
)
def h7(spark, sf):
    t = X.table(spark, sf, "documents").select("doc_id", _marked().alias("t"))
    return t.select("doc_id", *[M.escape_markup(F.col("t"), k).alias(k) for k in ("html", "html_web", "markdown")])


@query(
    "h8_fence_code",
    """WITH m AS (SELECT doc_id, replace(text, ' of ', CASE WHEN doc_id % 2 = 0 THEN ' ````of ' ELSE ' `of` ' END) AS t, (['.json','.XML','.yaml','.txt'])[doc_id % 4 + 1] AS ext FROM documents),
f AS (SELECT *, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda r: length(r))), 0) + 1)) AS fence FROM m)
SELECT doc_id, fence || CASE WHEN ext = '.txt' THEN 'text' ELSE lower(ext[2:]) END || chr(10) || t || chr(10) || fence || chr(10) AS fenced FROM f""",
)
def h8(spark, sf):
    t = F.replace(F.col("text"), F.lit(" of "), F.when(F.col("doc_id") % 2 == 0, F.lit(" ````of ")).otherwise(F.lit(" `of` ")))
    ext = F.element_at(F.array(*[F.lit(e) for e in (".json", ".XML", ".yaml", ".txt")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return X.table(spark, sf, "documents").select("doc_id", M.fence_code(t, ext).alias("fenced"))


# Constructs of the Markdown fixture: text with the line's words for §, the blocks it holds
# (kind, level, ordinal, text, path) and its HTML, all stated by hand.
CONSTRUCTS = [
    ("## § ##", [("heading", 2, None, "§", "")], "<h2>§</h2>"),
    ("§\n=====", [("heading", 1, None, "§", "")], "<h1>§</h1>"),
    ("§\n  § \n---", [("heading", 2, None, "§ §", "")], "<h2>§ §</h2>"),
    (
        "- §\n  - `§ **x**`\n    1. **§**\n    2. z\n- *§*",
        [
            ("paragraph", 1, None, "§", "ul"), ("paragraph", 2, None, "`§ **x**`", "ul/ul"), ("paragraph", 3, 1, "**§**", "ul/ul/ol"),
            ("paragraph", 3, 2, "z", "ul/ul/ol"), ("paragraph", 1, None, "*§*", "ul"),
        ],
        "<ul><li>§<ul><li><code>§ **x**</code><ol><li><strong>§</strong></li><li>z</li></ol></li></ul></li><li><em>§</em></li></ul>",
    ),
    (
        "> - §\n>   q\n>\n> §",
        [("paragraph", 1, None, "§ q", "quote/ul"), ("paragraph", 0, None, "§", "quote")],
        "<blockquote><ul><li>§ q</li></ul><p>§</p></blockquote>",
    ),
    ("````sql\n```\n§ < 1\n```\n````", [("code", 0, None, "```\n§ < 1\n```", "")], "<pre>```\n§ &lt; 1\n```</pre>"),
    ("~~~\n  §\n```\n~~~", [("code", 0, None, "  §\n```", "")], "<pre>  §\n```</pre>"),
    (
        "a|b\n-|-\n§|`c` \\| d\n§",
        [("table", 0, None, "a|b\n-|-\n§|`c` \\| d\n§", "")],
        "<table><tr><td>a</td><td>b</td></tr><tr><td>§</td><td><code>c</code> | d</td></tr><tr><td>§</td><td></td></tr></table>",
    ),
    (
        "7. §\n\n   ```\n   §\n   ```\n8. z",
        [("paragraph", 1, 7, "§", "ol"), ("code", 1, 7, "§", "ol"), ("paragraph", 1, 8, "z", "ol")],
        "<ol><li><p>§</p><pre>§</pre></li><li><p>z</p></li></ol>",
    ),
    ("> §\nlazy\n>> z", [("paragraph", 0, None, "§ lazy", "quote"), ("paragraph", 0, None, "z", "quote/quote")],
     "<blockquote><p>§ lazy</p><blockquote><p>z</p></blockquote></blockquote>"),
    ("***\n    §\n\n    z", [("rule", 0, None, "", ""), ("code", 0, None, "§\n\nz", "")], "<hr><pre>§\n\nz</pre>"),
    (
        "§ [l](https://x.test/a_b*c*) ![i](http://x.test/i.png) [bad](ftp://x) `<b>` \\*§\\* ~~d~~ __s__ & *e*",
        [("paragraph", 0, None, "§ [l](https://x.test/a_b*c*) ![i](http://x.test/i.png) [bad](ftp://x) `<b>` \\*§\\* ~~d~~ __s__ & *e*", "")],
        '<p>§ <a href="https://x.test/a_b*c*">l</a> [图片：i] bad <code>&lt;b&gt;</code> *§* <del>d</del> <strong>s</strong> &amp; <em>e</em></p>',
    ),
    (
        "* §\n\n* > §\n  > | a | b |\n  > |:-:|--:|\n  > | § | **z** |",
        [("paragraph", 1, None, "§", "ul"), ("paragraph", 1, None, "§", "ul/quote"), ("table", 1, None, "| a | b |\n|:-:|--:|\n| § | **z** |", "ul/quote")],
        "<ul><li><p>§</p></li><li><blockquote><p>§</p><table><tr><td>a</td><td>b</td></tr><tr><td>§</td><td><strong>z</strong></td></tr></table></blockquote></li></ul>",
    ),
]


def _markdown(spark, sf):
    """Documents turned into Markdown: each line becomes a construct by its number."""
    made = F.array(*[F.lit(c[0]) for c in CONSTRUCTS])
    lines = F.transform(_line_words(), lambda t, i: F.replace(F.get(made, i % len(CONSTRUCTS)), F.lit("§"), t))
    return X.table(spark, sf, "documents").select("doc_id", F.array_join(lines, "\n\n").alias("text"))


MARKDOWN = (
    f"{LINES},\n"
    "con(c, sub, kind, level, ordinal, text, path) AS (VALUES "
    + ", ".join(
        f"({i}, {j}, {_lit(k)}, {n}::BIGINT, {_lit(o)}::BIGINT, {_lit(t)}, {_lit(p)})"
        for i, (_, blocks, _) in enumerate(CONSTRUCTS) for j, (k, n, o, t, p) in enumerate(blocks)
    )
    + f"),\nblocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) AS block_no, kind, level, ordinal, replace(text, '§', t) AS text, path"
    f" FROM ln JOIN con ON c = pos % {len(CONSTRUCTS)})"
)


@query("h9_markdown_blocks", f"WITH {MARKDOWN} SELECT * FROM blocks")
def h9(spark, sf):
    return M.markdown_blocks(_markdown(spark, sf)).drop("stack", "blank")


@query(
    "h10_markdown_to_html",
    f"""WITH {MARKDOWN},
html(c, h) AS (VALUES {", ".join(f"({i}, {_lit(c[2])})" for i, c in enumerate(CONSTRUCTS))})
SELECT doc_id, string_agg(replace(h, '§', t), '' ORDER BY pos) AS html FROM ln JOIN html ON c = pos % {len(CONSTRUCTS)} GROUP BY doc_id""",
)
def h10(spark, sf):
    return M.markdown_to_html(M.markdown_blocks(_markdown(spark, sf)))


@query(
    "h11_document_shell",
    f"""WITH {FILES},
t AS (SELECT f.doc_id, f.name, lower(regexp_extract(name, '([.][^.]+)$', 1)) AS ext, CASE WHEN f.name LIKE '%.html' THEN '<html><BODY class="x">' || d.text || '</body></html>' ELSE d.text END AS text FROM files f JOIN documents d USING (doc_id)),
md AS (SELECT doc_id, string_agg('<p>' || {_esc("trim(l, ' ')")} || '</p>', '' ORDER BY i) AS h FROM (SELECT doc_id, string_agg(l, ' ' ORDER BY i) AS l, min(i) AS i FROM
   (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM t WHERE ext = '.md') GROUP BY doc_id) GROUP BY doc_id),
b AS (SELECT t.doc_id, t.name, CASE WHEN ext = '.html' THEN regexp_replace(regexp_replace(text, '^<html><BODY class="x">', ''), '</body></html>$', '') WHEN ext = '.md' THEN md.h
   WHEN ext = '.csv' THEN '<table><thead><tr>' || array_to_string(list_transform(string_split((string_split(text, chr(10)))[1], ','), lambda c: '<th>' || {_esc_web('c')} || '</th>'), '') || '</tr></thead><tbody>' ||
     coalesce(array_to_string(list_transform((string_split(text, chr(10)))[2:], lambda r: '<tr>' || array_to_string(list_transform(string_split(r, ','), lambda c: '<td>' || {_esc_web('c')} || '</td>'), '') || '</tr>'), ''), '') || '</tbody></table>'
   ELSE '<pre data-kind="text">' || {_esc_web('text')} || '</pre>' END AS body FROM t LEFT JOIN md USING (doc_id))
SELECT doc_id, '<!doctype html><html><head><meta charset="utf-8"><title>' || name || '</title></head><body><div class="doc-meta">' || name || '</div>' || body || '</body></html>' AS html FROM b""",
)
def h11(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", "text")
    f = X.files(spark, sf).join(d, "doc_id")
    page = F.when(
        F.col("name").endswith(".html"), F.concat(F.lit('<html><BODY class="x">'), "text", F.lit("</body></html>"))
    ).otherwise(F.col("text"))
    return M.document_html(f.select("doc_id", "name", page.alias("text")))


def _cells(spark, sf):
    """Every line of an order is a cell of its row; lines that share a number follow each other."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus")
    return X.table(spark, sf, "lineitem").select(
        F.expr("l_orderkey div 100").alias("sheet_id"), k.alias("row_no"), F.row_number().over(order).alias("cell_no"),
        F.when(F.col("l_linestatus") == "O", F.lit(" ")).otherwise(F.concat("l_returnflag", F.lit("|"), n.cast("string"))).alias("value"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit("at\ntr")).alias("attribute"),
        (n % 3 + 1).alias("col_repeat"),
        F.when(k % 10 == 0, F.lit(3)).otherwise(F.lit(1)).alias("row_repeat"),
    )


SHEET = """cells AS (SELECT l_orderkey // 100 AS sheet_id, l_orderkey AS row_no,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_returnflag, l_linestatus) AS cell_no,
  CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_suppkey % 3 = 0 THEN 'at tr' ELSE '' END ELSE l_returnflag || '\\|' || l_linenumber END AS v,
  (l_linenumber % 3 + 1)::BIGINT AS n, CASE WHEN l_orderkey % 10 = 0 THEN 3 ELSE 1 END AS rr FROM lineitem),
pl AS (SELECT *, sum(n) OVER (PARTITION BY sheet_id, row_no ORDER BY cell_no)::BIGINT AS e FROM cells),
rw AS (SELECT sheet_id, row_no, max(rr) AS rr FROM pl WHERE v <> '' GROUP BY ALL),
rp AS (SELECT *, sum(rr) OVER (PARTITION BY sheet_id ORDER BY row_no)::BIGINT AS last FROM rw),
x AS (SELECT p.sheet_id, p.v, p.e, p.n, unnest(range(r.last - r.rr + 1, r.last + 1)) AS row FROM pl p JOIN rp r USING (sheet_id, row_no) WHERE v <> ''),
sheet AS (SELECT sheet_id, row, unnest(range(e - n + 1, e + 1)) AS col, v AS value FROM x)"""


@query("h12_expand_sheet_runs", f"WITH {SHEET} SELECT * FROM sheet")
def h12(spark, sf):
    return M.expand_sheet(_cells(spark, sf))


@query(
    "h12_expand_small_sheets",
    f"""WITH {SHEET}, fit AS (SELECT sheet_id FROM sheet GROUP BY sheet_id HAVING max(col) <= 13 AND max(row) <= 100) SELECT * FROM sheet WHERE sheet_id IN (FROM fit)""",
)
def h12_small(spark, sf):
    return M.expand_sheet(_cells(spark, sf), max_columns=13, max_rows=100)


@query(
    "h12_sheet_limits",
    f"""WITH {SHEET} SELECT sheet_id, max(row) AS rows, max(col) AS columns, CASE WHEN max(col) > 13 THEN 'too_wide' WHEN max(row) > 100 THEN 'too_long' ELSE 'ok' END AS verdict FROM sheet GROUP BY sheet_id""",
)
def h12_limits(spark, sf):
    return M.sheet_limits(_cells(spark, sf), max_columns=13, max_rows=100)


@query(
    "h13_outline_markdown",
    f"""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS t FROM documents),
p AS (SELECT doc_id, i, CASE i % 5 WHEN 0 THEN repeat('#', least(6, greatest(1, (i % 9)::INT))) || ' ' || t || chr(10) || chr(10) WHEN 1 THEN '- ' || trim(t, {WS}) || chr(10)
   WHEN 2 THEN '## ' || CASE WHEN i % 2 = 0 THEN '幻灯片' ELSE t END || chr(10) || chr(10) ELSE t || chr(10) || chr(10) END AS m FROM l)
SELECT doc_id, string_agg(m, '' ORDER BY i) AS markdown FROM p GROUP BY doc_id""",
)
def h13(spark, sf):
    i = F.col("ord")
    lines = X.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "t"))
    nodes = lines.select(
        "doc_id", "ord",
        F.when(i % 5 == 0, "heading").when(i % 5 == 1, "item").when(i % 5 == 2, "slide").otherwise("paragraph").alias("node"),
        (i % 9).alias("level"),
        F.when((i % 5 == 2) & (i % 2 == 0), F.lit("")).otherwise(F.col("t")).alias("text"),
    )
    return M.outline_markdown(nodes)


@query(
    "h14_size_guard",
    """WITH t AS (SELECT doc_id // 8 AS job_id, doc_id % 8 + 1 AS ord, strlen(text) + CASE WHEN doc_id % 8 > 0 THEN 7 ELSE 0 END AS b FROM documents),
r AS (SELECT *, sum(b) OVER (PARTITION BY job_id ORDER BY ord) AS run FROM t)
SELECT job_id, sum(b)::BIGINT AS bytes, min(ord) FILTER (WHERE run > 20000) AS break_ord FROM r GROUP BY job_id""",
)
def h14(spark, sf):
    d = X.table(spark, sf, "documents").select(
        F.expr("doc_id div 8").alias("job_id"), (F.col("doc_id") % 8 + 1).alias("ord"), "text"
    )
    return M.size_guard(d, max_bytes=20000)


@query(
    "h14_block_guard",
    f"""WITH {MARKDOWN}
SELECT doc_id, count(*) AS blocks, CASE WHEN bool_or(kind = 'table') THEN 2 ELSE 0 END::BIGINT AS columns,
  CASE WHEN count(*) > 30 THEN 'too_many_blocks' WHEN bool_or(kind = 'table') THEN 'table_too_wide' ELSE 'ok' END AS verdict FROM blocks GROUP BY doc_id""",
)
def h14_blocks(spark, sf):
    return M.block_guard(M.markdown_blocks(_markdown(spark, sf)), max_blocks=30, max_columns=1)


@query(
    "h14_page_guard",
    """SELECT doc_id // 8 AS job_id, sum(len(string_split(text, chr(10))))::BIGINT AS pages, sum(len(string_split(text, chr(10)))) > 100 AS refused FROM documents GROUP BY ALL""",
)
def h14_pages(spark, sf):
    d = X.table(spark, sf, "documents").select(
        F.expr("doc_id div 8").alias("job_id"), F.size(F.split("text", "\n")).cast("bigint").alias("n_pages")
    )
    return M.page_guard(d, max_pages=100)
