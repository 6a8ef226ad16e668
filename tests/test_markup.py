"""Markup conversion on small inputs."""

from pyspark.sql import functions as F

from quire.operators import markup as M

PAGE = """<html><head><title>x</title></head><body><h1>Ti*tle</h1><p>A <strong>bold</strong> and
<a href="https://x.test/(a)">link</a> <a href="javascript:1">bad</a></p><ul><li>one</li><li>two</li></ul>
<ol><li>first</li></ol><blockquote><p>q1</p></blockquote><pre>code ``` here</pre>
<table><tr><th>A</th><th>B</th></tr><tr><td>1|2</td></tr></table><script>evil()</script><p hidden>no</p>
<p><b>open<br>x<p>next &amp; &#233; &#x4e2d;</p><img alt="pic" src="x"><code>a*b</code></body></html>"""


def markdown(spark, html):
    return M.html_to_markdown(spark.createDataFrame([(1, html)], "page_id long, html string")).first().markdown


def test_page_to_markdown(spark):
    md = markdown(spark, PAGE)
    assert md.startswith("# Ti\\*tle\n\nA **bold** and\n[link](https://x.test/(a%29) bad\n\n- one\n- two\n")
    assert "\n1. first\n" in md and "\n> q1\n" in md
    assert "\n````\ncode ``` here\n````\n" in md
    assert "| A | B |\n| --- | --- |\n| 1\\|2 |  |\n" in md
    assert "evil" not in md and "no" not in md.split()
    assert "**open\nx**\n\nnext & é 中\n" in md
    assert md.endswith("[图片：pic]`a*b`\n")
    assert "\n\n\n" not in md


def test_links_and_blocks(spark):
    df = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    assert [(r.href, r.text, r.kept) for r in M.html_links(df).orderBy("ordinal").collect()] == [
        ("https://x.test/(a)", "link", True), ("javascript:1", "bad", False),
    ]
    kinds = [(r.kind, r.text) for r in M.html_blocks(df).orderBy("ordinal").collect()]
    assert kinds[0] == ("h1", "Ti*tle") and ("li", "two") in kinds and ("td", "1|2") in kinds


def test_body_needs_a_closing_tag(spark):
    rows = [("<html><BODY class='a'>x</Body></html>",), ("<body>x",), ("x",), ("<body>a</body>b</body>c",)]
    df = spark.createDataFrame(rows, "h string")
    assert [r.b for r in df.select(M.html_body(F.col("h")).alias("b")).collect()] == ["x", "<body>x", "x", "a</body>b"]


def test_tables(spark):
    rows = [("t", 0, ["name", "value"]), ("t", 1, ["A|B"]), ("t", 2, ["x\ny", "<'2'>", "z"])]
    df = spark.createDataFrame(rows, "table_id string, row_no long, cells array<string>")
    md = [r.line for r in M.table_to_markdown(df).orderBy("row_no", "part").collect()]
    assert md == ["| name | value |  |", "| --- | --- | --- |", "| A\\|B |  |  |", "| x<br>y | <'2'> | z |"]
    html = "".join(r.html for r in M.table_to_html(df).orderBy("row_no").collect())
    assert html == (
        "<table><thead><tr><th>name</th><th>value</th></tr></thead><tbody><tr><td>A|B</td></tr>"
        "<tr><td>x\ny</td><td>&lt;&#x27;2&#x27;&gt;</td><td>z</td></tr></tbody></table>"
    )


def test_delimited_text(spark):
    df = spark.createDataFrame([('name,value\n"A,B","He said ""yes"""\n',)], "t string")
    assert df.select(M.delimited_html(F.col("t")).alias("h")).first().h == (
        "<table><thead><tr><th>name</th><th>value</th></tr></thead><tbody>"
        "<tr><td>A,B</td><td>He said &quot;yes&quot;</td></tr></tbody></table>"
    )


def test_delimited_records_may_hold_line_breaks(spark):
    texts = ['"a\nb",c\n,,\n\nx"y,"z""\n"\r\n"open,1', ",".join(["c"] * 3000) + '\n"' + "long " * 20_000 + '"', "a\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.h for r in df.select("i", M.delimited_html(F.col("t")).alias("h")).orderBy("i").collect()]
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    assert got[0] == (
        "<table><thead><tr><th>a\nb</th><th>c</th></tr></thead><tbody>" + row("", "", "") + row("")
        + row("x&quot;y", "z&quot;\n") + row("&quot;open", "1") + "</tbody></table>"
    )
    assert got[1].count("<th>") == 3000 and got[1].endswith("<tbody>" + row("long " * 20_000) + "</tbody></table>")
    assert got[2] == "<table><thead><tr><th>a</th></tr></thead><tbody>" + row("") + "</tbody></table>"


def test_markdown_blocks_and_html(spark):
    text = "# Head #\n\npara one\nstill\n- a\n- b\n1. c\n> q\n> r\n```py\nx < 1\n```\n```\ny\n```\n| a | b |\n|---|---|\n| 1 | **2** |\n\n---\n[l](https://x.y) [j](javascript:1)"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    blocks = M.markdown_blocks(df)
    assert [(r.kind, r.level, r.text, r.path) for r in blocks.orderBy("block_no").collect()] == [
        ("heading", 1, "Head", ""), ("paragraph", 0, "para one still", ""), ("paragraph", 1, "a", "ul"), ("paragraph", 1, "b", "ul"),
        ("paragraph", 1, "c", "ol"), ("paragraph", 0, "q r", "quote"), ("code", 0, "x < 1", ""), ("code", 0, "y", ""),
        ("table", 0, "| a | b |\n|---|---|\n| 1 | **2** |", ""), ("rule", 0, "", ""), ("paragraph", 0, "[l](https://x.y) [j](javascript:1)", ""),
    ]
    assert M.markdown_to_html(blocks).first().html == (
        "<h1>Head</h1><p>para one still</p><ul><li>a</li><li>b</li></ul><ol><li>c</li></ol><blockquote><p>q r</p></blockquote>"
        "<pre>x &lt; 1</pre><pre>y</pre><table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td><strong>2</strong></td></tr></table><hr>"
        '<p><a href="https://x.y">l</a> j</p>'
    )


def test_markdown_trees(spark):
    """Container stacks, fences, underlines, lazy lines, tables and inline rules on texts stated by hand."""
    cases = {
        "````\n```\nx\n````\ny": "<pre>```\nx</pre><p>y</p>",
        "~~~\na\n```\n~~~\nb": "<pre>a\n```</pre><p>b</p>",
        "```\nopen\n\n": "<pre>open\n</pre>",
        "Title\n=====\ntext\n---": "<h1>Title</h1><h2>text</h2>",
        "- a\n  - b\n    - c\n- d": "<ul><li>a<ul><li>b<ul><li>c</li></ul></li></ul></li><li>d</li></ul>",
        "- a\n\n- b\n  - c\n  - d": "<ul><li><p>a</p></li><li><p>b</p><ul><li>c</li><li>d</li></ul></li></ul>",
        "- a\n* b\n1. c\n1) d": "<ul><li>a</li></ul><ul><li>b</li></ul><ol><li>c</li></ol><ol><li>d</li></ol>",
        "- \n- a\n-": "<ul><li></li><li>a</li><li></li></ul>",
        "-\n\n  foo": "<ul><li></li></ul><p>foo</p>",
        "> - q\n> ---\n\n> r": "<blockquote><ul><li>q</li></ul><hr></blockquote><blockquote><p>r</p></blockquote>",
        "> a\n- b\nc\n\n\td": "<blockquote><p>a</p></blockquote><ul><li><p>b c</p><p>d</p></li></ul>",
        "p\n2. no\n1. yes": "<p>p 2. no</p><ol><li>yes</li></ol>",
        "    code\n\n    more\n\ntext\n    still": "<pre>code\n\nmore</pre><p>text still</p>",
        "- a\n\n      code\n  > q": "<ul><li><p>a</p><pre>code</pre><blockquote><p>q</p></blockquote></li></ul>",
        "x\na|b\n-|-\nc \\| d": "<p>x</p><table><tr><td>a</td><td>b</td></tr><tr><td>c | d</td><td></td></tr></table>",
        "a|b\n-": "<h2>a|b</h2>",
        "`x **y**` and ``a ` b`` and \\`no\\`": "<p><code>x **y**</code> and <code>a ` b</code> and `no`</p>",
        "***b*** **b *e* b** x*** y*** _e_ a_b_c 2 * 3 * 4 <i>": "<p><em><strong>b</strong></em> <strong>b <em>e</em> b</strong> x*** y*** <em>e</em> a_b_c 2 * 3 * 4 &lt;i&gt;</p>",
        "[a `]` b](http://x.y/(z)) ![](u) \ue001\ue002": '<p><a href="http://x.y/(z)">a <code>]</code> b</a> [图片：未提供替代文字] </p>',
    }
    df = spark.createDataFrame(list(enumerate([*cases, None, ""])), "doc_id int, text string")
    got = {r.doc_id: r.html for r in M.markdown_to_html(M.markdown_blocks(df)).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases
    assert len(got) == len(cases)


def test_markdown_of_many_lines(spark):
    """One long document in a single pass; deep stacks and long fences do no harm."""
    text = "\n".join(["- " * 200 + "x", "```", "y" * 100_000, *["a"] * 50_000, "```", *["> q", ""] * 5_000])
    rows = M.markdown_blocks(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert rows.count() == 5_002 and rows.agg(F.max("level")).first()[0] == 200


def test_sheet_runs(spark):
    rows = [
        ("s", 1, 1, "a", None, 2, 1), ("s", 1, 2, "", None, 3, 1), ("s", 1, 3, "", "9.5", 1, 1),
        ("s", 2, 1, "", None, 50, 900), ("s", 3, 1, "z", None, 1, 2),
    ]
    df = spark.createDataFrame(rows, "sheet_id string, row_no long, cell_no int, value string, attribute string, col_repeat int, row_repeat int")
    got = sorted((r.row, r.col, r.value) for r in M.expand_sheet(df).collect())
    assert got == [(1, 1, "a"), (1, 2, "a"), (1, 6, "9.5"), (2, 1, "z"), (3, 1, "z")]


def test_oversized_sheets_are_refused_before_they_grow(spark):
    rows = [("wide", 1, 1, "a", None, 2_000_000_000, 200_000), ("long", 1, 1, "a", None, 500, 1), ("long", 2, 1, "b", None, 1, 2_000_000_000), ("ok", 1, 1, "c", None, 1, 2)]
    df = spark.createDataFrame(rows, "sheet_id string, row_no long, cell_no int, value string, attribute string, col_repeat int, row_repeat int")
    assert sorted((r.sheet_id, r.row, r.col, r.value) for r in M.expand_sheet(df).collect()) == [("ok", 1, 1, "c"), ("ok", 2, 1, "c")]
    got = {r.sheet_id: (r.rows, r.columns, r.verdict) for r in M.sheet_limits(df, max_columns=500).collect()}
    assert got == {"wide": (200_000, 2_000_000_000, "too_wide"), "long": (2_000_000_001, 500, "too_long"), "ok": (2, 1, "ok")}


def test_one_sheet_over_many_buckets(spark):
    df = spark.range(5000).select(
        F.lit("s").alias("sheet_id"), F.col("id").alias("row_no"), F.lit(1).alias("cell_no"), F.col("id").cast("string").alias("value"),
        F.lit(None).cast("string").alias("attribute"), F.lit(1).alias("col_repeat"), (F.col("id") % 2 + 1).alias("row_repeat"),
    )
    got = M.expand_sheet(df).orderBy("row").collect()
    assert [r.row for r in got] == list(range(1, 7501))
    assert [int(r.value) for r in got] == sorted(int(r.value) for r in got)


def _markdown(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    return [r.markdown.strip() for r in M.html_to_markdown(df).orderBy("page_id").collect()]


def test_text_that_looks_like_markup_stays(spark):
    got = _markdown(
        spark, "<p>1 < 2 and 3 > 2</p>", '<p title="the hidden cost">Visible</p>', '<div class="menu hidden md:block">Shown</div>',
        "<p hidden>no</p><p>yes</p>", "<p>&#38;amp; &amp;lt; &lt;b&gt;</p>",
    )
    assert [g.replace("\\", "") for g in got] == ["1 < 2 and 3 > 2", "Visible", "Shown", "yes", "&amp; &lt; <b>"]
    rows = M.html_blocks(spark.createDataFrame([(1, "<p>a < b</p><p title='x > y'>c</p>")], "page_id int, html string")).orderBy("ordinal")
    assert [r.text for r in rows.collect()] == ["a < b", "c"]


def test_blocks_inside_blocks(spark):
    cell, item, head = _markdown(
        spark, "<table><tr><th>k</th></tr><tr><td><p>cell text</p><p>more</p></td></tr></table>", "<ul><li><p>x</p></li><li>y</li></ul>", "<h2><div>T</div></h2><p>z</p>",
    )
    assert "| cell text more |" in cell
    assert item.split() == ["-", "x", "-", "y"] and "- x" in item
    assert head.startswith("## T") and head.endswith("z")


def test_pages_of_odd_shape(spark):
    """Unclosed, crossed, hidden and endless elements; what takes a stack to tell."""
    cases = {
        "<a href=http://x.y>u</a>": "[u](http://x.y)",
        "<ul><li>a<ul><li>b": "- a\n\n  - b",
        "<div hidden>a<div>b</div>LEAK</div>": "",
        "<code><b>z</b></code>": "`z`",
        "<b>bold<p>x</b>y": "**bold\n\nx\n\n**y",
        "<table>loose<tr><td><table><tr><td>in|ner</table></table>": "loose\n\n| \\| in\\\\|ner \\| \\| --- \\| |\n| --- |",
        "<td>cell</td> <li>item": "cell \n- item",
        "<p title=it's>q</p></p></div>r</br>s": "q\n\nr\ns",
        "a <p never ends": "a",
        "<textarea><b>raw</b> &amp;</textarea><iframe><p>no</iframe>": "<b>raw</b> &",
        "<svg><p>no<svg></svg>no</svg>yes": "yes",
        "&eacute;&#x4e2d;&#128;&nosuch;": "é中€&nosuch;",
    }
    df = spark.createDataFrame(list(enumerate([*cases, None, ""])), "page_id int, html string")
    got = {r.page_id: r.markdown for r in M.html_to_markdown(df).collect()}
    assert {h: got[i].strip() for i, h in enumerate(cases)} == cases
    assert got[len(cases)] == got[len(cases) + 1] == "\n"
    deep = spark.createDataFrame([(1, "<div>" * 30_000 + "x"), (2, '<p a="' * 30_000), (3, "<td>" * 30_000 + "y")], "page_id int, html string")
    assert [r.markdown for r in M.html_to_markdown(deep).orderBy("page_id").collect()] == ["x\n", "\n", "y\n"]


def test_references_end_with_a_semicolon():
    from quire.functions.page_tree import Page

    page = Page('<p>a &amp; b&copy;&amp &am &#38 &ampx;</p><a href="/q?a=1&copy=2&amp;b=3">x&quo</a><title>&lt;&lt</title>')
    assert page.blocks == [("p", "a & b©&amp &am &#38 &ampx;"), ("text", "x&quo<&lt")]
    assert page.links == [("/q?a=1&copy=2&b=3", "x&quo")]


def test_rows_of_a_batch_are_read_in_slices():
    import pyarrow as pa

    texts = ["x" * 300_000, None, "", "y" * 3_000_000, *["z" * 400_000] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"])
    parts = M._slices(batch)
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(len(texts)))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()[1:]) <= M.SLICE for p in parts)
    assert M._slices(batch.slice(0, 0)) == []


def test_worker_reads_one_slice_at_a_time(spark):
    """The rows of an Arrow batch leave the step in several batches."""
    seen = []

    class Docs:
        schema = spark.createDataFrame([(1, "x")], "doc_id long, text string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            import pyarrow as pa

            texts = ["- a\n\n# b\n" * 20_000] * 40
            seen.extend(run(iter([pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], ["doc_id", "text"])])))
            return spark.createDataFrame([], f"doc_id long, _blocks array<{M.BLOCK}>")

    M.markdown_blocks(Docs())
    assert len(seen) > 4 and sum(b.num_rows for b in seen) == 40
    assert seen[0].column(1)[0].as_py()[:2] == [
        {"kind": "paragraph", "level": 1, "ordinal": None, "text": "a", "blank": False, "stack": [{"kind": "ul", "id": 1}, {"kind": "li", "id": 2}]},
        {"kind": "heading", "level": 1, "ordinal": None, "text": "b", "blank": True, "stack": []},
    ]


def test_line_words_without_a_negated_class(spark):
    from quire.plans import markup_queries as Q

    assert Q._others("a\nä") == r"[\x{0}-\x{9}\x{b}-\x{60}\x{62}-\x{e3}\x{e5}-\x{10ffff}]"
    rows = [("a\n\n \nä😀b\r\nÄ x  y\n",), ("",), ("  q  \n--",), ("\n",)]
    got = [r.w for r in spark.createDataFrame(rows, "text string").select(Q._line_words().alias("w")).collect()]
    assert got == [["a", "none", "none", "ä b", "x y", "none"], ["none"], ["q", "none"], ["none", "none"]]


def test_blocks_and_links_wait_until_asked_for():
    from quire.functions.page_tree import Page

    page = Page("<p>a\t b <a href='#'>c\n\nd</a></p> \n <h1> e</h1>")
    assert not {"markdown", "blocks", "links"} & set(vars(page))
    assert (page.blocks, page.links) == ([("p", "a b c d"), ("h1", "e")], [("#", "c d")])
