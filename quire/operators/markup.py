"""Text and markup conversion. One page or document is one row, and most work is a
projection on that row: HTML is cut into blocks and tokens with array functions and
folded back, so a corpus of pages converts without a shuffle.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.scale import running_total

# ---------------------------------------------------------------- plain HTML


def strip_html(html):
    """Visible text, roughly: scripts and styles out, tags to spaces, the four
    common entities decoded."""
    out = F.regexp_replace(html, r"(?i)<script[\s\S]*?</script>|<style[\s\S]*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def html_body(html):
    """Inner part between the first ``<body…>`` and the last ``</body>``, else all."""
    low = F.lower(html)
    at = F.instr(low, "<body")
    start = F.when(at > 0, F.instr(html.substr(at, F.length(html)), ">") + at - 1)
    back = F.instr(F.reverse(low), ">ydob/<")
    end = F.when(back > 0, F.length(html) - back - 5)
    ok = (at > 0) & F.contains(html.substr(at, F.length(html)), F.lit(">")) & (end > start)
    return F.when(F.coalesce(ok, F.lit(False)), html.substr(start + 1, end - start - 1)).otherwise(html)


NO_ALT = "未提供替代文字"


# Bytes of text that a Python step turns into rows at once.
SLICE = 1 << 20


def _slices(batch):
    """An Arrow batch (key, text) in runs of rows of about ``SLICE`` bytes, so that what a worker
    holds does not grow with the rows of a batch."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype="int64") // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def _read_pages(pages, key, html, out_type, values):
    """``values(Page)`` of every page as a column; many pages per Arrow batch, no shuffle.

    Elements close by rules of nesting, which a stack keeps (``functions.page_tree``).
    """
    import pyarrow as pa

    name, typed = out_type.split(" ", 1)
    kinds = {"string": pa.string(), "array<array<string>>": pa.list_(pa.list_(pa.string()))}

    def run(batches):
        from quire.functions.page_tree import Page

        for part in (part for batch in batches for part in _slices(batch)):
            read = [values(Page(source)) for source in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(read, kinds[typed])], [key, name])

    key_type = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(html).cast("string").alias("_html")).mapInArrow(run, f"`{key}` {key_type}, {name} {typed}")


def html_blocks(pages, key="page_id", html="html"):
    """(key, ordinal, kind, text) rows; kind is the tag the text follows (``text`` behind a
    closing one). Hidden and script content is left out."""
    rows = _read_pages(pages, key, html, "_blocks array<array<string>>", lambda p: p.blocks)
    return rows.select(key, F.posexplode("_blocks").alias("_i", "_b")).select(
        key, (F.col("_i") + 1).cast("bigint").alias("ordinal"), F.col("_b")[0].alias("kind"), F.col("_b")[1].alias("text")
    )


SAFE_LINK = r"(?i)^(https?:|mailto:|#)"


def html_links(pages, key="page_id", html="html"):
    """(key, ordinal, href, text, kept) of the shown links; ``kept`` = scheme allowed."""
    rows = _read_pages(pages, key, html, "_links array<array<string>>", lambda p: p.links)
    return rows.select(key, F.posexplode("_links").alias("_i", "_a")).select(
        key, (F.col("_i") + 1).cast("bigint").alias("ordinal"), F.col("_a")[0].alias("href"), F.col("_a")[1].alias("text")
    ).withColumn("kept", F.col("href").rlike(SAFE_LINK))


def html_to_markdown(pages, key="page_id", html="html"):
    """Markdown per page: headings, nested lists, emphasis, safe links, image texts, quotes, code
    fences and padded tables; hidden and script content dropped. Emphasis that is left open
    ends with the block around it, where a browser would carry it on."""
    return _read_pages(pages, key, html, "markdown string", lambda p: p.markdown)


def fence_for(content):
    """Backticks, at least three, one more than the longest run in the text."""
    runs = F.transform(F.regexp_extract_all(content, F.lit("(`+)"), 1), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


# ---------------------------------------------------------------- tables

MAX_COLUMNS, MAX_ROWS = 128, 20_000


def markdown_cell(col):
    return F.replace(F.replace(F.coalesce(col, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def table_to_markdown(rows, key="table_id", order="row_no", cells="cells"):
    """Lines (key, line_no, line) of one Markdown table per key, padded to the
    table's widest row, a rule after the first. Lines stay rows, so a table of any
    length is written in parallel; only the width per table is aggregated."""
    width = rows.groupBy(key).agg(F.max(F.size(cells)).alias("_w"), F.min(order).alias("_first"))
    padded = F.concat(
        F.transform(cells, lambda c: markdown_cell(c)), F.array_repeat(F.lit(""), F.col("_w") - F.size(cells))
    )
    line = F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("_w")), " | "), F.lit(" |"))
    body = F.array(F.struct(F.col(order).alias("n"), F.lit(0).alias("k"), line.alias("line")))
    head = F.array(
        F.struct(F.col(order).alias("n"), F.lit(0).alias("k"), line.alias("line")),
        F.struct(F.col(order).alias("n"), F.lit(1).alias("k"), rule.alias("line")),
    )
    return (
        rows.join(width, key)
        .select(key, F.explode(F.when(F.col(order) == F.col("_first"), head).otherwise(body)).alias("_l"))
        .select(key, F.col("_l.n").alias(order), F.col("_l.k").alias("part"), F.col("_l.line").alias("line"))
    )


def table_limits(rows, key="table_id", cells="cells", max_columns=MAX_COLUMNS, max_rows=MAX_ROWS):
    """Tables too wide or too long to convert."""
    return (
        rows.groupBy(key)
        .agg(F.max(F.size(cells)).cast("bigint").alias("columns"), F.count(F.lit(1)).alias("rows"))
        .withColumn(
            "verdict",
            F.when(F.col("columns") == 0, "empty")
            .when((F.col("columns") > max_columns) | (F.col("rows") > max_rows), "too_large")
            .otherwise("ok"),
        )
    )


def escape_markup(col, kind="html"):
    """``html`` escapes & < > " ; ``html_web`` also the apostrophe; ``markdown``
    puts a backslash before its marks."""
    if kind == "markdown":
        return T.escape_markdown(col)
    out = T.escape_html(col)
    return F.replace(out, F.lit("'"), F.lit("&#x27;")) if kind == "html_web" else out


def table_to_html(rows, key="table_id", order="row_no", cells="cells"):
    """Parts (key, row_no, part, html) of one HTML table per key: the first row as
    header cells, the closing tags as the last part. Concatenating the parts in
    order gives the table."""
    ends = rows.groupBy(key).agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    tag = lambda t: F.array_join(
        F.transform(cells, lambda c: F.concat(F.lit(f"<{t}>"), escape_markup(F.coalesce(c, F.lit("")), "html_web"), F.lit(f"</{t}>"))), ""
    )
    line = F.when(
        F.col(order) == F.col("_first"),
        F.concat(F.lit("<table><thead><tr>"), tag("th"), F.lit("</tr></thead><tbody>")),
    ).otherwise(F.concat(F.lit("<tr>"), tag("td"), F.lit("</tr>")))
    close = F.when(F.col(order) == F.col("_last"), F.lit("</tbody></table>")).otherwise(F.lit(""))
    return rows.join(ends, key).select(key, order, F.concat(line, close).alias("html"))


# Languages a fence names after the file's extension.
FENCE_LANGUAGES = ["json", "xml", "yaml", "yml"]


def fence_code(text, ext):
    """A text as a fenced block."""
    suffix = F.lower(F.regexp_replace(ext, r"^\.", ""))
    language = F.when(suffix.isin(FENCE_LANGUAGES), suffix).otherwise(F.lit("text"))
    fence = fence_for(text)
    return F.concat(fence, language, F.lit("\n"), text, F.lit("\n"), fence, F.lit("\n"))


# ---------------------------------------------------------------- Markdown

STACK = "array<struct<kind:string,id:int>>"
BLOCK = f"struct<kind:string,level:bigint,ordinal:bigint,text:string,blank:boolean,stack:{STACK}>"


def markdown_blocks(docs, key="doc_id", text="text"):
    """(key, block_no, kind, level, ordinal, text, path, stack, blank), one row per leaf block.

    ``kind`` is heading, paragraph, code, table, rule, or empty (a container without
    content). ``level`` is the heading's level or the depth of lists, ``ordinal`` the number of
    the innermost numbered item. ``path`` names the containers, such as ``quote/ul``;
    ``stack`` tells them apart; ``blank`` says that a blank line stands before the block.

    The lines of a text pass an automaton with a container stack (``functions.blocks``), once
    per document and many documents per Arrow batch; a document is one row, so nothing shuffles.
    A worker holds the blocks of about a megabyte of text, one document at least.
    """
    import pyarrow as pa

    field = pa.struct([("kind", pa.string()), ("id", pa.int32())])
    struct = pa.struct(
        [("kind", pa.string()), ("level", pa.int64()), ("ordinal", pa.int64()), ("text", pa.string()), ("blank", pa.bool_()), ("stack", pa.list_(field))]
    )

    def run(batches):
        from quire.functions.blocks import blocks_of

        for part in (part for batch in batches for part in _slices(batch)):
            found = [blocks_of(value) for value in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(struct))], [key, "_blocks"])

    typed = f"`{key}` {docs.schema[key].dataType.simpleString()}, _blocks array<{BLOCK}>"
    parsed = docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, typed)
    rows = parsed.select(key, F.posexplode("_blocks").alias("_i", "_b"))
    # an item adds nothing to the path that its list does not say
    path = F.array_join(F.transform(F.filter("_b.stack", lambda c: c["kind"] != "li"), lambda c: c["kind"]), "/")
    return rows.select(
        key, (F.col("_i") + 1).cast("bigint").alias("block_no"), "_b.kind", "_b.level", "_b.ordinal", "_b.text",
        path.alias("path"), "_b.stack", "_b.blank",
    )


# A code span between backtick runs of one length, or an escaped sign.
LITERAL = r"(?s)`(?<!``)(`*+)(?!`).*?`(?<!``)\1(?!`)|\\[!-/:-@\[-`{-~]"
# Stand for a literal, and for the ends of a link, while the other rules run.
MASK, LINK_START, LINK_END = "\ue001", "\ue002", "\ue003"
WEB_LINK = rf"(?i)^(?:https?|mailto):"
LINK_SPAN = r"\[([^\[\]]*)\]\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+&quot;.*?&quot;)?\)"


def _let(value, use):
    """``use(value)`` with ``value`` worked out once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _refill(text, mark, pieces):
    """``text`` with the ``mark`` number ``i`` replaced by ``pieces[i]``."""
    blank = F.lit("")
    return _let(text, lambda t: F.when(
        F.contains(t, F.lit(mark)),
        F.array_join(F.zip_with(F.split(t, mark), pieces, lambda g, p: F.concat(F.coalesce(g, blank), F.coalesce(p, blank))), ""),
    ).otherwise(t))


# Sign, pattern and replacement of the paired signs, in order. Each pattern begins with its sign
# and looks back over it, so that a search skips what lies between two signs.
EMPHASIS = (
    ("*", r"\*(?<!\*\*)\*\*(?=[^\s*])([^*]+?)(?<=[^\s*])\*\*\*(?!\*)", "<em><strong>$1</strong></em>"),
    ("*", r"\*(?<!\*\*)\*(?=[^\s*])(.+?)(?<=[^\s*])\*\*(?!\*)", "<strong>$1</strong>"),
    ("_", r"_(?<![\p{L}\p{N}_]_)_(?=\S)(.+?)(?<=\S)__(?![\p{L}\p{N}_])", "<strong>$1</strong>"),
    ("*", r"\*(?<!\*\*)(?=[^\s*])([^*]*?)(?<=[^\s*])\*(?!\*)", "<em>$1</em>"),
    ("_", r"_(?<![\p{L}\p{N}_]_)(?=[^\s_])([^_]*?)(?<=\S)_(?![\p{L}\p{N}_])", "<em>$1</em>"),
    ("~", r"~~(?=\S)(.+?)(?<=\S)~~", "<del>$1</del>"),
)


def inline_html(text):
    """Inline Markdown of one block as HTML: code, strong, em, strike-through, links with a
    safe scheme; images only when embedded as data. Code spans and escaped signs are set aside
    before any other rule runs, addresses of links before emphasis does."""

    def replaced(t, sign, pattern, to):
        return F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, to)).otherwise(t)

    def pictured(t):
        out = F.regexp_replace(t, r"!\[([^\]]*)\]\((data:image/[^)\s]*)\)", '<img src="$2" alt="$1">')
        out = F.regexp_replace(out, r"!\[\]\([^)]*\)", f"[图片：{NO_ALT}]")
        return F.when(F.contains(t, F.lit("![")), F.regexp_replace(out, r"!\[([^\]]*)\]\([^)]*\)", "[图片：$1]")).otherwise(t)

    def literal(v):
        # the text between the backticks; one blank on both sides belongs to the marks
        inner = F.regexp_replace(F.regexp_replace(v, r"\A`+|`+\z", ""), r"(?s)\A (.*\S.*) \z", "$1")
        code = F.concat(F.lit("<code>"), T.escape_html(F.replace(inner, F.lit("\n"), F.lit(" "))), F.lit("</code>"))
        return F.when(v.startswith("`"), code).otherwise(T.escape_html(v.substr(F.lit(2), F.lit(1))))

    def linked(t):
        hrefs = F.regexp_extract_all(t, F.lit(LINK_SPAN), F.lit(2))
        out = replaced(t, "[", LINK_SPAN, f"{LINK_START}$1{LINK_END}")
        for sign, pattern, to in EMPHASIS:
            out = _let(out, lambda v: replaced(v, sign, pattern, to))  # noqa: B023 - called at once
        safe = lambda yes: F.transform(hrefs, lambda h: F.when(h.rlike(WEB_LINK), yes(h)).otherwise(F.lit("")))
        out = _refill(out, LINK_START, safe(lambda h: F.concat(F.lit('<a href="'), h, F.lit('">'))))
        return _refill(out, LINK_END, safe(lambda h: F.lit("</a>")))

    def marked(t):
        return _refill(_let(_let(T.escape_html(F.regexp_replace(t, LITERAL, MASK)), pictured), linked), MASK, F.transform(F.regexp_extract_all(t, F.lit(LITERAL), F.lit(0)), literal))

    plain = F.regexp_replace(text, f"[{MASK}{LINK_START}{LINK_END}]", "")
    # Most texts have none of the signs.
    return F.when(text.rlike(r"[`*_~\[\\]"), _let(plain, marked)).otherwise(T.escape_html(plain))


def table_cells(row):
    """Cells of a table row; a bar behind a backslash belongs to its cell."""
    bare = F.regexp_replace(T.strip(row), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|"), lambda c: F.replace(T.strip(c), F.lit("\\|"), F.lit("|")))


def _table_html(text):
    """A header row, its delimiter row (not shown) and rows as wide as the header."""
    lines = F.split(text, "\n")
    width = F.size(table_cells(F.get(lines, F.lit(0))))
    row = lambda r: F.concat(
        F.lit("<tr>"),
        F.array_join(
            F.transform(
                F.slice(F.concat(table_cells(r), F.array_repeat(F.lit(""), width)), F.lit(1), width),
                lambda c: F.concat(F.lit("<td>"), inline_html(c), F.lit("</td>")),
            ),
            "",
        ),
        F.lit("</tr>"),
    )
    rows = F.concat(F.slice(lines, F.lit(1), F.lit(1)), F.slice(lines, F.lit(3), F.size(lines)))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, row), ""), F.lit("</table>"))


TAGS = {"quote": "blockquote", "ul": "ul", "ol": "ol", "li": "li"}


def markdown_to_html(blocks, key="doc_id"):
    """One HTML text per document from its blocks.

    Tags of containers open and close where the stacks of neighbouring blocks part. A list is
    loose if a blank line stands between two blocks whose innermost common list it is; in other
    lists paragraphs that stand in an item carry no tag of their own.
    """
    kind, text = F.col("kind"), F.col("text")
    body = (
        F.when(kind == "rule", F.lit("<hr>"))
        .when(kind == "code", F.concat(F.lit("<pre>"), T.escape_html(text), F.lit("</pre>")))
        .when(kind == "table", _table_html(text))
        .otherwise(inline_html(text))
    )
    docs = (
        blocks.withColumn("_body", body)
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("block_no", "kind", "level", "_body", "blank", "stack"))).alias("_bs"))
    )
    none = F.array().cast(STACK)
    docs = docs.withColumn("_before", F.concat(F.array(none), F.transform("_bs", lambda b: b["stack"])))
    # depth to which the stack of each block equals the one before it
    shared = lambda a, b: F.coalesce(
        F.nullif(F.array_position(F.zip_with(a, b, lambda x, y: x["id"].eqNullSafe(y["id"])), F.lit(False)), F.lit(0)) - 1, F.size(b)
    ).cast("int")
    docs = docs.withColumn(
        "_bs", F.transform("_bs", lambda b, i: F.struct(
            *[b[c].alias(c) for c in ("kind", "level", "_body", "blank", "stack")],
            F.get("_before", i).alias("before"), shared(F.get("_before", i), b["stack"]).alias("common"),
        ))
    )
    lists = lambda st: F.filter(st, lambda c: c["kind"].isin("ul", "ol"))
    loose = F.transform(F.filter("_bs", lambda b: b["blank"]), lambda b: F.try_element_at(lists(F.slice(b["stack"], F.lit(1), b["common"])), F.lit(-1))["id"])
    docs = docs.withColumn("_loose", F.array_compact(loose))
    name = lambda c: F.element_at(F.create_map(*[F.lit(v) for kv in TAGS.items() for v in kv]), c["kind"])
    opened = lambda st: F.array_join(F.transform(st, lambda c: F.concat(F.lit("<"), name(c), F.lit(">"))), "")
    closed = lambda st: F.array_join(F.transform(F.reverse(st), lambda c: F.concat(F.lit("</"), name(c), F.lit(">"))), "")
    behind = lambda st, n: F.slice(st, n + 1, F.size(st))

    def piece(b):
        in_item = F.coalesce(F.try_element_at(b["stack"], F.lit(-1))["kind"] == "li", F.lit(False))
        tight = in_item & ~F.coalesce(F.array_contains("_loose", F.try_element_at(lists(b["stack"]), F.lit(-1))["id"]), F.lit(False))
        tag = F.when(b["kind"] == "heading", F.concat(F.lit("h"), b["level"])).when((b["kind"] == "paragraph") & ~tight, F.lit("p"))
        shown = F.when(tag.isNotNull(), F.concat(F.lit("<"), tag, F.lit(">"), b["_body"], F.lit("</"), tag, F.lit(">"))).otherwise(b["_body"])
        return F.concat(closed(behind(b["before"], b["common"])), opened(behind(b["stack"], b["common"])), shown)

    last = closed(F.element_at("_before", -1))
    return docs.select(key, F.concat(F.array_join(F.transform("_bs", piece), ""), last).alias("html"))


def delimited_html(text, sep=","):
    """A small delimited text as one HTML table; quoted cells may hold the separator, line
    breaks and doubled quotes. A quote inside a plain cell, or one that never closes, is text."""
    quoted = rf'"[^"]*+(?:""[^"]*+)*+"'
    plain = rf"[^{sep}\r\n]*+"
    cell = rf"(?:{quoted})?+{plain}"
    # Every match takes the sign before it along, so that an empty record or cell counts.
    records = F.regexp_extract_all(
        F.concat(F.lit("\n"), F.regexp_replace(text, r"\r?\n\z", "")), F.lit(rf"\r?\n({cell}(?:{sep}{cell})*+)"), F.lit(1)
    )

    def cells(line):
        return F.transform(
            F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(rf"{sep}({cell})"), F.lit(1)),
            lambda c: F.when(
                c.rlike(rf"(?s)\A{quoted}\z"), F.replace(F.regexp_replace(c, r'\A"|"\z', ""), F.lit('""'), F.lit('"'))
            ).otherwise(c),
        )

    def row(line, tag):
        return F.array_join(
            F.transform(cells(line), lambda c: F.concat(F.lit(f"<{tag}>"), escape_markup(c, "html_web"), F.lit(f"</{tag}>"))), ""
        )

    def table(lines):
        body = F.transform(
            F.slice(lines, F.lit(2), F.size(lines)), lambda r: F.concat(F.lit("<tr>"), row(r, "td"), F.lit("</tr>"))
        )
        return F.concat(
            F.lit("<table><thead><tr>"), row(F.get(lines, F.lit(0)), "th"), F.lit("</tr></thead><tbody>"),
            F.array_join(body, ""), F.lit("</tbody></table>"),
        )

    return F.when(text == "", F.lit("<table></table>")).otherwise(_let(records, table))


def code_html(text, kind):
    return F.concat(F.lit('<pre data-kind="'), kind, F.lit('">'), escape_markup(text, "html_web"), F.lit("</pre>"))


def document_html(files, key="doc_id"):
    """Full HTML document per file by its extension: HTML body, Markdown, table or
    code, under an escaped title. Only Markdown files take the block pipeline; the
    others are one projection. ``files``: key, name, text."""
    ext = T.suffix(F.col("name"))
    tagged = files.withColumn("_ext", ext)
    kind = (
        F.when(F.col("_ext") == ".json", "json").when(F.col("_ext") == ".xml", "xml")
        .when(F.col("_ext").isin(".yaml", ".yml"), "yaml").otherwise("text")
    )
    text = F.col("text")
    direct = tagged.filter(~F.col("_ext").isin(".md", ".markdown")).withColumn(
        "_body",
        F.when(F.col("_ext").isin(".html", ".htm"), html_body(text))
        .when(F.col("_ext") == ".csv", delimited_html(text, ","))
        .when(F.col("_ext") == ".tsv", delimited_html(text, "\t"))
        .otherwise(code_html(text, kind)),
    )
    md = tagged.filter(F.col("_ext").isin(".md", ".markdown"))
    rendered = md.join(
        markdown_to_html(markdown_blocks(md.select(key, "text"), key), key).withColumnRenamed("html", "_body"), key, "left"
    ).withColumn("_body", F.coalesce("_body", F.lit("")))
    title = escape_markup(F.col("name"), "html_web")
    return direct.unionByName(rendered).select(
        key,
        F.concat(
            F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), title,
            F.lit('</title></head><body><div class="doc-meta">'), title, F.lit("</div>"), "_body", F.lit("</body></html>"),
        ).alias("html"),
    )


# ---------------------------------------------------------------- sheets, outlines, limits

MAX_SHEET_COLUMNS, MAX_SHEET_ROWS = 128, 10_000


def _sheet_runs(cells):
    """Cells with a value and where their runs lie: columns ``_start`` to ``_end``, rows up to
    ``_last``. Row starts are a running total per sheet over its rows, taken bucket by
    bucket, because one sheet may be most of the data."""
    value = T.strip(F.coalesce("value", F.lit("")))
    shown = F.when(value == "", F.coalesce("attribute", F.lit(""))).otherwise(value)
    shown = F.replace(F.replace(shown, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    reps = F.greatest(F.lit(1), F.coalesce("col_repeat", F.lit(1))).cast("bigint")
    inside = W.partitionBy("sheet_id", "row_no").orderBy("cell_no").rowsBetween(W.unboundedPreceding, 0)
    runs = (
        cells.withColumn("_v", shown)
        .withColumn("_n", reps)
        .withColumn("_end", F.sum("_n").over(inside))
        .filter("_v <> ''")
        .withColumn("_start", F.col("_end") - F.col("_n") + 1)
    )
    rows = runs.groupBy("sheet_id", "row_no").agg(
        F.greatest(F.lit(1), F.max(F.coalesce("row_repeat", F.lit(1)))).cast("bigint").alias("_reps"), F.max("_end").alias("_wide")
    )
    placed = running_total(rows, ["sheet_id"], F.expr("row_no div 1024"), ["row_no"], F.col("_reps"), "_last")
    return runs, placed


def sheet_limits(cells, max_columns=MAX_SHEET_COLUMNS, max_rows=MAX_SHEET_ROWS):
    """Size of each sheet and a verdict, from its runs: nothing is expanded for it."""
    return (
        _sheet_runs(cells)[1]
        .groupBy("sheet_id")
        .agg(F.max("_last").alias("rows"), F.max("_wide").alias("columns"))
        .withColumn(
            "verdict",
            F.when(F.col("columns") > max_columns, "too_wide").when(F.col("rows") > max_rows, "too_long").otherwise("ok"),
        )
    )


def expand_sheet(cells, max_columns=MAX_SHEET_COLUMNS, max_rows=MAX_SHEET_ROWS):
    """Run-length encoded cells to a dense grid: (sheet_id, row, col, value), both
    from 1. An empty run only moves the column on; rows without a value vanish. A
    blank value falls back to the attribute. Values are ready for a Markdown table: bars
    are escaped, a line break becomes a blank.

    Sheets over a limit are refused (``sheet_limits`` names them) before a run of theirs is
    expanded, so a few cells that repeat a million times cost no more than a few cells.
    """
    runs, placed = _sheet_runs(cells)
    fit = sheet_limits(cells, max_columns, max_rows).filter("verdict = 'ok'").select("sheet_id")
    return (
        runs.join(placed.join(fit, "sheet_id", "left_semi").drop("_wide"), ["sheet_id", "row_no"])
        .withColumn("row", F.explode(F.sequence(F.col("_last") - F.col("_reps") + 1, F.col("_last"))))
        .withColumn("col", F.explode(F.sequence("_start", "_end")))
        .select("sheet_id", "row", "col", F.col("_v").alias("value"))
    )


SLIDE = "幻灯片"


def outline_markdown(nodes):
    """Markdown of outline rows (doc_id, ord, node, level, text): headings,
    paragraphs, list items, slide titles."""
    c = F.col
    level = F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce(c("level"), F.lit(1)))).cast("int")
    piece = (
        F.when(c("node") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "text", F.lit("\n\n")))
        .when(c("node") == "item", F.concat(F.lit("- "), T.strip(c("text")), F.lit("\n")))
        .when(c("node") == "slide", F.concat(F.lit("## "), F.coalesce(F.nullif(c("text"), F.lit("")), F.lit(SLIDE)), F.lit("\n\n")))
        .otherwise(F.concat("text", F.lit("\n\n")))
    )
    return (
        nodes.select("doc_id", "ord", piece.alias("_p"))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "_p"))).alias("_ps"))
        .select("doc_id", F.array_join(F.transform("_ps", lambda p: p["_p"]), "").alias("markdown"))
    )


MAX_TEXT_BYTES = 20 * 1024 * 1024
MAX_BLOCKS = 25_000
MAX_PRINT_COLUMNS = 12
MAX_OUTPUT_PAGES = 2_000


def size_guard(texts, max_bytes=MAX_TEXT_BYTES, sep_bytes=7):
    """Per job: bytes of its joined text and the first document (ord) at which the
    running total breaks the limit. ``texts``: job_id, ord, text."""
    size = F.octet_length("text").cast("bigint") + F.when(F.col("ord") > 1, F.lit(sep_bytes)).otherwise(F.lit(0))
    sized = texts.select("job_id", "ord", size.alias("_b"))
    run = running_total(sized, ["job_id"], F.expr("ord div 1024"), ["ord"], F.col("_b"), "_run")
    return run.groupBy("job_id").agg(
        F.sum("_b").alias("bytes"), F.min(F.when(F.col("_run") > max_bytes, F.col("ord"))).alias("break_ord")
    )


def block_guard(blocks, key="doc_id", max_blocks=MAX_BLOCKS, max_columns=MAX_PRINT_COLUMNS):
    """Documents with too many blocks or a table too wide to print."""
    columns = F.when(
        F.col("kind") == "table",
        F.size(table_cells(F.get(F.split("text", "\n"), F.lit(0)))),
    )
    return (
        blocks.groupBy(key)
        .agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.max(columns), F.lit(0)).cast("bigint").alias("columns"))
        .withColumn(
            "verdict",
            F.when(F.col("blocks") > max_blocks, "too_many_blocks")
            .when(F.col("columns") > max_columns, "table_too_wide")
            .otherwise("ok"),
        )
    )


def page_guard(counts, max_pages=MAX_OUTPUT_PAGES):
    """Jobs whose output would have too many pages. ``counts``: job_id, n_pages."""
    return counts.groupBy("job_id").agg(F.sum("n_pages").alias("pages")).withColumn(
        "refused", F.col("pages") > max_pages
    )
