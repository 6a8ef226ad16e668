"""Wrapper induction on planted pages, against a plain reading of the table's pages."""

import html
import re

from quire.llm.html import align, blocks, extract, nodes_of, parse


def plain(page):
    """The table's pages keep their article in an ``article`` element."""
    found = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in parts]
    return "\n".join(p for p in parts if p)


def test_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in extract(pages).collect()} == want


def page(i, body):
    links = "".join(f'<li><a href="/{k}">Section {k}</a>' for k in range(12))
    return (
        f"<html><head><title>T{i}</title></head><body><div class=top>Our site, since 1999, welcomes every reader of this page.</div><ul>{links}</ul>"
        f'<div class="main">{body}</div><div class="comments">First! {i} nice article, thank you very much indeed</div>'
        "<form>Mail <input></form><aside>Popular</aside><footer>(c)</footer></body></html>"
    )


def article(i):
    return f"<h2>Title &amp; {i}</h2><p>Story {i} begins  here,\n with <b>bold{i}</b> words and <a href=x>a link {i}</a>.<p>It ends {i * 7}.<ul><li>one {i}<li>two</ul>"


def expect(i):
    return f"Title & {i}\nStory {i} begins here, with bold{i} words and a link {i}.\nIt ends {i * 7}.\none {i}\ntwo"


MORE = "And there is a good deal more to tell about it. " * 5 + "Truly."


def test_template_is_left_out(spark):
    rows = [(i, f"http://h.example/{i}", page(i, article(i)), "x") for i in range(9)]
    # another layout of the same host, a page without a host
    rows += [(20, "http://h.example/p", "<body><p>Only this &lt;b&gt; text.</p></body>", "x"), (21, None, page(21, article(21) + f"<p>{MORE}"), "x")]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got == {**{i: expect(i) for i in range(9)}, 20: "Only this <b> text.", 21: f"{expect(21)}\n{MORE}"}


def texts(spark, rows):
    frame = spark.createDataFrame([(i, f"http://{host}/{i}", html) for i, host, html in rows], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in extract(frame).collect()}


def framed(body):
    return f"<body><div class=top><p>A tagline of the whole site</div><div class=main>{body}</div></body>"


def test_region_keeps_all_parts_of_an_article(spark):
    say = lambda k, i: f"Sentence {k} of story {i} has words."
    inner = {
        "body": lambda i: (f"<h1>Head {i}</h1>", "<div class=text>", [f"<p>{say(k, i)}" for k in range(12)], "</div>", ""),
        "table": lambda i: (f"<p>Before {i}", "<table>", [f"<tr><td>{say(k, i)}" for k in range(12)], "</table>", f"<p>After {i}"),
        "list": lambda i: (f"<p>Before {i}", "<ul>", [f"<li>{say(k, i)}" for k in range(12)], "</ul>", f"<p>After {i}"),
        "quote": lambda i: (f"<p>Before {i}", "<blockquote>", [f"<p>{say(k, i)}" for k in range(12)], "</blockquote>", f"<p>After {i}"),
    }
    rows, want = [], {}
    for at, (name, make) in enumerate(inner.items()):
        for wrap in ("article", "div"):
            for i in range(6):
                first, begin, parts, end, last = make(i)
                # the page that is the reference is mostly the inner element, the others are mostly paragraphs
                more = [] if i == 0 else [f"<p>{say(k, i)}" for k in range(20, 40)]
                number = len(rows)
                rows.append((number, f"{name}.{wrap}", framed(f"<{wrap}>{first}{begin}{''.join(parts)}{end}{last}{''.join(more)}</{wrap}>")))
                want[number] = "\n".join(re.sub("<[^>]*>", "", x) for x in [first, *parts, last, *more] if x)
    got = texts(spark, rows)
    assert {k: got[k] for k in want} == want
    # without a host, too
    frame = spark.createDataFrame([(i, None, html) for i, _, html in rows], "page_id long, url string, html string")
    assert all(want[r["page_id"]] in r["text"] for r in extract(frame).collect())


def test_each_layout_has_its_wrapper(spark):
    main = lambda i: f"<h2>Head {i}</h2>" + "".join(f"<p>Sentence {k} of {i}." for k in range(10))
    rows = [(i, "two.example", f"<body><div>The site's tagline</div><div>{main(i)}</div></body>") for i in range(8)]
    rows += [(20 + i, "two.example", f"<body><div>{main(20 + i)}</div><div><em>Words that are on every page of the section</em></div></body>") for i in range(5)]
    # a single page of a third layout
    rows += [(30, "two.example", f"<body><div>{main(30)}</div><div><code>Another end</code></div></body>")]
    got = texts(spark, rows)
    for i, _, _ in rows[:-1]:
        assert got[i] == "\n".join([f"Head {i}", *(f"Sentence {k} of {i}." for k in range(10))])
    assert "Head 30\nSentence 0 of 30." in got[30]


def test_copies_do_not_hide_the_article(spark):
    main = lambda i: f"<article><h1>Head {i}</h1><p>This is the story {i}.<p>It ends here.</article>"
    want = lambda i: f"Head {i}\nThis is the story {i}.\nIt ends here."
    rows = [(i, "copies.example", framed(main(1))) for i in range(12)]
    dated = lambda i: framed(main(1) * 1).replace("</body>", f"<div>{i}</div></body>")
    rows += [(20 + i, "dated.example", dated(i)) for i in range(9)]
    rows += [(40 + i, "mixed.example", framed(main(1 if i < 30 else i))) for i in range(34)]
    got = texts(spark, rows)
    for i, host, _ in rows:
        assert got[i] == want(i - 40 if host == "mixed.example" and i >= 70 else 1), (i, host)


def test_alignment_skips_inserted_nodes():
    a, b = parse("<div><p>x<h1>t</h1><p>y</div>"), parse("<div><ul></ul><p>x<p>new<h1>t</h1><p>y</div>")
    nodes_of(a), nodes_of(b)
    assert [n.mark for n in align(a, b).values()].count("h1.") == 1
    assert len(align(a, b)) == len(nodes_of(a))


def test_broken_markup():
    assert blocks(parse("a < b &amp c <p>d<!-- x <script>if (a<b) '</p>'</script><p>e<b>f<div>g")) == ["a < b & c", "d"]
    assert blocks(parse("x<script>no")) == ["x"] and blocks(parse("")) == []
    assert blocks(parse("<div>" * 5000 + "deep")) == ["deep"]


def test_edge_rows(spark):
    long = page(3, "<p>" + "word " * 200_000)
    rows = [(1, "http://a.example/", None), (2, None, ""), (None, "not a url", "<p>t"), (4, "http://a.example/", long), (4, "http://a.example/", long)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host int, reference string")
    got = sorted(((r["page_id"] or 0, r["text"]) for r in extract(df).collect()))
    words = ("word " * 200_000).strip()
    assert got == [(0, "t"), (1, ""), (2, ""), (4, words), (4, words)]
    assert extract(df.limit(0)).count() == 0
