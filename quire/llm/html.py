"""Main text of web pages by wrapper induction.

Pages of one host are made by one template. Their trees are aligned by simple tree
matching; what stays the same from page to page belongs to the template, what varies is a
slot. Three steps, all of them Spark jobs over every page:

1. *Reference.* Pages of a host fall into layouts (the set of tags they use); the reference
   of a layout is its page with the smallest id. A layout of fewer than ``FEW`` different
   pages shares the reference of the host's most frequent one.
2. *Votes.* Every page is aligned with its reference, one page for all copies of a body. For
   each reference node the pages report the hash of the node's text and its length without
   links; votes are added up per (host, layout, node, hash) before they move. Text of nodes
   that the reference lacks counts as varying at the nearest aligned node.
3. *Slots.* A node is constant when one text makes ``constant`` or more of its votes (and
   there are enough), else it is a slot. The content of a layout is the lowest region that
   covers its varying text, added up over its pages. Every page is aligned again and
   gives the blocks of its part of that region.

Menus, headers, footers, asides, forms, scripts, styles, notices, adverts and comments of
readers are no content by the meaning of their tags or class names, wherever the alignment
puts them. A page gives its own richest region, without lists of links, if it has no host,
if its layout tells nothing about the template (few pages, or hardly any varying text), or
if most of its text that is not the template's lies outside the aligned region. Nothing is
cut or capped.

Blocks: white space inside a block becomes one space, blocks are trimmed and joined by one
line break, character references are decoded, ``<br>`` is white space. Nulls: a null html
is empty and gives an empty text; a null url has no host. Repeated rows are pages of their
own; extra columns are ignored; an empty table gives no rows.
"""

import hashlib
import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm.common import partitions, stored

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
NAMED = re.compile(r"\b(?:class|id|role|hidden)\b", re.I)
SPACE = re.compile(r"[ \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of the main text.
CHROME = set("nav header footer aside form button select menu dialog head".split()) | RAW
#: An element of these names closes an open element of the names after it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class names and ids that mark what is not the article.
AWAY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|footer|header|menu|nav\w*|newsletter|notices?|popup|promo\w*|related|"
    r"share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Elements that belong to an article wherever they stand beside its other parts, those that are never a region, headlines.
PROSE = set("p h1 h2 h3 h4 h5 h6 ul ol dl table tbody blockquote pre figure".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li td th tr dd dt pre".split())
HEADLINES = {"h1", "h2", "h3"}
FEW = 3
#: A group whose varying text is a smaller share of its text has no wrapper.
NEGLIGIBLE = 0.05


class Node:
    """An element: name, mark (name with class), children (elements and texts), whether it is chrome."""

    __slots__ = ("name", "mark", "items", "chrome", "number")

    def __init__(self, name, attributes=""):
        self.name, self.items, self.number = name, [], -1
        self.mark, self.chrome = name + ".", name in CHROME
        if NAMED.search(attributes):
            found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
            label = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".strip()
            self.mark += found.get("class", "")
            self.chrome = self.chrome or "hidden" in found or bool(label and AWAY.search(label))

    def children(self):
        return [i for i in self.items if not isinstance(i, str)]


def parse(html):
    """The tree of a page. Unclosed elements end with their parent, a block ends an open ``p``."""
    root = Node("#root")
    stack, at, end = [root], 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            stack[-1].items.append(html[at:])
            break
        if m.start() > at:
            stack[-1].items.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        if name in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    del stack[i:]
                    break
                if stack[i].name in BLOCK:
                    break
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in CLOSES.get(name, ()):
                del stack[i:]
                break
            if stack[i].name in ("ul", "ol", "table", "dl", "select", "body"):
                break
        node = Node(name, m[3] or "")
        stack[-1].items.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
        elif name not in VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
    return root


def nodes_of(root):
    """All elements in page order, without recursion."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.number = len(out)
        out.append(node)
        stack += reversed(node.children())
    return out


def blocks(node, menus=True):
    """Texts of the blocks below ``node`` in page order, without chrome.

    Unless ``menus``, lists and divisions that hold little but links are left out too.
    """
    out, run = [], []

    def close():
        text = SPACE.sub(" ", unescape("".join(run))).strip(" ")
        if text:
            out.append(text)
        run.clear()

    stack = [("open", node)]
    while stack:
        what, item = stack.pop()
        if what == "text":
            run.append(item)
        elif what == "close":
            close()
        elif item is not node and (item.chrome or (not menus and item.name in ("ul", "ol", "div", "table") and _is_menu(item))):
            if item.name in BLOCK:
                close()
        elif item.name == "br":
            run.append(" ")
        else:
            block = item.name in BLOCK
            if block:
                close()
                stack.append(("close", item))
            stack += [("text" if isinstance(i, str) else "open", i) for i in reversed(item.items)]
    close()
    return out


def align(a, b):
    """Simple tree matching of two trees: reference node number -> page node.

    Children of matched nodes are matched in order, so that the number of matched nodes is
    largest; nodes match by mark. Equal marks at both ends are matched first, which never
    makes the number smaller; a table decides about what lies between.
    """
    pairs = {}
    stack = [(a, b)]
    weights = {}
    while stack:
        x, y = stack.pop()
        pairs[x.number] = y
        left, right = x.children(), y.children()
        if not left or not right:
            continue
        short, k = min(len(left), len(right)), 0
        while k < short and left[k].mark == right[k].mark:
            stack.append((left[k], right[k]))
            k += 1
        left, right, short, e = left[k:], right[k:], short - k, 0
        while e < short and left[-1 - e].mark == right[-1 - e].mark:
            stack.append((left[-1 - e], right[-1 - e]))
            e += 1
        left, right = left[: len(left) - e], right[: len(right) - e]
        if not left or not right:
            continue
        # order-preserving match; a pair weighs the marks its children share
        best = np.zeros((len(left) + 1, len(right) + 1), np.int64)
        for i in range(len(left) - 1, -1, -1):
            for j in range(len(right) - 1, -1, -1):
                best[i, j] = max(best[i + 1, j], best[i, j + 1])
                if left[i].mark == right[j].mark:
                    best[i, j] = max(best[i, j], best[i + 1, j + 1] + _common(left[i], right[j], weights))
        i = j = 0
        while i < len(left) and j < len(right):
            if left[i].mark == right[j].mark and best[i, j] == best[i + 1, j + 1] + _common(left[i], right[j], weights):
                stack.append((left[i], right[j]))
                i, j = i + 1, j + 1
            elif best[i, j] == best[i + 1, j]:
                i += 1
            else:
                j += 1
    return pairs


def _marks(node, cache):
    if id(node) not in cache:
        cache[id(node)] = sorted(c.mark for c in node.children())
    return cache[id(node)]


def _common(a, b, cache):
    return 1 + sum((Counter(_marks(a, cache)) & Counter(_marks(b, cache))).values())


def _is_menu(node):
    """Three links or more make nearly all of the text below a block."""
    links = total = linked = 0
    stack = [(node, False)]
    while stack:
        x, inside = stack.pop()
        links += x.name == "a"
        inside = inside or x.name == "a"
        for i in x.items:
            if isinstance(i, str):
                size = len(i.strip())
                total += size
                linked += size * inside
            else:
                stack.append((i, inside))
    return links >= 3 and linked >= 0.8 * total


def _hash(text):
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(url):
    """Host of a url, lower case; null without one."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def text_sizes(root, count):
    """Length of the text of its own of every element, by number: no chrome, no links outside headings."""
    out, stack = [0] * count, [(root, "")]
    while stack:
        node, within = stack.pop()
        if node.chrome and node is not root:
            continue
        if node.name in HEADLINES or node.name == "a" and within != "h":
            within = "a" if node.name == "a" else "h"
        if within != "a":
            out[node.number] = sum(len(i.strip()) for i in node.items if isinstance(i, str))
        stack += [(c, within) for c in node.children()]
    return out


def region_of(root, all_nodes, sizes, varying=False):
    """The content region of a tree: the lowest node that covers the text counted in ``sizes``.

    Prose and headlines are never left behind. What else may stay outside is a fiftieth of
    the text if it is known to vary, and a fifth (half, beside the only ``article``) if
    nothing is known about the template.
    """
    score, headed = list(sizes), [False] * len(all_nodes)
    only = [False] * len(all_nodes)
    for node in reversed(all_nodes):
        inner = [c for c in node.children() if not c.chrome]
        score[node.number] += sum(score[c.number] for c in inner)
        headed[node.number] = node.name in HEADLINES and score[node.number] > 0 or any(headed[c.number] for c in inner)
    articles = [n for n in all_nodes if n.name == "article" and score[n.number]]
    if len(articles) == 1:
        for node in reversed(all_nodes):
            only[node.number] = node is articles[0] or any(only[c.number] for c in node.children())
    total, at = score[root.number], root
    while score[at.number] and at.name != "article":
        inner = [c for c in at.children() if c.name in BLOCK and not c.chrome]
        rich = max(inner, key=lambda c: score[c.number], default=None)
        if rich is None or rich.name in LEAVES or not score[rich.number]:
            break
        if score[rich.number] < score[at.number]:
            least = 0.98 if varying else 0.5 if only[rich.number] else 0.8
            beside = [c for c in at.children() if c is not rich and not c.chrome and score[c.number]]
            if at.name == "main" or sizes[at.number] > 0.02 * total or score[rich.number] < least * total:
                break
            if any(c.name in PROSE or headed[c.number] for c in beside) or (rich.name in PROSE and not varying):
                break
        at = rich
    return at


def _read(html):
    """All elements of a page and its body."""
    every = nodes_of(parse(html or ""))
    return every, next((n for n in every if n.name == "body"), every[0])


def _own_text(node):
    return "\n".join([i for i in node.items if isinstance(i, str)]).strip()


def extract(pages, constant=0.9, salt=None):
    """``page_id, url, text`` of every page; a host is dealt to ``salt`` parts (as many as partitions)."""
    salt = salt or partitions(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    low = F.lower(F.coalesce("html", F.lit("")))
    key = F.xxhash64("page_id", "url", "html")
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(r"<([a-z][^\s/>]*)"), F.lit(1))))
    body = F.xxhash64(F.expr("substring(html, greatest(instr(lower(html), '<body'), 1))"))
    dealt = rows.withColumns({"host": host_of(F.col("url")), "key": key, "salt": F.pmod(key, F.lit(salt)).cast("int")})
    dealt = dealt.withColumn("layout", F.when(F.col("host").isNotNull(), F.xxhash64(tags)))
    hosted = dealt.filter(F.col("host").isNotNull())

    # one page stands for all copies of a body
    laid = stored(hosted.select("host", "layout", "salt", "key", "page_id", body.alias("body")), "wrapper-layouts")
    voters = laid.groupBy("host", "layout", "body").agg(F.min(F.struct("page_id", "key", "salt")).alias("v")).select("host", "layout", "v.*")
    common = stored(voters.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "key")).alias("first")), "wrapper-common")
    top = common.groupBy("host").agg(F.max(F.struct("n", (-F.col("layout")).alias("less"), "layout")).alias("top"))
    # a layout of few pages is read by the wrapper of the most frequent one, and votes on it if that has few pages too
    few = F.col("n") < FEW
    groups = common.join(top, "host").select(
        "host", "layout", F.when(few, F.col("top.layout")).otherwise(F.col("layout")).alias("group"),
        (~few | (F.col("top.n") < FEW) | (F.col("layout") == F.col("top.layout"))).alias("votes"),
    )
    groups = stored(groups, "wrapper-groups")
    first = common.select("host", F.col("layout").alias("group"), F.col("first.key").alias("key")).join(groups.select("host", "group").distinct(), ["host", "group"], "left_semi")
    reference = hosted.select("host", "key", "html").join(first, ["host", "key"]).groupBy("host", "group").agg(F.min("html").alias("reference"))
    reference = stored(reference, "wrapper-reference")

    def spread(table, cells):
        """``table``, one row per group, once for each part that pages of the group are dealt to."""
        return cells.join(groups, ["host", "layout"]).join(table, ["host", "group"]).groupBy("host", "layout", "salt")

    def votes(pages, wrappers):
        tally, chars = Counter(), Counter()
        host = group = None
        if wrappers.num_rows and pages.num_rows and wrappers.column("votes")[0].as_py():
            host, group = wrappers.column("host")[0].as_py(), wrappers.column("group")[0].as_py()
            _, tree = _read(wrappers.column("reference")[0].as_py())
            voting = set(wrappers.column("voters")[0].as_py())
            for key, html in zip(pages.column("key").to_pylist(), pages.column("html").to_pylist()):
                if key not in voting:
                    continue
                voting.remove(key)
                every, page = _read(html)
                sizes = text_sizes(page, len(every))
                pairs = align(tree, page)
                for number, node in pairs.items():
                    text = _own_text(node)
                    if text:
                        tally[number, _hash(text)] += 1
                        chars[number, _hash(text)] += sizes[node.number]
                # text of nodes that only this page has varies, at the nearest node that both have
                back = {node.number: number for number, node in pairs.items()}
                stack = [(page, tree.number)]
                while stack:
                    node, near = stack.pop()
                    near = back.get(node.number, near)
                    if node.number not in back and sizes[node.number]:
                        chars[near, None] += sizes[node.number]
                    stack += [(c, near) for c in node.children()]
        rows = [(host, group, *k, tally[k], n) for k, n in chars.items()]
        cols = list(zip(*rows)) or [()] * 6
        kinds = (("host", pa.string()), ("group", pa.int64()), ("node", pa.int32()), ("text_hash", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()))
        return pa.table({name: pa.array(c, k) for c, (name, k) in zip(cols, kinds)})

    chosen = voters.groupBy("host", "layout", "salt").agg(F.collect_list("key").alias("voters"))
    grouped = hosted.select("host", "layout", "salt", "key", "html").groupBy("host", "layout", "salt")
    told = grouped.cogroup(spread(reference, chosen)).applyInArrow(votes, "host string, group long, node int, text_hash long, n long, chars long")
    told = told.groupBy("host", "group", "node", "text_hash").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    told = told.groupBy("host", "group", "node").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "text_hash")).alias("top"), F.sum("chars").alias("chars"),
        F.sum(F.when(F.col("text_hash").isNull(), F.col("chars")).otherwise(0)).alias("more"),
    )
    # a node constant in enough pages weighs nothing
    fixed = (F.col("n") >= FEW) & (F.col("top.n") >= constant * F.col("n"))
    told = told.select("host", "group", "node", "n", "chars", F.when(fixed, F.col("top.text_hash")).alias("fixed"), F.when(fixed, F.col("more")).otherwise(F.col("chars")).alias("varying"))
    wrapper = told.groupBy("host", "group").agg(F.max("n").alias("most"), F.sum("chars").alias("chars"), F.collect_list(F.struct("node", "varying", "fixed")).alias("slots"))
    wrapper = stored(reference.join(wrapper, ["host", "group"], "left"), "wrapper-slots")

    def texts(pages, wrappers):
        tree = slot = None
        fixed = {}
        if wrappers.num_rows:
            slots = wrappers.column("slots")[0].as_py() or []
            varying = {s["node"]: s["varying"] for s in slots}
            # too few pages, or copies but for a date or counter, tell nothing about the template
            if (wrappers.column("most")[0].as_py() or 0) >= FEW and sum(varying.values()) > NEGLIGIBLE * wrappers.column("chars")[0].as_py():
                fixed = {s["node"]: s["fixed"] for s in slots if s["fixed"] is not None}
                every, tree = _read(wrappers.column("reference")[0].as_py())
                slot = region_of(tree, every, [varying.get(n.number, 0) for n in every], varying=True)
        out = [_main_text(html, tree, slot, fixed) for html in pages.column("html").to_pylist()]
        return pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array(out, pa.string())})

    cells = laid.select("host", "layout", "salt").distinct()
    final = dealt.drop("key").groupBy("host", "layout", "salt").cogroup(spread(wrapper, cells))
    return final.applyInArrow(texts, "page_id long, url string, text string")


def _main_text(html, tree, slot, fixed):
    every, page = _read(html)
    sizes = text_sizes(page, len(every))
    known = False
    if tree is not None:
        pairs = align(tree, page)
        own = list(sizes)
        for number, node in pairs.items():
            if number in fixed and _hash(_own_text(node)) == fixed[number]:
                own[node.number] = 0
        region = pairs.get(slot.number)
        if region is not None and slot is not tree and 2 * sum(own[n.number] for n in _below(region)) >= sum(own):
            return "\n".join(blocks(region))
        known = any(own)
        sizes = own if known else sizes
    return "\n".join(blocks(region_of(page, every, sizes, varying=known), menus=False))


def _below(node):
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack += node.children()
