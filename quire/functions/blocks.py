"""Blocks of a Markdown text: an automaton over its lines with a stack of open containers.

Containers are quotes and list items; the stack keeps what a line must show to stay inside
each of them (a ``>``, or the indent of the item's text). At most one leaf block is open: a
paragraph, a table, code by indent, or code in a fence, whose sign and length are kept.
Every line is read once; memory is the text's own blocks.
"""

import re

RULE = re.compile(r"(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
HEADING = re.compile(r"(#{1,6})(?:[ \t]+|$)")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
BULLET = re.compile(r"([-*+])(?=[ \t]|$)")
ORDERED = re.compile(r"([0-9]{1,9})([.)])(?=[ \t]|$)")
# A delimiter row needs a bar or a colon, else it underlines a heading.
DELIMITER = re.compile(r"(?=.*[|:])\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
BAR = re.compile(r"(?<!\\)\|")


def cell_count(line):
    return len(BAR.split(re.sub(r"^\||(?<!\\)\|$", "", line.strip())))


def _indent(text):
    return len(text) - len(text.lstrip(" "))


class Automaton:
    """``feed`` every line, then ``finish``; ``blocks`` holds (kind, level, ordinal, text, blank, stack).

    ``stack`` lists the containers as (kind, number): ``quote``, or a list (``ul``/``ol``) and its ``li``.
    """

    def __init__(self):
        self.blocks, self.stack, self.leaf = [], [], None
        self.blank, self.number = False, 0

    def _new(self):
        self.number += 1
        return self.number

    def _emit(self, kind, text, level=None, blank=False):
        stack, lists, ordinal = [], 0, None
        for c in self.stack:
            c["used"] = True
            if c["kind"] == "quote":
                stack.append(("quote", c["id"]))
            else:
                stack += [(c["kind"], c["list"]), ("li", c["id"])]
                lists, ordinal = lists + 1, c["ordinal"]
        self.blocks.append((kind, lists if level is None else level, ordinal, text, blank, stack))

    def _close_leaf(self):
        leaf, self.leaf = self.leaf, None
        if leaf:
            lines = leaf["lines"]
            if leaf["kind"] == "indented":
                while lines and not lines[-1].strip():
                    lines.pop()
            kind = {"indented": "code", "fence": "code"}.get(leaf["kind"], leaf["kind"])
            self._emit(kind, (" " if kind == "paragraph" else "\n").join(lines), blank=leaf["blank"])

    def _close_to(self, depth):
        """Close the leaf and the containers from ``depth`` on; one without content stays as an empty block."""
        self._close_leaf()
        while len(self.stack) > depth:
            if not self.stack[-1]["used"]:
                self._emit("empty", "")
            self.stack.pop()

    def _start(self, kind, lines, **more):
        self._close_leaf()
        self.leaf = {"kind": kind, "lines": lines, "blank": self.blank, **more}
        self.blank = False

    def _single(self, kind, text, level=None):
        self._close_leaf()
        self._emit(kind, text, level, self.blank)
        self.blank = False

    def _stay(self, line):
        """How many containers the line stays in, and what is left of it."""
        depth = 0
        for c in self.stack:
            at = _indent(line)
            if c["kind"] == "quote":
                if at > 3 or line[at : at + 1] != ">":
                    break
                line = line[at + 1 :].removeprefix(" ")
            elif not line.strip():
                # an item may begin with one empty line, not with two
                if c["empty"] and not c["used"] and self.leaf is None:
                    break
            elif at >= c["width"]:
                line = line[c["width"] :]
            else:
                break
            depth += 1
        return depth, line

    def _open(self, depth, line):
        """Open the containers that ``line`` begins; what is left of it, and whether there were any."""
        opened = False
        while line.strip():
            at = _indent(line)
            text = line[at:]
            if at > 3:
                break
            bullet, ordered = BULLET.match(text), ORDERED.match(text)
            if text[0] == ">":
                self._close_to(depth)
                self.stack.append({"kind": "quote", "id": self._new(), "used": False})
                line = text[1:].removeprefix(" ")
            elif (bullet and not RULE.match(text)) or ordered:
                found = bullet or ordered
                rest = text[found.end() :]
                goes_on = self.leaf and self.leaf["kind"] == "paragraph" and not opened and depth == len(self.stack)
                if goes_on and (not rest.strip() or (ordered and int(ordered[1]) != 1)):
                    break
                mark = bullet[1] if bullet else ordered[2]
                old = self.stack[depth] if depth < len(self.stack) else None
                same = old and old["kind"] != "quote" and old["mark"] == mark
                self._close_to(depth)
                gap = _indent(rest)
                gap = gap if rest.strip() and gap <= 4 else 1
                self.stack.append(
                    {
                        "kind": "ul" if bullet else "ol", "mark": mark, "width": at + found.end() + gap, "used": False, "empty": not rest.strip(),
                        "list": old["list"] if same else self._new(), "id": self._new(),
                        "ordinal": None if bullet else old["ordinal"] + 1 if same else int(ordered[1]),
                    }
                )
                line = rest[gap:]
            else:
                break
            opened, depth = True, depth + 1
        return depth, line, opened

    def feed(self, raw):
        head = re.match(r"[ \t]*", raw)[0]
        depth, line = self._stay(head.expandtabs(4) + raw[len(head) :])
        inside = depth == len(self.stack)
        leaf = self.leaf
        if leaf and leaf["kind"] == "fence" and inside:
            at = _indent(line)
            if at <= 3 and re.fullmatch(re.escape(leaf["mark"]) + "+[ \t]*", line[at:]):
                self._close_leaf()
            else:
                leaf["lines"].append(line[min(at, leaf["indent"]) :])
            return
        if leaf and leaf["kind"] == "indented" and inside and (_indent(line) > 3 or not line.strip()):
            leaf["lines"].append(line[4:])
            return
        depth, line, opened = self._open(depth, line)
        at, text = _indent(line), line.strip()
        leaf = self.leaf
        paragraph = leaf is not None and leaf["kind"] == "paragraph"
        heading, fence = HEADING.match(text), FENCE.match(text)
        if not opened and depth < len(self.stack):
            # a paragraph may go on without the marks of its containers
            if paragraph and text and (at > 3 or not (heading or fence or RULE.match(text))):
                leaf["lines"].append(text)
                return
            self._close_to(depth)
            leaf, paragraph = None, False
        if not text:
            self._close_leaf()
            self.blank = bool(self.blocks)
        elif at > 3 and not paragraph:
            self._start("indented", [line[4:]])
        elif at > 3:
            leaf["lines"].append(text)
        elif paragraph and UNDERLINE.match(text):
            self.leaf = None
            self._emit("heading", " ".join(leaf["lines"]), 1 if text[0] == "=" else 2, leaf["blank"])
        elif heading:
            self._single("heading", re.sub(r"(^|[ \t]+)#+$", "", text[heading.end() :]), len(heading[1]))
        elif fence:
            self._start("fence", [], mark=fence[1] or fence[2], indent=at)
        elif RULE.match(text):
            self._single("rule", "")
        elif paragraph and DELIMITER.match(text) and cell_count(leaf["lines"][-1]) == cell_count(text):
            head = leaf["lines"].pop()
            if leaf["lines"]:
                self._start("table", [head, text])
            else:
                leaf.update(kind="table", lines=[head, text])
        elif leaf and leaf["kind"] in ("table", "paragraph"):
            leaf["lines"].append(text)
        else:
            self._start("paragraph", [text])

    def finish(self):
        self._close_to(0)
        return self.blocks


def blocks_of(text):
    """All blocks of a Markdown text in order."""
    automaton = Automaton()
    for line in re.split(r"\r\n|\n|\r", re.sub(r"(\r\n|\n|\r)\Z", "", text or "")):
        automaton.feed(line)
    return automaton.finish()
