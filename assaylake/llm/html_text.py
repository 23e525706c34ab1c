"""HTML extraction: a forward tokenizer, a tree builder with implied tags and visibility rules, a layout-aware renderer.

Every step is linear in the page: the tokenizer never goes back, the builder knows where each tag was last
opened, and the renderer bounds how deep boxes nest, how wide columns are padded and what aligning adds to a table.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fmt: off
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"head", "title", "script", "style", "template", "noscript", "datalist", "iframe", "object", "audio", "video", "canvas", "noframes", "noembed", "defs", "desc", "metadata", "symbol", "annotation", "annotation-xml"}
#: Elements whose content is text up to their end tag; in the second, character references count.
RAW, RAW_WITH_REFERENCES = {"script", "style", "xmp", "iframe", "noembed", "noframes", "noscript"}, {"title", "textarea"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "pre", "blockquote", "figure", "hr", "fieldset", "listing", "menu"}
LINES = {"html", "body", "div", "section", "article", "header", "footer", "nav", "main", "aside", "address", "form", "li", "dt", "dd", "figcaption", "center", "details", "summary", "legend", "dialog", "hgroup", "search", "option", "optgroup", "caption", "tr"}
BLOCKS = SPACED | LINES
#: A start tag of the first ends the open element of the second that is nearest, unless one of the third is nearer.
IMPLIED = [
    ({"li"}, {"li"}, {"ul", "ol", "menu"}),
    ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    ({"option", "optgroup"}, {"option"}, {"select", "datalist", "optgroup"}),
    ({"td", "th"}, {"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    ({"tr"}, {"tr", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    ({"tbody", "thead", "tfoot"}, {"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    (BLOCKS - {"option", "optgroup", "html", "body"}, {"p"}, {"td", "th", "table", "li", "button", "caption", "object", "dd", "dt"}),
    ({"body"}, {"head"}, {"html"}),
]
#: An end tag does not close elements beyond these.
SCOPE = {"table", "td", "th", "caption", "html"}
# fmt: on
_RULES = {tag: [(ends, stop) for starts, ends, stop in IMPLIED if tag in starts] for tag in set().union(*(starts for starts, _, _ in IMPLIED))}
#: Boxes (items, quotes, cells) within one another that are laid out by themselves; deeper ones flow in the box around them.
DEPTH = 16
#: Characters that a cell is padded to at most, and columns of a table in which cells can span others.
PADDED, SPANNED = 120, 100
#: A table's cells are aligned if its lines then hold at most so many characters for each that is no space, and so many more.
ROOM, SMALL = 16, 4096

_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(["'])|([^\s>]*)))?)""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW | RAW_WITH_REFERENCES}
_SPACE = re.compile(r"[ \t\r\n\f]+")


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag whose name ended at ``at``, the first of equal names; where the tag ends, or -1 if the page ends in it."""
    attrs: dict[str, str] = {}
    if page.startswith(">", at):
        return attrs, at + 1
    while m := _ATTRIBUTE.match(page, at):
        close, name, double, single, unended, bare = m.groups()
        at = m.end()
        if close:
            return attrs, at
        if unended:
            return attrs, -1
        value = next((v for v in (double, single, bare) if v is not None), "")
        attrs.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return attrs, -1


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("start" | "end" | "text", tag or text, attributes) in order; comments and the like give nothing, nor does a tag that the page ends in."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        lt = n if lt < 0 else lt
        after = page[lt + 1 : lt + 2]
        closing = after == "/"
        first = page[lt + 2 : lt + 3] if closing else after
        letter = first.isascii() and first.isalpha()
        if lt < n and not letter and not (after and after in "!?" or closing and first):  # a mere sign
            lt += 1
            yield "text", unescape(page[at:lt]), {}
            at = lt
            continue
        if lt > at:
            yield "text", unescape(page[at:lt]), {}
        if lt == n:
            return
        if not letter:
            if page.startswith("<!--", lt):
                end = lt + 4 if page.startswith((">", "->"), lt + 4) else page.find("-->", lt + 4)
                at = page.find(">", end) + 1 if end >= 0 else n
            else:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            continue
        m = _NAME.match(page, lt + 1 + closing)
        attrs, at = _attributes(page, m.end())
        if at < 0:
            return
        tag = m[0].lower()
        yield "end" if closing else "start", tag, attrs
        if closing:
            continue
        if tag == "plaintext":
            yield "text", page[at:], {}
            return
        if tag in _RAW_END:
            m = _RAW_END[tag].search(page, at)
            end = m.start() if m else n
            if end > at:
                yield "text", unescape(page[at:end]) if tag in RAW_WITH_REFERENCES else page[at:end], {}
            at = end


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def shown(self, visible: bool) -> bool | None:
        """Whether its own text is visible, inside what is or is not; None if nothing of it is laid out."""
        if not self.attrs:
            return None if self.tag in HIDDEN or self.tag == "dialog" else visible
        style = {}
        for rule in (self.attrs.get("style") or "").lower().split(";"):
            name, _, value = rule.partition(":")
            style[name.strip()] = value.replace("!important", "").strip()
        if self.tag in HIDDEN or "hidden" in self.attrs or style.get("display") == "none" or (self.tag == "dialog" and "open" not in self.attrs):
            return None
        return {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), visible)


class TreeBuilder:
    """Builds the tree with the tags that HTML lets authors leave out; open elements are a stack, with the places of each tag in it."""

    def __init__(self):
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)

    def feed(self, page: str) -> Node:
        for kind, what, attrs in tokens(page):
            if kind == "text":
                self._text(what)
            elif kind == "start":
                self._start(what, attrs)
            else:
                self._close(what)
        return self.root

    def _nearest(self, tags: set[str]) -> int:
        return max([at[-1] for t in tags if (at := self.places.get(t))], default=0)

    def _end(self, tags: set[str], stop: set[str]) -> None:
        at = self._nearest(tags)
        if at and at > self._nearest(stop):
            self._pop(at)

    def _pop(self, upto: int) -> None:
        while len(self.open) > upto:
            self.places[self.open.pop().tag].pop()

    def _add(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.places[node.tag].append(len(self.open))
        self.open.append(node)

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body") and self.places[tag]:
            return
        if self.open[-1].tag == "head" and tag not in HIDDEN | {"meta", "link", "base"}:
            self._pop(len(self.open) - 1)  # content ends the head
        for ends, stop in _RULES.get(tag, ()):
            self._end(ends, stop)
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._add(Node("tr", {}))
        if tag in VOID:
            self.open[-1].children.append(Node(tag, attrs))
        else:
            self._add(Node(tag, attrs))

    def _close(self, tag: str) -> None:
        if tag in ("br", "p") and not self.places[tag]:
            self.open[-1].children.append(Node(tag, {}))
        elif tag not in VOID:
            self._end({tag}, SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else {"table"} - {tag})

    def _text(self, data: str) -> None:
        top = self.open[-1]
        if top.tag == "head" and data.strip():
            self._pop(len(self.open) - 1)
            top = self.open[-1]
        if top.tag in ("pre", "listing", "textarea") and not top.children:
            data = data.removeprefix("\r").removeprefix("\n")  # a newline right after the tag is not shown
        top.children.append(data)


class Flow:
    """Lines of one box: inline text gathers until a block starts or ends."""

    def __init__(self):
        self.lines: list[str] = []
        self.text: list[str] = []
        self.blank = False  # a blank line is due before what comes next

    def end_line(self, spaced: bool = False) -> None:
        line = "".join(self.text)
        self.text = []
        line = re.sub(r" ?\n ?", "\n", _SPACE.sub(" ", line).replace("\0", "\n")).strip(" ") if "\1" not in line else line.replace("\1", "")
        if line:
            self.put(line.split("\n"))
        self.blank |= spaced and bool(self.lines)

    def put(self, lines: list[str]) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines += lines

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return self.lines


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining marks none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def span(value: str | None) -> int:
    return min(1000, max(1, int(value))) if value and value.isascii() and value.isdigit() and len(value) < 5 else 1


def table_lines(rows: list[list[tuple[Node, list[str]]]]) -> list[str]:
    """Cells under one another in columns as wide as their widest cell, ``PADDED`` at most; spanned columns stay empty.

    A table that aligning would make far larger than its text, see ``ROOM``, has its cells one under another instead.
    Either way takes time in proportion to the cells, their lines and what is written.
    """
    grid: list[list[list[str]]] = []
    below: dict[int, int] = {}  # rows that a cell above still fills, by column
    for row in rows:
        line: list[list[str]] = []
        for cell, lines in row:
            while below.get(len(line), 0):
                below[len(line)] -= 1
                line.append([])
            down, across = span(cell.attrs.get("rowspan")), min(span(cell.attrs.get("colspan")), max(1, SPANNED - len(line)))
            for i in range(across):
                if down > 1 and len(line) < SPANNED:
                    below[len(line)] = down - 1
                line.append(lines if i == 0 else [])
        while below.get(len(line), 0):
            below[len(line)] -= 1
            line.append([])
        grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        for i, lines in enumerate(line):
            if lines:
                widths[i] = max([widths.get(i, 0), *(min(PADDED, width(x)) for x in lines)])
    columns = sorted(i for i, w in widths.items() if w)
    upto = [0, *accumulate(widths[i] + 2 for i in columns)]
    size = text = 0
    for line in grid:
        while line and not any(line[-1]):
            line.pop()
        size += max([0, *map(len, line)]) * upto[bisect_left(columns, len(line))]
        text += sum(len(x) - x.count(" ") for lines in line for x in lines)
    if size > ROOM * text + SMALL:
        return [x for line in grid for lines in line for x in lines]
    out = []
    for line in grid:
        own = columns[: bisect_left(columns, len(line))]
        for j in range(max([0, *map(len, line)])):
            cells = [(line[i][j] if j < len(line[i]) else "", widths[i]) for i in own]
            out.append("  ".join(c + " " * (w - width(c)) for c, w in cells).rstrip())
    return out


def button_label(node: Node) -> str:
    """What stands on an input that is a button; other inputs hold what the reader enters."""
    kind = (node.attrs.get("type") or "").strip().lower()
    default = {"submit": "Submit", "reset": "Reset", "button": ""}.get(kind)
    return "" if default is None else node.attrs.get("value", default)


def render(root: Node) -> str:
    """All visible text: blank lines around paragraphs, headings, lists and tables; list marks; aligned cells.

    A walk with its own stack, so that depth has no limit.
    """
    top = Flow()
    flows, tables, lists, pre = [top], [], [], 0  # tables: the rows of each open table
    stack: list[tuple[str, Node | str, bool]] = [("in", root, True)]  # what is left to do; whether text is visible, or whether a box was opened
    while stack:
        step, node, flag = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if flag and pre:
                flow.text.append("\1" + node.replace("\0", "").replace("\1", "").replace("\r\n", "\n").expandtabs(8))
            elif flag:
                flow.text.append(node.replace("\0", "").replace("\1", ""))
            continue
        tag = node.tag
        if step == "in":
            visible = node.shown(flag)
            if visible is None:
                continue
            if tag == "br":
                flow.text.append("\1\n" if pre else "\0")
                continue
            if tag == "hr":
                flow.end_line(spaced=True)
                continue
            if tag == "input" and visible:
                flow.text.append(button_label(node))
            if tag in VOID:
                continue
            if tag in BLOCKS:
                flow.end_line(spaced=tag in SPACED and not (tag in ("ul", "ol") and lists))
            boxed = False
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start") or "1"
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start, re.A) else 1])
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th"):
                boxed = bool(tables and tables[-1]) and len(flows) <= DEPTH
            elif tag in ("li", "blockquote", "dd"):
                boxed = len(flows) <= DEPTH
            elif tag == "q" and visible:
                flow.text.append('"')
            if boxed:
                flows.append(Flow())
            elif tag in ("td", "th"):
                flow.text.append(" ")
            elif tag == "li":
                flow.text.append(_mark(lists, node))
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            stack.append(("out" if visible else "out unseen", node, boxed))
            stack += [("in", c, visible) for c in reversed(children)]
            continue
        if flag:
            lines, flow = flows.pop().done(), flows[-1]
            if tag in ("td", "th"):
                tables[-1][-1].append((node, lines))
                continue
            mark = _mark(lists, node) if tag == "li" else "  "
            if lines:
                flow.put([(mark if i == 0 else " " * len(mark)) + line if line else "" for i, line in enumerate(lines)])
        if tag == "q" and step == "out":
            flow.text.append('"')
        elif tag == "table":
            if lines := table_lines(tables.pop()):
                flow.put(lines)
        elif tag in ("ul", "ol", "menu") and lists:
            lists.pop()
        if tag in BLOCKS:
            flow.end_line(spaced=tag in SPACED and not (tag in ("ul", "ol") and lists))
        if tag == "pre":
            pre -= 1
    return "\n".join(top.done())


def _mark(lists: list[list], item: Node) -> str:
    """The mark of the next item of the innermost list."""
    kind = lists[-1] if lists else ["ul", 1]
    if kind[0] == "ol" and re.fullmatch(r"-?\d{1,9}", item.attrs.get("value") or "", re.A):
        kind[1] = int(item.attrs["value"])
    kind[1] += 1
    return f"{kind[1] - 1}. " if kind[0] == "ol" else "- "


def html_to_text(html: str | None) -> str:
    """The visible text of a page as a browser would lay it out; null and empty pages give the empty text.

    Shown: all text that is laid out and not made invisible, labels of buttons, text of formulas and drawings. Not
    shown: what ``HIDDEN`` lists, hidden elements, closed details and dialogs, the content of input fields, and the
    alternative text of images, which browsers show only in place of a missing image.
    """
    return render(TreeBuilder().feed(html or ""))


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the text of each whole page in column ``out`` (replaced if there).

    Null and empty pages give the empty text; repeated rows a text each; no rows no rows; pages of any length and depth
    take time in proportion to their length; other columns, whatever their names and nulls, stay.
    """

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(html_to_text, na_action=None)

    return pages.withColumn(out, text(F.col(f"`{html}`")))
