"""A small tolerant HTML reader: a tree of elements, and text runs that know their element."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Fixed values of the HTML format.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that end an open element of the same group when they begin.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "body": ("head",)}
_SCOPES = frozenset("ul ol dl table select body html article section div".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r">|=\s*[\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[int] = field(default_factory=list)
    start: int = 0  # of its tag in the source


@dataclass
class Page:
    """Nodes in page order, the root first.  Runs are (node, text); a text of None is a line break or block edge."""

    nodes: list[Node]
    runs: list[tuple[int, str | None]]


class _TagEnds:
    """Where tags end: at the first ``>`` outside of quoted values.  Every quote is looked at once, so a page takes linear time."""

    def __init__(self, source: str):
        self.source, self.last, self.known = source, source.rfind(">"), {}

    def after(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``, or -1."""
        passed, found = [], -1
        while at <= self.last and (m := _STOP.search(self.source, at)) is not None:
            if m[0] == ">":
                found = m.start()
                break
            quote = m.end() - 1
            if quote in self.known:
                found = self.known[quote]
                break
            passed.append(quote)
            at = self.source.find(self.source[quote], quote + 1) + 1
            if not at:
                break
        self.known.update(dict.fromkeys(passed, found))
        return found


class _Builder:
    """The tree so far and the open elements, with what is asked about them kept up to date."""

    def __init__(self):
        self.nodes, self.runs = [Node("#root", -1, 0)], []
        self.stack, self.body = [0], 0
        self.near_p, self.near_block = [-1], [0]  # per open element: place of the p that a block would end, of the nearest block
        self.open: dict[str, list[int]] = {}  # places in the stack by tag

    def push(self, node: int) -> None:
        tag, place = self.nodes[node].tag, len(self.stack)
        self.near_p.append(place if tag == "p" else -1 if tag in BLOCK else self.near_p[-1])
        self.near_block.append(place if tag in BLOCK else self.near_block[-1])
        self.open.setdefault(tag, []).append(place)
        self.stack.append(node)

    def cut(self, place: int) -> None:
        """Close the elements from ``place`` on."""
        while len(self.stack) > place:
            self.open[self.nodes[self.stack.pop()].tag].pop()
            self.near_p.pop()
            self.near_block.pop()

    def text(self, value: str) -> None:
        if len(self.stack) == 1 and value.strip():
            self.open_body()
        self.runs.append((self.stack[-1], value))

    def open_body(self) -> None:
        """Text outside of all elements is the body's, as readers of HTML have it."""
        if self.body:
            self.push(self.body)
        else:
            self.begin("body", "", 0)

    def begin(self, tag: str, attrs: str, start: int) -> None:
        nodes = self.nodes
        if self.body and tag in ("html", "head", "body"):
            return  # the page's one body has begun
        if tag in BLOCK:
            while self.near_p[-1] >= 0:
                self.cut(self.near_p[-1])
        ends = CLOSES.get(tag)
        if ends:
            for at in range(len(self.stack) - 1, 0, -1):
                if nodes[self.stack[at]].tag in ends:
                    self.cut(at)
                    break
                if nodes[self.stack[at]].tag in _SCOPES:
                    break
        here = self.stack[-1]
        nodes.append(Node(tag, here, nodes[here].depth + 1, {
            k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(attrs)} if attrs.strip(" /") else {}, start=start))
        nodes[here].children.append(len(nodes) - 1)
        if tag in BLOCK or tag == "br":
            self.runs.append((here, None if tag != "br" else "\n"))
        if tag == "body":
            self.body = len(nodes) - 1
        if tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
            self.push(len(nodes) - 1)

    def end(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        at = self.open[tag][-1]
        if tag not in BLOCK and at < self.near_block[-1]:
            return  # an inline end tag does not close a block
        if tag in BLOCK:
            self.runs.append((self.stack[at], None))
        if tag not in ("body", "html"):  # what follows them is still the body's
            self.cut(at)


def parse(source: str) -> Page:
    """The tree of a page, in time that is linear in its length (but for the depth of open inline elements at list items and cells)."""
    page, ends, place, at = _Builder(), _TagEnds(source), 0, 0
    while (start := source.find("<", at)) >= 0:
        at = start + 1
        name = None
        if source.startswith("<!--", start):
            close = source.find("-->", start + 2)
            stop = close + 3 if close >= 0 else len(source)
        elif source.startswith(("<!", "<?"), start):
            stop = source.find(">", start) + 1 if start < ends.last else 0
        else:
            closing = source.startswith("</", start)
            name = _NAME.match(source, start + 1 + closing)
            stop = ends.after(name.end()) + 1 if name else 0
        if not stop:
            continue  # the mark is text
        if start > place:
            page.text(html.unescape(source[place:start]))
        place = at = stop
        if name is None:
            continue
        tag = name[0].lower()
        if closing:
            page.end(tag)
            continue
        page.begin(tag, source[name.end() : stop - 1], start)
        if tag in RAW and page.nodes[page.stack[-1]].tag == tag:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, place)
            page.cut(len(page.stack) - 1)
            place = at = close.end() if close else len(source)
    if place < len(source):
        page.text(html.unescape(source[place:]))
    return Page(page.nodes, page.runs)
