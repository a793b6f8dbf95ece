"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A block element is *kept* if its subtree holds main text.  Boosted trees give
every block element a probability from features of the node itself, its subtree
(text, link density, text per tag), its siblings, its depth and the tokens of its and its
ancestors' tag, class, id and role.  Decoding maximises the sum of log
probabilities under the condition that a kept node has kept ancestors, so that no
child is kept below a dropped parent; ``html`` and ``body`` are always kept.  Text runs of kept elements are joined:
one block per run of text between block edges.

Training material is a bounded sample: of ``max_pages`` pages of any size, whole
subtrees up to ``max_chars`` characters (where none fits, text up to half of it), and of
these the first ``max_pieces`` elements per training page.  They carry no labels, so a labelled set is made
from them: the content of ``article`` or ``main`` (or, without either, the page's
paragraphs outside of links and of parts with usual names) is main text;
it is set into other containers, and menus, headers, side bars, notices,
adverts, forms and comment sections built from other pages' text are put around
and inside it, with known labels.  The same page gives the same training set.

Extraction reads every page whole, in one pass without a shuffle.

Defined results: a null or empty page, or one without kept text, gives an empty
text; repeated rows give equal texts; an empty table gives an empty result; text
outside of all elements belongs to the body, also behind its end tag; with no text to train on every block counts as main text; unclosed and crossing tags are
closed by the next block or by the end; further columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm import boosting
from emberframe.llm.common import map_rows, smallest_hashes
from emberframe.llm.dom import BLOCK, Page, parse

_TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form",
         "table", "blockquote", "pre", "figure", "body", "fieldset", "dl", "details")
# Usual names of page parts in class, id and role tokens.
_ASIDE = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header "
    "masthead topbar footer copyright sidebar side aside widget related recommended recommendations popular trending share sharing social "
    "comment comments reply replies disqus discussion respond cookie cookies consent gdpr notice notification alert popup modal overlay "
    "newsletter subscribe subscription signup login form search tags tagcloud pagination pager toolbar skip hidden contentinfo complementary "
    "dialog legal disclaimer toc byline".split())
_MAIN = frozenset("article content main post entry story body text page hentry prose markdown maincontent".split())
_TOKEN = re.compile(r"[a-z]+")
_EDGES = frozenset(("title", "script", "style", "noscript", "template", "textarea", "iframe", "head", "xmp", "select", "button", "svg"))
WIDTH = 14 + 2 * 2 + 2 * len(_TAGS) + 4


def features(page: Page) -> tuple[list[int], np.ndarray]:
    """The block nodes, and a row of features for each."""
    nodes, n = page.nodes, len(page.nodes)
    text, linked, count = [0] * n, [0] * n, [1] * n
    in_link = [False] * n
    for i, node in enumerate(nodes):
        if i and (node.tag == "a" or in_link[node.parent]):
            in_link[i] = True
    for at, run in page.runs:
        if run:
            size = len(run.strip())
            text[at] += size
            if in_link[at]:
                linked[at] += size
    sentences = [0] * n
    for at, run in page.runs:
        if run:
            sentences[at] += run.count(". ") + run.endswith(".")
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        text[p] += text[i]
        linked[p] += linked[i]
        count[p] += count[i]
        sentences[p] += sentences[i]
    blocks = [i for i in range(1, n) if nodes[i].tag in BLOCK]
    x = np.zeros((len(blocks), WIDTH))
    flags: list[tuple[int, int]] = [(0, 0)] * n
    above: list[frozenset] = [frozenset()] * n
    place, alike = [0] * n, [0] * n  # among the siblings; siblings of the same tag
    for node in nodes:
        times = Counter(nodes[c].tag for c in node.children)
        for k, c in enumerate(node.children):
            place[c], alike[c] = k, times[nodes[c].tag]
    whole, index = max(1, text[0]), {t: k for k, t in enumerate(_TAGS)}
    row = 0
    for i in range(1, n):
        node = nodes[i]
        p = node.parent
        own = _tokens(node)
        flags[i] = (flags[p][0] + own[0], flags[p][1] + own[1])
        above[i] = above[p] | {node.tag} if node.tag in index and node.tag not in above[p] else above[p]
        if node.tag not in BLOCK:
            continue
        kin = nodes[p].children
        x[row, :18] = (
            log(1 + text[i]), linked[i] / max(1, text[i]), text[i] / count[i], log(count[i]), text[i] / whole, sentences[i],
            node.depth, place[i], len(kin), place[i] / len(kin), text[i] / max(1, text[p]), len(node.children), i / n,
            linked[p] / max(1, text[p]), own[0], own[1], flags[p][0], flags[p][1])
        if node.tag in index:
            x[row, 18 + index[node.tag]] = 1
        for tag in above[p]:
            x[row, 18 + len(_TAGS) + index[tag]] = 1
        at = 18 + 2 * len(_TAGS)
        before, after = place[i] - 1, place[i] + 1
        x[row, at : at + 4] = (
            log(1 + text[kin[before]]) if before >= 0 else -1, log(1 + text[kin[after]]) if after < len(kin) else -1,
            alike[i] / len(kin), node.tag == "p" and text[i] > 0)
        row += 1
    return blocks, x


def _tokens(node) -> tuple[int, int]:
    if not node.attrs:
        return 0, 0
    named = " ".join(node.attrs.get(k, "") for k in ("class", "id", "role")).lower()
    if "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or "display:none" in node.attrs.get("style", "").replace(" ", ""):
        named += " hidden"
    found = _TOKEN.findall(named)
    return sum(t in _ASIDE for t in found), sum(t in _MAIN for t in found)


def decode(page: Page, blocks: list[int], logits: np.ndarray) -> set[int]:
    """The most likely set of kept blocks in which every kept block's block ancestors are kept."""
    nodes = page.nodes
    # The body is no part among others: what is directly in it is judged only as such.
    own = {i: x for i, x in zip(blocks, logits.tolist(), strict=True) if nodes[i].tag not in ("html", "body")}
    gain = [0.0] * len(nodes)  # of keeping the node over dropping its subtree, given a kept parent
    for i in range(len(nodes) - 1, 0, -1):
        gain[i] += own.get(i, 0.0)
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    kept: set[int] = {0}
    for i in range(1, len(nodes)):
        if nodes[i].parent in kept and (gain[i] > 0 or i not in own):
            kept.add(i)
    return kept


def main_text(page: Page, kept: set[int]) -> str:
    nodes, out, block = page.nodes, [], []
    hidden = [False] * len(nodes)
    for i in range(1, len(nodes)):
        hidden[i] = hidden[nodes[i].parent] or nodes[i].tag in _EDGES

    def close() -> None:
        words = "".join(block).split()
        if words:
            out.append(" ".join(words))
        block.clear()

    for at, run in page.runs:
        if run is None:
            close()
        elif run == "\n" or (at in kept and at and not hidden[at]):
            block.append(run)
    close()
    return "\n\n".join(out)


# --- training set ---------------------------------------------------------------

_CONTAINERS = ('<article>{}</article>', '<main>{}</main>', '<div class="content">{}</div>', '<div id="main-content">{}</div>',
               '<div class="post-body entry">{}</div>', '<main><article class="post">{}</article></main>',
               '<div class="wrap"><section class="story">{}</section></div>', '<div>{}</div>')
_AROUND = ('<nav>{links}</nav>', '<div class="menu">{links}</div>', '<header><h1>{short}</h1>{links}</header>',
           '<div id="header">{short}</div>', '<div class="ad">{text}</div>', '<aside>{text}</aside>', '<div class="ad">{short}</div>',
           '<div class="sidebar"><h3>{short}</h3>{links}<p>{text}</p></div>', '<footer>{short}</footer>', '<div id="footer"><p>{text}</p></div>',
           '<div class="cookie-notice"><p>{text}</p></div>', '<form action="/s"><label>{short}</label><input name="q"></form>',
           '<section class="related"><h2>{short}</h2>{links}</section>', '<div class="comments"><div class="comment"><p>{text}</p></div></div>',
           '<section id="comments"><h2>{short}</h2><ul><li><p>{text}</p></li><li><p>{text}</p></li></ul></section>',
           '<footer><p>{text}</p></footer>', '<div role="alert"><p>{text}</p></div>', '<div class="newsletter"><form><p>{short}</p></form></div>')
_INSIDE = ('<aside>{text}</aside>', '<div class="advert"><p>{text}</p></div>', '<nav>{links}</nav>', '<div class="share">{links}</div>',
           '<form><p>{short}</p></form>', '<div class="comment"><p>{text}</p></div>', '<footer>{short}</footer>',
           '<section class="comments"><p>{text}</p></section>', '<div class="notice">{text}</div>', '<header>{short}</header>')
_OWN = ('<ul><li>{}</li><li>{}</li><li>{}</li></ul>', '<ol><li><p>{}</p></li><li><p>{}</p></li></ol>', '<blockquote><p>{}</p></blockquote>',
        '<h2>{}</h2>', '<h3>{}</h3><p>{}</p>', '<table><tr><td>{}</td><td>{}</td></tr></table>', '<pre>{}</pre>', '<div><p>{}</p><p>{}</p></div>',
        '<section><h2>{}</h2><p>{}</p></section>', '<figure><figcaption>{}</figcaption></figure>', '<p>{}<a href="#">{}</a>{}</p>')


def article_of(source: str) -> str:
    """The inner markup of the first article or main element; empty without one."""
    m = re.search(r"<(article|main)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", source, re.S | re.I)
    return m[2] if m else ""


def material(source: str, max_chars: int = 12_000) -> str:
    """Markup of main text, whole subtrees up to ``max_chars``: of article or main, else the page's own paragraphs."""
    body = article_of(source)
    if not body.strip():
        return _paragraphs(parse(source), max_chars)
    return body if len(body) <= max_chars else _subtrees(body, max_chars)


def _subtrees(body: str, max_chars: int) -> str:
    """The first subtrees, as large as possible, that fit; if none does, the first ``max_chars`` of the text."""
    page = parse(body)
    nodes, taken, room = page.nodes, [], max_chars
    last = list(range(len(nodes)))
    for i in range(len(nodes) - 1, 0, -1):
        last[nodes[i].parent] = max(last[nodes[i].parent], last[i])
    i = 1
    while i < len(nodes):
        end = nodes[last[i] + 1].start if last[i] + 1 < len(nodes) else len(body)
        if nodes[i].tag in BLOCK and end - nodes[i].start <= room:
            taken.append(body[nodes[i].start : end])
            room -= end - nodes[i].start
            i = last[i] + 1
        else:
            i += 1
    if taken:
        return "".join(taken)
    text = " ".join("".join(run for _, run in page.runs if run).split())
    return f"<p>{html.escape(text[: max_chars // 2], quote=False)}</p>" if text else ""


def _paragraphs(page: Page, max_chars: int) -> str:
    nodes, n = page.nodes, len(page.nodes)
    shut, block, texts = [False] * n, [0] * n, {}
    for i in range(1, n):
        node = nodes[i]
        shut[i] = shut[node.parent] or node.tag in _EDGES or node.tag in ("a", "nav", "header", "footer", "aside", "form") or (
            node.tag != "body" and _tokens(node)[0] > 0)
        block[i] = i if node.tag in BLOCK else block[node.parent]
    for at, run in page.runs:
        if run and not shut[at]:
            texts.setdefault(block[at], []).append(run)
    taken, room = [], max_chars
    for at, runs in texts.items():
        text = " ".join("".join(runs).split())
        if len(text) < 20:
            continue
        tag = nodes[at].tag if nodes[at].tag in ("div", "li", "pre", "blockquote", "h1", "h2", "h3") else "p"
        piece = f"<{tag}>{html.escape(text, quote=False)}</{tag}>"
        if len(piece) > room and not taken:
            piece = f"<{tag}>{html.escape(text[: max_chars // 2], quote=False)}</{tag}>"
        if len(piece) <= room:
            taken.append(piece)
            room -= len(piece)
    return "".join(taken)


def training_pages(bodies: list[str], seed: int = 5, max_pieces: int = 40) -> Iterator[str]:
    """Pages around the main texts ``bodies`` in which every element outside of the main text carries ``data-off``."""
    rng = random.Random(seed)
    prose = [t for b in bodies for t in re.findall(r">([^<>]{20,})<", b)] or ["Text of no page."]

    def part(template: str) -> str:
        links = "<ul>" + "".join(f'<li><a href="#">{rng.choice(prose)[:rng.randint(4, 20)]}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"
        made = template.format(links=links, short=rng.choice(prose)[:rng.randint(8, 60)], text=rng.choice(prose)[:rng.randint(40, 600)])
        return re.sub(r"<([a-z][a-z0-9]*)", r"<\1 data-off", made, count=1)

    def own(template: str) -> str:
        return template.format(*[rng.choice(prose)[:rng.randint(8, 300)] for _ in range(3)])

    for body in bodies:
        for _ in range(3):
            pieces = re.split(r"(?=<(?:p|h[1-6]|ul|ol|blockquote|div|section)\b)", body)
            pieces = pieces[:max_pieces]
            for _ in range(rng.choice((0, 0, 1, 2))):
                pieces.insert(rng.randint(0, len(pieces)), part(rng.choice(_INSIDE)))
            if rng.random() < 0.3:  # ends that are missing or that are there
                pieces = [p + "</b></p>" if p.startswith("<p><b>") and "</p>" not in p else p for p in pieces]
            for _ in range(rng.choice((0, 0, 1, 2))):
                pieces.insert(rng.randint(0, len(pieces)), own(rng.choice(_OWN)))
            before = "".join(part(rng.choice(_AROUND)) for _ in range(rng.randint(0, 4)))
            behind = "".join(part(rng.choice(_AROUND)) for _ in range(rng.randint(0, 4)))
            inner = rng.choice(_CONTAINERS).format("".join(pieces).replace("{", "").replace("}", ""))
            if rng.random() < 0.3:
                before, inner, behind = "", f"<div>{before}{inner}{behind}</div>", ""
            yield f"<html><body>{before}{inner}{behind}</body></html>"


def train(sources: list[str], **options) -> boosting.Boosted:
    return _train([b for b in map(material, sources) if b], **options)


def _train(bodies: list[str], max_pieces: int = 40, **options) -> boosting.Boosted:
    rows, labels = [], []
    for source in training_pages(bodies, max_pieces=max_pieces):
        page = parse(source)
        blocks, x = features(page)
        off, good = [False] * len(page.nodes), [False] * len(page.nodes)
        for i, node in enumerate(page.nodes[1:], 1):
            off[i] = off[node.parent] or "data-off" in node.attrs
        for at, run in page.runs:
            if run and run.strip() and not off[at]:
                good[at] = True
        for i in range(len(page.nodes) - 1, 0, -1):
            good[page.nodes[i].parent] |= good[i]
        full = [k for k, i in enumerate(blocks) if x[k, 0] > 0]  # nodes without text decide nothing
        rows.append(x[full])
        labels += [good[blocks[k]] for k in full]
    x = np.concatenate(rows) if rows else np.zeros((1, WIDTH))
    return boosting.fit(x, np.array(labels or [True], float), **options)


def train_on(pages: DataFrame, html_col: str = "html", max_pages: int = 150, max_chars: int = 12_000, max_pieces: int = 40) -> boosting.Boosted:
    """Train on material of the pages with the smallest hashes; tasks cut it out, so that the driver gets only this."""
    sources = pages.select(F.col(f"`{html_col}`").alias("h")).where("h IS NOT NULL")
    bodies = smallest_hashes(sources, "h", max_pages, lambda source: material(source, max_chars))
    return _train([b for b in bodies if b], max_pieces)


def extract(pages: DataFrame, model: boosting.Boosted, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def flush(held: list) -> Iterator[tuple]:
        logits = model.logits(np.concatenate([x for *_, x in held]))
        at = 0
        for key, url, page, blocks, x in held:
            text = main_text(page, decode(page, blocks, logits[at : at + len(x)]))
            at += len(x)
            yield key, url, text, len(text)

    def rows(sources: Iterator[tuple]) -> Iterable[tuple]:
        held, size = [], 0
        for key, url, source in sources:
            page = parse(source)
            held.append((key, url, page, *features(page)))
            size += len(page.nodes)
            if size > 20_000:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    columns = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                           F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    return map_rows(columns, rows, f"page_id {dict(columns.dtypes)['page_id']}, url string, text string, n_chars bigint")
