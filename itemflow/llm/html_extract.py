"""HTML extraction: composite text density.

A page becomes a small DOM in one forward pass (implied end tags, void elements, unclosed and stray tags as browsers
read them; character references are decoded in each run of text).  What the contract leaves out is taken away first:
scripts, styles and other elements without text of their own, and the boxes that hold menus, headers, footers,
sidebars, notices, adverts, forms or reader comments, known by their element, role or class name (``KINDS``).  A class
name alone, but for comments, doesn't take away a box of several paragraphs with over half of the page's text.

Densities are measured on what is left.  For every node the density is its characters per tag, adjusted by its links; a
node's density sum adds up its children's densities.  The threshold is the least density on the path from the densest
node to the body; the subtree with the largest density sum among the nodes above it is selected.  It is widened to its
parent while the parent's other blocks belong to it: paragraphs, headings, lists, tables and boxes of the same kind,
and boxes above the threshold, none of them with more than half of its characters in links.  Widening ends at an
``article`` or ``main``, which are complete by themselves; inside an ``article`` boxes below the threshold belong too.

Figures and their captions stay.  ``label``, ``select``, ``option``, ``button`` and ``textarea`` are form parts;
``noscript``, ``template``, ``iframe``, ``object``, ``audio``, ``video``, ``canvas``, ``svg`` and ``math`` hold no text.
Null and empty pages give an empty text; equal rows give equal rows.  One row for each row of the input, other columns
are ignored; work and memory are linear in a page's length, however deep its elements.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*(?:(?P<end>>)|(?P<name>[^\s/>][^\s/>=]*)(?:\s*=\s*(?P<quote>[\"'])?)?)")
_BARE = re.compile(r"[^\s>]*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is read as text up to their end tag, all of it left out.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "xmp", "title", "noembed", "noframes")}
#: What may stand in a head.
IN_HEAD = frozenset("base link meta script style title noscript template".split())
#: Start tags that end the open elements of the same group below the nearest holder.
_GROUPS = {"li": (("li",), ("ul", "ol", "menu")), "d": (("dt", "dd"), ("dl",)), "row": (("tr",), ("table", "tbody", "thead", "tfoot")), "cell": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "part": (("tbody", "thead", "tfoot"), ("table",))}
_GROUP_OF = {tag: g for g, (tags, _) in _GROUPS.items() for tag in tags}
_HELD = {tag: [g for g, (_, holders) in _GROUPS.items() if tag in holders] for tag in {t for _, holders in _GROUPS.values() for t in holders}}
#: No open p beyond these is ended by a block.
_P_SCOPE = frozenset("table td th caption button object applet marquee template html".split())
#: Elements that hold no main text.
APART = frozenset("head title nav footer aside form button select option label input textarea dialog menu object embed audio video canvas applet svg math iframe script style noscript template xmp noembed noframes".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar".split())
#: Words that name boxes of the kinds to leave out, as the head of a class name or id.
KINDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination",
    "header": "header masthead topbar",
    "footer": "footer colophon",
    "sidebar": "sidebar sidebars aside",
    "notice": "notice notices cookie cookies consent gdpr",
    "advert": "ad ads advert adverts advertisement advertisements adsense adbox sponsor sponsored promo",
    "form": "form newsletter login signup",
    "comment": "comment comments commentlist disqus replies",
}
_KIND_OF = {w: kind for kind, words in KINDS.items() for w in words.split()}
#: Words after the head that don't change what a box is: "comments-area", "sidebar-left", "ad-300x250".
_QUALIFIERS = frozenset("area bar block bottom box col column container content inner item items left links list main outer panel primary right secondary section slot thread top unit widget wrap wrapper zone x".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACES = re.compile(r"\s+")
#: Blocks that belong to the text they stand beside.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 hgroup pre blockquote ul ol dl table figure details address header center hr br b i em strong a span code sub sup small q cite time abbr mark img".split())


class Node:
    __slots__ = ("tag", "parent", "items", "beside", "named", "kids", "chars", "tags", "link_chars", "link_tags", "density", "total", "level", "article", "label", "block", "p", "same", "open")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.items: list[Node | str] = []
        self.kids: list[Node] = []
        self.beside, self.named, self.label = False, "", ""
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        # what the parser asks about the open elements, handed down so that it never walks them
        self.level = parent.level + 1 if parent else 0
        self.article: Node | None = self if tag == "article" else parent.article if parent else None
        self.block: Node = self if tag in BLOCK or not parent else parent.block
        self.p: Node | None = self if tag == "p" else parent.p if parent and tag not in _P_SCOPE else None
        self.same: dict[str, Node] = parent.same if parent else {}
        if tag in _GROUP_OF and _GROUP_OF[tag] not in self.same:
            self.same = {**self.same, _GROUP_OF[tag]: self}
        if tag in _HELD:
            self.same = {g: n for g, n in self.same.items() if g not in _HELD[tag]}
        #: Open inline elements below this block, by tag.
        self.open: dict[str, int] = {}


def kind_of(name: str) -> str:
    """Kind of box that a class name or id says, or nothing: its last word counts, without qualifiers and numbers."""
    words = [w.lower() for w in _SPLIT.split(name) if w]
    while len(words) > 1 and (words[-1] in _QUALIFIERS or words[-1][0].isdigit()):
        words.pop()
    return _KIND_OF.get(words[-1], "") if words else ""


def _mark(node: Node, attrs: list[tuple[str, str]]) -> None:
    """Whether an element stands beside the main text: for certain, or by its class name."""
    tag = node.tag
    node.beside = tag in APART or tag == "header" and node.article is None
    for name, value in attrs:
        value = value.lower() if name in ("role", "aria-hidden") else value
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            node.beside = True
        elif name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for token in value.split():
                kind = kind_of(token)
                if kind and not (kind == "header" and node.article) and node.named != "comment":
                    node.named = kind
        if name == "class":
            node.label = value


def parse(page: str) -> tuple[Node, list[Node]]:
    """The body and all nodes, parents before children."""
    root = Node("html", None)
    here, nodes = root, [root]
    opened: dict[str, int] = {}  # blocks
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'>"}

    def text(a: int, b: int) -> None:
        nonlocal here
        if a < b:
            run = page[a:b]
            if here.tag == "head":
                if run.isspace():
                    return
                leave(root)
            here.items.append(html.unescape(run) if "&" in run else run)

    def leave(to: Node) -> None:
        """End the open elements below ``to``."""
        nonlocal here
        while here is not to:
            if here.tag in BLOCK:
                opened[here.tag] -= 1
            else:
                here.block.open[here.tag] -= 1
            here = here.parent

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(at, n)
            break
        c = page[lt + 1 : lt + 2]
        closing = c == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            if c not in ("!", "?", "/") or not c:  # a lone < is text
                text(at, lt + 1)
                at = lt + 1
                continue
            text(at, lt)
            if page.startswith("<!--", lt):
                quick = next((q for q in (">", "->") if page.startswith(q, lt + 4)), None)
                end = lt + 4 + len(quick) if quick else (e + 3 if (e := page.find("-->", lt + 4)) >= 0 else n)
            else:
                end = e + 1 if (e := page.find(">", lt + 2)) >= 0 else n
            at = end
            continue
        text(at, lt)
        at = name.end()
        tag, attrs, void = name[0].lower(), [], False
        while True:
            if at > last[">"]:  # never closed: no tag and no text
                return root, nodes
            m = _ATTR.match(page, at)
            if m["end"]:
                void = page[m.start() : m.end()].rstrip(">").endswith("/")
                at = m.end()
                break
            at, value = m.end(), ""
            if m["quote"]:
                if at <= last[m["quote"]]:
                    end = page.index(m["quote"], at)
                    value, at = page[at:end], end + 1
            elif page[at - 1] in "= \t\n\f\r" and "=" in m[0]:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
            attrs.append((m["name"].lower(), html.unescape(value) if "&" in value else value))
        if closing:
            if tag in BLOCK:
                if opened.get(tag):
                    while here.tag != tag:
                        leave(here.parent)
                    leave(here.parent)
            elif here.block.open.get(tag):
                while here.tag != tag:
                    leave(here.parent)
                leave(here.parent)
            continue
        if tag in ("html", "body"):
            if here.tag == "head":
                leave(root)
            continue
        if here.tag == "head" and tag not in IN_HEAD:
            leave(root)
        if here.p and tag in BLOCK:
            leave(here.p.parent)
        group = _GROUP_OF.get(tag)
        if group and group in here.same:
            leave(here.same[group].parent)
        node = Node(tag, here)
        _mark(node, attrs)
        here.items.append(node)
        here.kids.append(node)
        nodes.append(node)
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = (page.find(">", end.start()) + 1 or n) if end else n
        elif tag not in VOID and not (void and tag in ("svg", "math")):
            here = node
            if tag in BLOCK:
                opened[tag] = opened.get(tag, 0) + 1
            else:
                node.block.open[tag] = node.block.open.get(tag, 0) + 1
    return root, nodes


def take_away(nodes: list[Node]) -> list[Node]:
    """Marks the named boxes that count as such and returns the nodes that remain."""
    size, paragraphs = {}, {}
    for n in reversed(nodes):
        size[n] = 0 if n.beside else sum(len(x) for x in n.items if isinstance(x, str)) + sum(size[k] for k in n.kids)
        paragraphs[n] = 0 if n.beside else (n.tag == "p") + sum(paragraphs[k] for k in n.kids)
    out = []
    for n in nodes:
        if n.parent and n.parent.beside:
            n.beside = True
        elif n.named and (n.named == "comment" or paragraphs[n] < 2 or 2 * size[n] <= size[nodes[0]]):
            n.beside = True
        if not n.beside:
            out.append(n)
    return out


def measure(nodes: list[Node]) -> None:
    """Densities and density sums of the nodes that remain."""
    for n in reversed(nodes):
        n.chars += sum(len(_SPACES.sub(" ", x).strip()) for x in n.items if isinstance(x, str))
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        p = n.parent
        if p:
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags
    body = nodes[0]
    ratio = body.link_chars / max(1, body.chars)
    for n in nodes:
        if n.chars:
            plain = max(1, n.chars - n.link_chars)
            base = 1 + math.log(n.chars / plain * n.link_chars + ratio * n.chars + math.e)
            tags = max(1, n.tags)
            n.density = n.chars / tags * math.log(max(1.0, n.chars / max(1, n.link_chars) * tags / max(1, n.link_tags)), base)
        if n.parent:
            n.parent.total += n.density


def belongs(k: Node, best: Node, threshold: float) -> bool:
    """Whether a block beside ``best`` is of the same text."""
    if not k.chars or k.beside:
        return True
    if 2 * k.link_chars > k.chars:
        return False
    return k.tag in FLOW or k.density >= threshold or best.article is not None and k.article is best.article or (k.tag, k.label) == (best.tag, best.label) and k.tag != "article" and bool(k.label or k.tag == "section")


def main_node(nodes: list[Node]) -> Node:
    """The selected node of those that remain, the body first."""
    measure(nodes)
    body, some = nodes[0], [n for n in nodes if n.chars]
    if not some:
        return body
    walk: Node | None = max(some, key=lambda n: (n.density, n.level))
    threshold = walk.density
    while walk:
        threshold = min(threshold, walk.density)
        walk = walk.parent
    best = max((n for n in some if n.density >= threshold), key=lambda n: (n.total, n.level))
    while best.parent and best.tag not in ("article", "main") and all(k is best or belongs(k, best, threshold) for k in best.parent.kids):
        best = best.parent
    return best


def text_of(top: Node) -> str:
    """Blocks of the subtree, one a line, without what stands beside."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append(text)
            run.clear()

    stack: list[tuple[Node, int]] = [(top, 0)]
    while stack:
        node, i = stack.pop()
        block = node.tag in BLOCK
        if i == 0 and block:
            flush()
        while i < len(node.items):
            x = node.items[i]
            i += 1
            if isinstance(x, str):
                run.append(x)
            elif x.tag in VOID:
                if x.tag == "br":
                    run.append(" ")
                elif x.tag == "hr":
                    flush()
            elif not x.beside:
                stack.append((node, i))
                stack.append((x, 0))
                break
            elif x.tag in BLOCK:
                flush()
        else:
            if block:
                flush()
    flush()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    _, nodes = parse(page)
    return text_of(main_node(take_away(nodes)))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        text = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long")
