"""Document trees: nodes in memory, built from XML, HTML or JSON text."""

from __future__ import annotations

import itertools
import json
import re
import xml.parsers.expat
from collections.abc import Iterator

from ..errors import EngineError
from .items import Untyped

XML = "http://www.w3.org/XML/1998/namespace"
FN = "http://www.w3.org/2005/xpath-functions"
_serial = itertools.count()


class Node:
    """kind: document, element, attribute, text, comment, pi or namespace."""

    __slots__ = ("kind", "uri", "local", "prefix", "value", "parent", "children", "attributes", "namespaces", "place", "tree", "base", "ids", "dtd")

    def __init__(self, kind: str, local: str = "", uri: str = "", prefix: str = "", value: str = ""):
        self.kind, self.local, self.uri, self.prefix, self.value = kind, local, uri, prefix, value
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.attributes: list[Node] = []
        self.namespaces: dict[str, str] | None = None
        self.place = -1
        self.tree = 0
        self.base = ""
        self.ids = None
        self.dtd = None

    # structure

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def set(self, attribute: Node) -> None:
        for i, a in enumerate(self.attributes):
            if (a.local, a.uri) == (attribute.local, attribute.uri):
                self.attributes[i] = attribute
                break
        else:
            self.attributes.append(attribute)
        attribute.parent = self

    def root(self) -> Node:
        n = self
        while n.parent is not None:
            n = n.parent
        return n

    def order(self) -> tuple[int, int]:
        """Document order; a tree is numbered when first asked, and again after it grew."""
        if self.place < 0:
            number(self.root())
        return self.tree, self.place

    def descendants(self) -> Iterator[Node]:
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    # values

    def string(self) -> str:
        if self.kind in ("document", "element"):
            return "".join(n.value for n in self.descendants() if n.kind == "text")
        return self.value

    def typed(self) -> object:
        return self.value if self.kind in ("comment", "pi", "namespace") else Untyped(self.string())

    def name(self) -> str:
        return f"{self.prefix}:{self.local}" if self.prefix else self.local

    def attribute(self, local: str, uri: str = "") -> str | None:
        for a in self.attributes:
            if a.local == local and a.uri == uri:
                return a.value
        return None

    def in_scope(self) -> dict[str, str]:
        out: dict[str, str] = {"xml": XML}
        chain = []
        n = self
        while n is not None:
            chain.append(n)
            n = n.parent
        for n in reversed(chain):
            if n.namespaces:
                out.update(n.namespaces)
        return {p: u for p, u in out.items() if u}

    def base_uri(self) -> str:
        n = self
        while n is not None:
            if n.base:
                return n.base
            n = n.parent
        return ""

    def copy(self) -> Node:
        out = Node(self.kind, self.local, self.uri, self.prefix, self.value)
        out.base = self.base
        out.namespaces = dict(self.namespaces) if self.namespaces else None
        for a in self.attributes:
            out.set(Node("attribute", a.local, a.uri, a.prefix, a.value))
        stack = [(self, out)]
        while stack:
            source, target = stack.pop()
            for c in source.children:
                n = Node(c.kind, c.local, c.uri, c.prefix, c.value)
                n.namespaces = dict(c.namespaces) if c.namespaces else None
                for a in c.attributes:
                    n.set(Node("attribute", a.local, a.uri, a.prefix, a.value))
                target.append(n)
                if c.children:
                    stack.append((c, n))
        return out


def number(root: Node) -> None:
    tree, place = next(_serial), 0
    stack = [root]
    while stack:
        n = stack.pop()
        n.tree, n.place = tree, place
        place += 1
        for a in n.attributes:
            a.tree, a.place = tree, place
            place += 1
        stack.extend(reversed(n.children))


def parse_xml(text: str | bytes, base: str = "", fragment: bool = False, strip=None) -> Node:
    """XML text to a document node.  fragment: content without a single root.  strip(element): whether to drop its white space."""
    doc = here = Node("document")
    doc.base = base
    pending: dict[str, str] = {}
    depth = 0
    p = xml.parsers.expat.ParserCreate(namespace_separator="\x01")
    p.namespace_prefixes = True
    p.buffer_text = True
    p.ordered_attributes = True

    def split(name: str) -> tuple[str, str, str]:
        parts = name.split("\x01")
        return (parts[0], "", "") if len(parts) == 1 else (parts[1], parts[0], parts[2] if len(parts) > 2 else "")

    def namespace(prefix, uri):
        pending[prefix or ""] = uri or ""

    def start(name, attributes):
        nonlocal here, depth, pending
        depth += 1
        if fragment and depth == 1:
            return
        local, uri, prefix = split(name)
        e = here.append(Node("element", local, uri, prefix))
        if pending:
            e.namespaces, pending = pending, {}
        for i in range(0, len(attributes), 2):
            local, uri, prefix = split(attributes[i])
            e.set(Node("attribute", local, uri, prefix, attributes[i + 1]))
        here = e

    def end(name):
        nonlocal here, depth
        depth -= 1
        if fragment and depth == 0:
            return
        here = here.parent

    def text_(data):
        if here is doc and not fragment:
            return
        if here.children and here.children[-1].kind == "text":
            here.children[-1].value += data
        else:
            here.append(Node("text", value=data))

    p.StartNamespaceDeclHandler, p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = namespace, start, end, text_
    p.CommentHandler = lambda data: here.append(Node("comment", value=data))
    p.ProcessingInstructionHandler = lambda target, data: here.append(Node("pi", target, value=data))
    dtd: dict = {"ids": set(), "refs": set(), "entities": {}}

    def attribute_type(element, name, kind, default, required):
        if kind in ("ID", "IDREF", "IDREFS"):
            dtd["ids" if kind == "ID" else "refs"].add((element, name))

    def unparsed(name, entity_base, system, public, notation):
        dtd["entities"][name] = (system, public or "")

    p.AttlistDeclHandler, p.UnparsedEntityDeclHandler = attribute_type, unparsed
    p.StartDoctypeDeclHandler = lambda *a: setattr(doc, "dtd", dtd)
    try:
        if fragment:
            body = re.sub(r"^\s*<\?xml[^>]*\?>", "", text if isinstance(text, str) else text.decode())
            p.Parse("<x>" + body + "</x>", True)
        else:
            p.Parse(text, True)
    except xml.parsers.expat.ExpatError as x:
        raise EngineError("FODC0006", str(x)) from None
    if strip:
        strip_space(doc, strip)
    return doc


def strip_space(doc: Node, strip) -> None:
    """Drop white-space text of the elements that strip() picks, but not under xml:space="preserve"."""
    for n in [doc, *doc.descendants()]:
        if n.kind == "element" and any(c.kind == "text" and not c.value.strip(" \t\r\n") for c in n.children):
            m, space = n, None
            while m is not None and space is None:
                space = m.attribute("space", XML) if m.kind == "element" else None
                m = m.parent
            if space != "preserve" and strip(n):
                n.children = [c for c in n.children if c.kind != "text" or c.value.strip(" \t\r\n")]


def parse_html(text: str) -> Node:
    """HTML text to a document node, as browsers read unclosed and stray tags."""
    from html.parser import HTMLParser

    void = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    closes_p = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
    doc = Node("document")
    here = doc

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            nonlocal here
            if tag in closes_p:
                n = here
                while n is not doc and n.local not in ("p", "td", "th", "button", "body"):
                    n = n.parent
                if n is not doc and n.local == "p":
                    here = n.parent
            if tag in ("li", "option", "tr", "td", "th", "dt", "dd"):
                stop = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr",), "th": ("tr",)}.get(tag, ("select", "dl"))
                n = here
                while n is not doc and n.local != tag and n.local not in stop:
                    n = n.parent
                if n is not doc and n.local == tag:
                    here = n.parent
            e = here.append(Node("element", re.sub(r"[^\w.\-]", "_", tag)))
            for k, v in attrs:
                e.set(Node("attribute", re.sub(r"[^\w.\-]", "_", k), value=v or ""))
            if tag not in void:
                here = e

        def handle_startendtag(self, tag, attrs):
            nonlocal here
            at = here
            self.handle_starttag(tag, attrs)
            if tag not in void:
                here = at

        def handle_endtag(self, tag):
            nonlocal here
            n = here
            while n is not doc and n.local != tag:
                n = n.parent
            if n is not doc:
                here = n.parent

        def handle_data(self, data):
            if here.children and here.children[-1].kind == "text":
                here.children[-1].value += data
            else:
                here.append(Node("text", value=data))

        def handle_comment(self, data):
            here.append(Node("comment", value=data))

    reader = Reader(convert_charrefs=True)
    reader.feed(text)
    reader.close()
    return doc


def json_tree(text: str, duplicates: str = "use-first", escape: bool = False) -> Node:
    """JSON text to the standard's tree of map, array, string, number, boolean and null elements."""
    doc = Node("document")

    def put(parent: Node, value: object, key: str | None) -> None:
        kind = "map" if isinstance(value, Pairs) else "array" if isinstance(value, list) else "boolean" if isinstance(value, bool) else "null" if value is None else "string" if isinstance(value, str) else "number"
        e = parent.append(Node("element", kind, FN))
        e.namespaces = {"": FN} if parent is doc else None
        if key is not None:
            e.set(Node("attribute", "key", value=key))
        if kind == "map":
            seen = {}
            for k, v in value:
                if k in seen and duplicates == "reject":
                    raise EngineError("FOJS0003", k)
                if k in seen and duplicates == "use-first":
                    continue
                if k in seen and duplicates == "use-last":
                    e.children.remove(seen[k])
                put(e, v, k)
                seen[k] = e.children[-1]
        elif kind == "array":
            for v in value:
                put(e, v, None)
        elif kind != "null":
            s = {True: "true", False: "false"}[value] if kind == "boolean" else value.text if isinstance(value, Number) else str(value)
            if s:
                e.append(Node("text", value=s))

    put(doc, read_json(text), None)
    return doc


class Pairs(list):
    """The pairs of an object, repeats included."""


class Number(float):
    text = ""


def _number(s: str) -> Number:
    out = Number(s)
    out.text = s
    return out


def read_json(text: str, liberal: bool = False) -> object:
    def bad(name):
        raise EngineError("FOJS0001", name)

    try:
        return json.loads(text, object_pairs_hook=Pairs, parse_int=_number, parse_float=_number, parse_constant=bad, strict=not liberal)
    except (ValueError, RecursionError) as x:
        raise EngineError("FOJS0001", str(x)) from None
