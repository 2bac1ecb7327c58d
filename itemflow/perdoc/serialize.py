"""Serialization: xml, html, xhtml, text, json and adaptive."""

from __future__ import annotations

import json
import math
from decimal import Decimal

from ..errors import EngineError
from .items import Function, QName, XArray, XMap, atomic_text, type_name
from .tree import XML, Node

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo br button cite code dfn em i img input kbd label q s samp select small span strong sub sup textarea u var".split())
XHTML = "http://www.w3.org/1999/xhtml"


class Output:
    """Settings of xsl:output; characters: a character map."""

    def __init__(self, settings: dict[str, str] | None = None, characters: dict[str, str] | None = None):
        s = dict(settings or {})
        yes = lambda name, default=False: {"yes": True, "true": True, "1": True, "no": False, "false": False, "0": False}.get((s.get(name) or "").strip(), default)
        self.method = s.get("method", "")
        self.given = s
        self.encoding = s.get("encoding", "UTF-8")
        self.indent = yes("indent", self.method in ("html", "xhtml"))
        self.omit = yes("omit-xml-declaration", self.method in ("html", "text", "json", "adaptive"))
        self.standalone = s.get("standalone")
        self.public, self.system, self.version = s.get("doctype-public"), s.get("doctype-system"), s.get("html-version") or s.get("version") or ""
        self.cdata = set((s.get("cdata-section-elements") or "").split())
        self.separator = s.get("item-separator")
        self.meta = yes("include-content-type", True)
        self.bom = yes("byte-order-mark")
        self.characters = characters or {}
        self.escape_uri = yes("escape-uri-attributes", True)


def _mapped(text: str, o: Output, escape) -> str:
    if not o.characters:
        return escape(text)
    out, run = [], []
    for c in text:
        if c in o.characters:
            out += [escape("".join(run)), o.characters[c]]
            run = []
        else:
            run.append(c)
    return "".join([*out, escape("".join(run))])


def _encodable(text: str, o: Output) -> str:
    """Characters that the encoding lacks become references."""
    if o.encoding.upper().replace("_", "-") in ("UTF-8", "UTF-16", "UTF8"):
        return text
    return text.encode(o.encoding, "xmlcharrefreplace").decode(o.encoding)


def escape_text(t: str) -> str:
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#xD;")


def escape_attribute(t: str) -> str:
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("\t", "&#x9;").replace("\n", "&#xA;").replace("\r", "&#xD;")


def normalized(items: list, separator: str | None) -> list:
    """Adjacent values to text, arrays flattened; document nodes to their children."""
    out: list = []
    joined = False
    from .library import flat

    for i, v in enumerate(flat(items)):
        if isinstance(v, (XMap, Function)):
            raise EngineError("SENR0001", type_name(v))
        if separator is not None and i:
            out.append(Node("text", value=separator))
        if isinstance(v, Node):
            if v.kind in ("attribute", "namespace"):
                raise EngineError("SENR0001", v.kind)
            out += v.children if v.kind == "document" else [v]
            joined = False
        else:
            if joined and separator is None:
                out[-1] = Node("text", value=out[-1].value + " " + atomic_text(v))
            else:
                out.append(Node("text", value=atomic_text(v)))
            joined = True
    return out


def serialize(items: list, o: Output | None = None) -> str:
    o = o or Output()
    method = o.method
    if method == "json":
        return _json(items, o)
    if method == "adaptive":
        return (o.separator if o.separator is not None else "\n").join(adaptive(v) for v in items)
    nodes = normalized(items, o.separator)
    if not method:
        first = next((n for n in nodes if n.kind == "element" or n.kind == "text" and n.value.strip()), None)
        method = "html" if first is not None and first.kind == "element" and first.local.lower() == "html" and not first.uri else "xhtml" if first is not None and first.kind == "element" and first.local == "html" and first.uri == XHTML else "xml"
        if method != "xml":
            o = Output({**o.given, "method": method}, o.characters)
    if method == "text":
        return _mapped("".join(n.string() if n.kind in ("element", "text") else "" for n in nodes), o, lambda t: t)
    out: list[str] = []
    if method == "xhtml" or method == "xml":
        if not o.omit:
            out.append(f'<?xml version="1.0" encoding="{o.encoding}"' + (f' standalone="{o.standalone}"' if o.standalone in ("yes", "no") else "") + "?>")
            if o.indent:
                out.append("\n")
    top = next((n for n in nodes if n.kind == "element"), None)
    doctype = None
    if top is not None:
        if o.system:
            doctype = f"<!DOCTYPE {top.name()}" + (f' PUBLIC "{o.public}"' if o.public else " SYSTEM") + f' "{o.system}">'
        elif method in ("html", "xhtml") and (o.version.startswith("5") or not o.public) and top.local.lower() == "html":
            doctype = f"<!DOCTYPE {top.name()}>" if o.version.startswith("5") else None
        elif o.public and method == "html":
            doctype = f'<!DOCTYPE {top.name()} PUBLIC "{o.public}">'
    w = _Writer(o, method, out)
    for n in nodes:
        if n is top and doctype:
            out.append(doctype + ("\n" if o.indent else ""))
        w.write(n, {"xml": XML}, 0, False)
    return _encodable("".join(out), o)


class _Writer:
    def __init__(self, o: Output, method: str, out: list[str]):
        self.o, self.method, self.out = o, method, out

    def write(self, n: Node, scope: dict[str, str], depth: int, raw: bool) -> None:
        out, o = self.out, self.o
        if n.kind == "text":
            if raw or n.prefix == "raw":
                out.append(n.value)
            else:
                out.append(_mapped(n.value, o, escape_text))
            return
        if n.kind == "comment":
            out.append(f"<!--{n.value}-->")
            return
        if n.kind == "pi":
            out.append(f"<?{n.local} {n.value}".rstrip() + (">" if self.method == "html" else "?>"))
            return
        html = self.method == "html" and not n.uri or self.method == "xhtml" and n.uri == XHTML
        name = n.local if self.method == "html" and n.uri == XHTML else n.name()
        declared: dict[str, str] = {}
        inner = dict(scope)

        def declare(prefix: str, uri: str) -> None:
            if inner.get(prefix, "") != uri and prefix != "xml":
                declared[prefix] = inner[prefix] = uri

        declare(n.prefix, n.uri)
        for p, u in (n.namespaces or {}).items():
            if p != n.prefix and (p or n.prefix):
                declare(p, u)
        for a in n.attributes:
            if a.uri and a.uri != XML:
                prefix = a.prefix or next((p for p, u in inner.items() if u == a.uri and p), None) or self.fresh(inner)
                if inner.get(prefix) not in (None, a.uri):
                    prefix = next((p for p, u in inner.items() if u == a.uri and p), None) or self.fresh(inner)
                declare(prefix, a.uri)
                a.prefix = prefix
        out.append("<" + name)
        for p, u in sorted(declared.items()):
            if self.method == "html" and not u:
                continue
            out.append(f' xmlns{":" + p if p else ""}="{escape_attribute(u)}"')
        for a in n.attributes:
            if html and self.method == "html" and a.value.lower() == a.local.lower() and a.local.lower() in ("checked", "compact", "declare", "defer", "disabled", "ismap", "multiple", "nohref", "noresize", "noshade", "nowrap", "readonly", "selected"):
                out.append(" " + a.name())
                continue
            value = a.value
            if html and o.escape_uri and a.local.lower() in ("href", "src", "action", "cite", "longdesc", "usemap"):
                from ..functions.udfs import html_uri

                value = html_uri(value)
            text = _mapped(value, o, escape_attribute)
            out.append(f' {a.name()}="{text.replace("&lt;", "<") if self.method == "html" else text}"')
        local = n.local.lower()
        if html and local in VOID and not n.children:
            out.append(">" if self.method == "html" else " />")
            return
        head = html and local == "head" and o.meta and "include-content-type" in o.given
        if not n.children and not head:
            out.append(f"></{name}>" if html else "/>")
            return
        out.append(">")
        if head:
            out.append(f'<meta http-equiv="Content-Type" content="text/html; charset={o.encoding}"' + (">" if self.method == "html" else " />"))
        raw = self.method == "html" and local in ("script", "style")
        cdata = name in o.cdata or f"Q{{{n.uri}}}{n.local}" in o.cdata
        mixed = any(c.kind == "text" and c.value.strip() for c in n.children) or n.attribute("space", XML) == "preserve"
        lay = o.indent and not mixed and not raw and any(c.kind != "text" for c in n.children) and not (html and (local in ("pre", "textarea") or all(c.kind == "element" and c.local.lower() in INLINE for c in n.children)))
        for c in n.children:
            if lay:
                if c.kind == "text":
                    continue
                out.append("\n" + "   " * (depth + 1))
            if cdata and c.kind == "text":
                out.append("<![CDATA[" + c.value.replace("]]>", "]]]]><![CDATA[>") + "]]>")
            else:
                self.write(c, inner, depth + 1 if lay else depth, raw)
        if lay:
            out.append("\n" + "   " * depth)
        out.append(f"</{name}>")

    @staticmethod
    def fresh(scope: dict) -> str:
        i = 0
        while f"ns{i}" in scope:
            i += 1
        return f"ns{i}"


def _json(items: list, o: Output) -> str:
    if len(items) > 1:
        raise EngineError("SERE0023", "several items")

    def value(v):
        if isinstance(v, list):
            if len(v) > 1:
                raise EngineError("SERE0023", "several items")
            return value(v[0]) if v else None
        if isinstance(v, XMap):
            out = {}
            for k, x in v.items():
                if atomic_text(k) in out:
                    raise EngineError("SERE0022", atomic_text(k))
                out[atomic_text(k)] = value(x)
            return out
        if isinstance(v, XArray):
            return [value(m) for m in v.m]
        if isinstance(v, Node):
            return serialize([v], Output({"method": "xml", "omit-xml-declaration": "yes"}))
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float, Decimal)):
            if isinstance(v, float) and not math.isfinite(v):
                raise EngineError("SERE0020", atomic_text(v))
            return int(v) if v == int(v) and abs(v) < 1e15 else float(v)
        if isinstance(v, Function):
            raise EngineError("SERE0021", "a function")
        return atomic_text(v)

    out = json.dumps(value(items), ensure_ascii=False, indent=2 if o.indent else None, separators=None if o.indent else (",", ":"))
    return _mapped(out, o, lambda t: t) if o.characters else out


def adaptive(v) -> str:
    if isinstance(v, Node):
        if v.kind == "attribute":
            return f'{v.name()}="{escape_attribute(v.value)}"'
        if v.kind == "namespace":
            return f'xmlns{":" + v.local if v.local else ""}="{v.value}"'
        return serialize([v], Output({"method": "xml", "omit-xml-declaration": "yes"}))
    if isinstance(v, XMap):
        return "map{" + ",".join(adaptive(k) + ":" + sequence(x) for k, x in v.items()) + "}"
    if isinstance(v, XArray):
        return "[" + ",".join(sequence(m) for m in v.m) + "]"
    if isinstance(v, Function):
        return f"{v.name or '(anonymous-function)'}#{v.arity}"
    if isinstance(v, bool):
        return "true()" if v else "false()"
    if isinstance(v, QName):
        return f"Q{{{v.uri}}}{v.local}"
    kind = type_name(v)
    if kind in ("string", "untypedAtomic", "anyURI"):
        return '"' + str(v).replace('"', '""') + '"'
    if kind == "double":
        return atomic_text(v) if "E" in atomic_text(v) else atomic_text(v) + "e0"
    if kind in ("integer", "decimal"):
        return atomic_text(v)
    return f'xs:{kind}("{atomic_text(v)}")'


def sequence(v: list) -> str:
    return adaptive(v[0]) if len(v) == 1 else "(" + ",".join(adaptive(x) for x in v) + ")"
