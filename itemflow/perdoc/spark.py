"""Per-document evaluation as DataFrame operators: a stylesheet or an expression on each document of a column.

Each row is evaluated by itself in a Python worker, in Arrow batches; the stylesheet is compiled once a task.  A
row that fails gives its error code in ``error`` and nothing else, so that one bad document doesn't end a job
(``strict`` raises instead).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import collations

TRANSFORMED = "doc_id long, result string, results map<string,string>, messages array<string>, error string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("result", pa.string()), ("results", pa.map_(pa.string(), pa.string())), ("messages", pa.list_(pa.string())), ("error", pa.string())])
EVALUATED = "doc_id long, items array<string>, error string"
_ITEMS = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(pa.string())), ("error", pa.string())])


def _guard(f, strict: bool):
    """f's result, or its error code."""
    try:
        return f(), None
    except EngineError as x:
        if strict:
            raise
        return None, x.code
    except RecursionError:
        if strict:
            raise
        return None, "SXLM0001"


def transform(df: DataFrame, key: str, text: str, stylesheet: str, kind: str = "xml", params: dict | None = None, modules: dict[str, str] | None = None, documents: dict[str, str] | None = None, template: str | None = None, mode: str | None = None, function: tuple | None = None, environment: dict | None = None, dynamic: bool = True, strict: bool = False) -> DataFrame:
    """The stylesheet on each document of a column: doc_id, result, results, messages, error.

    kind: xml, html, json or none (no source: the initial template runs for each row).  modules: texts of
    imported and included modules and packages by URI; documents: of what doc() may read.  Either is a mapping or a
    resolver, which runs in the workers: URI to text or None (``sources.resolvers`` has one for HTTP).  Nothing else is
    reachable.  template, mode, function: where to start.  params: values of stylesheet parameters.
    """

    own = collations.known()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..sources.documents import parser
        from .serialize import serialize
        from .stylesheet import Run, SheetCompiler, document_of, whitespace_stripper
        from .tree import parse_xml, strip_space

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        collations.KEYS.update(own)

        def text_at(source, uri: str, code: str) -> str:
            """From a mapping, or from a resolver of the caller: uri to text, None for what isn't there."""
            found = source(uri) if callable(source) else (source or {}).get(uri)
            if found is None:
                raise EngineError(code, uri)
            return found

        def module(uri: str) -> str:
            return text_at(modules, uri, "XTSE0165")

        sheet = SheetCompiler(module, {k: [v] for k, v in (params or {}).items()}).compile(stylesheet)
        parse = parser(kind) if kind != "none" else None
        loaded: dict = {}

        def document(uri: str):
            if uri not in loaded:
                loaded[uri] = parse_xml(text_at(documents, uri, "FODC0002"), uri)
            return loaded[uri]

        def one(value: str | None):
            source = parse(value) if parse is not None and value is not None else None
            r = Run(sheet, source, {k: v if isinstance(v, list) else [v] for k, v in (params or {}).items()}, document, lambda uri, encoding: text_at(documents, uri, "FOUT1170"), None, environment, dynamic)
            strip = whitespace_stripper(sheet, r.rt)
            if strip and source is not None:
                strip_space(source, strip)
            items = r.function(function[0], [[v] for v in function[1]]) if function else r.start(template, mode)
            o = r.output()
            return serialize(items if o.method in ("json", "adaptive") else [document_of(items)], o), list(r.results.items()), r.messages

        for batch in batches:
            out = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got, error = (None, None) if value is None and parse is not None else _guard(lambda v=value: one(v), strict)
                out.append((doc, *(got or (None, [], [])), error))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, TRANSFORMED)


def xpath(df: DataFrame, key: str, text: str, expression: str, kind: str = "xml", namespaces: dict | None = None, variables: dict | None = None, strict: bool = False) -> DataFrame:
    """The expression on each document: doc_id, items (their string values, maps and arrays as JSON), error."""

    own = collations.known()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..plans import xpath as X
        from ..sources.documents import parser
        from .evaluate import Compiler, Ctx, Static, string_of
        from .items import Function, XArray, XMap
        from .serialize import Output, serialize

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        collations.KEYS.update(own)
        program, parse = Compiler(Static(namespaces)).compile(X.parse(expression)), parser(kind)
        bound = {k: v if isinstance(v, list) else [v] for k, v in (variables or {}).items()}

        def shown(v) -> str:
            if isinstance(v, (XMap, XArray)):
                return serialize([v], Output({"method": "json"}))
            return f"function#{v.arity}" if isinstance(v, Function) else string_of(v)

        for batch in batches:
            out = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got, error = (None, None) if value is None else _guard(lambda v=value: [shown(x) for x in program(Ctx(parse(v), 1, 1, bound))], strict)
                out.append((doc, got, error))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ITEMS, strict=True)], schema=_ITEMS)

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, EVALUATED)
