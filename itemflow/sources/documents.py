"""Sources: XML, HTML, JSON and text, as rows or as a node table; sinks for results.

Paths are read by Spark's own readers and only below roots that the caller allows; nothing is reachable by
default.  A node table has a row for each node: doc_id, pre (document order), size (of the subtree), level,
parent, kind, name, uri, value.  Subtrees are intervals of pre, so axes are joins (``operators.nodes``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError

NODES = "doc_id long, pre int, size int, level int, parent int, kind string, name string, uri string, value string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("pre", pa.int32()), ("size", pa.int32()), ("level", pa.int32()), ("parent", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("uri", pa.string()), ("value", pa.string())])


def node_rows(root, doc: int) -> list[tuple]:
    """Rows of a tree in document order; attributes follow their element."""
    rows: list[list] = []
    stack = [(root, -1, 0, False)]
    place: dict[int, int] = {}
    while stack:
        n, parent, level, leaving = stack.pop()
        if leaving:
            rows[place[id(n)]][2] = len(rows) - place[id(n)] - 1
            continue
        at = place[id(n)] = len(rows)
        rows.append([doc, at, 0, level, parent, n.kind, n.local or None, n.uri or None, n.value if n.kind not in ("document", "element") else None])
        for a in n.attributes:
            rows.append([doc, len(rows), 0, level + 1, at, "attribute", a.local, a.uri or None, a.value])
        stack.append((n, parent, level, True))
        stack.extend((c, at, level + 1, False) for c in reversed(n.children))
    return rows


def parser(kind: str):
    from ..perdoc import tree

    return {"xml": tree.parse_xml, "html": tree.parse_html, "json": tree.json_tree, "fragment": lambda t: tree.parse_xml(t, fragment=True)}[kind]


def shred(df: DataFrame, key: str, text: str, kind: str = "xml") -> DataFrame:
    """Node table of the documents in a column.  A document that can't be parsed, or a null, has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = parser(kind)
        for batch in batches:
            rows: list = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = node_rows(parse(t), doc) if t is not None and doc is not None else []
                except EngineError:
                    found = []
                rows += found
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, NODES)


def _batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


class Reader:
    """Reads below the allowed roots only."""

    def __init__(self, spark: SparkSession, roots: list[str] | None = None):
        self.spark, self.roots = spark, [r.rstrip("/") for r in roots or []]

    def allowed(self, path: str) -> str:
        import posixpath

        clean = posixpath.normpath(path) if "://" not in path else path.split("://")[0] + "://" + posixpath.normpath(path.split("://", 1)[1])
        if not any(clean == r or clean.startswith(r + "/") for r in self.roots):
            raise EngineError("FODC0002", f"{path} is outside the allowed roots")
        return clean

    def xml_rows(self, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
        """Row-shaped XML: one row for each ``row_tag`` element."""
        reader = self.spark.read.format("xml").option("rowTag", row_tag)
        return (reader.schema(schema) if schema else reader).load(self.allowed(path))

    def json_rows(self, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
        reader = self.spark.read.option("multiLine", multi_line)
        return (reader.schema(schema) if schema else reader).json(self.allowed(path))

    def text(self, path: str, whole: bool = True) -> DataFrame:
        """unparsed-text (a row for each file) or unparsed-text-lines (a row for each line): path, value."""
        return self.spark.read.text(self.allowed(path), wholetext=whole).select(F.input_file_name().alias("path"), "value")

    def collection(self, path: str, select: str = "*", recurse: bool = False) -> DataFrame:
        """Files of a directory: path, text; the table form of collection('dir?select=*.xml;recurse=yes')."""
        reader = self.spark.read.format("binaryFile").option("pathGlobFilter", select).option("recursiveFileLookup", recurse)
        return reader.load(self.allowed(path)).select("path", F.decode("content", "UTF-8").alias("text"))

    def uri_collection(self, path: str, select: str = "*", recurse: bool = False) -> DataFrame:
        reader = self.spark.read.format("binaryFile").option("pathGlobFilter", select).option("recursiveFileLookup", recurse)
        return reader.load(self.allowed(path)).select("path")

    def validated(self, path: str, row_tag: str, schema: str, mode: str = "strict") -> DataFrame:
        """Rows of a declared schema.  strict: a row that doesn't fit is an error; lax: its fields are null; strip: only rows that fit."""
        modes = {"strict": "FAILFAST", "lax": "PERMISSIVE", "strip": "DROPMALFORMED"}
        return self.spark.read.format("xml").option("rowTag", row_tag).option("mode", modes[mode]).schema(schema).load(self.allowed(path))


def write_text(df: DataFrame, column: str, path: str) -> None:
    """Sink of text results: a line for each row, in Spark's part files."""
    df.select(F.col(column)).write.mode("errorifexists").text(path)


def write_results(transformed: DataFrame, path: str) -> None:
    """Sink of xsl:result-document: a table partitioned by href, with the document's key and text."""
    rows = transformed.select("doc_id", F.explode("results").alias("href", "text"))
    rows.write.mode("errorifexists").partitionBy("href").parquet(path)


def schema_of_xsd(text: str, element: str) -> str:
    """Spark DDL of an XSD element: sequences of simple typed elements and attributes, nested complex types."""
    from ..perdoc.tree import parse_xml

    doc = parse_xml(text)
    top = next(c for c in doc.children if c.kind == "element")
    named = {c.attribute("name"): c for c in top.children if c.kind == "element" and c.attribute("name")}
    simple = {"string": "string", "integer": "bigint", "long": "bigint", "int": "int", "short": "smallint", "decimal": "decimal(38,18)", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "dateTime": "timestamp", "anyURI": "string", "positiveInteger": "bigint", "nonNegativeInteger": "bigint"}

    def kind(e) -> str:
        name = (e.attribute("type") or "").split(":")[-1]
        inner = next((c for c in e.children if c.kind == "element" and c.local in ("complexType", "simpleType")), None)
        if inner is None and name in named:
            inner = named[name]
        if inner is None:
            return simple.get(name, "string")
        return complex_type(inner) if inner.local == "complexType" else base_of(inner)

    def base_of(e) -> str:
        for n in e.descendants():
            if n.kind == "element" and n.local in ("restriction", "extension"):
                base = (n.attribute("base") or "").split(":")[-1]
                return simple[base] if base in simple else base_of(named[base]) if base in named else "string"
        return "string"

    def complex_type(e) -> str:
        fields = []
        for n in e.descendants():
            if n.kind != "element" or _owner(n) is not e:
                continue
            if n.local == "element":
                target = named.get((n.attribute("ref") or "").split(":")[-1], n)
                t = kind(target)
                fields.append(f"`{target.attribute('name')}`: " + (f"array<{t}>" if n.attribute("maxOccurs") not in (None, "0", "1") else t))
            elif n.local == "attribute":
                fields.append(f"`_{n.attribute('name')}`: {kind(n)}")
            elif n.local in ("extension", "restriction") and n.parent.local == "simpleContent":
                base = (n.attribute("base") or "").split(":")[-1]
                fields.append(f"`_VALUE`: {simple[base] if base in simple else base_of(named[base]) if base in named else 'string'}")
        return "struct<" + ", ".join(fields) + ">"

    def _owner(n):
        n = n.parent
        while n is not None and n.local != "complexType":
            n = n.parent
        return n

    return kind(named[element]).removeprefix("struct<").removesuffix(">").replace("`: ", "` ", 0)
