"""The engine's entry point for tables: expressions select and filter rows, operators take DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import columns, values


class Rows:
    """A table as the sequence of its rows, each a context item whose columns are child elements.

    where and select take XPath; everything stays one lazy DataFrame.
    """

    def __init__(self, df: DataFrame, variables: dict[str, values.Val] | None = None, functions: dict | None = None):
        self.df, self.variables, self.functions = df, variables or {}, functions or {}

    def value(self, expression: str) -> values.Val:
        return columns.column(expression, self.df, self.variables, self.functions)

    def column(self, expression: str) -> Column:
        """The expression's value: an array for a sequence, else one item or null.  JSON and values with a zone are text."""
        v = self.value(expression)
        if values.zoned(v.t) or v.t.kind == "json":
            return F.transform(values.arr(v), lambda x: values.shown(x, v.t)) if v.many else values.shown(values.one(v), v.t)
        return values.arr(v) if v.many else values.one(v)

    def string(self, expression: str) -> Column:
        return values.text(self.value(expression))

    def condition(self, expression: str) -> Column:
        """The expression as a filter or join condition, where null is as good as false."""
        return columns.condition(expression, self.df, self.variables, self.functions)

    def where(self, expression: str) -> Rows:
        """Rows for which the expression's effective boolean value is true."""
        return Rows(self.df.where(self.condition(expression)), self.variables, self.functions)

    def select(self, **expressions: str) -> DataFrame:
        return self.df.select(*[self.column(e).alias(n) for n, e in expressions.items()])

    def with_columns(self, **expressions: str) -> Rows:
        return Rows(self.df.withColumns({n: self.column(e) for n, e in expressions.items()}), self.variables, self.functions)

    def let(self, name: str, expression: str) -> Rows:
        return Rows(self.df, {**self.variables, name: self.value(expression)}, self.functions)

    def function(self, name: str, params: list[str], body: str) -> Rows:
        """Declare a function of XPath text, for the expressions that follow (xsl:function in a row)."""
        from .plans import xpath as X

        def call(*args: values.Val) -> values.Val:
            env = columns.Env(None, variables=dict(zip(params, args, strict=True)))
            return columns.Compiler(functions).compile(X.parse(body), env)

        functions = {**self.functions, (name, len(params)): call}
        return Rows(self.df, self.variables, functions)


class Engine:
    """Tables under ``root`` (name.parquet), and per-document transformation of XML, HTML and JSON."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def rows(self, table: str | DataFrame) -> Rows:
        return Rows(self.table(table) if isinstance(table, str) else table)

    def shred(self, df: DataFrame, key: str, text: str, kind: str = "xml") -> DataFrame:
        """Node table of the documents in a column, written once: each step of a path reads it, none parses again."""
        from .scratch import materialize
        from .sources.documents import shred

        return materialize(shred(df, key, text, kind), "nodes")

    def transform(self, df: DataFrame, key: str, text: str, stylesheet: str, **options) -> DataFrame:
        """A stylesheet on each document of a column; options of ``perdoc.spark.transform``."""
        from .perdoc.spark import transform

        return transform(df, key, text, stylesheet, **options)

    def xpath(self, df: DataFrame, key: str, text: str, expression: str, **options) -> DataFrame:
        """An expression on each document of a column; options of ``perdoc.spark.xpath``."""
        from .perdoc.spark import xpath

        return xpath(df, key, text, expression, **options)

    def reader(self, *roots: str):
        """Sources below the given roots."""
        from .sources.documents import Reader

        return Reader(self.spark, list(roots))
