"""for-each-group in its four kinds, as aggregations.

``group_by`` is a plain hash aggregation, partial before its shuffle.  The three positional kinds need an order:
it is given within ``partition`` columns, so that the window that finds group borders runs in many tasks; one
global sequence without partitions would run in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..engine import Rows
from ..errors import EngineError
from ..plans.values import Val, arr, comparable, ebv, one, spark_type, text

GROUP = "group_no"


def key_column(v: Val) -> Column:
    """A grouping key: equal for equal values; NaN equals itself, -0 equals 0."""
    c = comparable(v)
    if v.t.kind in ("float", "double"):
        return F.when(c == 0, F.lit(0.0).cast(spark_type(v.t))).otherwise(c)
    return c


def aggregate(rows: Rows, name: str, expression: str, order: list[Column] | None = None, separator: str = " ") -> Column:
    """An aggregate over current-group(): count, sum, avg, min, max, string-join, distinct-values, first, last, items.

    Empty values take no part.  Ordered aggregates follow ``order``.
    """
    if name == "count" and expression in (".", ""):
        return F.count("*").cast("bigint")
    v = rows.value(expression)
    c = one(v)
    if v.many:
        raise EngineError("XPTY0004", "one value for each item of a group")
    if name == "count":
        return F.count(c).cast("bigint")
    if name == "sum":
        zero = F.lit(0).cast(spark_type(v.t)) if v.t.numeric else None
        return F.coalesce(F.sum(c), zero) if zero is not None else F.sum(c)
    if name == "avg":
        return F.avg(c)
    if name in ("min", "max"):
        f = F.min if name == "min" else F.max
        if v.t.kind in ("float", "double"):
            return F.when(F.bool_or(F.isnan(c)), F.lit(float("nan")).cast(spark_type(v.t))).otherwise(f(c))
        return f(c)
    ordered = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order or [])], (text(v) if name == "string-join" else c).alias("v"))
    if name == "string-join":
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), ordered))), lambda x: x["v"]), separator)
    if name == "distinct-values":
        return F.array_sort(F.collect_set(c))
    if name in ("first", "last"):
        picked = F.min(ordered) if name == "first" else F.max(ordered)
        return picked["v"]
    if name == "items":
        return F.transform(F.array_sort(F.collect_list(ordered)), lambda x: x["v"])
    raise EngineError("XPST0017", name)


def _aggregates(rows: Rows, aggregates: dict[str, tuple], order: list[Column] | None = None) -> list[Column]:
    return [aggregate(rows, spec[0], spec[1], order, *spec[2:]).alias(n) for n, spec in aggregates.items()]


def group_by(rows: Rows, keys: dict[str, str], aggregates: dict[str, tuple], having: str = "", order: str | None = None) -> DataFrame:
    """Groups by the values of the keys; several keys, or one key that is a sequence.

    keys: name to XPath.  Several keys are a composite key.  A key that is a sequence puts an item in a group for
    each of its values, once.  aggregates: name to (function, XPath[, separator]).  order: XPath that orders
    items within their group, for the ordered aggregates; the least of it gives the order of first appearance.
    """
    values = {n: rows.value(e) for n, e in keys.items()}
    df = rows.df
    if len(values) == 1 and next(iter(values.values())).many:
        (name, v), = values.items()
        df = df.withColumn("__key", F.explode(F.array_distinct(arr(v))))
        grouped = Rows(df, rows.variables, rows.functions)
        columns = [F.col("__key").alias(name)]
    else:
        grouped = rows
        columns = [key_column(v).alias(n) for n, v in values.items()]
    ordering = [one(grouped.value(order))] if order else None
    out = df.groupBy(*columns).agg(*_aggregates(grouped, aggregates, ordering))
    return Rows(out).where(having).df if having else out


def _positional(rows: Rows, partition: list[str], order: list[str], starts, aggregates: dict[str, tuple], keep: dict[str, str]) -> DataFrame:
    ordering = [one(rows.value(o)) for o in order]
    w = Window.partitionBy(*partition).orderBy(*ordering)
    marked = rows.df.withColumn("__start", starts(w, rows).cast("int"))
    numbered = marked.withColumn(GROUP, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    again = Rows(numbered, rows.variables, rows.functions)
    ordering = [one(again.value(o)) for o in order]
    kept = [aggregate(again, "first", e, ordering).alias(n) for n, e in keep.items()]
    return numbered.groupBy(*partition, GROUP).agg(*kept, *_aggregates(again, aggregates, ordering))


def group_adjacent(rows: Rows, partition: list[str], order: list[str], key: str, aggregates: dict[str, tuple], key_name: str = "grouping_key") -> DataFrame:
    """Runs of items with one key; an item without a key is an error (XTTE1100)."""
    v = rows.value(key)
    k = key_column(v)
    checked = F.when(k.isNull(), F.raise_error(F.lit("XTTE1100: no grouping key")).cast(spark_type(v.t))).otherwise(k)
    rows = Rows(rows.df.withColumn("__adjacent", checked), rows.variables, rows.functions)

    def starts(w, r):
        before = F.lag("__adjacent").over(w)
        return before.isNull() | (before != F.col("__adjacent"))

    return _positional(rows, partition, order, starts, aggregates, {key_name: "__adjacent"})


def group_starting_with(rows: Rows, partition: list[str], order: list[str], pattern: str, aggregates: dict[str, tuple]) -> DataFrame:
    """A group begins at each item that matches; items before the first match form a group of their own."""
    return _positional(rows, partition, order, lambda w, r: ebv(r.value(pattern)) | (F.row_number().over(w) == 1), aggregates, {})


def group_ending_with(rows: Rows, partition: list[str], order: list[str], pattern: str, aggregates: dict[str, tuple]) -> DataFrame:
    """A group ends with each item that matches; items after the last match form a group of their own."""
    return _positional(rows, partition, order, lambda w, r: F.coalesce(F.lag(ebv(r.value(pattern))).over(w), F.lit(True)), aggregates, {})


def totals(rows: Rows, aggregates: dict[str, tuple]) -> DataFrame:
    """One row: aggregates over the whole table."""
    return rows.df.agg(*_aggregates(rows, aggregates))


def rollup(rows: Rows, keys: dict[str, str], aggregates: dict[str, tuple]) -> DataFrame:
    """The shape of nested for-each-group: groups by all keys, by fewer, and the whole."""
    return rows.df.rollup(*[key_column(rows.value(e)).alias(n) for n, e in keys.items()]).agg(*_aggregates(rows, aggregates))


def fold(rows: Rows, partition: list[str], order: list[str], zero: str, step: str, name: str) -> DataFrame:
    """fold-left over the items of each partition in order.  step sees $acc and the item as columns of $item.

    A partition's items are gathered, with the columns that step names and no others, since each value may depend on
    the one before; sums and other aggregates that don't are ``group_by``'s.
    """
    import re

    from ..plans import xpath as X
    from ..plans.columns import Compiler, Env, row_item

    named = [c for c in rows.df.columns if re.search(rf"(?<![\w-]){re.escape(c)}(?![\w-])", step)]
    read = rows.df.select(*(named or rows.df.columns[:1])) if re.search(r"\$item/[\w]", step) and "*" not in step.replace(" * ", "") else rows.df
    items = row_item(read)
    struct = F.struct(*[F.col(c) for c in read.columns])
    ordering = F.struct(*[one(rows.value(o)).alias(f"o{i}") for i, o in enumerate(order)], struct.alias("v"))
    compiler = Compiler(rows.functions)
    start = rows.value(zero)
    grouped = rows.df.groupBy(*partition).agg(F.array_sort(F.collect_list(ordering)).alias("__items"))

    def combine(a: Column, x: Column) -> Column:
        env = Env(Val(x["v"], items.t), variables={**rows.variables, "acc": Val(a, start.t), "item": Val(x["v"], items.t)})
        return one(compiler.compile(X.parse(step), env)).cast(spark_type(start.t))

    return grouped.select(*partition, F.aggregate("__items", one(start).cast(spark_type(start.t)), combine).alias(name))

