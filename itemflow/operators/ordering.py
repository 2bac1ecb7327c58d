"""Sorting with the standard's order, limits, set operations, positions and running values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..engine import Rows
from ..functions import collations, udfs
from ..plans.values import comparable, ebv, one, text

# sorting


def sort_columns(rows: Rows, keys: list[tuple]) -> list[Column]:
    """keys: (XPath[, options]); options: order, data_type ('text' or 'number'), collation, case_order.

    Empty comes first, then NaN, then values; descending reverses all of it.
    """
    out = []
    for key in keys:
        expression, options = key if isinstance(key, tuple) else (key, {})
        v = rows.value(expression)
        c = comparable(v)
        if options.get("data_type") == "number" and v.t.text:
            c = F.coalesce(c.try_cast("double"), F.lit(float("nan")))
            rank = F.when(F.isnan(c), 1).otherwise(2)
        elif options.get("data_type") == "text":
            c = text(v)
            rank = F.when(c.isNull(), 0).otherwise(2)
        else:
            rank = F.when(c.isNull(), 0).when(F.isnan(c), 1).otherwise(2) if v.t.kind in ("float", "double") else F.when(c.isNull(), 0).otherwise(2)
        if options.get("collation") or options.get("case_order"):
            name = options.get("collation") or "http://www.w3.org/2013/collation/UCA"
            if options.get("case_order") == "upper-first":
                name += ("?" if "?" not in name else ";") + "caseFirst=upper"
            own = collations.COLUMNS.get(name) or (udfs.keyed_by(collations.KEYS[name]) if name in collations.KEYS else None)
            c = own(c) if own else F.lower(c) if "html-ascii" in name else udfs.collation_text(F.coalesce(c, F.lit("")), F.lit(name))
        down = options.get("order") == "descending"
        out += [rank.desc(), c.desc_nulls_last()] if down else [rank.asc(), c.asc_nulls_first()]
    return out


def sort(rows: Rows, *keys, stable: list[str] | None = None) -> DataFrame:
    """xsl:sort, xsl:perform-sort: a range-partitioned sort; ``stable``: columns that give the input order."""
    return rows.df.orderBy(*sort_columns(rows, list(keys)), *[F.col(c) for c in stable or []])


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """position() over a whole sorted table: rows are counted in each partition of it, and a partition's rows start
    after those before, so no task sees more than its partition.  The sorted table is written once, as both need it."""
    from ..scratch import materialize

    at = F.monotonically_increasing_id()
    placed = materialize(ordered.withColumn("__at", at), "sorted")
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row for each partition
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, place.cast("bigint")).drop("__part", "__at", "__before")


def top(rows: Rows, n: int, *keys, stable: list[str] | None = None) -> DataFrame:
    """sort(...)[position() le n]: each task keeps n rows, no full sort."""
    return sort(rows, *keys, stable=stable).limit(n)


def top_in_group(rows: Rows, n: int, partition: list[str], *keys, stable: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*sort_columns(rows, list(keys)), *[F.col(c) for c in stable or []])
    return rows.df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def subsequence(rows: Rows, order: list, start: int, length: int | None = None) -> DataFrame:
    """Rows start .. start + length - 1 of the whole table in order: Spark's offset and limit, no global window."""
    out = sort(rows, *order)
    if start > 1:
        out = out.offset(start - 1)
    return out if length is None else out.limit(length)


# sets


def union(a: DataFrame, b: DataFrame, identity: list[str]) -> DataFrame:
    """By identity: each row once."""
    return a.unionByName(b).dropDuplicates(identity)


def intersect(a: DataFrame, b: DataFrame, identity: list[str]) -> DataFrame:
    return a.join(b.select(*identity).distinct(), identity, "left_semi").dropDuplicates(identity)


def except_(a: DataFrame, b: DataFrame, identity: list[str]) -> DataFrame:
    return a.join(b.select(*identity).distinct(), identity, "left_anti").dropDuplicates(identity)


def distinct_values(rows: Rows, expression: str, name: str = "value") -> DataFrame:
    from .grouping import key_column

    return rows.df.select(key_column(rows.value(expression)).alias(name)).where(F.col(name).isNotNull()).distinct()


def concatenated(*parts: DataFrame) -> DataFrame:
    """The comma operator on tables: all rows of each."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# positions


def _window(partition: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*partition).orderBy(*order)


def positions(rows: Rows, partition: list[str], order: list[str]) -> DataFrame:
    """position() and last() of each row among its siblings."""
    return rows.df.withColumns({"position": F.row_number().over(_window(partition, order)).cast("bigint"), "last": F.count("*").over(Window.partitionBy(*partition)).cast("bigint")})


def neighbours(rows: Rows, partition: list[str], order: list[str], expression: str) -> DataFrame:
    """preceding-sibling::*[1] and following-sibling::*[1]."""
    c, w = rows.column(expression), _window(partition, order)
    return rows.df.withColumns({"preceding": F.lag(c).over(w), "following": F.lead(c).over(w)})


def number(rows: Rows, partition: list[str], order: list[str], count: str = "true()", since: str | None = None, start_at: int = 1, name: str = "number") -> DataFrame:
    """xsl:number level single or any: how many rows up to this one match ``count``, since the last match of ``since``."""
    w = _window(partition, order).rowsBetween(Window.unboundedPreceding, 0)
    df = rows.df
    parts = list(partition)
    if since is not None:
        df = df.withColumn("__from", F.sum(ebv(rows.value(since)).cast("int")).over(w))
        parts.append("__from")
    again = Rows(df, rows.variables, rows.functions)
    w = _window(parts, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, (F.sum(ebv(again.value(count)).cast("int")).over(w) + (start_at - 1)).cast("bigint")).drop("__from")


def _with_first(df: DataFrame, first: DataFrame, level: str) -> DataFrame:
    first = first.withColumnRenamed(level, "__level")
    return df.join(first, df[level].eqNullSafe(first["__level"])).drop("__level")


def number_multiple(rows: Rows, levels: list[str], order: list[str], name: str = "number") -> DataFrame:
    """xsl:number level multiple over nested keys: 1.2.3, each level numbered within the level above.

    The first level has nothing above it: its distinct keys alone, not the rows, are numbered in one task, and joined.
    """
    first = rows.df.select(levels[0]).distinct().withColumn("__n0", F.row_number().over(Window.orderBy(levels[0])))
    if len(levels) == 1:
        first = rows.df.groupBy(levels[0]).agg(F.count("*").alias("__c")).withColumn("__n0", F.sum("__c").over(Window.orderBy(levels[0]).rowsBetween(Window.unboundedPreceding, -1)))
        rank = F.coalesce(F.col("__n0"), F.lit(0)) + F.row_number().over(_window(levels, order))
        return _with_first(rows.df, first, levels[0]).withColumn(name, rank.cast("string")).drop("__n0", "__c")
    out, above, marks = _with_first(rows.df, first, levels[0]), levels[:1], ["__n0"]
    for i, level in enumerate(levels[1:], 1):
        rank = F.dense_rank().over(_window(above, [level])) if i + 1 < len(levels) else F.row_number().over(_window(above, [level, *order]))
        out = out.withColumn(f"__n{i}", rank)
        marks.append(f"__n{i}")
        above = [*above, level]
    return out.withColumn(name, F.concat_ws(".", *marks)).drop(*marks)


# running values


def accumulator(rows: Rows, partition: list[str], order: list[str], rule: str, function: str = "sum", name: str = "value") -> DataFrame:
    """Running value at each row: ``name``_before and ``name``_after.  function: sum, count, min or max of ``rule``."""
    w = _window(partition, order)
    c = rows.column(rule)
    f = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[function]
    after, before = f(c).over(w.rowsBetween(Window.unboundedPreceding, 0)), f(c).over(w.rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0) if function in ("sum", "count") else F.lit(None)
    return rows.df.withColumns({f"{name}_before": F.coalesce(before, zero), f"{name}_after": F.coalesce(after, zero)})


def iterate_until(rows: Rows, partition: list[str], order: list[str], running: str, stop: str) -> DataFrame:
    """xsl:iterate with a running sum and xsl:break: rows of each partition until ``stop`` holds, that row included.

    stop sees the running sum as the column ``running_sum``.
    """
    w = _window(partition, order)
    summed = Rows(rows.df.withColumn("running_sum", F.sum(rows.column(running)).over(w.rowsBetween(Window.unboundedPreceding, 0))), rows.variables, rows.functions)
    stopped = summed.df.withColumn("__stop", F.coalesce(F.sum(ebv(summed.value(stop)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return stopped.where("__stop = 0").drop("__stop")


def iterate(rows: Rows, partition: list[str], order: list[str], state: dict, step: Callable[[dict, dict], tuple[dict, dict | None, bool]], schema: str) -> DataFrame:
    """xsl:iterate in general: Python state carried along each partition's rows in order.

    step(row, state) gives the next state, a row to write or None, and whether to go on.  Rows stream through
    in Arrow batches sorted by partition and order; only the state and one batch are held, however long a
    partition is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now, going = None, dict(state), True
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                key = tuple(row[p] for p in partition)
                if key != at:
                    at, now, going = key, dict(state), True
                if going:
                    now, written, going = step(row, now)
                    if written is not None:
                        out.append(written)
            if out:
                yield pd.DataFrame(out)

    return rows.df.repartition(*partition).sortWithinPartitions(*partition, *order).mapInPandas(run, schema)
