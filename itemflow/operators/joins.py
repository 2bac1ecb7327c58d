"""Joins: keyed lookup, nested iteration with predicates, semi and anti joins, ordered merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..engine import Rows
from ..plans.values import arr, one
from .grouping import key_column


def _key(rows: Rows, expressions: list[str]) -> list[Column]:
    return [key_column(rows.value(e)) for e in expressions]


def lookup(rows: Rows, key: str | list[str], target: Rows, use: str | list[str], how: str = "inner", columns: dict[str, str] | None = None) -> DataFrame:
    """key(): rows with the target rows whose ``use`` equals their ``key``; how: inner, left, semi or anti.

    A key that is a sequence finds its target for each value, once.  Several keys are a composite key.  Spark
    picks the physical join: broadcast for a small target, sort-merge with skew splitting otherwise.
    columns: name to XPath over the target; all of its columns by default.
    """
    keys, uses = ([x] if isinstance(x, str) else x for x in (key, use))
    left, right = rows.df, target.df
    if len(uses) == 1 and target.value(uses[0]).many:
        right = right.withColumn("__use0", F.explode(F.array_distinct(arr(target.value(uses[0])))))
    else:
        right = right.withColumns({f"__use{i}": c for i, c in enumerate(_key(target, uses))})
    kept = Rows(right, target.variables, target.functions)
    chosen = [kept.column(e).alias(n) for n, e in columns.items()] if columns is not None else [F.col(c) for c in target.df.columns]
    right = right.select(*[f"__use{i}" for i in range(len(uses))], *chosen)
    many = len(keys) == 1 and rows.value(keys[0]).many
    if many:
        left = left.withColumn("__key0", F.explode_outer(F.array_distinct(arr(rows.value(keys[0])))))
    else:
        left = left.withColumns({f"__key{i}": c for i, c in enumerate(_key(rows, keys))})
    on = [F.col(f"__key{i}") == F.col(f"__use{i}") for i in range(len(keys))]
    joined = left.join(right, on, {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}[how])
    return joined.drop(*[f"__key{i}" for i in range(len(keys))], *[f"__use{i}" for i in range(len(uses))])


def nested(rows: Rows, inner: Rows, predicate: str, how: str = "inner") -> DataFrame:
    """``for $x in rows, $y in inner[predicate]``: predicate over the columns of both; names must differ.

    Equalities in the predicate become join keys; other conditions filter inside the join.
    """
    schema = StructType([*rows.df.schema.fields, *inner.df.schema.fields])
    both = Rows(rows.df.sparkSession.createDataFrame([], schema), rows.variables, rows.functions)
    return rows.df.join(inner.df, both.condition(predicate), {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}[how])


def band(rows: Rows, point: str, intervals: Rows, low: str, high: str, width: float) -> DataFrame:
    """Theta join low <= point < high: intervals are cut into cells of ``width``, which join by equality."""
    p, a, z = one(rows.value(point)), one(intervals.value(low)), one(intervals.value(high))
    left = rows.df.withColumns({"__p": p, "__cell": F.floor(p / width)})
    cells = F.sequence(F.floor(a / width), F.greatest(F.ceil(z / width) - 1, F.floor(a / width)))
    right = intervals.df.withColumns({"__a": a, "__z": z}).where("__a < __z").withColumn("__cell", F.explode(cells))
    return left.join(right, "__cell").where("__a <= __p and __p < __z").drop("__cell", "__p", "__a", "__z")


def as_of(rows: Rows, at: str, other: Rows, when: str, by: list[str], columns: list[str]) -> DataFrame:
    """``(other[@when le $at])[last()]`` for each row: both in one window over ``by``, no join at all."""
    names = rows.df.columns
    left = rows.df.select(*names, one(rows.value(at)).alias("__t"), F.lit(1).alias("__side"), *[F.lit(None).cast(other.df.schema[c].dataType).alias(f"__{c}") for c in columns])
    right = other.df.select(*[(F.col(n) if n in by else F.lit(None).cast(rows.df.schema[n].dataType).alias(n)) for n in names], one(other.value(when)).alias("__t"), F.lit(0).alias("__side"), *[F.col(c).alias(f"__{c}") for c in columns])
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(f"__{c}", ignorenulls=True).over(w).alias(f"last_{c}") for c in columns]
    return left.unionByName(right).select(*names, "__side", *last).where("__side = 1").drop("__side")


def merge(sources: dict[str, tuple[Rows, str]], aggregates: dict[str, tuple], key_name: str = "merge_key") -> DataFrame:
    """xsl:merge: one row for each distinct key of any source, in key order.

    sources: name to (rows, key).  aggregates: output name to (source, function, XPath): over that source's
    current-merge-group().  Each source is aggregated first, then the small results are joined, so no group's
    rows meet; inputs need not be sorted (sort-before-merge).
    """
    from .grouping import aggregate

    out = None
    for name, (rows, key) in sources.items():
        own = {n: spec[1:] for n, spec in aggregates.items() if spec[0] == name}
        part = rows.df.groupBy(key_column(rows.value(key)).alias(key_name)).agg(*[aggregate(rows, s[0], s[1]).alias(n) for n, s in own.items()], F.lit(True).alias(f"in_{name}")).where(F.col(key_name).isNotNull())
        out = part if out is None else out.join(part, key_name, "full")
    return out.withColumns({f"in_{n}": F.coalesce(F.col(f"in_{n}"), F.lit(False)) for n in sources}).orderBy(key_name)


def merge_rows(sources: dict[str, tuple[Rows, list[str]]], columns: dict[str, str]) -> DataFrame:
    """Ordered interleaving of several sources: key columns k0.., source, and the columns; sorted by range partition."""
    parts = []
    for i, (name, (rows, keys)) in enumerate(sources.items()):
        parts.append(rows.df.select(*[one(rows.value(k)).alias(f"k{n}") for n, k in enumerate(keys)], F.lit(i).alias("source_no"), F.lit(name).alias("source"), *[rows.column(e).alias(n) for n, e in columns.items()]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = len(next(iter(sources.values()))[1])
    return out.orderBy(*[f"k{i}" for i in range(n)], "source_no")


def idrefs(rows: Rows, refs: str, target: Rows, ids: str) -> DataFrame:
    """id(): white-space separated references to the rows that have those ids."""
    left = Rows(rows.df.withColumn("__refs", F.split(F.trim(one(rows.value(refs))), r"\s+")))
    return lookup(left, "__refs", target, ids).drop("__refs")


def deep_equal(rows: Rows, other: Rows, columns: list[str]) -> DataFrame:
    """Rows that have a deep-equal row in other, null equal to null."""
    on = None
    right = other.df.select(*[F.col(c).alias(f"__{c}") for c in columns])
    for c in columns:
        test = F.col(c).eqNullSafe(F.col(f"__{c}"))
        on = test if on is None else on & test
    return rows.df.join(right, on, "left_semi")
