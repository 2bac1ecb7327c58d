"""Typed columns: what the column compiler passes around."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import EngineError, Unsupported

DECIMAL = "decimal(38,18)"
SPARK = {
    "string": "string", "untyped": "string", "anyURI": "string", "integer": "bigint", "decimal": DECIMAL, "float": "float", "double": "double",
    "boolean": "boolean", "date": "date", "dateTime": "timestamp_ntz", "time": "interval day to second", "yearMonthDuration": "interval year to month", "dayTimeDuration": "interval day to second",
    "hexBinary": "binary", "base64Binary": "binary", "json": "variant",
}
NUMERIC = ("integer", "decimal", "float", "double")
TEXT = ("string", "untyped", "anyURI")
#: Derived integer types and their bounds.
INTEGERS = {
    "integer": (None, None), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 65535), "unsignedByte": (0, 255),
}
STRINGS = ("string", "normalizedString", "token", "language", "Name", "NMTOKEN", "NCName", "ID", "IDREF", "ENTITY", "anyURI", "untypedAtomic")


@dataclass(frozen=True)
class T:
    """kind: an atomic type, map, array, struct, item or empty.  args: key and value of a map, member of an array."""

    kind: str
    args: tuple = ()
    fields: tuple = ()

    @property
    def numeric(self) -> bool:
        return self.kind in NUMERIC

    @property
    def text(self) -> bool:
        return self.kind in TEXT


@dataclass(frozen=True)
class Val:
    """A column of one item (null: none) or, if ``many``, of an array of items.

    node: a value that stands for a node, whose effective boolean value is its existence.
    constant: its Python value, where known.  call: a function item.
    """

    col: Column | None
    t: T
    many: bool = False
    node: bool = False
    constant: object = None
    call: Callable | None = None
    arity: int = 0

    def typed(self, kind: str) -> Val:
        return replace(self, t=T(kind))


def of_spark(t: S.DataType) -> tuple[T, bool]:
    """Type and whether it is a sequence, for a column of a table."""
    if isinstance(t, S.ArrayType):
        inner, many = of_spark(t.elementType)
        return (T("array", (inner,)), True) if many else (inner, True)
    if isinstance(t, S.StructType):
        return T("struct", (), tuple((f.name, *of_spark(f.dataType)) for f in t.fields)), False
    if isinstance(t, S.MapType):
        return T("map", (of_spark(t.keyType)[0], of_spark(t.valueType)[0])), False
    for classes, kind in (
        ((S.StringType, S.CharType, S.VarcharType), "string"),
        ((S.ByteType, S.ShortType, S.IntegerType, S.LongType), "integer"),
        ((S.DecimalType,), "decimal"),
        ((S.FloatType,), "float"),
        ((S.DoubleType,), "double"),
        ((S.BooleanType,), "boolean"),
        ((S.DateType,), "date"),
        ((S.TimestampType, S.TimestampNTZType), "dateTime"),
        ((S.YearMonthIntervalType,), "yearMonthDuration"),
        ((S.DayTimeIntervalType,), "dayTimeDuration"),
        ((S.BinaryType,), "hexBinary"),
    ):
        if isinstance(t, classes):
            return T(kind), False
    if type(t).__name__ == "TimeType":
        return T("time"), False
    raise Unsupported(f"column type {t.simpleString()}")


def spark_type(t: T) -> str:
    if t.kind == "array":
        return f"array<{spark_type(t.args[0])}>"
    if t.kind == "map":
        return f"map<{spark_type(t.args[0])},{spark_type(t.args[1])}>"
    if t.kind == "struct":
        return "struct<" + ",".join(f"`{n}`:{'array<' * m}{spark_type(ft)}{'>' * m}" for n, ft, m in t.fields) + ">"
    if t.kind == "empty":
        return "string"
    if t.kind not in SPARK:
        raise Unsupported(f"type {t.kind}")
    return f"struct<v:{SPARK[t.kind]},z:int>" if zoned(t) else SPARK[t.kind]


EMPTY = Val(None, T("empty"))
#: Dates and times that may have a zone: a struct of the local reading and the offset in minutes (null: none).
ZONED = ("zoned",)
STAMPS = ("date", "dateTime", "time")


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is evaluated once however often f names it; but for columns with Python functions, which Spark
    evaluates once anyway and takes into no lambda."""
    if "python_" in str(c):
        return f(c)
    return F.get(F.transform(F.array(c), f), F.lit(0))


def zoned(t: T) -> bool:
    return t.args == ZONED


def local(v: Val) -> Column:
    """The reading of a date or time, whatever its zone."""
    return one(v).getField("v") if zoned(v.t) else one(v)


def zone(v: Val) -> Column:
    """Offset in minutes; null for none."""
    return one(v).getField("z") if zoned(v.t) else F.lit(None).cast("int")


def with_zone(kind: str, reading: Column, offset: Column) -> Val:
    return Val(let(F.struct(reading.alias("v"), offset.cast("int").alias("z")), lambda x: F.when(x.getField("v").isNotNull(), x)), T(kind, ZONED))


def instant(c: Column, t: T) -> Column:
    """What dates and times compare by: the reading in UTC, which is the implicit zone."""
    base = c.getField("v") if zoned(t) else c
    base = base.cast("timestamp_ntz") if t.kind == "date" else base
    return base - F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(c.getField("z"), F.lit(0))) if zoned(t) else base


def comparable(v: Val) -> Column:
    """The item as grouping and sorting compare it."""
    return instant(one(v), v.t) if zoned(v.t) else json_text(one(v)) if v.t.kind == "json" else one(v)


def json_text(c: Column) -> Column:
    """String of a JSON value: strings, numbers as doubles and booleans; objects and arrays have none."""

    def of(x: Column, kind: Column) -> Column:
        plain = F.try_variant_get(x, "$", "string")
        return (
            F.when(x.isNull() | (kind == "VOID"), F.lit(None).cast("string")).when(kind == "STRING", plain).when(kind == "BOOLEAN", plain)
            .when(_composite(kind), F.raise_error(F.lit("FOTY0014: a map or array has no string value")).cast("string"))
            .otherwise(let(F.try_variant_get(x, "$", "double"), lambda n: number(n, "double")))
        )

    return let(c, lambda x: let(F.schema_of_variant(x), lambda kind: of(x, kind)))


def _composite(kind: Column) -> Column:
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def json_number(c: Column) -> Column:
    return F.try_variant_get(c, "$", "double")


def shown(c: Column, t: T) -> Column:
    """An item as a result column has it: zoned values and JSON as text."""
    if t.kind == "json":
        return let(c, lambda x: F.when(_composite(F.schema_of_variant(x)), F.to_json(x)).otherwise(json_text(x)))
    return text(Val(c, t)) if zoned(t) else c


def one(v: Val) -> Column:
    """The item; of a sequence the first (column mode checks no cardinality)."""
    if v.t.kind == "empty":
        return F.lit(None)
    if v.call:
        raise Unsupported("a function item as a value")
    return F.get(v.col, F.lit(0)) if v.many else v.col


def arr(v: Val) -> Column:
    """The items as an array, never null."""
    if v.t.kind == "empty":
        return F.array().cast("array<string>")
    if v.many:
        return F.coalesce(v.col, F.array().cast(f"array<{spark_type(v.t)}>"))
    if v.call:
        raise Unsupported("a function item as a value")
    return F.when(v.col.isNull(), F.array().cast(f"array<{spark_type(v.t)}>")).otherwise(F.array(v.col))


def ebv(v: Val) -> Column:
    """Effective boolean value, two-valued."""
    if v.t.kind == "empty":
        return F.lit(False)
    if v.node:
        return F.size(arr(v)) > 0 if v.many else v.col.isNotNull()
    if v.many:
        if v.t.kind == "boolean":
            return F.when(F.size(arr(v)) == 1, F.coalesce(one(v), F.lit(False))).otherwise(F.size(arr(v)) > 1)
        return F.size(arr(v)) > 0
    if v.t.kind == "boolean":
        return F.coalesce(v.col, F.lit(False))
    if v.t.kind in ("integer", "decimal"):
        return F.coalesce(v.col != 0, F.lit(False))
    if v.t.numeric:
        return F.coalesce((v.col != 0) & ~F.isnan(v.col), F.lit(False))
    if v.t.text:
        return F.coalesce(F.length(v.col) > 0, F.lit(False))
    if v.t.kind == "json":
        none = F.raise_error(F.lit("FORG0006: no effective boolean value for a map or array")).cast("boolean")

        def holds(x: Column, kind: Column) -> Column:
            real = let(json_number(x), lambda n: F.coalesce((n != 0) & ~F.isnan(n), F.lit(False)))
            said = F.when(x.isNull() | (kind == "VOID"), False).when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
            return said.when(kind == "STRING", F.length(F.try_variant_get(x, "$", "string")) > 0).when(_composite(kind), none).otherwise(real)

        return let(v.col, lambda x: let(F.schema_of_variant(x), lambda kind: holds(x, kind)))
    raise EngineError("FORG0006", f"no effective boolean value for {v.t.kind}")


def common(a: T, b: T) -> T:
    """The type both convert to in a sequence, comparison or branch."""
    if a == b or b.kind == "empty":
        return a
    if a.kind == "empty":
        return b
    if a.kind == b.kind and a.kind in STAMPS:
        return T(a.kind, ZONED)
    if a.numeric and b.numeric:
        return T(NUMERIC[max(NUMERIC.index(a.kind), NUMERIC.index(b.kind))])
    if a.text and b.text:
        return T("string")
    if a.kind == "array" and b.kind == "array":
        return T("array", (common(a.args[0], b.args[0]),))
    if a.kind == "map" and b.kind == "map":
        return T("map", (common(a.args[0], b.args[0]), common(a.args[1], b.args[1])))
    raise Unsupported(f"no common column type for {a.kind} and {b.kind}")


def to(v: Val, t: T) -> Val:
    """v with its items cast to the Spark type of t, a wider type of the same family."""
    if v.t == t or v.t.kind == "empty":
        return replace(v, t=t, col=F.lit(None).cast(f"array<{spark_type(t)}>" if v.many else spark_type(t))) if v.t.kind == "empty" else v
    if zoned(t):
        widened = lambda c: with_zone(t.kind, c, F.lit(None)).col
        return replace(v, t=t, col=F.transform(v.col, widened) if v.many else widened(v.col))
    target = spark_type(t)
    return replace(v, t=t, col=v.col.cast(f"array<{target}>" if v.many else target))


def number(c: Column, kind: str) -> Column:
    """Lexical form of a number, as the standard casts it to a string."""
    if kind == "integer":
        return c.cast("string")
    if kind == "decimal":
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if kind == "float":
        c = c.cast("string").cast("double")
    size = F.abs(c)
    plain = number(c.cast(DECIMAL), "decimal")
    return (
        F.when(F.isnan(c), "NaN").when(c == float("inf"), "INF").when(c == float("-inf"), "-INF").when(c == 0, F.when(c.cast("string").startswith("-"), "-0").otherwise("0"))
        .when((size >= 1e-6) & (size < 1e6), plain)
        .when((size >= 1e6) & (size < 1e7), F.regexp_replace(F.regexp_replace(c.cast("string"), r"^(-?\d)(\d{6})\.(\d+)$", "$1.$2$3E6"), r"(\.\d+?)0+E6$", "$1E6"))  # Spark's form has no exponent yet
        .otherwise(c.cast("string"))
    )


def text(v: Val) -> Column:
    """The string value of one item; null for none."""
    c, k = one(v), v.t.kind
    if k == "empty":
        return F.lit(None).cast("string")
    if v.t.text:
        return c
    if v.t.numeric:
        return number(c, k)
    if k == "json":
        return json_text(c)
    if zoned(v.t):
        two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
        offset = lambda z: F.when(z.isNull(), "").when(z == 0, "Z").otherwise(F.concat(F.when(z < 0, "-").otherwise("+"), two(F.floor(F.abs(z) / 60)), F.lit(":"), two(F.abs(z) % 60)))
        return let(c, lambda x: F.concat(text(Val(x.getField("v"), T(k))), offset(x.getField("z"))))
    if k == "boolean":
        return c.cast("string")
    if k == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if k == "dateTime":
        return F.regexp_replace(F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if k == "time":  # held as the time since midnight
        two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")

        def clock(total: Column) -> Column:
            whole = F.floor(total).cast("bigint")
            rest = number((total - whole).cast(DECIMAL), "decimal")
            return F.concat(two(whole / 3600), F.lit(":"), two((whole % 3600) / 60), F.lit(":"), two(whole % 60), F.when(total > whole, F.substring(rest, 2, 30)).otherwise(""))

        return let(seconds_of(c), clock)
    if k == "hexBinary":
        return F.hex(c)
    if k == "base64Binary":
        return F.base64(c)
    if k == "dayTimeDuration":
        return duration_text(c)
    if k == "yearMonthDuration":
        months = F.extract(F.lit("YEAR"), c) * 12 + F.extract(F.lit("MONTH"), c)
        y, m = F.floor(F.abs(months) / 12), F.abs(months) % 12
        return F.concat(F.when(months < 0, "-").otherwise(""), F.lit("P"), F.when(y > 0, F.concat(y.cast("string"), F.lit("Y"))).otherwise(""), F.when((m > 0) | (months == 0), F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    raise Unsupported(f"string of {k}")


def seconds_of(c: Column) -> Column:
    """Seconds of a day-time interval, as decimal."""
    return F.extract(F.lit("DAY"), c).cast(DECIMAL) * 86400 + F.extract(F.lit("HOUR"), c) * 3600 + F.extract(F.lit("MINUTE"), c) * 60 + F.extract(F.lit("SECOND"), c)


def duration_text(c: Column) -> Column:
    part = lambda x, unit: F.when(x > 0, F.concat(x.cast("string"), F.lit(unit))).otherwise("")

    def of(total: Column) -> Column:
        s = F.abs(total)
        whole = F.floor(s).cast("bigint")
        d, h, m = (whole / 86400).cast("bigint"), ((whole % 86400) / 3600).cast("bigint"), ((whole % 3600) / 60).cast("bigint")
        rest = (s - (d * 86400 + h * 3600 + m * 60)).cast(DECIMAL)
        sec = let(rest, lambda r: F.when(r > 0, F.concat(number(r, "decimal"), F.lit("S"))).otherwise(""))
        clock = F.concat(part(h, "H"), part(m, "M"), sec)
        timed = let(clock, lambda x: F.when(x != "", F.concat(F.lit("T"), x)).otherwise(""))
        return F.when(total == 0, "PT0S").when(total.isNotNull(), F.concat(F.when(total < 0, "-").otherwise(""), F.lit("P"), part(d, "D"), timed))

    return let(c, lambda x: let(seconds_of(x), of))
