"""XPath to Spark columns.

The context item is a row of a table: a child or attribute step names a column, deeper steps go into structs and
arrays of structs.  Sequences are arrays, the empty sequence is null, maps and arrays are Spark maps and
arrays, function items exist at compile time only.  Nothing here runs: the result is a ``Column`` that
Catalyst plans, prunes and generates code for.  What has no column form raises ``Unsupported``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, Unsupported
from . import xpath as X
from .values import DECIMAL, EMPTY, INTEGERS, NUMERIC, STAMPS, STRINGS, T, Val, ZONED, arr, common, ebv, instant, json_number, json_text, let, local, of_spark, one, spark_type, text, to, with_zone, zone, zoned


@dataclass(frozen=True)
class Env:
    """What an expression sees: the context item, its position and the size, variables, and the row's columns."""

    item: Val | None
    position: Column | None = None
    last: Column | None = None
    variables: dict = field(default_factory=dict)
    functions: dict = field(default_factory=dict)
    now: object = None

    def bind(self, name: str, v: Val) -> Env:
        return replace(self, variables={**self.variables, name: v})

    def focus(self, item: Val, position: Column | None = None, last: Column | None = None) -> Env:
        return replace(self, item=item, position=position, last=last)


def literal(value: object) -> Val:
    if isinstance(value, bool):
        return Val(F.lit(value), T("boolean"), constant=value)
    if isinstance(value, int):
        return Val(F.lit(value).cast("bigint") if abs(value) < 2**63 else F.lit(value).cast("decimal(38,0)"), T("integer"), constant=value)
    if isinstance(value, float):
        return Val(F.lit(value), T("double"), constant=value)
    if isinstance(value, str):
        return Val(F.lit(value), T("string"), constant=value)
    return Val(F.lit(str(value)).cast(DECIMAL), T("decimal"), constant=value)


def strip_prefix(name: str) -> str:
    return name[3:] if name.startswith("fn:") else name


class Compiler:
    def __init__(self, functions: dict | None = None):
        from ..functions import library

        self.library = library.FUNCTIONS
        self.user = functions or {}

    def compile(self, e: X.Expr, env: Env) -> Val:
        method = getattr(self, "_" + type(e).__name__.lower(), None)
        if method is None:
            raise Unsupported(type(e).__name__)
        return method(e, env)

    def condition(self, e: X.Expr, env: Env) -> Column:
        """The effective boolean value where null does as well as false: in a filter or join condition.

        Comparisons stay bare, so that scans take them as pushed filters and joins see their keys.
        """
        if isinstance(e, X.Logic):
            a, b = self.condition(e.left, env), self.condition(e.right, env)
            return a & b if e.op == "and" else a | b
        if isinstance(e, X.Compare) and e.kind != "node":
            a, b = self.compile(e.left, env), self.compile(e.right, env)
            if not a.many and not b.many and "empty" not in (a.t.kind, b.t.kind):
                if e.kind == "value":
                    a, b = (v.typed("string") if v.t.kind == "untyped" else v for v in (a, b))
                return self.compared(e.op, one(a), a.t, one(b), b.t)
        return ebv(self.compile(e, env))

    # primaries

    def _literal(self, e: X.Literal, env: Env) -> Val:
        return literal(e.value)

    def _var(self, e: X.Var, env: Env) -> Val:
        if e.name not in env.variables:
            raise EngineError("XPST0008", f"${e.name}")
        return env.variables[e.name]

    def _context(self, e: X.Context, env: Env) -> Val:
        if env.item is None:
            raise EngineError("XPDY0002", "no context item")
        return env.item

    def _root(self, e: X.Root, env: Env) -> Val:
        raise Unsupported("the root of a row")

    def _sequence(self, e: X.Sequence, env: Env) -> Val:
        vals = [v for v in (self.compile(x, env) for x in e.items) if v.t.kind != "empty"]
        return self.concatenated(vals)

    def concatenated(self, vals: list[Val]) -> Val:
        if not vals:
            return EMPTY
        if len(vals) == 1:
            return vals[0]
        t = vals[0].t
        for v in vals[1:]:
            t = common(t, v.t)
        return Val(F.concat(*[arr(to(v, t)) for v in vals]), t, many=True)

    # steps

    def _step(self, e: X.Step, env: Env) -> Val:
        if env.item is None:
            raise EngineError("XPDY0002", "no context item")
        if e.axis == "self":
            out = env.item
        elif e.axis in ("child", "attribute"):
            if e.test.name is None:
                if e.test.kind == "text" and env.item.t.kind != "struct":
                    out = env.item
                else:
                    raise Unsupported("a step to all columns")
            else:
                out = self.member(env.item, e.test.name)
        else:
            raise Unsupported(f"axis {e.axis} in a row")
        for p in e.predicates:
            out = self.filtered(out, p, env)
        return out

    def member(self, base: Val, name: str) -> Val:
        if base.t.kind != "struct":
            return EMPTY
        for n, t, many in base.t.fields:
            if n == name or n == "_" + name:
                if not base.many:
                    return Val(F.col(f"`{n}`") if base.col is None else base.col.getField(n), t, many, node=True)
                inner = F.transform(arr(base), lambda x: x.getField(n))
                if many:
                    return Val(F.flatten(F.filter(inner, lambda x: x.isNotNull())), t, True, node=True)
                return Val(F.filter(inner, lambda x: x.isNotNull()), t, True, node=True)
        return EMPTY

    def _path(self, e: X.Path, env: Env) -> Val:
        left = self.compile(e.left, env)
        if isinstance(e.right, X.Step) and e.right.axis in ("child", "attribute") and e.right.test.name and left.t.kind == "struct":
            out = self.member(left, e.right.test.name)
            for p in e.right.predicates:
                out = self.filtered(out, p, env)
            return out
        return self.mapped(left, e.right, env)

    def _simplemap(self, e: X.SimpleMap, env: Env) -> Val:
        return self.mapped(self.compile(e.left, env), e.right, env)

    def mapped(self, source: Val, body: X.Expr, env: Env) -> Val:
        if source.t.kind == "empty":
            return EMPTY
        if not source.many:
            return self.guarded(source, self.compile(body, env.focus(source, F.lit(1).cast("bigint"), F.lit(1).cast("bigint"))))
        items = arr(source)
        size = F.size(items).cast("bigint")
        return self.flat(items, source.t, lambda x, i: self.compile(body, env.focus(Val(x, source.t, node=source.node), (i + 1).cast("bigint"), size)))

    def guarded(self, source: Val, v: Val) -> Val:
        """v where source has an item."""
        if v.t.kind == "empty" or source.col is None or source.t.kind == "struct" and source.col is None:
            return v
        if v.many:
            return replace(v, col=F.when(source.col.isNull(), F.array().cast(f"array<{spark_type(v.t)}>")).otherwise(v.col))
        return replace(v, col=F.when(source.col.isNotNull(), v.col), constant=None)

    def flat(self, items: Column, t: T, f) -> Val:
        """f over the items, its sequences joined."""
        shape = {}

        def body(x: Column, i: Column) -> Column:
            v = shape["v"] = f(x, i)
            return arr(v)

        nested = F.transform(items, lambda x, i: body(x, i))
        v = shape["v"]
        if v.t.kind == "empty":
            return EMPTY
        return Val(F.flatten(nested), v.t, many=True)

    # predicates

    def _filter(self, e: X.Filter, env: Env) -> Val:
        return self.filtered(self.compile(e.base, env), e.predicate, env)

    def filtered(self, base: Val, p: X.Expr, env: Env) -> Val:
        if base.t.kind == "empty":
            return EMPTY
        one_ = F.lit(1).cast("bigint")
        if not base.many:
            v = self.compile(p, env.focus(base, one_, one_))
            ok = one(v) == 1 if v.t.numeric else ebv(v)
            return replace(base, col=F.when(ok, base.col), constant=None)
        items = arr(base)
        size = F.size(items).cast("bigint")
        probe = self.compile(p, env.focus(Val(F.get(items, F.lit(0)), base.t, node=base.node), one_, size))
        if probe.t.numeric and not probe.many and self.constant_focus(p):
            at = one(probe)
            return replace(base, col=F.when((at >= 1) & (at <= size) & (at == F.floor(at)), F.get(items, (at - 1).cast("int"))), many=False, constant=None)

        def test(x: Column, i: Column) -> Column:
            at = (i + 1).cast("bigint")
            v = self.compile(p, env.focus(Val(x, base.t, node=base.node), at, size))
            return F.coalesce(one(v) == at, F.lit(False)) if v.t.numeric and not v.many else ebv(v)

        return replace(base, col=F.filter(items, lambda x, i: test(x, i)))

    def constant_focus(self, e: X.Expr) -> bool:
        """Whether e is the same for every item: it uses neither the item nor its position."""
        if isinstance(e, (X.Literal, X.Var)):
            return True
        if isinstance(e, X.Call):
            return strip_prefix(e.name) == "last" and not e.args or bool(e.args) and all(self.constant_focus(a) for a in e.args)
        if isinstance(e, X.Binary):
            return self.constant_focus(e.left) and self.constant_focus(e.right)
        return isinstance(e, X.Unary) and self.constant_focus(e.operand)

    # control

    def _if(self, e: X.If, env: Env) -> Val:
        test, a, b = ebv(self.compile(e.test, env)), self.compile(e.then, env), self.compile(e.other, env)
        if a.t.kind == "empty" and b.t.kind == "empty":
            return EMPTY
        t = common(a.t, b.t)
        if a.many or b.many:
            return Val(F.when(test, arr(to(a, t))).otherwise(arr(to(b, t))), t, many=True)
        return Val(F.when(test, one(to(a, t))).otherwise(one(to(b, t))), t, node=a.node and b.node)

    def _let(self, e: X.Let, env: Env) -> Val:
        return self.compile(e.body, env.bind(e.name, self.compile(e.value, env)))

    def _for(self, e: X.For, env: Env) -> Val:
        source = self.compile(e.source, env)
        if source.t.kind == "empty":
            return EMPTY
        if not source.many:
            return self.guarded(source, self.compile(e.body, env.bind(e.name, source)))
        return self.flat(arr(source), source.t, lambda x, i: self.compile(e.body, env.bind(e.name, Val(x, source.t, node=source.node))))

    def _quantified(self, e: X.Quantified, env: Env) -> Val:
        source = self.compile(e.source, env)
        if source.t.kind == "empty":
            return literal(e.every)
        f = F.forall if e.every else F.exists
        return Val(f(arr(source), lambda x: ebv(self.compile(e.test, env.bind(e.name, Val(x, source.t, node=source.node))))), T("boolean"))

    def _logic(self, e: X.Logic, env: Env) -> Val:
        a, b = ebv(self.compile(e.left, env)), ebv(self.compile(e.right, env))
        return Val(a & b if e.op == "and" else a | b, T("boolean"))

    # operators

    def _range(self, e: X.Range, env: Env) -> Val:
        low, high = (one(self.compile(x, env)).cast("bigint") for x in (e.low, e.high))
        none = F.array().cast("array<bigint>")
        return Val(F.when(F.coalesce(low <= high, F.lit(False)), F.sequence(low, F.greatest(low, high), F.lit(1).cast("bigint"))).otherwise(none), T("integer"), many=True)

    def _unary(self, e: X.Unary, env: Env) -> Val:
        v = self.as_number(self.compile(e.operand, env))
        if v.t.kind == "empty":
            return EMPTY
        return Val(-one(v) if e.op == "-" else one(v), v.t, constant=(-v.constant if e.op == "-" else v.constant) if v.constant is not None else None)

    def as_number(self, v: Val) -> Val:
        if v.t.kind == "untyped":
            return Val(one(v).cast("double"), T("double"))
        if v.t.kind == "json":
            return Val(json_number(one(v)), T("double"))
        return v

    def _binary(self, e: X.Binary, env: Env) -> Val:
        return self.arithmetic(e.op, self.compile(e.left, env), self.compile(e.right, env))

    def arithmetic(self, op: str, a: Val, b: Val) -> Val:
        if a.t.kind == "empty" or b.t.kind == "empty":
            return EMPTY
        a, b = self.as_number(a), self.as_number(b)
        if a.t.numeric and b.t.numeric:
            return self.numeric(op, a, b)
        return self.temporal(op, a, b)

    def numeric(self, op: str, a: Val, b: Val) -> Val:
        t = common(a.t, b.t)
        if op == "div" and t.kind == "integer":
            t = T("decimal")
        x, y = one(to(a, t)), one(to(b, t))
        target = spark_type(t)
        zero = F.when(y == 0, F.raise_error(F.lit("FOAR0001: division by zero")).cast(target))
        if op in "+-*":
            out = {"+": x + y, "-": x - y, "*": x * y}[op]
            return Val(out.cast(target) if t.kind in ("decimal", "float") else out, t)
        if t.kind in ("float", "double"):
            x, y = x.cast("double"), y.cast("double")
            inf = float("inf")
            quotient = F.when(y == 0, F.when((x == 0) | F.isnan(x), float("nan")).when((x > 0) == (y.cast("string") == "0.0"), inf).otherwise(-inf)).otherwise(F.try_divide(x, y))
            if op == "div":
                return Val(F.when(x.isNotNull() & y.isNotNull(), quotient).cast(target), t)
            if op == "mod":
                return Val(F.when(y == 0, float("nan")).otherwise(F.try_mod(x, y)).cast(target), t)
            return Val(F.when(y == 0, F.raise_error(F.lit("FOAR0001: division by zero")).cast("bigint")).otherwise(F.try_divide(x, y).cast("bigint")), T("integer"))
        if op == "div":
            return Val(zero.otherwise(F.try_divide(x, y).cast(target)), t)
        if op == "mod":
            return Val(zero.otherwise(F.try_mod(x, y).cast(target)), t)
        if t.kind == "integer":
            return Val(zero.otherwise(F.call_function("div", x, y)), T("integer"))
        return Val(F.when(y == 0, F.raise_error(F.lit("FOAR0001: division by zero")).cast("bigint")).otherwise(F.try_divide(x, y).cast("decimal(38,6)").cast("bigint")), T("integer"))

    def temporal(self, op: str, a: Val, b: Val) -> Val:
        x, y, k, l = one(a), one(b), a.t.kind, b.t.kind
        stamps, spans = ("date", "dateTime", "time"), ("dayTimeDuration", "yearMonthDuration")
        if k in stamps and zoned(a.t) and l in spans:
            return with_zone(k, self.temporal(op, Val(local(a), T(k)), b).col, zone(a))
        if k == l and k in stamps and op == "-" and (zoned(a.t) or zoned(b.t)):
            return Val(instant(x, a.t) - instant(y, b.t), T("dayTimeDuration"))
        if k in stamps and l in spans and op in "+-" and not (k == "time" and l == "yearMonthDuration"):
            out = x + y if op == "+" else x - y
            return Val(out.cast("date") if k == "date" else out, T(k))
        if k in spans and l in stamps and op == "+":
            return self.temporal("+", b, a)
        if k == l and k in stamps and op == "-":
            if k == "date":
                return Val(F.make_dt_interval(F.datediff(x, y)), T("dayTimeDuration"))
            return Val(x - y, T("dayTimeDuration"))
        if k == l and k in spans:
            if op in "+-":
                return Val(x + y if op == "+" else x - y, T(k))
            if op == "div":
                from .values import seconds_of

                if k == "dayTimeDuration":
                    return Val(F.try_divide(seconds_of(x), seconds_of(y)).cast(DECIMAL), T("decimal"))
                months = lambda c: (F.extract(F.lit("YEAR"), c) * 12 + F.extract(F.lit("MONTH"), c)).cast(DECIMAL)
                return Val(F.try_divide(months(x), months(y)).cast(DECIMAL), T("decimal"))
        if k in spans and b.t.numeric and op in ("*", "div"):
            return Val(x * y if op == "*" else x / y, T(k))
        if a.t.numeric and l in spans and op == "*":
            return Val(y * x, T(l))
        raise EngineError("XPTY0004", f"{k} {op} {l}")

    def _compare(self, e: X.Compare, env: Env) -> Val:
        if e.kind == "node":
            raise Unsupported("node comparison in a row")
        a, b = self.compile(e.left, env), self.compile(e.right, env)
        if e.kind == "value":
            if a.t.kind == "empty" or b.t.kind == "empty":
                return Val(F.lit(None).cast("boolean"), T("boolean"))
            a, b = (v.typed("string") if v.t.kind == "untyped" else v for v in (a, b))
            return Val(self.compared(e.op, one(a), a.t, one(b), b.t), T("boolean"))
        if a.t.kind == "empty" or b.t.kind == "empty":
            return literal(False)
        test = lambda x, y: F.coalesce(self.compared(e.op, x, a.t, y, b.t), F.lit(False))
        if not a.many and not b.many:
            return Val(test(a.col, b.col), T("boolean"))
        if not b.many:
            return Val(F.exists(arr(a), lambda x: test(x, b.col)), T("boolean"))
        if not a.many:
            return Val(F.exists(arr(b), lambda y: test(a.col, y)), T("boolean"))
        if e.op == "=" and a.t == b.t and a.t.kind not in ("float", "double", "json") and not zoned(a.t):
            return Val(F.coalesce(F.arrays_overlap(arr(a), arr(b)), F.lit(False)), T("boolean"))
        return Val(F.exists(arr(a), lambda x: F.exists(arr(b), lambda y: test(x, y))), T("boolean"))

    def compared(self, op: str, x: Column, s: T, y: Column, t: T) -> Column:
        if s.kind == "json" or t.kind == "json":
            to_ = lambda c, other: (json_number(c), T("double")) if other.numeric else (F.try_variant_get(c, "$", "boolean"), T("boolean")) if other.kind == "boolean" else (json_text(c), T("string"))
            (x, s), (y, t) = to_(x, t) if s.kind == "json" else (x, s), to_(y, s) if t.kind == "json" else (y, t)
        if s.kind == t.kind and s.kind in STAMPS and (zoned(s) or zoned(t)):
            x, y = instant(x, s), instant(y, t)
        if s.kind == "untyped" and t.numeric:
            x, s = x.cast("double"), T("double")
        elif t.kind == "untyped" and s.numeric:
            y, t = y.cast("double"), T("double")
        elif s.kind == "untyped" and not t.text:
            x, s = x.cast(spark_type(t)), t
        elif t.kind == "untyped" and not s.text:
            y, t = y.cast(spark_type(s)), s
        if s.numeric and t.numeric:
            kind = common(s, t)
            if s != t:
                x, y = x.cast(spark_type(kind)), y.cast(spark_type(kind))
            if kind.kind in ("float", "double"):  # Spark holds NaN equal to itself and above all
                real = ~F.isnan(x) & ~F.isnan(y)
                plain = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
                return F.when(x.isNotNull() & y.isNotNull(), F.when(real, plain).otherwise(op == "!="))
        elif not (s.text and t.text) and s.kind != t.kind:
            raise EngineError("XPTY0004", f"{s.kind} {op} {t.kind}")
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def _setop(self, e: X.SetOp, env: Env) -> Val:
        raise Unsupported("set operators on nodes of a row")

    # types

    def _typeop(self, e: X.TypeOp, env: Env) -> Val:
        v = self.compile(e.operand, env)
        if e.op in ("cast", "castable"):
            name = e.type.name.removeprefix("xs:")
            try:
                made = cast(v, name, soft=e.op == "castable")
            except EngineError:
                if e.op == "cast":
                    raise
                return literal(False)
            if e.op == "cast":
                return made
            present = F.lit(e.type.occurs == "?") if v.t.kind == "empty" else F.when(one(v).isNull(), F.lit(e.type.occurs == "?")).otherwise(one(made).isNotNull())
            return Val(F.coalesce(present, F.lit(False)), T("boolean"))
        if e.op == "treat":
            return v
        size = F.lit(0) if v.t.kind == "empty" else F.size(arr(v))
        low, high = {"": (1, 1), "?": (0, 1), "*": (0, None), "+": (1, None)}[e.type.occurs] if e.type.kind != "empty" else (0, 0)
        fits = (size >= low) & (size <= high) if high is not None else size >= low
        return Val(fits & ((size == 0) | F.lit(instance(v.t, e.type))), T("boolean"))

    # maps, arrays, functions

    def _mapcons(self, e: X.MapCons, env: Env) -> Val:
        constant = {k.value: v.value for k, v in e.entries if isinstance(k, X.Literal) and isinstance(v, X.Literal)}
        if not e.entries:
            return Val(F.create_map().cast("map<string,string>"), T("map", (T("string"), T("string"))))
        pairs = [(self.compile(k, env), self.compile(v, env)) for k, v in e.entries]
        kt, vt = pairs[0][0].t, pairs[0][1].t
        for k, v in pairs[1:]:
            kt, vt = common(kt, k.t), common(vt, v.t)
        many = any(v.many for _, v in pairs)
        value = T("array", (vt,)) if many else vt
        keys = F.array(*[one(to(k, kt)) for k, _ in pairs])
        values = F.array(*[(arr(to(v, vt)) if many else one(to(v, vt)).cast(spark_type(vt))) for _, v in pairs])
        return Val(F.map_from_arrays(keys, values), T("map", (kt, value)), constant=constant if len(constant) == len(e.entries) else None)

    def _arraycons(self, e: X.ArrayCons, env: Env) -> Val:
        vals = [self.compile(m, env) for m in e.members]
        if e.square:
            if not vals:
                return Val(F.array().cast("array<string>"), T("array", (T("string"),)))
            t = vals[0].t
            for v in vals[1:]:
                t = common(t, v.t)
            if any(v.many for v in vals):
                return Val(F.array(*[arr(to(v, t)) for v in vals]), T("array", (T("array", (t,)),)))
            return Val(F.array(*[one(to(v, t)) for v in vals]), T("array", (t,)))
        v = self.concatenated(vals)
        return Val(arr(v), T("array", (T("string") if v.t.kind == "empty" else v.t,)))

    def _lookup(self, e: X.Lookup, env: Env) -> Val:
        base = self.compile(e.base, env) if e.base is not None else env.item
        if base.t.kind == "map":
            if e.key is None:
                return self.unwrapped_items(F.map_values(one(base)), base.t.args[1])
            return self.unwrapped(F.try_element_at(one(base), one(to(self.compile(e.key, env), base.t.args[0]))), base.t.args[1])
        if base.t.kind == "array":
            if e.key is None:
                return self.unwrapped_items(one(base), base.t.args[0])
            return self.unwrapped(F.element_at(one(base), one(self.compile(e.key, env)).cast("int")), base.t.args[0])
        if base.t.kind == "json":
            return self.json_member(one(base), self.compile(e.key, env) if e.key is not None else None)
        if base.t.kind == "struct" and isinstance(e.key, X.Literal):
            return self.member(base, str(e.key.value))
        raise EngineError("XPTY0004", f"lookup in {base.t.kind}")

    def json_member(self, c: Column, key: Val | None) -> Val:
        """``?key`` of a JSON object, ``?n`` of a JSON array, ``?*`` of either; JSON's null is the empty sequence."""
        items = lambda x: F.try_variant_get(x, "$", "array<variant>")
        entries = lambda x: F.try_variant_get(x, "$", "map<string,variant>")
        there = lambda x: x.isNotNull() & ~F.is_variant_null(x)
        if key is None:
            return Val(F.filter(let(c, lambda x: F.coalesce(items(x), F.map_values(entries(x)), F.array().cast("array<variant>"))), there), T("json"), many=True)
        if key.t.kind == "integer":
            n = one(key).cast("int")
            outside = F.raise_error(F.lit("FOAY0001: no such member")).cast("variant")
            found = let(items(c), lambda x: F.when(x.isNotNull() & ((n < 1) | (n > F.size(x))), outside).otherwise(F.get(x, n - 1)))
        else:
            found = F.try_element_at(entries(c), text(key))
        return Val(let(found, lambda x: F.when(there(x), x)), T("json"))

    def unwrapped(self, c: Column, t: T) -> Val:
        return Val(c, t.args[0], many=True) if t.kind == "array" else Val(c, t)

    def unwrapped_items(self, c: Column, t: T) -> Val:
        return Val(F.flatten(c), t.args[0], many=True) if t.kind == "array" else Val(c, t, many=True)

    def _inlinefunction(self, e: X.InlineFunction, env: Env) -> Val:
        def call(*args: Val) -> Val:
            inner = env
            for name, v in zip(e.params, args, strict=True):
                inner = inner.bind(name, v)
            return self.compile(e.body, replace(inner, item=None))

        return Val(None, T("function"), call=call, arity=len(e.params))

    def _functionref(self, e: X.FunctionRef, env: Env) -> Val:
        return Val(None, T("function"), call=lambda *args: self.called(e.name, list(args), env), arity=e.arity)

    def _dynamiccall(self, e: X.DynamicCall, env: Env) -> Val:
        f = self.compile(e.function, env)
        if f.call is None:
            key = self.compile(e.args[0], env)
            if f.t.kind == "map":
                return self.unwrapped(F.try_element_at(one(f), one(to(key, f.t.args[0]))), f.t.args[1])
            if f.t.kind == "array":
                return self.unwrapped(F.element_at(one(f), one(key).cast("int")), f.t.args[0])
            raise EngineError("XPTY0004", "not a function")
        return self.applied(f, e.args, env)

    def applied(self, f: Val, args: tuple, env: Env) -> Val:
        if any(isinstance(a, X.Placeholder) for a in args):
            fixed = [None if isinstance(a, X.Placeholder) else self.compile(a, env) for a in args]

            def call(*rest: Val) -> Val:
                left = iter(rest)
                return f.call(*[next(left) if v is None else v for v in fixed])

            return Val(None, T("function"), call=call, arity=sum(v is None for v in fixed))
        return f.call(*[self.compile(a, env) for a in args])

    def _call(self, e: X.Call, env: Env) -> Val:
        if any(isinstance(a, X.Placeholder) for a in e.args):
            return self.applied(Val(None, T("function"), call=lambda *args: self.called(e.name, list(args), env), arity=len(e.args)), e.args, env)
        return self.called(e.name, [self.compile(a, env) for a in e.args], env)

    def called(self, name: str, args: list[Val], env: Env) -> Val:
        name = strip_prefix(name)
        if (name, len(args)) in self.user:
            return self.user[name, len(args)](*args)
        if name.startswith("xs:"):
            return cast(args[0], name[3:])
        found = self.library.get(name)
        if found is None:
            raise EngineError("XPST0017", f"{name}#{len(args)}")
        low, high, build = found
        if name.startswith(("map:", "array:")) and args:
            args = [json_typed(a, name) if a.t.kind == "json" and n == 0 else a for n, a in enumerate(args)]
        if name in ("sort", "array:sort", "deep-equal", "fold-left", "fold-right") and any(zoned(a.t) for a in args):
            raise Unsupported(f"{name} of values with a zone")
        if not low <= len(args) <= (high if high is not None else len(args)):
            raise EngineError("XPST0017", f"{name}#{len(args)}")
        return build(self, env, *args)


def json_typed(v: Val, name: str) -> Val:
    """A JSON value as the argument of a map or array function."""
    if name.startswith("map:"):
        return Val(F.try_variant_get(one(v), "$", "map<string,variant>"), T("map", (T("string"), T("json"))))
    return Val(F.try_variant_get(one(v), "$", "array<variant>"), T("array", (T("json"),)))


def instance(t: T, wanted: X.SeqType) -> bool:
    if t.kind == "json" and wanted.kind != "item":
        raise Unsupported("instance of on a JSON value")
    if wanted.kind in ("item", "empty"):
        return wanted.kind == "item"
    if wanted.kind in ("map", "array"):
        return t.kind == wanted.kind
    if wanted.kind == "function":
        return t.kind in ("function", "map", "array")
    if wanted.kind == "node":
        return t.kind == "struct"
    name = wanted.name.removeprefix("xs:")
    if name in ("anyAtomicType",):
        return t.kind not in ("map", "array", "struct", "function")
    if name == "numeric":
        return t.numeric
    if name == "untypedAtomic":
        return t.kind == "untyped"
    if name == "decimal":
        return t.kind in ("decimal", "integer")
    return t.kind == name or name == "duration" and t.kind.endswith("Duration")


#: The zone at the end of a date or time.
ZONE_PATTERN = r"(Z|[+-](?:0\d|1[0-3]):[0-5]\d|[+-]14:00)$"


def cast(v: Val, name: str, soft: bool = False) -> Val:
    """v as the built-in type; soft: null where the cast fails, else an error with the standard's code."""
    if v.t.kind == "empty":
        return EMPTY
    if v.t.kind == "json":
        v = Val(json_number(one(v)), T("double")) if name in INTEGERS or name in NUMERIC else Val(json_text(one(v)), T("string"))
    c, k = one(v), v.t.kind
    failed = lambda kind, code="FORG0001": F.lit(None).cast(kind) if soft else F.raise_error(F.concat(F.lit(f"{code}: cannot cast to xs:{name}: "), F.coalesce(text(v), F.lit("")))).cast(kind)
    if name in STRINGS:
        out = text(v)
        if name == "normalizedString":
            out = F.regexp_replace(out, r"[\t\n\r]", " ")
        elif name not in ("string", "untypedAtomic"):
            out = F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))
        return Val(out, T("untyped" if name == "untypedAtomic" else "anyURI" if name == "anyURI" else "string"))
    if name == "boolean":
        if v.t.numeric:
            return Val((c != 0) & (~F.isnan(c) if k in ("float", "double") else F.lit(True)), T("boolean"))
        if k == "boolean":
            return v
        s = F.trim(text(v))
        return Val(F.when(c.isNull(), F.lit(None).cast("boolean")).when(s.isin("true", "1"), True).when(s.isin("false", "0"), False).otherwise(failed("boolean")), T("boolean"))
    if name in INTEGERS or name in NUMERIC:
        kind = "integer" if name in INTEGERS else name
        target = spark_type(T(kind))
        if k == "boolean":
            out = c.cast("int").cast(target)
        elif v.t.numeric:
            if kind in ("integer", "decimal") and k in ("float", "double"):
                out = F.when(c.isNull(), F.lit(None).cast(target)).when(F.isnan(c) | (F.abs(c) == float("inf")), failed(target, "FOCA0002")).otherwise(c.cast("decimal(38,18)" if kind == "decimal" else "bigint"))
            else:
                out = c.cast(target)
        elif v.t.text:
            s = F.trim(c)
            pattern = r"^[+-]?\d+$" if kind == "integer" else r"^[+-]?(\d+(\.\d*)?|\.\d+)$" if kind == "decimal" else r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
            plain = s.try_cast(target)
            out = F.when(c.isNull(), F.lit(None).cast(target)).when(s.rlike(pattern), plain)
            if kind in ("float", "double"):
                out = out.when(s == "INF", F.lit(float("inf")).cast(target)).when(s == "-INF", F.lit(float("-inf")).cast(target)).when(s == "NaN", F.lit(float("nan")).cast(target))
            out = out.otherwise(failed(target))
        else:
            raise EngineError("XPTY0004", f"{k} as {name}")
        low, high = INTEGERS.get(name, (None, None))
        if low is not None or high is not None:
            ok = F.lit(True)
            if low is not None and low > -(2**63):
                ok = ok & (out >= low)
            if high is not None and high < 2**63 - 1:
                ok = ok & (out <= high)
            out = F.when(out.isNull() | ok, out).otherwise(failed(target))
        return Val(out, T(kind))
    if name in STAMPS:
        target = spark_type(T(name))
        if k == name:
            return v
        if k in ("date", "dateTime") and zoned(v.t):
            return with_zone(name, cast(Val(local(v), T(k)), name).col, zone(v))
        if k == "dateTime" and name == "date":
            return Val(c.cast("date"), T("date"))
        if k == "dateTime" and name == "time":
            return Val(F.make_dt_interval(F.lit(0), F.hour(c), F.minute(c), F.extract(F.lit("SECOND"), c)), T("time"))
        if k == "date" and name == "dateTime":
            return Val(c.cast("timestamp_ntz"), T("dateTime"))
        if not v.t.text:
            raise EngineError("XPTY0004", f"{k} as {name}")
        pattern = {"date": r"^-?\d{4,}-\d\d-\d\d$", "dateTime": r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?$", "time": r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?$"}[name]

        def reading(body: Column) -> Column:
            if name != "time":
                return F.when(body.rlike(pattern), body.try_cast(target))
            part = lambda n: F.split_part(body, F.lit(":"), F.lit(n))
            return F.when(body.rlike(pattern), F.make_dt_interval(F.lit(0), part(1).try_cast("int"), part(2).try_cast("int"), part(3).try_cast("decimal(18,6)")))

        if isinstance(v.constant, str) and not re.search(ZONE_PATTERN, v.constant.strip()):
            made = reading(F.trim(c))
            return Val(F.when(c.isNull() | made.isNotNull(), made).otherwise(failed(target)), T(name))
        minutes = lambda x: F.substring(x, 2, 2).try_cast("int") * 60 + F.substring(x, 5, 2).try_cast("int")
        offset = lambda x: F.when(x == "Z", 0).when(x.startswith("-"), -minutes(x)).otherwise(minutes(x))
        # the text is evaluated once, as it may be a long expression itself
        parsed = let(F.trim(c), lambda s: F.struct(s.isNull().alias("none"), let(F.regexp_replace(s, ZONE_PATTERN, ""), reading).alias("v"), let(F.regexp_extract(s, ZONE_PATTERN, 1), offset).alias("z")))
        bad = F.struct(failed(target).alias("v"), F.lit(None).cast("int").alias("z"))
        made = lambda x: F.when(x.getField("v").isNotNull(), F.struct(x.getField("v").alias("v"), x.getField("z").cast("int").alias("z")))
        return Val(let(parsed, made if soft else lambda x: made(x).when(~x.getField("none"), bad)), T(name, ZONED))
    if name in ("dayTimeDuration", "yearMonthDuration"):
        target = spark_type(T(name))
        if k == name:
            return v
        if not v.t.text:
            raise EngineError("XPTY0004", f"{k} as {name}")
        s = F.trim(c)
        sign = F.when(s.startswith("-"), -1).otherwise(1)
        part = lambda unit, kind="int": F.coalesce(F.nullif(F.regexp_extract(s, rf"(\d+(?:\.\d+)?){unit}", 1), F.lit("")).cast(kind), F.lit(0).cast(kind))
        if name == "yearMonthDuration":
            ok = s.rlike(r"^-?P(\d+Y)?(\d+M)?$") & ~s.rlike(r"P$")
            made = F.make_ym_interval(F.lit(0), sign * (part("Y") * 12 + part("M")))
        else:
            ok = s.rlike(r"^-?P(\d+D)?(T(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$") & ~s.rlike(r"[PT]$")
            made = F.make_dt_interval(sign * part("D"), sign * part("H"), sign * part("M"), sign * part("S", "decimal(18,6)"))
        return Val(F.when(c.isNull(), F.lit(None).cast(target)).when(ok, made).otherwise(failed(target)), T(name))
    if name in ("hexBinary", "base64Binary"):
        if v.t.text:
            return Val(F.try_to_binary(F.trim(c), F.lit("hex" if name == "hexBinary" else "base64")), T(name))
        return Val(c, T(name))
    raise Unsupported(f"cast to xs:{name}")


def row_item(df: DataFrame) -> Val:
    """The row of df as context item; columns without an item type cannot be named."""
    fields = []
    for f in df.schema.fields:
        try:
            t, many = of_spark(f.dataType)
        except Unsupported:
            continue
        fields.append((f.name, t, many))
    return Val(None, T("struct", (), tuple(fields)))


def condition(expression: str, df: DataFrame, variables: dict[str, Val] | None = None, functions: dict | None = None) -> Column:
    """The expression as a filter over the rows of df."""
    return Compiler(functions).condition(X.parse(expression), Env(row_item(df), variables=variables or {}))


def column(expression: str, df: DataFrame, variables: dict[str, Val] | None = None, functions: dict | None = None) -> Val:
    """The expression over the rows of df."""
    return Compiler(functions).compile(X.parse(expression), Env(row_item(df), variables=variables or {}))
