"""Expressions of the query language as Spark columns with static kinds.

Predicates are two-valued: a comparison with null or of things that can't be compared is false, its negation true.
Strings and numbers are never equal. Kinds are known before anything runs, so Spark's implicit casts never come in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from graphloom.cypher import ast as A
from graphloom.cypher.ast import QueryError

_EPSILON = 2.220446049250313e-16
_TEXT_TESTS = {"starts": F.startswith, "ends": F.endswith, "contains": F.contains}
_ORDER = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@dataclass
class Val:
    """A column and its kind: null bool int float str ts list map node rel path. ``elem``: of a list; ``props``: kinds by
    name of a node, relationship or map; ``get``: property access."""

    col: Column
    kind: str
    elem: Any = None
    props: dict[str, Any] = field(default_factory=dict)
    get: Callable[[str], Column] | None = None
    ident: Column | None = None


def kind_of(t: T.DataType) -> Val:
    """A Val without a column, for a Spark type."""
    if isinstance(t, T.NullType):
        return Val(None, "null")
    if isinstance(t, T.BooleanType):
        return Val(None, "bool")
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return Val(None, "int")
    if isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
        return Val(None, "float")
    if isinstance(t, T.StringType):
        return Val(None, "str")
    if isinstance(t, T.TimestampType | T.DateType | T.TimestampNTZType):
        return Val(None, "ts")
    if isinstance(t, T.ArrayType):
        return Val(None, "list", elem=kind_of(t.elementType))
    if isinstance(t, T.StructType):
        return Val(None, "map", props={f.name: kind_of(f.dataType) for f in t.fields})
    if isinstance(t, T.MapType):
        return Val(None, "map", elem=kind_of(t.valueType))
    return Val(None, "other")


def with_col(col: Column, like: Val) -> Val:
    return Val(col, like.kind, like.elem, like.props, (lambda name: col["labels" if name == "\0labels" else name]) if like.kind in ("map", "rel", "node") else None, col["id"] if like.kind in ("rel", "node") and "id" in like.props else None)


RESERVED = ("id", "labels", "rel_type", "source", "target")


def property_key(name: str) -> str:
    """Column of a property; names the model uses itself get a prefix."""
    return f"prop:{name}" if name in RESERVED else name


def own_properties(v: Val) -> list[str]:
    return [n for n in v.props if n not in RESERVED]


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _number(v: Val) -> bool:
    return v.kind in ("int", "float")


def raw_equal(a: Val, b: Val) -> Column:
    """True where equal, else false or null: for filters, where it can be a join key or go down to the scan."""
    if a.kind in ("node", "rel") and b.kind == a.kind:
        return a.ident == b.ident
    if "null" in (a.kind, b.kind):
        return F.lit(False)
    if _number(a) and _number(b):
        return a.col == b.col if a.kind == b.kind == "int" else (F.abs(a.col - b.col) < F.lit(_EPSILON)) | (a.col == b.col)
    return a.col == b.col if a.kind == b.kind else F.lit(False)


def equal(a: Val, b: Val) -> Column:
    return two_valued(raw_equal(a, b))


def raw_compare(op: str, a: Val, b: Val) -> Column:
    if op == "=":
        return raw_equal(a, b)
    if op == "<>":
        return ~equal(a, b)
    if _number(a) and _number(b) or a.kind == b.kind and a.kind in ("str", "ts"):
        return _ORDER[op](a.col, b.col)
    return F.lit(False)


def compare(op: str, a: Val, b: Val) -> Column:
    return two_valued(raw_compare(op, a, b))


def _merge_kinds(values: list[Val]) -> Val:
    some = [v for v in values if v.kind != "null"]
    if not some:
        return Val(None, "null")
    if len({v.kind for v in some}) == 1:
        return some[0]
    if all(_number(v) for v in some):
        return Val(None, "float")
    return Val(None, "str")


def _as(v: Val, kind: Val) -> Column:
    if v.kind == kind.kind or kind.kind == "null":
        return v.col
    spark_type = {"float": "double", "str": "string", "int": "bigint", "bool": "boolean", "ts": "timestamp"}.get(kind.kind)
    return v.col.cast(spark_type) if spark_type else v.col


def _whole_quotient(x: Column, y: Column) -> Column:
    """Integer division, toward zero; null for a zero divisor."""
    return F.call_function("div", x, F.nullif(y, F.lit(0).cast("bigint")))


class Compiler:
    """Compiles against a scope: names -> Val. ``exists``: maps pattern predicates to boolean columns."""

    def __init__(self, scope: dict[str, Val], params: dict[str, Any], exists: dict[A.Exists, Column] | None = None):
        self.scope, self.params, self.exists = scope, params, exists or {}

    def condition(self, e: Any) -> Column:
        v = self.compile(e)
        if v.kind not in ("bool", "null"):
            raise QueryError("a condition must be a boolean")
        return F.lit(False) if v.kind == "null" else two_valued(v.col)

    def filter(self, e: Any) -> Column:
        """A condition for a filter: as ``condition``, but null may stand for false where that lets Spark push it down."""
        if isinstance(e, A.Op) and e.op == "and":
            return self.filter(e.args[0]) & self.filter(e.args[1])
        if isinstance(e, A.Op) and e.op in ("=", "<", "<=", ">", ">="):
            return raw_compare(e.op, *map(self.compile, e.args))
        if isinstance(e, A.Op) and e.op in _TEXT_TESTS:
            a, b = map(self.compile, e.args)
            return _TEXT_TESTS[e.op](a.col, b.col) if a.kind == b.kind == "str" else F.lit(False)
        if isinstance(e, A.Op) and e.op == "in" and isinstance(e.args[1], A.ListOf) and all(isinstance(x, A.Lit) for x in e.args[1].items):
            a, items = self.compile(e.args[0]), [self._constant(x.value) for x in e.args[1].items]
            some = [v.col for v in items if v.kind == a.kind or _number(v) and _number(a)]
            return a.col.isin(*some) if some and a.kind != "null" else F.lit(False)
        return self.condition(e)

    def compile(self, e: Any) -> Val:
        return getattr(self, "on_" + type(e).__name__.lower())(e)

    def on_lit(self, e: A.Lit) -> Val:
        return self._constant(e.value)

    def _constant(self, value: Any) -> Val:
        if isinstance(value, list | tuple):
            return self._list([self._constant(x) for x in value])
        if isinstance(value, dict):
            return self._map([(k, self._constant(x)) for k, x in value.items()])
        kinds = {type(None): "null", bool: "bool", int: "int", float: "float", str: "str"}
        if type(value) not in kinds:
            return Val(F.lit(value), "ts")
        return Val(F.lit(value).cast("bigint") if type(value) is int else F.lit(value), kinds[type(value)])

    def on_param(self, e: A.Param) -> Val:
        if e.name not in self.params:
            raise QueryError(f"parameter ${e.name} is not given")
        return self._constant(self.params[e.name])

    def on_var(self, e: A.Var) -> Val:
        if e.name not in self.scope:
            raise QueryError(f"unknown variable {e.name}")
        return self.scope[e.name]

    def on_prop(self, e: A.Prop) -> Val:
        base = self.compile(e.base)
        if base.kind not in ("node", "rel", "map"):
            return Val(F.lit(None), "null")
        name = property_key(e.name) if base.kind in ("node", "rel") else e.name
        if name in base.props:
            return with_col(base.get(name), base.props[name])
        if base.kind == "map" and base.elem is not None:
            return with_col(base.col[F.lit(e.name)], base.elem)
        return Val(F.lit(None), "null")

    def on_haslabels(self, e: A.HasLabels) -> Val:
        base = self.compile(e.base)
        if base.kind != "node":
            raise QueryError("a label test needs a node")
        out = F.lit(True)
        for group in e.labels:
            out = out & F.arrays_overlap(base.get("\0labels"), F.array(*map(F.lit, group)))
        return Val(two_valued(out), "bool")

    def on_exists(self, e: A.Exists) -> Val:
        if e not in self.exists:
            raise QueryError("a pattern can be tested in WHERE, WITH and RETURN only")
        return Val(self.exists[e], "bool")

    def on_listof(self, e: A.ListOf) -> Val:
        return self._list([self.compile(x) for x in e.items])

    def _list(self, items: list[Val]) -> Val:
        kind = _merge_kinds(items)
        return Val(F.array(*(_as(v, kind) for v in items)), "list", elem=with_col(None, kind) if kind.kind not in ("map", "rel", "node") else kind)

    def on_mapof(self, e: A.MapOf) -> Val:
        return self._map([(k, self.compile(v)) for k, v in e.items])

    def _map(self, items: list[tuple[str, Val]]) -> Val:
        col = F.struct(*(v.col.alias(k) for k, v in items)) if items else F.struct(F.lit(None).alias("_"))
        return Val(col, "map", props={k: v for k, v in items}, get=lambda name: col[name])

    def on_case(self, e: A.Case) -> Val:
        subject = None if e.subject is None else self.compile(e.subject)
        conditions = [self.condition(w) if subject is None else equal(subject, self.compile(w)) for w, _ in e.whens]
        values = [self.compile(v) for _, v in e.whens] + [self.compile(e.otherwise) if e.otherwise is not None else Val(F.lit(None), "null")]
        kind = _merge_kinds(values)
        out = F
        for c, v in zip(conditions, values, strict=False):
            out = out.when(c, _as(v, kind))
        return with_col(out.otherwise(_as(values[-1], kind)), kind)

    def _with_var(self, name: str, element: Column, kind: Val) -> Compiler:
        return Compiler({**self.scope, name: with_col(element, kind)}, self.params, self.exists)

    def on_quantified(self, e: A.Quantified) -> Val:
        source = self._list_of(e.source)
        if source is None:
            return Val(F.lit(e.kind in ("all", "none")), "bool")
        test = lambda x: self._with_var(e.var, x, source.elem).condition(e.condition)
        held = {
            "all": lambda: F.forall(source.col, test),
            "any": lambda: F.exists(source.col, test),
            "none": lambda: ~F.exists(source.col, test),
            "single": lambda: F.size(F.filter(source.col, test)) == 1,
        }[e.kind]()
        return Val(F.coalesce(held, F.lit(e.kind in ("all", "none"))), "bool")

    def _list_of(self, e: Any) -> Val | None:
        source = self.compile(e)
        if source.kind == "null":
            return None
        if source.kind != "list":
            raise QueryError("IN needs a list")
        return source

    def on_comprehension(self, e: A.Comprehension) -> Val:
        source = self._list_of(e.source)
        if source is None:
            return Val(F.lit(None), "null")
        col, kind = source.col, source.elem
        if e.condition is not None:
            col = F.filter(col, lambda x: self._with_var(e.var, x, source.elem).condition(e.condition))
        if e.mapped is not None:
            made: list[Val] = []

            def mapped(x):
                made.append(self._with_var(e.var, x, source.elem).compile(e.mapped))
                return made[-1].col

            col = F.transform(col, mapped)
            kind = made[-1]
        return Val(col, "list", elem=kind)

    def on_op(self, e: A.Op) -> Val:
        op = e.op
        if op in ("and", "or", "xor"):
            a, b = (self.condition(x) for x in e.args)
            return Val(a & b if op == "and" else a | b if op == "or" else a != b, "bool")
        if op == "not":
            return Val(~self.condition(e.args[0]), "bool")
        if op == "slice":
            return self._slice(*e.args)
        args = [self.compile(x) for x in e.args]
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return Val(compare(op, *args), "bool")
        a = args[0]
        if op == "isnull":
            return Val(F.lit(True) if a.kind == "null" else (a.ident if a.kind in ("node", "rel") and a.ident is not None else a.col).isNull(), "bool")
        if op == "in":
            return self._in(*args)
        if op in ("starts", "ends", "contains"):
            if not all(v.kind == "str" for v in args):
                return Val(F.lit(False), "bool")
            return Val(two_valued(_TEXT_TESTS[op](a.col, args[1].col)), "bool")
        if op == "=~":
            if not all(v.kind == "str" for v in args):
                return Val(F.lit(False), "bool")
            return Val(two_valued(F.rlike(a.col, args[1].col)), "bool")
        if op == "neg":
            return Val(-a.col, a.kind) if _number(a) else Val(F.lit(None), "null")
        if op == "index":
            return self._index(a, args[1])
        return self._arithmetic(op, a, args[1])

    def _in(self, a: Val, source: Val) -> Val:
        if source.kind != "list" or source.elem is None or source.elem.kind == "null" or a.kind == "null":
            return Val(F.lit(False), "bool")
        if not (_number(a) and _number(source.elem)) and a.kind != source.elem.kind:
            return Val(F.lit(False), "bool")
        if a.kind in ("node", "rel"):
            return Val(two_valued(F.exists(source.col, lambda x: x["id"] == a.ident)), "bool")
        return Val(two_valued(F.exists(source.col, lambda x: two_valued(x == a.col))), "bool")

    def _index(self, a: Val, i: Val) -> Val:
        if a.kind == "list" and i.kind == "int":
            n = i.col.cast("int")
            return with_col(F.get(a.col, F.when(n < 0, F.size(a.col) + n).otherwise(n)), a.elem)
        if a.kind == "map" and i.kind == "str" and a.elem is not None:
            return with_col(a.col[i.col], a.elem)
        return Val(F.lit(None), "null")

    def _slice(self, source: Any, low: Any, high: Any) -> Val:
        a = self.compile(source)
        if a.kind != "list":
            return Val(F.lit(None), "null")
        n = F.size(a.col)

        def bound(e: Any, default: Column) -> Column:
            if e is None:
                return default
            i = self.compile(e).col.cast("int")
            return F.least(n, F.greatest(F.lit(0), F.when(i < 0, n + i).otherwise(i)))

        start, end = bound(low, F.lit(0)), bound(high, n)
        return Val(F.slice(a.col, start + 1, F.greatest(F.lit(0), end - start)), "list", elem=a.elem)

    def _arithmetic(self, op: str, a: Val, b: Val) -> Val:
        if op == "+" and "str" in (a.kind, b.kind) and "list" not in (a.kind, b.kind):
            return Val(F.concat(a.col.cast("string"), b.col.cast("string")), "str")
        if op == "+" and a.kind == "list":
            return Val(F.concat(a.col, b.col if b.kind == "list" else F.array(b.col)), "list", elem=a.elem)
        if not (_number(a) and _number(b)):
            return Val(F.lit(None), "null")
        whole = a.kind == b.kind == "int"
        x, y = a.col, b.col
        if op in "+-*":
            f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
            return Val(f(x, y), "int" if whole else "float")
        if op == "/":
            return Val(_whole_quotient(x, y), "int") if whole else Val(F.try_divide(x.cast("double"), y.cast("double")), "float")
        if op == "%":
            return Val(F.try_mod(x, y), "int" if whole else "float")
        return Val(F.pow(x, y), "float")

    # --- functions
    def on_call(self, e: A.Call) -> Val:
        from graphloom.functions.library import call

        if e.star or e.distinct:
            raise QueryError(f"{e.name} with * or DISTINCT is an aggregate and can't stand here")
        return call(e.name, [self.compile(x) for x in e.args])
