"""Scalar functions of the query language, each a Spark expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from graphloom.cypher.ast import QueryError
from graphloom.plans.expressions import Val, own_properties, with_col

_NULL = lambda: Val(F.lit(None), "null")


def _string(f: Callable) -> Callable:
    return lambda a, *rest: Val(f(a.col, *(r.col for r in rest)), "str") if a.kind == "str" else _NULL()


def _number(f: Callable, kind: str | None = None) -> Callable:
    return lambda a: Val(f(a.col), kind or a.kind) if a.kind in ("int", "float") else _NULL()


def _size(a: Val) -> Val:
    if a.kind == "list":
        return Val(F.when(a.col.isNotNull(), F.size(a.col)).cast("bigint"), "int")
    return Val(F.length(a.col).cast("bigint"), "int") if a.kind == "str" else _NULL()


def _length(a: Val) -> Val:
    if a.kind == "path" and "hops" in a.props:
        return Val(a.col, "int")
    return Val(F.size(a.col["relationships"]).cast("bigint"), "int") if a.kind == "path" else _size(a)


def _part(name: str) -> Callable:
    def part(a: Val) -> Val:
        return Val(a.col[name], "list", elem=a.props[name].elem) if a.kind == "path" else _NULL()

    return part


def _coalesce(*args: Val) -> Val:
    some = [a for a in args if a.kind != "null"]
    if not some:
        return _NULL()
    kinds = {a.kind for a in some}
    if len(kinds) == 1:
        return with_col(F.coalesce(*(a.col for a in some)), some[0])
    if kinds <= {"int", "float"}:
        return Val(F.coalesce(*(a.col.cast("double") for a in some)), "float")
    return Val(F.coalesce(*(a.col.cast("string") for a in some)), "str")


def _labels(a: Val) -> Val:
    return Val(a.get("\0labels"), "list", elem=Val(None, "str")) if a.kind == "node" else _NULL()


def _keys(a: Val) -> Val:
    if a.kind not in ("node", "rel", "map"):
        return _NULL()
    names = list(a.props) if a.kind == "map" else own_properties(a)
    if not names:
        return Val(F.array().cast("array<string>"), "list", elem=Val(None, "str"))
    return Val(F.array_compact(F.array(*(F.when(a.get(n).isNotNull(), F.lit(n.removeprefix("prop:"))) for n in names))), "list", elem=Val(None, "str"))


def _properties(a: Val) -> Val:
    if a.kind not in ("node", "rel"):
        return a
    names = own_properties(a)
    if not names:
        return _NULL()
    col = F.struct(*(a.get(n).alias(n.removeprefix("prop:")) for n in names))
    return Val(col, "map", props={n.removeprefix("prop:"): a.props[n] for n in names}, get=lambda n: col[n])


def _endpoint(name: str) -> Callable:
    return lambda a: Val(a.get(name), "int" if a.props[name].kind == "int" else "str") if a.kind == "rel" else _NULL()


def _range(low: Val, high: Val, step: Val | None = None) -> Val:
    by = F.lit(1).cast("bigint") if step is None else step.col
    empty = F.expr("cast(array() as array<bigint>)")
    up = F.signum(by) * (high.col - low.col) >= 0
    return Val(F.when(up, F.sequence(low.col, high.col, by)).otherwise(empty), "list", elem=Val(None, "int"))


def _at(which: str) -> Callable:
    def pick(a: Val) -> Val:
        if a.kind != "list":
            return _NULL()
        i = F.lit(0) if which == "head" else F.size(a.col) - 1
        return with_col(F.get(a.col, i), a.elem)

    return pick


def _tail(a: Val) -> Val:
    return Val(F.slice(a.col, 2, F.greatest(F.lit(0), F.size(a.col) - 1)), "list", elem=a.elem) if a.kind == "list" else _NULL()


def _reverse(a: Val) -> Val:
    return Val(F.reverse(a.col), a.kind, elem=a.elem) if a.kind in ("list", "str") else _NULL()


def _to(kind: str, spark_type: str) -> Callable:
    def convert(a: Val) -> Val:
        if a.kind in ("list", "map", "node", "rel", "path", "null"):
            return _NULL()
        if kind == "int" and a.kind == "str":
            return Val(a.col.try_cast("double").cast("bigint"), "int")
        return Val(a.col.try_cast(spark_type), kind)

    return convert


def _substring(a: Val, start: Val, length: Val | None = None) -> Val:
    if a.kind != "str":
        return _NULL()
    n = F.length(a.col) if length is None else length.col.cast("int")
    return Val(F.substring(a.col, start.col.cast("int") + 1, n), "str")


def _round(a: Val, digits: Val | None = None) -> Val:
    if a.kind not in ("int", "float"):
        return _NULL()
    return Val(F.round(a.col.cast("double"), F.lit(0) if digits is None else digits.col.cast("int")), "float")


def _id(a: Val) -> Val:
    return Val(a.ident, a.props["id"].kind if "id" in a.props else "int") if a.kind in ("node", "rel") else _NULL()


FUNCTIONS: dict[str, Callable] = {
    "id": _id,
    "type": lambda a: Val(a.get("rel_type"), "str") if a.kind == "rel" else _NULL(),
    "labels": _labels,
    "keys": _keys,
    "properties": _properties,
    "startnode": _endpoint("source"),
    "endnode": _endpoint("target"),
    "length": _length,
    "size": _size,
    "nodes": _part("nodes"),
    "relationships": _part("relationships"),
    "rels": _part("relationships"),
    "coalesce": _coalesce,
    "head": _at("head"),
    "last": _at("last"),
    "tail": _tail,
    "reverse": _reverse,
    "range": _range,
    "tolower": _string(F.lower),
    "lower": _string(F.lower),
    "toupper": _string(F.upper),
    "upper": _string(F.upper),
    "trim": _string(F.trim),
    "ltrim": _string(F.ltrim),
    "rtrim": _string(F.rtrim),
    "replace": _string(F.replace),
    "left": _string(lambda s, n: F.left(s, n)),
    "right": _string(lambda s, n: F.right(s, n)),
    "substring": _substring,
    "split": lambda a, b: Val(F.split(a.col, F.concat(F.lit("\\Q"), b.col, F.lit("\\E"))), "list", elem=Val(None, "str")) if a.kind == "str" else _NULL(),
    "tostring": _to("str", "string"),
    "tointeger": _to("int", "bigint"),
    "toint": _to("int", "bigint"),
    "tofloat": _to("float", "double"),
    "toboolean": _to("bool", "boolean"),
    "abs": _number(F.abs),
    "ceil": _number(lambda c: F.ceil(c).cast("double"), "float"),
    "floor": _number(lambda c: F.floor(c).cast("double"), "float"),
    "round": _round,
    "sqrt": _number(lambda c: F.when(c >= 0, F.sqrt(c)), "float"),
    "sign": _number(lambda c: F.signum(c).cast("bigint"), "int"),
    "exp": _number(F.exp, "float"),
    "log": _number(F.log, "float"),
    "log10": _number(F.log10, "float"),
    "sin": _number(F.sin, "float"),
    "cos": _number(F.cos, "float"),
    "tan": _number(F.tan, "float"),
    "pi": lambda: Val(F.pi(), "float"),
    "e": lambda: Val(F.e(), "float"),
}


def call(name: str, args: list[Val]) -> Val:
    if name not in FUNCTIONS:
        raise QueryError(f"unknown function {name}")
    try:
        return FUNCTIONS[name](*args)
    except TypeError as e:
        raise QueryError(f"wrong arguments for {name}: {e}") from e
