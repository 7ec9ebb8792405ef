"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class QueryError(ValueError):
    """A query that can't be parsed, bound or run."""


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    base: Any
    name: str


@dataclass(frozen=True)
class HasLabels:
    base: Any
    labels: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Op:
    """op: and or xor not neg + - * / % ^ = <> < <= > >= in starts ends contains =~ isnull index slice"""

    op: str
    args: tuple[Any, ...]


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Any, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class ListOf:
    items: tuple[Any, ...]


@dataclass(frozen=True)
class MapOf:
    items: tuple[tuple[str, Any], ...]


@dataclass(frozen=True)
class Case:
    subject: Any
    whens: tuple[tuple[Any, Any], ...]
    otherwise: Any


@dataclass(frozen=True)
class Quantified:
    """all any none single (var IN list WHERE condition)"""

    kind: str
    var: str
    source: Any
    condition: Any


@dataclass(frozen=True)
class Comprehension:
    var: str
    source: Any
    condition: Any
    mapped: Any


@dataclass(frozen=True)
class Exists:
    paths: tuple[Any, ...]
    where: Any = None


@dataclass(frozen=True)
class NodePat:
    var: str | None
    labels: tuple[tuple[str, ...], ...] = ()
    props: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class RelPat:
    var: str | None
    types: tuple[str, ...]
    direction: str  # out, in, both
    props: tuple[tuple[str, Any], ...] = ()
    hops: tuple[int, int] | None = None


@dataclass(frozen=True)
class PathPat:
    var: str | None
    parts: tuple[Any, ...]  # node, rel, node, ...
    shortest: str | None = None  # one, all


@dataclass(frozen=True)
class Match:
    paths: tuple[PathPat, ...]
    where: Any = None
    optional: bool = False


@dataclass(frozen=True)
class Unwind:
    source: Any
    var: str


@dataclass(frozen=True)
class Project:
    """WITH (final false) or RETURN (final true)"""

    items: tuple[tuple[Any, str], ...]
    star: bool = False
    distinct: bool = False
    order: tuple[tuple[Any, bool], ...] = ()
    skip: Any = None
    limit: Any = None
    where: Any = None
    final: bool = True


@dataclass(frozen=True)
class Create:
    paths: tuple[PathPat, ...]


@dataclass(frozen=True)
class Merge:
    path: PathPat
    on_create: tuple[Any, ...] = ()
    on_match: tuple[Any, ...] = ()


@dataclass(frozen=True)
class SetItem:
    """kind: prop (target Prop), labels, replace, merge"""

    kind: str
    target: Any
    value: Any


@dataclass(frozen=True)
class SetClause:
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Remove:
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Delete:
    targets: tuple[Any, ...]
    detach: bool = False


@dataclass(frozen=True)
class Query:
    clauses: tuple[Any, ...]


@dataclass(frozen=True)
class Statement:
    parts: tuple[Query, ...]
    union_all: tuple[bool, ...] = field(default=())

    def is_read_only(self) -> bool:
        return not any(isinstance(c, Create | Merge | SetClause | Remove | Delete) for q in self.parts for c in q.clauses)


def walk(node: Any):
    """The node and everything below it."""
    yield node
    if isinstance(node, tuple | list):
        for x in node:
            yield from walk(x)
    elif hasattr(node, "__dataclass_fields__"):
        for name in node.__dataclass_fields__:
            yield from walk(getattr(node, name))
