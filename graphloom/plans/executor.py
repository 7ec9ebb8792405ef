"""Clauses to DataFrames.

A row of bindings is a DataFrame row; each variable owns some columns (an entity its id, labels or type, and properties).
Everything is one lazy plan, so column pruning, filter pushdown and join choice are Catalyst's. Only what Catalyst can't
see is decided here: which tables can match at all, which node joins are needless, where a traversal loop gets its seeds
(filters that are ready are applied before a loop starts), and when paths have to be carried along.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.cypher import ast as A
from graphloom.cypher.ast import QueryError
from graphloom.cypher.parser import has_aggregate, is_aggregate
from graphloom.model import Graph, RelTable, may_have, union_tables
from graphloom.operators.traverse import Half, bfs, repeated, staged, stages
from graphloom.plans.expressions import Compiler, Val, kind_of, property_key, raw_equal, with_col

_AGG = "\0agg"
STAGED = 16  # hops up to which a search looks ahead by labels


@dataclass
class Bound:
    """A variable: kind (node, rel or value) and its columns by key (id, labels or rel_type, ..., property)."""

    kind: str
    cols: dict[str, str]
    kinds: dict[str, Val]
    whole: Val | None = None  # of a value: its kind
    sets: set[tuple[str, ...]] | None = None  # of a node: the label sets it can have, if known

    def val(self) -> Val:
        if self.kind == "value":
            return with_col(F.col(self.cols["value"]), self.whole)
        ident = F.col(self.cols["id"])

        def get(name: str) -> Column:
            return F.col(self.cols["labels" if name == "\0labels" else name])

        order = ["id", *(["labels"] if self.kind == "node" else ["rel_type", "source", "target"])]
        keys = [k for k in [*order, *(k for k in self.cols if k not in order)] if k in self.cols]
        col = F.when(ident.isNotNull(), F.struct(*(F.col(self.cols[k]).alias(k) for k in keys)))
        return Val(col, self.kind, props=self.kinds, get=get, ident=ident)

    def key(self) -> list[str]:
        return [self.cols["value"]] if self.kind == "value" else [self.cols["id"]]


@dataclass
class State:
    """Bindings so far; ``df`` None stands for one row without variables.

    ``factors``: as long as ``df`` is nothing but the cross join ``product`` of independent parts, those parts.
    ``packed``: as long as ``df`` is its first frame, the second with a row as often as the third, a column, says is the same."""

    df: DataFrame | None = None
    scope: dict[str, Bound] = field(default_factory=dict)
    factors: list[State] = field(default_factory=list)
    product: DataFrame | None = None
    packed: tuple[DataFrame, DataFrame, str] | None = None

    def parts(self) -> list[State]:
        return self.factors if self.factors and self.product is self.df else []

    def times(self, other: State) -> State:
        """The cross join with an independent part; the parts are kept, so a search between them needs no product."""
        if self.df is None:
            return State(other.df, {**self.scope, **other.scope})
        factors = [*(self.parts() or [State(self.df, self.scope)]), other]
        df = self.df.crossJoin(other.df)
        return State(df, {**self.scope, **other.scope}, factors, df)

    def vals(self) -> dict[str, Val]:
        return {n: b.val() for n, b in self.scope.items()}


@dataclass
class Stats:
    nodes_created: int = 0
    nodes_deleted: int = 0
    relationships_created: int = 0
    relationships_deleted: int = 0
    properties_set: int = 0
    labels_added: int = 0


def conjuncts(e: Any) -> list[Any]:
    if e is None:
        return []
    if isinstance(e, A.Op) and e.op == "and":
        return [x for a in e.args for x in conjuncts(a)]
    return [e]


def free_vars(e: Any, inner: frozenset[str] = frozenset()) -> set[str]:
    if isinstance(e, A.Var):
        return set() if e.name in inner else {e.name}
    if isinstance(e, A.Quantified | A.Comprehension):
        below = inner | {e.var}
        more = [e.condition] + ([e.mapped] if isinstance(e, A.Comprehension) else [])
        return free_vars(e.source, inner).union(*(free_vars(x, below) for x in more if x is not None))
    if isinstance(e, A.Exists):
        return {v for p in e.paths for v in pattern_vars(p)}
    if isinstance(e, tuple | list):
        return set().union(*(free_vars(x, inner) for x in e)) if e else set()
    if hasattr(e, "__dataclass_fields__"):
        return set().union(*(free_vars(getattr(e, n), inner) for n in e.__dataclass_fields__))
    return set()


def fixed_props(props: tuple) -> tuple:
    return tuple((n, e) for n, e in props if not free_vars(e))


def other_props(props: tuple) -> tuple:
    return tuple((n, e) for n, e in props if free_vars(e))


def pattern_vars(path: A.PathPat) -> list[str]:
    return [p.var for p in path.parts if p.var] + ([path.var] if path.var else [])


def _used_vars(statement: Any) -> set[str]:
    """Variables of which more than the id (of a path: the length) is needed somewhere."""
    out: set[str] = set()

    def visit(e: Any) -> None:
        if isinstance(e, A.Call) and e.name in ("count", "id", "length") and len(e.args) == 1 and isinstance(e.args[0], A.Var):
            return
        if isinstance(e, A.Var):
            out.add(e.name)
        elif isinstance(e, tuple | list):
            for x in e:
                visit(x)
        elif hasattr(e, "__dataclass_fields__"):
            for n in e.__dataclass_fields__:
                visit(getattr(e, n))

    visit(statement)
    return out


def _whole_nodes(statement: Any) -> set[str]:
    """Path variables of whose nodes more than the ids may be needed: used whole, or in ``nodes()`` that isn't only counted."""
    out: set[str] = set()

    def visit(e: Any) -> None:
        if isinstance(e, A.Call) and len(e.args) == 1:
            arg = e.args[0]
            if e.name in ("length", "relationships", "count", "rels") and isinstance(arg, A.Var):
                return
            if e.name == "size" and isinstance(arg, A.Call) and arg.name == "nodes" and len(arg.args) == 1 and isinstance(arg.args[0], A.Var):
                return
        if isinstance(e, A.Var):
            out.add(e.name)
        elif isinstance(e, tuple | list):
            for x in e:
                visit(x)
        elif hasattr(e, "__dataclass_fields__"):
            for n in e.__dataclass_fields__:
                visit(getattr(e, n))

    visit(statement)
    return out


def _rows(df: DataFrame) -> int:
    """Rows of a base table, counted once (from file footers where it is a plain file)."""
    if "_row_count" not in df.__dict__:
        df.__dict__["_row_count"] = df.count()
    return df.__dict__["_row_count"]


class Executor:
    def __init__(self, spark: SparkSession, graph: Graph, params: dict[str, Any] | None = None, frontier_limit: int | None = None):
        self.spark, self.graph, self.params, self.frontier_limit = spark, graph, params or {}, frontier_limit
        self.stats, self._n, self.used, self.star = Stats(), count(), set(), False
        self.whole_nodes: set[str] = set()
        self.named: Counter[str] = Counter()  # how often a variable stands in the statement

    # --- statements
    def run(self, statement: A.Statement) -> DataFrame | None:
        self.used, self.whole_nodes = _used_vars(statement), _whole_nodes(statement)
        self.named = Counter(x.name if isinstance(x, A.Var) else x.var for x in A.walk(statement) if isinstance(x, A.Var | A.NodePat | A.RelPat | A.PathPat))
        self.read_only = statement.is_read_only()
        self.star = any(isinstance(c, A.Project) and c.star for q in statement.parts for c in q.clauses)
        results = [self.query(q) for q in statement.parts]
        if len(results) == 1:
            return results[0]
        if any(r is None for r in results):
            raise QueryError("the parts of a UNION must return rows")
        if any(r.columns != results[0].columns for r in results):
            raise QueryError("the parts of a UNION must have the same columns in the same order")
        out = union_tables(results)
        return out if all(statement.union_all) else out.distinct()

    def query(self, q: A.Query) -> DataFrame | None:
        state = State()
        for k, clause in enumerate(q.clauses):
            if isinstance(clause, A.Match):
                state = self.optional(state, clause) if clause.optional else self.match(state, clause)
            elif isinstance(clause, A.Unwind):
                state = self.unwind(state, clause)
            elif isinstance(clause, A.Project):
                state = self.project(state, clause)
            else:
                if isinstance(q.clauses[-1], A.Project) and any(isinstance(c, A.Project) and not c.final for c in q.clauses[k + 1 :]):
                    raise QueryError("an update can't stand before WITH")
                state = self.update(state, clause)
        if isinstance(q.clauses[-1], A.Project):
            return state.df
        return None

    def one_row(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(1).alias("one"))

    def frame(self, state: State) -> DataFrame:
        return self.one_row() if state.df is None else state.df

    def fresh(self, hint: str) -> str:
        return f"{hint.replace('`', '').replace('.', '_')}_{next(self._n)}"

    # --- scans
    def _bind(self, df: DataFrame, kind: str, hint: str) -> tuple[DataFrame, Bound]:
        """Renames all columns so that they belong to one new variable."""
        prefix = self.fresh(hint)
        cols, kinds, out = {}, {}, []
        for f in df.schema.fields:
            name = f"{prefix}:{f.name}".replace(".", "_")
            cols[f.name] = name
            kinds[f.name] = kind_of(f.dataType)
            out.append(F.col(f"`{f.name}`").alias(name))
        return df.select(*out), Bound(kind, {k: f"`{v}`" for k, v in cols.items()}, kinds)

    def scan(self, node: A.NodePat, among: set | None = None) -> tuple[DataFrame, Bound]:
        """The nodes of a pattern; properties that depend on other variables are left to ``_with_props``."""
        df, bound = self._bind(self.graph.node_frame(node.labels, among), "node", node.var or "node")
        if all(t.labels is not None for t in self.graph.nodes):
            bound.sets = {t.labels for t in self.graph.nodes if may_have(t.labels, node.labels) and (among is None or t.labels in among)}
        return self._with_props(df, bound, fixed_props(node.props), State()), bound

    def _with_props(self, df: DataFrame, bound: Bound, props: tuple, state: State) -> DataFrame:
        compiler = Compiler(state.vals(), self.params)
        for name, e in props:
            key = property_key(name)
            mine = with_col(bound.val().get(key), bound.kinds[key]) if key in bound.kinds else Val(F.lit(None), "null")
            df = df.where(raw_equal(mine, compiler.compile(e)))
        return df

    # --- matching
    def match(self, state: State, clause: A.Match) -> State:
        waiting = conjuncts(clause.where)
        state, waiting = self._ready(state, waiting)
        rels: list[tuple[Bound, set[str] | None]] = []
        # searches last, so that they know which relationships are taken
        for path in sorted(clause.paths, key=lambda p: any(r.hops is not None for r in p.parts[1::2])):
            state, waiting = self._path(state, path, rels, waiting)
        for e in waiting:
            state = self.filter(state, e)
        return state

    def _ready(self, state: State, waiting: list) -> tuple[State, list]:
        """Applies the conditions whose variables are all bound."""
        if state.df is None:
            return state, waiting
        rest = []
        for e in waiting:
            if free_vars(e) <= state.scope.keys() and not any(isinstance(x, A.Exists) for x in A.walk(e)):
                state = self.filter(state, e)
            else:
                rest.append(e)
        return state, rest

    def filter(self, state: State, e: Any) -> State:
        for i, part in enumerate(state.parts()):  # a condition on one of several independent parts
            if free_vars(e) and free_vars(e) <= part.scope.keys():
                parts = [*state.factors[:i], self.filter(part, e), *state.factors[i + 1 :]]
                return reduce(State.times, parts)
        negated = isinstance(e, A.Op) and e.op == "not" and isinstance(e.args[0], A.Exists)
        if negated or isinstance(e, A.Exists):
            keys, on = self._exists_keys(state, e.args[0] if negated else e)
            return replace(state, df=state.df.join(keys, on, "left_anti" if negated else "left_semi"))
        df, exists, extra = self._flags(state, e)
        df = df.where(Compiler(state.vals(), self.params, exists).filter(e))
        return replace(state, df=df.drop(*extra))

    def _exists_keys(self, state: State, e: A.Exists) -> tuple[DataFrame, Column]:
        """Distinct ids of the bound variables for which the pattern holds, and the join condition."""
        shared = [v for v in dict.fromkeys(v for p in e.paths for v in pattern_vars(p)) if v in state.scope]
        outer = free_vars(e.where) & state.scope.keys() - set(shared) if e.where is not None else set()
        names = shared + sorted(outer)
        used, self.used = self.used, self.used | {v for p in e.paths for v in pattern_vars(p)}
        columns = [c for v in names for c in state.scope[v].cols.values()]
        inner = State(state.df.select(*columns).distinct() if columns else None, {v: state.scope[v] for v in names})
        found = self.match(inner, A.Match(e.paths, e.where))
        self.used = used
        ids = [c for v in names for c in state.scope[v].key()]
        renamed = {c: self.fresh("k") for c in ids}
        keys = self.frame(found).select(*(F.col(c).alias(n) for c, n in renamed.items()), *([] if ids else [F.lit(1).alias("k_any")])).distinct()
        return keys, reduce(Column.__and__, (F.col(c) == F.col(n) for c, n in renamed.items()), F.lit(True))

    def _flags(self, state: State, *es: Any) -> tuple[DataFrame, dict, list[str]]:
        """A boolean column for each pattern predicate inside the expressions."""
        df, exists, extra = self.frame(state), {}, []
        for x in A.walk(es):
            if isinstance(x, A.Exists) and x not in exists:
                keys, on = self._exists_keys(replace(state, df=df), x)
                flag = self.fresh("flag")
                df = df.join(keys.withColumn(flag, F.lit(True)), on, "left")
                exists[x] = F.coalesce(F.col(flag), F.lit(False))
                extra += [flag, *[c for c in keys.columns]]
        return df, exists, extra

    def _path(self, state: State, path: A.PathPat, rels: list, waiting: list) -> tuple[State, list]:
        parts = path.parts
        at = next((i for i in range(0, len(parts), 2) if parts[i].var in state.scope), None)
        if at is None:
            at = next((i for i in range(0, len(parts), 2) if parts[i].props), 0)
            among = None
            if len(parts) > 1:
                neighbour = parts[at + 1] if at + 1 < len(parts) else parts[at - 1]
                among = self._ends(neighbour, at + 1 >= len(parts))
            df, bound = self.scan(parts[at], among)
            state = state.times(State(df, {parts[at].var: bound} if parts[at].var else {}))
            if some := other_props(parts[at].props):
                state = replace(state, df=self._with_props(state.df, bound, some, state))
        else:
            bound = self._node_of(state, parts[at].var)
            state = self._check_node(state, bound, parts[at])
        if parts[at].var:
            state.scope[parts[at].var] = bound
        state, waiting = self._ready(state, waiting)
        nodes: dict[int, Bound] = {at: bound}
        steps: dict[int, Any] = {}
        live = path.var is not None and (path.var in self.used or self.star)
        for i in range(0, len(parts), 2):  # later nodes of the path that are bound already, as in a cycle
            if i != at and parts[i].var and parts[i].var in state.scope:
                nodes[i] = self._node_of(state, parts[i].var)
                state = self._check_node(state, nodes[i], parts[i])
        while len(steps) < len(parts) // 2:
            k = self._next_hop(parts, nodes, steps)
            i, j = (k - 1, k + 1) if k - 1 in nodes else (k + 1, k - 1)
            state, nodes[j], steps[k] = self._hop(state, nodes[i], parts[k], parts[j], nodes.get(j), j < i, path, live, rels)
            state, waiting = self._ready(state, waiting)
        if path.var:
            bind = self._bind_path if live else self._bind_length
            state = bind(state, path.var, [nodes[i] for i in range(0, len(parts), 2)], [steps[i] for i in range(1, len(parts), 2)])
        return state, waiting

    def _next_hop(self, parts: tuple, nodes: dict[int, Bound], steps: dict[int, Any]) -> int:
        """Of the relationships next to a bound node, one between bound nodes, else the one with the least fan-out."""
        some = [k for k in range(1, len(parts), 2) if k not in steps and (k - 1 in nodes or k + 1 in nodes)]
        closing = [k for k in some if k - 1 in nodes and k + 1 in nodes]
        if closing or len(some) == 1:
            return (closing or some)[0]

        def fan_out(k: int) -> float:
            if parts[k].hops is not None:
                return float("inf")
            near = nodes[k - 1] if k - 1 in nodes else nodes[k + 1]
            tables = [t for t in self.graph.nodes if near.sets is None or t.labels in near.sets]
            return sum(_rows(t.df) for t in self.graph.rel_tables(parts[k].types)) / max(1, sum(_rows(t.df) for t in tables))

        return min(some, key=fan_out)

    def _node_of(self, state: State, name: str) -> Bound:
        bound = state.scope[name]
        if bound.kind != "node":
            raise QueryError(f"{name} is not a node")
        return bound

    def _check_node(self, state: State, bound: Bound, node: A.NodePat) -> State:
        if not node.labels and not node.props:
            return state
        df = state.df
        if node.labels:
            for group in node.labels:
                df = df.where(F.arrays_overlap(bound.cols["labels"], F.array(*map(F.lit, group))))
        return replace(state, df=self._with_props(df, bound, node.props, state))

    def _ends(self, rel: A.RelPat, last: bool) -> set | None:
        """Label sets a node at this end of a relationship can have, if all tables tell."""
        out: set = set()
        for t in self.graph.rel_tables(rel.types):
            sides = [t.source_labels, t.target_labels]
            if rel.direction != "both":
                sides = [sides[(rel.direction == "out") == last]]
            if any(s is None for s in sides):
                return None
            out.update(sides)
        return out

    def _oriented(self, rel: A.RelPat, direction: str, near: Bound, far: A.NodePat) -> tuple[DataFrame, list[RelTable], set | None]:
        """src, dst and the relationships' columns, from the tables that can match; label sets of the far end."""
        every = self.graph.rel_tables(rel.types)
        many = rel.hops is not None  # on the way any table may serve

        def fits(here: tuple | None, there: tuple | None) -> bool:
            return many or (near.sets is None or here is None or here in near.sets) and may_have(there, far.labels)

        out = [t for t in every if direction != "in" and fits(t.source_labels, t.target_labels)]
        back = [t for t in every if direction != "out" and fits(t.target_labels, t.source_labels)]
        halves = []
        if out or not back:
            halves.append(self.graph.rel_frame(out).withColumns({"src": F.col("source"), "dst": F.col("target")}))
        if back:
            df = self.graph.rel_frame(back).withColumns({"src": F.col("target"), "dst": F.col("source")})
            halves.append(df.where("source <> target") if direction == "both" else df)
        sides = [t.target_labels for t in out] + [t.source_labels for t in back]
        ends = None if any(s is None for s in sides) else set(sides)
        tables = out + [t for t in back if not any(t is o for o in out)]
        return union_tables(halves) if len(halves) > 1 else halves[0], tables, ends

    def _hop(self, state: State, near: Bound, rel: A.RelPat, far: A.NodePat, known: Bound | None, backwards: bool, path: A.PathPat, live: bool, rels: list) -> tuple[State, Bound, Any]:
        direction = {"out": "in", "in": "out"}.get(rel.direction, "both") if backwards else rel.direction
        edges, tables, ends = self._oriented(rel, direction, near, far)
        edges, bound = self._bind(edges, "rel", rel.var or "rel")
        edges = self._with_props(edges, bound, fixed_props(rel.props), State())
        if rel.hops is not None or path.shortest:
            if other_props(rel.props):
                raise QueryError("properties of a variable-length relationship must be constants")
            return self._traverse(state, near, rel, far, known, edges, bound, backwards, path, live, ends, tables, rels)
        df = state.df.join(edges, F.col(near.cols["id"]) == F.col(bound.cols["src"]))
        df = self._with_props(df, bound, other_props(rel.props), state)
        if rel.var and rel.var in state.scope:
            df = df.where(F.col(bound.cols["id"]) == F.col(state.scope[rel.var].cols["id"]))
        mine = {t.type for t in tables} if all(t.type for t in tables) else None
        for other, types in rels:
            if isinstance(other, str):  # the path of a search
                if types is None or mine is None or types & mine:
                    df = df.where(~F.exists(other, lambda r: (r["id"] == F.col(bound.cols["id"])) & (r["rel_type"] == F.col(bound.cols["rel_type"]))))
            elif other.cols["id"] != bound.cols["id"] and (types is None or mine is None or types & mine) and not (rel.var and rel.var in state.scope):
                same = (F.col(other.cols["id"]) == F.col(bound.cols["id"])) & (F.col(other.cols["rel_type"]) == F.col(bound.cols["rel_type"]))
                df = df.where(~F.coalesce(same, F.lit(False)))
        rels.append((bound, mine))
        state = State(df, dict(state.scope))
        if rel.var:
            state.scope[rel.var] = Bound("rel", {k: v for k, v in bound.cols.items() if k not in ("src", "dst")}, {k: v for k, v in bound.kinds.items() if k not in ("src", "dst")})
        state, end = self._arrive(state, F.col(bound.cols["dst"]), far, known, ends, tables)
        return state, end, bound

    def _arrive(self, state: State, ident: Column, far: A.NodePat, known: Bound | None, ends: set | None, tables: list[RelTable]) -> tuple[State, Bound]:
        if known is not None:
            return replace(state, df=state.df.where(ident == F.col(known.cols["id"]))), known
        if far.var and far.var in state.scope:  # the node the path started from, as in (a)-[]->(a)
            bound = self._node_of(state, far.var)
            state = replace(state, df=state.df.where(ident == F.col(bound.cols["id"])))
            return self._check_node(state, bound, far), bound
        idle = not far.props and not (far.var and (far.var in self.used or self.star))
        if idle and ends is not None and self.graph.is_closed(tables) and all(may_have(e, far.labels) for e in ends):
            name = self.fresh(far.var or "node")
            labels = f"{name}_labels"
            df = state.df.withColumns({name: ident, labels: F.array().cast("array<string>")})
            bound = Bound("node", {"id": name, "labels": labels}, {"id": Val(None, "int")}, sets=ends)
        else:
            nodes, bound = self.scan(far, ends)
            df = state.df.join(nodes, ident == F.col(bound.cols["id"]))
            df = self._with_props(df, bound, other_props(far.props), state)
        state = State(df, dict(state.scope))
        if far.var:
            state.scope[far.var] = bound
        return state, bound

    def _traverse(
        self, state: State, near: Bound, rel: A.RelPat, far: A.NodePat, known: Bound | None, edges: DataFrame, bound: Bound, backwards: bool, path: A.PathPat, live: bool, ends: set | None, tables: list, rels: list
    ) -> tuple[State, Bound, Any]:
        listed = bool(rel.var and (rel.var in self.used or self.star))
        mine = {t.type for t in tables} if all(t.type for t in tables) else None
        # relationships of the same MATCH that the search may not take, and whether a later one must not repeat its own
        taken = [] if path.shortest else [other for other, types in rels if types is None or mine is None or types & mine]
        paths = live or listed
        struct = F.struct(*(F.col(bound.cols[k]).alias(k) for k in ["id", "rel_type", "source", "target", *(k for k in bound.cols if k not in ("id", "rel_type", "source", "target", "src", "dst"))]))
        key = F.struct(F.col(bound.cols["id"]).alias("id"), F.col(bound.cols["rel_type"]).alias("rel_type"))
        every = path.shortest == "all"
        several = not path.shortest and sum(r.hops is not None for r in path.parts[1::2]) > 1
        carried = [struct.alias("rel")] if paths or every else [key.alias("rel")] if several or taken else []
        flat = edges.select(F.col(bound.cols["src"]).alias("src"), F.col(bound.cols["dst"]).alias("dst"), *carried)
        df = state.df
        seed, same = F.col(near.cols["id"]), None
        if taken:
            pair = lambda i, t: F.struct(i.alias("id"), t.alias("rel_type"))
            lists = [F.transform(o, lambda r: pair(r["id"], r["rel_type"])) if isinstance(o, str) else F.array(pair(F.col(o.cols["id"]), F.col(o.cols["rel_type"]))) for o in taken]
            seed = F.struct(seed.alias("node"), F.array_sort(F.array_distinct(F.concat(*lists))).alias("taken"))
        pairs = targets = None
        sides = [p for p in state.parts() if near.cols["id"].strip("`") in p.df.columns], [p for p in state.parts() if known is not None and known.cols["id"].strip("`") in p.df.columns]
        if known is not None and all(sides) and sides[0][0] is not sides[1][0] and not taken:  # two independent ends: no product of them
            df, same = sides[0][0].df, sides[1][0].df
            targets = same.select(F.col(known.cols["id"]).alias("node"))
        elif known is not None:
            pairs = df.select(seed.alias("seed"), F.col(known.cols["id"]).alias("node"))
        elif far.labels or far.props:
            nodes, end = self.scan(far, ends)
            targets = nodes.select(F.col(end.cols["id"]).alias("node"))
        levels = None if paths or several or taken or known is not None or rel.props else self._levels(rel, backwards, near, far)
        if levels is not None:
            return self._staged(state, near, rel, far, path, bound, tables, rels, every, targets, *levels)
        found = bfs(flat, df.select(seed.alias("seed")), max(1, rel.hops[0]), rel.hops[1], paths or every or several, every, pairs, targets, self.frontier_limit, bool(taken))
        mark = self.fresh("bfs")
        found = found.select(*(F.col(c).alias(f"{mark}_{c}") for c in found.columns))
        df = df.join(found, seed == F.col(f"{mark}_seed"))
        if same is not None:
            df = df.join(same, F.col(f"{mark}_node") == F.col(known.cols["id"]))
            for part in state.parts():
                if part is not sides[0][0] and part is not sides[1][0]:
                    df = df.crossJoin(part.df)
            state, end = State(df, dict(state.scope)), known
        else:
            state, end = self._arrive(State(df, dict(state.scope)), F.col(f"{mark}_node"), far, known, ends, tables)
        if several and not path.shortest:
            rels.append((f"{mark}_rels", mine))
        elem = Val(None, "rel", props={k: v for k, v in bound.kinds.items() if k not in ("src", "dst")})
        if paths:
            rel_list = F.col(f"{mark}_rels")
            node_list = F.col(f"{mark}_nodes")
            if backwards:
                rel_list, node_list = F.reverse(rel_list), F.reverse(node_list)
            state = replace(state, df=state.df.withColumns({f"{mark}_rels": rel_list, f"{mark}_nodes": node_list}))
            if listed:
                state.scope[rel.var] = Bound("value", {"value": f"{mark}_rels"}, {}, Val(None, "list", elem=elem))
        return state, end, (mark, elem)

    def _levels(self, rel: A.RelPat, backwards: bool, near: Bound, far: A.NodePat) -> tuple[list[list[Half]], set] | None:
        """The relationships each level of a search can use, and the label sets of its end, if the tables tell."""
        tables = self.graph.rel_tables(rel.types)
        if near.sets is None or rel.hops[1] > STAGED or not tables or not self.graph.is_closed(tables):
            return None
        direction = {"out": "in", "in": "out"}.get(rel.direction, "both") if backwards else rel.direction
        halves = []
        for t in tables:
            if direction != "in":
                halves.append(Half(t.df.select(F.col("source").alias("src"), F.col("target").alias("dst")), t.source_labels, t.target_labels))
            if direction != "out":
                df = t.df.where("source <> target") if direction == "both" else t.df
                halves.append(Half(df.select(F.col("target").alias("src"), F.col("source").alias("dst")), t.target_labels, t.source_labels))
        goal = {h.far for h in halves if may_have(h.far, far.labels)}
        return stages(halves, near.sets, goal, rel.hops[1]), goal

    def _once(self, name: str | None) -> bool:
        """No other place of the statement needs the variable."""
        return self.read_only and not self.star and (not name or name not in self.used and self.named[name] == 1)

    def _staged(self, state: State, near: Bound, rel: A.RelPat, far: A.NodePat, path: A.PathPat, bound: Bound, tables: list, rels: list, every: bool, targets: DataFrame | None, levels: list, goal: set) -> tuple[State, Bound, Any]:
        """A search of which neither nodes nor relationships are asked: paths are counted, and an end that nothing else needs
        is summed away."""
        short = len(path.parts) == 3 and not rels
        here = next(k for k in path.parts[::2] if k is not far)
        drop_seed = short and every and self._once(here.var) and not set(state.scope) - {here.var} and near.cols["id"].strip("`") in state.df.columns
        drop_node = short and self._once(far.var) and not far.props and not (far.var and far.var in state.scope)
        seed = F.col(near.cols["id"])
        mark = self.fresh("bfs")
        found = staged(levels, state.df.select(seed.alias("seed")), goal, max(1, rel.hops[0]), every, targets, bool(far.props), self.frontier_limit, drop_seed, drop_node)
        found = found.select(*(F.col(c).alias(f"{mark}_{c}") for c in found.columns))
        if drop_seed:
            state = State(found, {})
        else:
            state = State(state.df.join(found, seed == F.col(f"{mark}_seed")), dict(state.scope))
        if drop_node:
            end = Bound("node", {}, {}, sets=goal)
        else:
            state, end = self._arrive(state, F.col(f"{mark}_node"), far, None, goal, tables)
        if every or drop_node:
            df = repeated(state.df, f"{mark}_times")
            state = replace(state, df=df, packed=(df, state.df, f"{mark}_times"))
        return state, end, (mark, Val(None, "rel", props={k: v for k, v in bound.kinds.items() if k not in ("src", "dst")}))

    def _bind_length(self, state: State, name: str, nodes: list[Bound], steps: list[Any]) -> State:
        """A path of which only the length is asked: no nodes or relationships are carried along."""
        hops = reduce(Column.__add__, (F.lit(1) if isinstance(s, Bound) else F.col(f"{s[0]}_depth") for s in steps), F.lit(0))
        col = self.fresh(name)
        bound = Bound("value", {"value": col}, {}, Val(None, "path", props={"hops": Val(None, "int")}))
        longer = lambda df: df.withColumn(col, hops.cast("bigint"))
        df, packed = longer(state.df), state.packed
        packed = (df, longer(packed[1]), packed[2]) if packed and packed[0] is state.df else None
        return State(df, {**state.scope, name: bound}, packed=packed)

    def _bind_path(self, state: State, name: str, nodes: list[Bound], steps: list[Any]) -> State:
        kinds: dict[str, Val] = {}
        for s in steps:
            for k, v in (s.kinds if isinstance(s, Bound) else s[1].props).items():
                if k not in ("src", "dst"):
                    kinds.setdefault(k, v)
        spark_type = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean", "ts": "timestamp"}
        alone = len(steps) == 1

        def shape(get, have) -> Column:
            return F.struct(*((get(k) if k in have else F.lit(None)).cast(spark_type.get(v.kind, "string")).alias(k) if not alone else get(k).alias(k) for k, v in kinds.items()))

        def over(elem: Val):
            return lambda r: shape(lambda k: r[k], elem.props)

        one = lambda b: F.struct(F.col(b.cols["id"]).alias("id"))
        node_parts, rel_parts = [F.array(one(nodes[0]))], []
        for s, end in zip(steps, nodes[1:], strict=True):
            if isinstance(s, Bound):
                rel_parts.append(F.array(shape(lambda k, s=s: F.col(s.cols[k]), s.cols)))
                node_parts.append(F.array(one(end)))
            else:
                mark, elem = s
                rel_parts.append(F.transform(f"{mark}_rels", over(elem)))
                node_parts.append(F.transform(F.slice(F.col(f"{mark}_nodes"), 2, F.size(f"{mark}_nodes") - 1), lambda n: F.struct(n.alias("id"))))
        whole = F.struct(F.concat(*node_parts).alias("nodes"), (F.concat(*rel_parts) if rel_parts else F.array()).alias("relationships"))
        col = self.fresh(name)
        id_kind = nodes[0].kinds.get("id", Val(None, "int"))
        parts = {"nodes": Val(None, "list", elem=Val(None, "node", props={"id": id_kind})), "relationships": Val(None, "list", elem=Val(None, "rel", props=kinds))}
        df = state.df.withColumn(col, whole)
        if name in self.whole_nodes or self.star:
            df, col, kinds = self._with_nodes(df, col)
            parts["nodes"] = Val(None, "list", elem=Val(None, "node", props=kinds))
        return State(df, {**state.scope, name: Bound("value", {"value": col}, {}, Val(None, "path", props=parts))})

    def _with_nodes(self, df: DataFrame, path: str) -> tuple[DataFrame, str, dict[str, Val]]:
        """Paths whose nodes have labels and properties: the different lists of ids are joined with the nodes once."""
        nodes = self.graph.node_frame()
        names = ["id", "labels", *(c for c in nodes.columns if c not in ("id", "labels"))]
        key, out = self.fresh("ids"), self.fresh("path")
        ids = F.transform(F.col(path)["nodes"], lambda n: n["id"])
        steps = df.select(ids.alias(key)).distinct().select(key, F.posexplode(key).alias("step", "step_id"))
        own = nodes.select(F.col("id").alias("node_id"), F.struct(*(F.col(f"`{c}`").alias(c) for c in names)).alias("node"))
        listed = steps.join(own, F.col("step_id") == F.col("node_id")).groupBy(key).agg(F.collect_list(F.struct("step", "node")).alias("listed"))
        whole = listed.select(F.col(key).alias(f"{key}_k"), F.transform(F.array_sort("listed", lambda a, b: a["step"] - b["step"]), lambda x: x["node"]).alias("nodes_of_path"))
        joined = df.withColumn(key, ids).join(whole, F.col(key) == F.col(f"{key}_k"), "left")
        col = F.struct(F.col("nodes_of_path").alias("nodes"), F.col(path)["relationships"].alias("relationships")).alias(out)
        kept = [c for c in df.columns if c != path]
        return joined.select(*(F.col(f"`{c}`") for c in kept), col), out, {f.name: kind_of(f.dataType) for f in nodes.schema.fields}

    def optional(self, state: State, clause: A.Match) -> State:
        """Rows without a match stay, with nulls: the inner match of the row keys, joined back from the left."""
        if state.df is None:
            state = State(self.one_row(), {})
        new = [v for p in clause.paths for v in pattern_vars(p) if v not in state.scope]
        names = [v for v in dict.fromkeys(v for p in clause.paths for v in pattern_vars(p)) if v in state.scope]
        names += sorted((free_vars(clause.where) & state.scope.keys()) - set(names)) if clause.where is not None else []
        columns = list(dict.fromkeys(c for v in names for c in state.scope[v].cols.values()))
        keys = [c for v in names for c in state.scope[v].key()]
        inner = State(state.df.select(*columns).dropDuplicates([k.strip("`") for k in keys]) if names else None, {v: state.scope[v] for v in names})
        found = self.match(inner, replace(clause, optional=False))
        renamed = {c: self.fresh("o") for c in dict.fromkeys(keys)}
        made = [c for v in new if v in found.scope for c in found.scope[v].cols.values()]
        right = found.df.select(*(F.col(c).alias(n) for c, n in renamed.items()), *dict.fromkeys(made))
        on = reduce(Column.__and__, (F.col(c) == F.col(n) for c, n in renamed.items()), F.lit(True))
        df = state.df.join(right, on, "left").drop(*renamed.values())
        return State(df, {**state.scope, **{v: found.scope[v] for v in new if v in found.scope}})

    def unwind(self, state: State, clause: A.Unwind) -> State:
        source = Compiler(state.vals(), self.params).compile(clause.source)
        if source.kind == "null":
            source = Val(F.array(), "list", elem=Val(None, "null"))
        if source.kind != "list":
            source = Val(F.array(source.col), "list", elem=source)
        col = self.fresh(clause.var)
        df = self.frame(state).withColumn(col, F.explode(source.col))
        return State(df, {**state.scope, clause.var: Bound("value", {"value": col}, {}, source.elem)})

    # --- projection
    def project(self, state: State, clause: A.Project) -> State:
        items = list(clause.items)
        if clause.star:
            items = [(A.Var(v), v) for v in state.scope] + items
        names = [n for _, n in items]
        if len(set(names)) != len(names):
            raise QueryError("two columns have the same name")
        df, exists, _ = self._flags(state, tuple(e for e, _ in items))
        state = State(df, state.scope, packed=state.packed)
        grouped = any(has_aggregate(e) for e, _ in items)
        out = self._aggregate(state, items) if grouped else self._select(state, items, exists, keep=not clause.distinct)
        if clause.distinct:
            out = replace(out, df=out.df.dropDuplicates([c.strip("`") for n in names for c in out.scope[n].key()]))
        visible = dict(out.scope)
        if not grouped and not clause.distinct:
            visible = {**state.scope, **out.scope}
        keys = [self._order_key(e, up, items, out.scope, visible) for e, up in clause.order]
        df = out.df
        if keys:
            df = df.orderBy(*keys)
        if clause.skip is not None:
            df = df.offset(self._number(clause.skip))
        if clause.limit is not None:
            df = df.limit(self._number(clause.limit))
        df = df.select(*dict.fromkeys(c for n in names for c in out.scope[n].cols.values()))
        out = State(df, {n: out.scope[n] for n in names})
        if clause.where is not None:
            for e in conjuncts(clause.where):
                out = self.filter(out, e)
        if clause.final:
            vals = out.vals()
            out = State(out.df.select(*(vals[n].col.alias(n) for n in names)), {})
        return out

    def _number(self, e: Any) -> int:
        value = self.params.get(e.name) if isinstance(e, A.Param) else e.value if isinstance(e, A.Lit) else None
        if type(value) is not int or value < 0:
            raise QueryError("SKIP and LIMIT need a whole number")
        return value

    def _order_key(self, e: Any, up: bool, items: list, made: dict[str, Bound], visible: dict[str, Bound]) -> Column:
        for item, name in items:
            if e == item:
                e = A.Var(name)
        val = Compiler({n: b.val() for n, b in {**visible, **made}.items()}, self.params).compile(e)
        col = val.ident if val.kind in ("node", "rel") and val.ident is not None else val.col
        return col.asc_nulls_last() if up else col.desc_nulls_first()

    def _value(self, name: str, val: Val, new: dict[str, Column]) -> Bound:
        col = self.fresh(name if name.isidentifier() else "c")
        new[col] = val.col
        return Bound("value", {"value": col}, {}, replace(val, col=None, get=None, ident=None))

    def _select(self, state: State, items: list, exists: dict, keep: bool) -> State:
        compiler, new, scope = Compiler(state.vals(), self.params, exists), {}, {}
        for e, name in items:
            if isinstance(e, A.Var) and e.name in state.scope:
                scope[name] = state.scope[e.name]
            else:
                scope[name] = self._value(name, compiler.compile(e), new)
        df = self.frame(state)
        return State(df.withColumns(new) if new else df, scope)

    def _aggregate(self, state: State, items: list) -> State:
        compiler = Compiler(state.vals(), self.params)
        keys, firsts, scope, new = [], [], {}, {}
        for e, name in items:
            if has_aggregate(e):
                continue
            if isinstance(e, A.Var) and e.name in state.scope:
                scope[name] = state.scope[e.name]
            else:
                scope[name] = self._value(name, compiler.compile(e), new)
        for b in {id(b): b for b in scope.values()}.values():
            keys += b.key()
            firsts += [F.first(c).alias(c.strip("`")) for c in b.cols.values() if c not in b.key()]
        aggs, made, after = [], {}, {}
        for e, name in items:
            if has_aggregate(e):
                after[name] = self._lift(e, made)
        df, times = self.frame(state), None
        if state.packed and state.packed[0] is df and all(call.star and call.name == "count" for call in made.values()):
            _, df, times = state.packed  # rows are only counted, so they need not be made
        df = df.withColumns(new) if new else df
        for var, call in made.items():
            val = self._aggregation(call, compiler) if times is None else Val(F.coalesce(F.sum(times), F.lit(0).cast("bigint")), "int")
            col = self.fresh("agg")
            aggs.append(val.col.alias(col))
            made[var] = Bound("value", {"value": col}, {}, replace(val, col=None))
        df = df.groupBy(*dict.fromkeys(keys)).agg(*aggs, *firsts) if keys else df.agg(*aggs)
        inner = {**{n: b.val() for n, b in scope.items()}, **{v: b.val() for v, b in made.items()}}
        more: dict[str, Column] = {}
        for e, name in items:
            if name in after:
                lifted = after[name]
                scope[name] = made[lifted.name] if isinstance(lifted, A.Var) else self._value(name, self._grouped(lifted, items, inner), more)
        return State(df.withColumns(more) if more else df, {n: scope[n] for _, n in items})

    def _grouped(self, e: Any, items: list, vals: dict[str, Val]) -> Val:
        """An expression over aggregates; grouping expressions inside it stand for their columns."""

        def swap(x: Any) -> Any:
            for item, name in items:
                if x == item and not has_aggregate(item):
                    return A.Var(name)
            if isinstance(x, tuple):
                return tuple(swap(y) for y in x)
            if hasattr(x, "__dataclass_fields__"):
                return type(x)(**{n: swap(getattr(x, n)) for n in x.__dataclass_fields__})
            return x

        return Compiler(vals, self.params).compile(swap(e))

    def _lift(self, e: Any, made: dict) -> Any:
        if is_aggregate(e):
            for var, call in made.items():
                if call == e:
                    return A.Var(var)
            var = f"{_AGG}{len(made)}"
            made[var] = e
            return A.Var(var)
        if isinstance(e, tuple):
            return tuple(self._lift(x, made) for x in e)
        if hasattr(e, "__dataclass_fields__"):
            return type(e)(**{n: self._lift(getattr(e, n), made) for n in e.__dataclass_fields__})
        return e

    def _aggregation(self, call: A.Call, compiler: Compiler) -> Val:
        if call.star:
            if call.name != "count":
                raise QueryError(f"{call.name}(*) does not exist")
            return Val(F.count(F.lit(1)), "int")
        if len(call.args) != 1:
            raise QueryError(f"{call.name} takes one argument")
        v = compiler.compile(call.args[0])
        col = v.ident if v.kind in ("node", "rel") and v.ident is not None and call.name == "count" else v.col
        number = v.kind in ("int", "float")
        if call.name == "count":
            return Val(F.count_distinct(col) if call.distinct else F.count(col), "int")
        if call.name == "collect":
            if v.kind == "null":
                return Val(F.collect_list(F.lit(None).cast("string")), "list", elem=Val(None, "str"))
            return Val(F.collect_set(col) if call.distinct else F.collect_list(col), "list", elem=replace(v, col=None))
        if call.name in ("min", "max"):
            return replace(v, col=(F.min if call.name == "min" else F.max)(col)) if v.kind in ("int", "float", "str", "bool", "ts") else Val(F.max(F.lit(None)), "null")
        if not number:
            return Val(F.max(F.lit(0)).cast("bigint"), "int") if call.name == "sum" else Val(F.max(F.lit(None)), "null")
        if call.name == "sum":
            return Val(F.coalesce(F.sum_distinct(col) if call.distinct else F.sum(col), F.lit(0)), v.kind)
        if call.name == "avg":
            distinct = F.try_divide(F.sum_distinct(col.cast("double")), F.count_distinct(col))
            return Val(distinct if call.distinct else F.avg(col), "float")
        return Val((F.stddev_samp if call.name == "stdev" else F.stddev_pop)(col), "float")

    # --- updates
    def update(self, state: State, clause: Any) -> State:
        from graphloom.plans import updates

        return updates.apply(self, state, clause)
