"""CREATE, MERGE, SET, REMOVE and DELETE: each makes new tables; a graph never changes.

New entities get ids from the rows' position in a checkpointed frame, below all ids in use: they stay the same however
often a plan is run again.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from graphloom.cypher import ast as A
from graphloom.cypher.ast import QueryError
from graphloom.model import Graph, NodeTable, RelTable, common_type
from graphloom.plans.expressions import Compiler, Val, kind_of, property_key
from graphloom.runtime import cut

_STEP = 1 << 44
_ROW = "row_no"


def apply(ex: Any, state: Any, clause: Any) -> Any:
    if isinstance(clause, A.Create):
        return create(ex, state, clause.paths)
    if isinstance(clause, A.Merge):
        return merge(ex, state, clause)
    if isinstance(clause, A.SetClause | A.Remove):
        for item in clause.items:
            state = set_item(ex, state, item, isinstance(clause, A.Remove))
        return state
    return delete(ex, state, clause)


def _numbered(ex: Any, state: Any) -> Any:
    df = ex.frame(state).drop(_ROW)
    return replace(state, df=cut(df.withColumn(_ROW, F.monotonically_increasing_id())))


def _id_type(graph: Graph) -> T.DataType:
    for t in (*graph.nodes, *graph.rels):
        return t.df.schema["id"].dataType
    return T.LongType()


def create(ex: Any, state: Any, paths: tuple[A.PathPat, ...]) -> Any:
    state = _numbered(ex, state)
    n = state.df.count()
    compiler = Compiler(state.vals(), ex.params)
    made = sum(1 for p in paths for x in p.parts)
    base, k = ex.graph.made, 0
    text_ids = isinstance(_id_type(ex.graph), T.StringType)
    nodes, rels = list(ex.graph.nodes), list(ex.graph.rels)

    def new_id():
        nonlocal k
        k += 1
        value = -((F.lit(base + 1).cast("bigint") * _STEP) + F.col(_ROW) * made + k)
        return F.concat(F.lit("new"), value.cast("string")) if text_ids else value

    def props(items) -> list[tuple[str, Val]]:
        values = [(property_key(name), compiler.compile(e)) for name, e in items]
        return [(name, v) for name, v in values if v.kind != "null"]

    df, scope = state.df, dict(state.scope)
    for path in paths:
        ends: list[str] = []
        for part in path.parts[::2]:
            if part.var and part.var in scope:
                if part.labels or part.props:
                    raise QueryError(f"{part.var} is bound already")
                ends.append(scope[part.var].cols["id"])
                continue
            if any(len(g) > 1 for g in part.labels):
                raise QueryError("CREATE takes no label alternatives")
            own = ex.fresh(part.var or "new")
            values = props(part.props)
            labels = tuple(g[0] for g in part.labels)
            df = df.withColumns({f"{own}_id": new_id(), f"{own}_labels": F.array(*map(F.lit, labels)).cast("array<string>"), **{f"{own}_p{i}": v.col for i, (_, v) in enumerate(values)}})
            bound = _bound("node", own, "labels", values, df)
            nodes.append(NodeTable(df.select(F.col(f"{own}_id").alias("id"), *(F.col(f"{own}_p{i}").alias(name) for i, (name, _) in enumerate(values))), labels))
            if part.var:
                scope[part.var] = bound
            ends.append(bound.cols["id"])
            ex.stats.nodes_created += n
            ex.stats.labels_added += n * len(labels)
            ex.stats.properties_set += n * len(values)
        for i, part in enumerate(path.parts[1::2]):
            if len(part.types) < 1 or part.hops is not None:
                raise QueryError("CREATE needs one relationship type and no length")
            source, target = (ends[i + 1], ends[i]) if part.direction == "in" else (ends[i], ends[i + 1])
            own = ex.fresh(part.var or "new")
            values = props(part.props)
            df = df.withColumns({f"{own}_id": new_id(), f"{own}_rel_type": F.lit(part.types[0]), f"{own}_source": F.col(source), f"{own}_target": F.col(target), **{f"{own}_p{j}": v.col for j, (_, v) in enumerate(values)}})
            rels.append(
                RelTable(df.select(F.col(f"{own}_id").alias("id"), F.col(f"{own}_source").alias("source"), F.col(f"{own}_target").alias("target"), *(F.col(f"{own}_p{j}").alias(name) for j, (name, _) in enumerate(values))), part.types[0])
            )
            if part.var:
                scope[part.var] = _bound("rel", own, "rel_type source target", values, df)
            ex.stats.relationships_created += n
            ex.stats.properties_set += n * len(values)
    ex.graph = Graph(tuple(nodes), tuple(rels), base + 1)
    return replace(state, df=df, scope=scope)


def _bound(kind: str, own: str, more: str, values: list[tuple[str, Val]], df: DataFrame):
    from graphloom.plans.executor import Bound

    cols = {c: f"{own}_{c}" for c in ("id", *more.split())} | {name: f"{own}_p{i}" for i, (name, _) in enumerate(values)}
    return Bound(kind, cols, {k: kind_of(df.schema[c].dataType) for k, c in cols.items()})


def merge(ex: Any, state: Any, clause: A.Merge) -> Any:
    """Rows where the pattern matches keep the matches; for the others it is created, once for equal values."""
    used = ex.used
    ex.used = ex.used | {p.var for p in clause.path.parts if p.var}
    rows = _numbered(ex, state)
    found = ex.match(rows, A.Match((clause.path,)))
    found = replace(found, df=cut(found.df))
    ex.used = used
    missing = replace(rows, df=rows.df.join(found.df.select(_ROW).distinct(), _ROW, "left_anti"))
    keys = [e for p in clause.path.parts for _, e in p.props]
    compiler = Compiler(rows.vals(), ex.params)
    key_cols = {f"merge_key{i}": compiler.compile(e).col for i, e in enumerate(keys)}
    bound = [rows.scope[p.var].cols["id"] for p in clause.path.parts if p.var in rows.scope]
    first = missing.df.withColumns(key_cols) if key_cols else missing.df
    first = first.dropDuplicates([*key_cols, *(c.strip("`") for c in bound)]) if key_cols or bound else first.limit(1)
    made = None
    if first.limit(1).count():
        made = create(ex, replace(missing, df=first.drop(*key_cols)), (clause.path,))
        for item in clause.on_create:
            made = set_item(ex, made, item, False)
    if found.df.limit(1).count():
        for item in clause.on_match:
            found = set_item(ex, found, item, False)
        if made is None:
            return found
    again = ex.match(rows, A.Match((clause.path,)))  # all rows find what is there now
    return again


def _targets(ex: Any, state: Any, target: Any) -> tuple[str, Any]:
    if not isinstance(target, A.Var) or target.name not in state.scope or state.scope[target.name].kind == "value":
        raise QueryError("only nodes and relationships can be changed")
    return target.name, state.scope[target.name]


def set_item(ex: Any, state: Any, item: A.SetItem, remove: bool) -> Any:
    if item.kind == "prop":
        name, bound = _targets(ex, state, item.target.base)
        return _set_props(ex, state, name, bound, {property_key(item.target.name): Compiler(state.vals(), ex.params).compile(item.value)}, count=not remove)
    name, bound = _targets(ex, state, item.target)
    if item.kind == "labels":
        return _set_labels(ex, state, name, bound, [g[0] for g in item.value], remove)
    value = Compiler(state.vals(), ex.params).compile(item.value)
    if value.kind not in ("map", "node", "rel"):
        raise QueryError("properties are set from a map")
    new = {property_key(k): Val(value.get(k), v.kind, v.elem, v.props) for k, v in value.props.items() if k not in ("labels", "rel_type", "source", "target") and (value.kind == "map" or k != "id")}
    if item.kind == "replace":
        gone = [k for k in bound.cols if k not in ("id", "labels", "rel_type", "source", "target") and k not in new]
        new |= {k: Val(F.lit(None), "null") for k in gone}
    return _set_props(ex, state, name, bound, new)


def _updates(state: Any, bound: Any, values: dict[str, Any]) -> DataFrame:
    return cut(state.df.select(F.col(bound.cols["id"]).alias("set_id"), *(c.alias(f"set_{i}") for i, c in enumerate(values.values()))).where("set_id is not null").dropDuplicates(["set_id"]))


def _set_props(ex: Any, state: Any, name: str, bound: Any, values: dict[str, Val], count: bool = True) -> Any:
    spark_type = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean", "null": None}
    state = replace(state, df=cut(ex.frame(state)))
    rows = _updates(state, bound, {k: v.col for k, v in values.items()})
    if count:
        ex.stats.properties_set += rows.count() * len(values)
    tables = ex.graph.nodes if bound.kind == "node" else ex.graph.rels
    out = []
    for t in tables:
        df = t.df.join(rows, t.df["id"] == rows["set_id"], "left")
        have = {f.name: f.dataType for f in t.df.schema.fields}
        cols = [F.col(f"`{c}`") for c in t.df.columns if c not in values]
        for i, (key, v) in enumerate(values.items()):
            new, hit = F.col(f"set_{i}"), F.col("set_id").isNotNull()
            if v.kind == "null" and key not in have:
                continue
            if key in have:
                kind = have[key] if v.kind == "null" else common_type(have[key], rows.schema[f"set_{i}"].dataType)
                cols.append(F.when(hit, new.cast(kind)).otherwise(F.col(f"`{key}`").cast(kind)).alias(key))
            else:
                cols.append(F.when(hit, new).alias(key))
        out.append(replace(t, df=df.select(*cols)))
    ex.graph = replace(ex.graph, **{"nodes" if bound.kind == "node" else "rels": tuple(out)})
    cols, kinds, new_cols = dict(bound.cols), dict(bound.kinds), {}
    for key, v in values.items():
        cols[key] = ex.fresh(name)
        kinds[key] = replace(v, col=None, get=None, ident=None)
        new_cols[cols[key]] = v.col.cast(spark_type[v.kind]) if spark_type.get(v.kind) else v.col
    return replace(state, df=state.df.withColumns(new_cols), scope={**state.scope, name: replace(bound, cols=cols, kinds=kinds)})


def _set_labels(ex: Any, state: Any, name: str, bound: Any, labels: list[str], remove: bool) -> Any:
    if bound.kind != "node":
        raise QueryError("only nodes have labels")
    state = replace(state, df=cut(ex.frame(state)))
    rows = _updates(state, bound, {})
    change = F.array(*map(F.lit, labels))
    f = F.array_except if remove else F.array_union
    if not remove:
        ex.stats.labels_added += rows.count() * len(labels)
    out = []
    for t in ex.graph.nodes:
        fixed = F.col("labels") if t.labels is None else F.array(*map(F.lit, t.labels)).cast("array<string>")
        hit = t.df.join(rows, t.df["id"] == rows["set_id"], "left_semi")
        if t.labels is None:
            df = t.df.join(rows, t.df["id"] == rows["set_id"], "left")
            out.append(NodeTable(df.select(F.when(F.col("set_id").isNotNull(), f(fixed, change)).otherwise(fixed).alias("labels"), *(F.col(f"`{c}`") for c in t.df.columns if c != "labels"))))
            continue
        rest = t.df.join(rows, t.df["id"] == rows["set_id"], "left_anti")
        new = tuple(x for x in t.labels if x not in labels) if remove else (*t.labels, *(x for x in labels if x not in t.labels))
        out += [NodeTable(rest, t.labels), NodeTable(hit, new)]
    ex.graph = replace(ex.graph, nodes=tuple(out), rels=tuple(replace(r, source_labels=None, target_labels=None) for r in ex.graph.rels))
    own = ex.fresh(name)
    return replace(state, df=state.df.withColumn(own, f(F.col(bound.cols["labels"]), change)), scope={**state.scope, name: replace(bound, cols={**bound.cols, "labels": own})})


def delete(ex: Any, state: Any, clause: A.Delete) -> Any:
    nodes, rels = [], []
    for target in clause.targets:
        _, bound = _targets(ex, state, target)
        (nodes if bound.kind == "node" else rels).append(F.col(bound.cols["id"]))
    state = replace(state, df=cut(ex.frame(state)))

    def ids(cols: list) -> DataFrame:
        return cut(state.df.select(F.explode(F.array(*cols)).alias("gone")).where("gone is not null").distinct())

    graph = ex.graph
    if rels:
        gone = ids(rels)
        ex.stats.relationships_deleted += gone.count()
        graph = replace(graph, rels=tuple(replace(t, df=t.df.join(gone, t.df["id"] == gone["gone"], "left_anti")) for t in graph.rels))
    if nodes:
        gone = ids(nodes)
        left = []
        for t in graph.rels:
            if not clause.detach:
                if t.df.join(gone, t.df["source"] == gone["gone"], "left_semi").limit(1).count() or t.df.join(gone, t.df["target"] == gone["gone"], "left_semi").limit(1).count():
                    raise QueryError("a node that still has relationships needs DETACH DELETE")
                left.append(t)
                continue
            kept = t.df.join(gone, t.df["source"] == gone["gone"], "left_anti").join(gone.withColumnRenamed("gone", "gone2"), F.col("target") == F.col("gone2"), "left_anti")
            ex.stats.relationships_deleted += t.df.count() - kept.count()
            left.append(replace(t, df=kept))
        ex.stats.nodes_deleted += gone.count()
        graph = Graph(tuple(replace(t, df=t.df.join(gone, t.df["id"] == gone["gone"], "left_anti")) for t in graph.nodes), tuple(left), graph.made)
    ex.graph = graph
    return state
