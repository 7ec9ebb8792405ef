"""The front door: a graph, queries against it, and their results."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from graphloom.cypher.ast import QueryError, Statement
from graphloom.cypher.parser import parse
from graphloom.model import Graph
from graphloom.plans.executor import Executor, Stats


@dataclass
class Result:
    """``df`` is None for a pure update. ``columns`` keep their order."""

    df: DataFrame | None
    stats: Stats = field(default_factory=Stats)

    @property
    def columns(self) -> list[str]:
        return [] if self.df is None else self.df.columns

    def rows(self) -> list[tuple]:
        return [] if self.df is None else [tuple(r) for r in self.df.collect()]

    def graph(self, graph: Graph) -> tuple[DataFrame, DataFrame]:
        """Nodes and relationships named in the result's node, relationship and path columns, each once; ends of
        relationships come along from ``graph`` even where the result has no column for them."""
        from functools import reduce

        from pyspark.sql import functions as F
        from pyspark.sql import types as T

        rel_fields, ids, rels = ["id", "rel_type", "source", "target"], [], []
        for f in self.df.schema.fields if self.df is not None else []:
            names = f.dataType.names if isinstance(f.dataType, T.StructType) else []
            col = F.col(f"`{f.name}`")
            if {"nodes", "relationships"} <= set(names):
                ids.append(self.df.select(F.explode(col["nodes"]["id"]).alias("id")))
                rels.append(self.df.select(F.explode(col["relationships"]).alias("r")).select(*(F.col(f"r.{c}") for c in rel_fields)))
            elif "rel_type" in names:
                rels.append(self.df.select(*(col[c].alias(c) for c in rel_fields)).where("id is not null"))
            elif "labels" in names:
                ids.append(self.df.select(col["id"].alias("id")).where("id is not null"))
        nodes = graph.node_frame()
        none = graph.rel_frame(list(graph.rels)).select(*rel_fields).where(F.lit(False))
        found = reduce(DataFrame.unionByName, rels, none).dropDuplicates(["id", "rel_type"])
        ids += [found.select(F.col(c).alias("id")) for c in ("source", "target")]
        return nodes.join(reduce(DataFrame.unionByName, ids).distinct(), "id", "left_semi"), found

    def json(self) -> DataFrame:
        """One JSON object per row, for sinks."""
        from pyspark.sql import functions as F

        return self.df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


class GraphSession:
    """Runs queries against the current version of a graph; an update replaces it.

    Results of read-only queries are remembered by their syntax tree until the next update (as plans, not as data; the
    ``cached`` latest ones)."""

    def __init__(self, spark: SparkSession, graph: Graph, read_only: bool = False, frontier_limit: int | None = None, history: int = 1000, cached: int = 500):
        self.spark, self.graph, self.read_only, self.frontier_limit = spark, graph, read_only, frontier_limit
        self._cache: OrderedDict[tuple, Result] = OrderedDict()
        self._history: list[tuple[int, str]] = []
        self._keep, self._cached, self._asked = history, cached, 0
        self._indexes: set[tuple[str, str]] = set()

    def query(self, text: str, **params: Any) -> Result:
        self._asked += 1
        self._history = [*self._history, (self._asked, text)][-self._keep :]
        statement = parse(text)
        if statement.is_read_only():
            key = (statement, repr(sorted(params.items())))
            if key not in self._cache:
                self._cache[key] = self._run(statement, params)
            self._cache.move_to_end(key)
            while len(self._cache) > self._cached:
                self._cache.popitem(last=False)
            return self._cache[key]
        if self.read_only:
            raise QueryError("this session is read-only")
        self._cache.clear()
        return self._run(statement, params)

    def _run(self, statement: Statement, params: dict[str, Any]) -> Result:
        executor = Executor(self.spark, self.graph, params, self.frontier_limit)
        df = executor.run(statement)
        self.graph = executor.graph
        return Result(df, executor.stats)

    def history(self, skip: int = 0, limit: int = 20) -> list[str]:
        """Queries, the latest first."""
        return [text for _, text in self._history[::-1][skip : skip + limit]]

    def history_ids(self) -> list[int]:
        """Numbers of the remembered queries, the latest first."""
        return [i for i, _ in self._history[::-1]]

    def forget(self, number: int | None = None) -> None:
        """Deletes one query of the history by its number, or all."""
        self._history = [] if number is None else [h for h in self._history if h[0] != number]

    def size(self) -> tuple[int, int]:
        """Numbers of nodes and relationships."""
        return sum(t.df.count() for t in self.graph.nodes), sum(t.df.count() for t in self.graph.rels)

    def clear(self) -> None:
        """An empty graph with the same tables."""
        if self.read_only:
            raise QueryError("this session is read-only")
        self._cache.clear()
        self.graph = self.graph.emptied()

    def create_index(self, kind: str, prop: str) -> None:
        """Registers a property of nodes ("node") or relationships ("rel") as one queries look up.

        There is no index to build: filters on properties reach the scans, which skip by the files' statistics. The catalog
        tells a writer what to cluster by (``clustered``)."""
        if kind not in ("node", "rel"):
            raise ValueError("an index is on node or rel properties")
        self._indexes.add((kind, prop))

    def drop_index(self, kind: str, prop: str) -> bool:
        there = (kind, prop) in self._indexes
        self._indexes.discard((kind, prop))
        return there

    def indexes(self) -> list[tuple[str, str]]:
        return sorted(self._indexes)

    def clustered(self) -> Graph:
        """The graph with its tables sorted by their indexed properties, for writing: files then skip by statistics."""

        def sort(t, kind: str):
            by = [p for k, p in self.indexes() if k == kind and p in t.df.columns]
            return replace(t, df=t.df.repartitionByRange(*by).sortWithinPartitions(*by)) if by else t

        return replace(self.graph, nodes=tuple(sort(t, "node") for t in self.graph.nodes), rels=tuple(sort(t, "rel") for t in self.graph.rels))
