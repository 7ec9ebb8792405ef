"""A property graph over DataFrames: node tables and relationship tables, immutable."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T


@dataclass(frozen=True)
class NodeTable:
    """``df``: id and properties, all with the given labels; with ``labels`` None, a column ``labels`` has them."""

    df: DataFrame
    labels: tuple[str, ...] | None = None

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("id", "labels")]


@dataclass(frozen=True)
class RelTable:
    """``df``: id, source, target and properties; with ``type`` None, a column ``rel_type`` has the type.

    ``source_labels``/``target_labels``: labels all ends have, if known; ends of such tables always exist."""

    df: DataFrame
    type: str | None = None
    source_labels: tuple[str, ...] | None = None
    target_labels: tuple[str, ...] | None = None

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("id", "source", "target", "rel_type")]


Groups = tuple[tuple[str, ...], ...]


def may_have(labels: tuple[str, ...] | None, groups: Groups) -> bool:
    return labels is None or all(any(x in labels for x in g) for g in groups)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    if isinstance(a, numbers) and isinstance(b, numbers):
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        return T.LongType() if isinstance(a, whole) and isinstance(b, whole) else T.DoubleType()
    return T.StringType()


def union_tables(frames: list[DataFrame]) -> DataFrame:
    """By name; columns a table lacks are null, columns of different types get a common one."""
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds[f.name] = common_type(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    fixed = []
    for df in frames:
        have = {f.name: f.dataType for f in df.schema.fields}
        fixed.append(df.select(*((F.col(f"`{c}`") if have[c] == t else F.col(f"`{c}`").cast(t)).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in kinds.items())))
    return reduce(DataFrame.union, fixed)


@dataclass(frozen=True)
class Graph:
    nodes: tuple[NodeTable, ...]
    rels: tuple[RelTable, ...]
    made: int = 0  # CREATE steps so far, for ids

    def node_frame(self, groups: Groups = (), among: set[tuple[str, ...]] | None = None) -> DataFrame:
        """id, labels and all properties of the nodes with labels (AND of ORs); ``among``: label sets that can occur."""
        frames = []
        for t in self.nodes:
            if t.labels is not None:
                if may_have(t.labels, groups) and (among is None or t.labels in among):
                    frames.append(t.df.withColumn("labels", F.array(*map(F.lit, t.labels)).cast("array<string>")))
            else:
                df = t.df
                for g in groups:
                    df = df.where(F.arrays_overlap("labels", F.array(*map(F.lit, g))))
                frames.append(df)
        if not frames:
            t = self.nodes[0]
            frames = [(t.df if t.labels is None else t.df.withColumn("labels", F.array(*map(F.lit, t.labels)))).where(F.lit(False))]
        return union_tables(frames)

    def rel_tables(self, types: Iterable[str] = ()) -> list[RelTable]:
        types = tuple(types)
        out = []
        for t in self.rels:
            if t.type is None:
                out.append(replace(t, df=t.df.where(F.col("rel_type").isin(*types))) if types else t)
            elif not types or t.type in types:
                out.append(t)
        return out

    def rel_frame(self, tables: list[RelTable]) -> DataFrame:
        frames = [t.df if t.type is None else t.df.withColumn("rel_type", F.lit(t.type)) for t in tables]
        if not frames:
            t = self.rels[0]
            frames = [(t.df if t.type is None else t.df.withColumn("rel_type", F.lit(t.type))).where(F.lit(False))]
        return union_tables(frames)

    def all_labels(self) -> DataFrame:
        return self.node_frame().select(F.explode("labels").alias("label")).distinct()

    def emptied(self) -> Graph:
        none = lambda t: replace(t, df=t.df.where(F.lit(False)))
        return replace(self, nodes=tuple(map(none, self.nodes)), rels=tuple(map(none, self.rels)))

    def label_counts_without(self, prop: str) -> DataFrame:
        """label, n: nodes that don't have the property (or have it false, as placeholders do when they are resolved)."""
        nodes = self.node_frame()
        if prop in nodes.columns:
            value = F.lower(F.col(f"`{prop}`").cast("string"))
            nodes = nodes.where(value.isNull() | (value == "false"))
        return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))

    def label_counts(self) -> DataFrame:
        return self.node_frame().select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))

    def rel_types(self) -> DataFrame:
        return self.rel_frame(list(self.rels)).select("rel_type").distinct()

    def is_closed(self, tables: list[RelTable]) -> bool:
        return all(t.source_labels is not None and t.target_labels is not None for t in tables)
