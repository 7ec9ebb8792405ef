"""The test tables as property graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from graphloom.model import Graph, NodeTable, RelTable
from graphloom.runtime import table

_ORDINAL = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "User": 7, "Event": 8}
_KEYS = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey")}


def node_id(label: str, key: str):
    return (F.lit(_ORDINAL[label]).cast("bigint") * (1 << 48)) + F.col(key).cast("bigint")


def trade_graph(spark: SparkSession, d: str) -> Graph:
    """Regions, nations, customers, suppliers, parts, orders, users and events, with their relationships."""
    t = {label: table(spark, d, name) for label, (name, _) in _KEYS.items()}
    events, lines = table(spark, d, "events"), table(spark, d, "lineitem")
    nodes = [NodeTable(df.withColumn("id", node_id(label, _KEYS[label][1])), (label,)) for label, df in t.items()]
    nodes.append(NodeTable(events.select("user_id").distinct().withColumn("id", node_id("User", "user_id")), ("User",)))
    nodes.append(NodeTable(events.select("event_id", "ts", F.col("user_id").alias("event_user"), "event_type", "value", "props").withColumn("id", node_id("Event", "event_id")), ("Event",)))

    def rel(df: DataFrame, kind: str, source: tuple[str, str], target: tuple[str, str], key: list[str], keep: list[str] | None = None) -> RelTable:
        ends = [F.xxhash64(F.lit(kind), *key).alias("id"), node_id(*source).alias("source"), node_id(*target).alias("target")]
        return RelTable(df.select(*ends, *(keep or [])), kind, (source[0],), (target[0],))

    following = events.select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_id")).where("next_id is not null")
    content = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rels = [
        rel(t["Nation"], "IN_REGION", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), ["n_nationkey"]),
        rel(t["Customer"], "IN_NATION", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), [F.lit("c"), "c_custkey"]),
        rel(t["Supplier"], "IN_NATION", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), [F.lit("s"), "s_suppkey"]),
        rel(t["Order"], "PLACED", ("Customer", "o_custkey"), ("Order", "o_orderkey"), ["o_orderkey"]),
        rel(lines, "CONTAINS", ("Order", "l_orderkey"), ("Part", "l_partkey"), lines.columns, content),
        rel(lines.select("l_suppkey", "l_partkey").distinct(), "SUPPLIES", ("Supplier", "l_suppkey"), ("Part", "l_partkey"), ["l_suppkey", "l_partkey"]),
        rel(events, "PERFORMED", ("User", "user_id"), ("Event", "event_id"), ["event_id"]),
        rel(following, "NEXT_EVENT", ("Event", "event_id"), ("Event", "next_id"), ["event_id"]),
    ]
    return Graph(tuple(nodes), tuple(rels))


def object_graph(spark: SparkSession, d: str) -> Graph:
    """nodes, well_known_principals and graph_edges: ids are objectids, of several loads the last counts; of equal
    (source, target, rel_type) rows the first loaded stays. Ends may be missing."""
    loads = table(spark, d, "nodes").where("objectid is not null")
    last = loads.groupBy("objectid").agg(F.max_by(F.struct("name", "label", "loaded_at", "deleted_at"), F.struct("loaded_at", "id")).alias("n"))
    objects = last.select(F.col("objectid").alias("id"), "objectid", "n.name", F.coalesce("n.label", F.lit("Base")).alias("label"), "n.loaded_at", "n.deleted_at")
    known = table(spark, d, "well_known_principals").select(F.col("objectid").alias("id"), "objectid", "name", F.coalesce("label", F.lit("Base")).alias("label"))
    nodes = [NodeTable(df.withColumn("labels", F.array("label"))) for df in (objects, known)]
    edges = table(spark, d, "graph_edges").where("source is not null and target is not null and rel_type is not null")
    first = edges.groupBy("source", "target", "rel_type").agg(F.min_by(F.struct("edge_id", "properties", "loaded_at"), F.struct("loaded_at", "edge_id")).alias("e"))
    likelihood = F.get_json_object("e.properties", "$.exploit_likelihood").try_cast("double")
    rels = first.select(F.col("e.edge_id").alias("id"), "source", "target", "rel_type", F.col("e.loaded_at").alias("loaded_at"), likelihood.alias("exploit_likelihood"))
    return Graph(tuple(nodes), (RelTable(rels),))


def object_edges(spark: SparkSession, d: str) -> DataFrame:
    """id, source, target, rel_type of the object graph's relationships: a struct in an aggregate isn't pruned, so the
    properties are left out here."""
    edges = table(spark, d, "graph_edges").where("source is not null and target is not null and rel_type is not null")
    first = edges.groupBy("source", "target", "rel_type").agg(F.min(F.struct("loaded_at", "edge_id")).alias("e"))
    return first.select(F.col("e.edge_id").alias("id"), "source", "target", "rel_type")
