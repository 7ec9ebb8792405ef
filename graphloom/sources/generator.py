"""Deterministic test graphs of any size: the same for the same parameters, made by the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.model import Graph, NodeTable, RelTable

TOPOLOGIES = ("dense_cluster", "long_chain", "wide_fanout", "power_law")


def _uniform(seed: int, *keys) -> F.Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)


def topology(spark: SparkSession, kind: str, n: int, seed: int = 1, degree: int = 4) -> Graph:
    """Nodes (id, value) with label Node and relationships LINK.

    dense_cluster: every node to ``degree`` hashed others; long_chain: each to the next; wide_fanout: node 0 to all others;
    power_law: ``degree`` hashed targets each, low numbers far more often."""
    nodes = spark.range(n).select("id", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1000)).alias("value"))
    each = spark.range(n).select(F.col("id").alias("source"), F.explode(F.sequence(F.lit(1), F.lit(degree))).alias("k"))
    pairs: dict[str, DataFrame] = {
        "dense_cluster": each.select("source", F.floor(_uniform(seed, "source", "k") * n).alias("target")),
        "long_chain": spark.range(max(0, n - 1)).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target")),
        "wide_fanout": spark.range(1, max(1, n)).select(F.lit(0).cast("bigint").alias("source"), F.col("id").alias("target")),
        "power_law": each.select("source", F.floor(F.pow(_uniform(seed, "source", "k"), 3) * n).alias("target")),
    }
    if kind not in pairs:
        raise ValueError(f"unknown topology {kind}")
    rels = pairs[kind].where("source <> target").distinct().select(F.xxhash64("source", "target").alias("id"), "source", "target")
    return Graph((NodeTable(nodes, ("Node",)),), (RelTable(rels, "LINK", ("Node",), ("Node",)),))


def enterprise(spark: SparkSession, domains: int = 3, users: int = 1000, computers: int = 400, groups: int = 100, ous: int = 20, seed: int = 1) -> Graph:
    """A made-up directory: per domain so many users, computers, groups and organisational units, with their links.

    Units form a tree under the domain and contain users and computers; groups form a tree of memberships; users are in two
    groups each, low-numbered groups have far more members; groups administer computers; computers hold users' sessions;
    each domain trusts the next. Every row comes from its own number by hash, so any size is made by the executors."""

    def sid(domain: F.Column, rid: F.Column) -> F.Column:
        return F.concat(F.lit("S-1-5-21-"), (domain + 1000).cast("string"), F.lit("-"), rid.cast("string"))

    def kind(label: str, n: int, base: int) -> DataFrame:
        d, k = F.floor(F.col("i") / max(1, n)).cast("bigint"), F.pmod("i", F.lit(max(1, n)))
        rows = spark.range(domains * n).withColumnRenamed("id", "i").select(d.alias("domain"), k.alias("k"))
        name = F.concat(F.lit(label.upper()), F.col("k").cast("string"), F.lit("@DOMAIN"), F.col("domain").cast("string"), F.lit(".EXAMPLE"))
        return rows.select(sid(F.col("domain"), F.col("k") + base).alias("id"), name.alias("name"), F.array(F.lit(label)).alias("labels"), "domain", "k", (_uniform(seed, F.lit(label), "domain", "k") < 0.95).alias("enabled"))

    bases = {"User": 10_000_000_000, "Computer": 20_000_000_000, "Group": 30_000_000_000, "OU": 40_000_000_000}
    size = {"User": users, "Computer": computers, "Group": groups, "OU": ous}
    made = {label: kind(label, n, bases[label]) for label, n in size.items()}
    top = spark.range(domains).select(F.concat(F.lit("S-1-5-21-"), (F.col("id") + 1000).cast("string")).alias("id"), F.concat(F.lit("DOMAIN"), F.col("id").cast("string"), F.lit(".EXAMPLE")).alias("name"), F.array(F.lit("Domain")).alias("labels"), F.col("id").alias("domain"), F.col("id").alias("k"), F.lit(True).alias("enabled"))

    def pick(label: str, *keys, skew: int = 1) -> F.Column:
        """The id of one of the domain's objects of a label, low numbers more often with ``skew``."""
        return sid(F.col("domain"), F.floor(F.pow(_uniform(seed, F.lit(label), *keys), skew) * size[label]).cast("bigint") + bases[label])

    def edges(df: DataFrame, source: F.Column, target: F.Column, rel_type: str) -> DataFrame:
        return df.select(source.cast("string").alias("source"), target.cast("string").alias("target"), F.lit(rel_type).alias("rel_type"))

    root, up = F.concat(F.lit("S-1-5-21-"), (F.col("domain") + 1000).cast("string")), F.floor((F.col("k") - 1) / 3).cast("bigint")
    twice = made["User"].withColumn("t", F.explode(F.array(F.lit(1), F.lit(2))))
    parts = [edges(made["OU"], F.when(F.col("k") == 0, root).otherwise(sid(F.col("domain"), up + bases["OU"])), F.col("id"), "Contains")]
    if ous:
        parts += [edges(made[x], pick("OU", F.lit(x), "domain", "k"), F.col("id"), "Contains") for x in ("User", "Computer")]
    if groups:
        parts.append(edges(twice, F.col("id"), pick("Group", "domain", "k", "t", skew=3), "MemberOf"))
        parts.append(edges(made["Group"].where("k > 0"), F.col("id"), sid(F.col("domain"), up + bases["Group"]), "MemberOf"))
        parts.append(edges(made["Computer"], pick("Group", F.lit("admin"), "domain", "k", skew=2), F.col("id"), "AdminTo"))
    if users:
        parts.append(edges(made["Computer"], F.col("id"), pick("User", F.lit("session"), "domain", "k"), "HasSession"))
    parts.append(edges(top.where(F.col("k") < domains - 1), F.col("id"), F.concat(F.lit("S-1-5-21-"), (F.col("domain") + 1001).cast("string")), "SameForestTrust"))
    rels = reduce(DataFrame.unionByName, parts).distinct().select(F.xxhash64("source", "target", "rel_type").alias("id"), "source", "target", "rel_type")
    nodes = reduce(DataFrame.unionByName, [top, *made.values()]).drop("k")
    return Graph((NodeTable(nodes),), (RelTable(rels),))
