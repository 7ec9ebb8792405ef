"""Registered queries that update a graph and then read it, each with SQL that gives the same rows.

The updates run over whole tables; the stored tables never change, so every run starts from the same graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.session import GraphSession
from graphloom.sources.tables import trade_graph

# name: (updates and a last query that reads, SQL)
UPDATES: dict[str, tuple[list[str], str]] = {
    "create": (
        ["CREATE (a:Audit {k: 1, name: 'x', share: 0.5})-[:CHECKS {weight: 2}]->(b:Audit {k: 2})<-[:CHECKS]-(c:Audit:Late {k: 3, open: true})", "MATCH (a:Audit)-[r:CHECKS]->(b:Audit) RETURN a.k AS a, a.name AS name, a.share AS share, coalesce(r.weight, 0) AS w, b.k AS b, size(labels(a)) AS n, coalesce(a.open, false) AS open"],
        "SELECT CAST(1 AS BIGINT) AS a, 'x' AS name, 0.5::DOUBLE AS share, CAST(2 AS BIGINT) AS w, CAST(2 AS BIGINT) AS b, CAST(1 AS BIGINT) AS n, false AS open UNION ALL SELECT 3, NULL, NULL, 0, 2, 2, true",
    ),
    "match_create": (
        ["MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE c.c_acctbal > 5000 CREATE (c)-[:RICH_IN {bal: c.c_acctbal}]->(n)", "MATCH (c:Customer)-[r:RICH_IN]->(n:Nation) RETURN n.n_name AS name, count(*) AS n, round(sum(r.bal), 2) AS bal"],
        "SELECT n_name AS name, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000 GROUP BY 1",
    ),
    "create_returning": (
        ["MATCH (r:Region) CREATE (t:Tag {of: r.r_regionkey})-[:TAGS]->(r) RETURN t.of AS k, r.r_name AS name"],
        "SELECT r_regionkey AS k, r_name AS name FROM region",
    ),
    "set": (
        ["MATCH (s:Supplier) WHERE s.s_acctbal < 5000 SET s.debt = true, s.s_acctbal = s.s_acctbal - 1.0", "MATCH (s:Supplier) RETURN s.s_suppkey AS k, round(s.s_acctbal, 2) AS b, coalesce(s.debt, false) AS debt"],
        "SELECT s_suppkey AS k, round(CASE WHEN s_acctbal < 5000 THEN s_acctbal - 1.0 ELSE s_acctbal END, 2) AS b, s_acctbal < 5000 AS debt FROM supplier",
    ),
    "set_by_type": (
        ["MATCH ()-[r:IN_NATION]->() SET r.risk = 0.25", "MATCH (s:Supplier)-[r:IN_NATION]->(n:Nation) RETURN n.n_name AS name, sum(r.risk) AS risk"],
        "SELECT n_name AS name, 0.25::DOUBLE * count(*) AS risk FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "set_map": (
        ["MATCH (r:Region) SET r = {code: r.r_regionkey * 10}", "MATCH (r:Region) RETURN r.code AS code, r.r_name IS NULL AS gone"],
        "SELECT CAST(r_regionkey * 10 AS BIGINT) AS code, true AS gone FROM region",
    ),
    "set_map_merge": (
        ["MATCH (n:Nation) WHERE n.n_nationkey < 20 SET n += {code: n.n_nationkey + 100, n_regionkey: null}", "MATCH (n:Nation) RETURN n.n_name AS name, coalesce(n.code, -1) AS code, coalesce(n.n_regionkey, -1) AS r"],
        "SELECT n_name AS name, CAST(CASE WHEN n_nationkey < 20 THEN n_nationkey + 100 ELSE -1 END AS BIGINT) AS code, CASE WHEN n_nationkey >= 20 THEN n_regionkey ELSE -1 END AS r FROM nation",
    ),
    "labels": (
        ["MATCH (c:Customer) WHERE c.c_acctbal < 0 OR c.c_nationkey < 3 SET c:Watched:Odd", "MATCH (c:Watched) WHERE c.c_nationkey = 1 REMOVE c:Watched", "MATCH (c:Odd) RETURN c.c_custkey AS k, c:Watched AS watched, size(labels(c)) AS n"],
        "SELECT c_custkey AS k, c_nationkey <> 1 AS watched, CAST(CASE WHEN c_nationkey <> 1 THEN 3 ELSE 2 END AS BIGINT) AS n FROM customer WHERE c_acctbal < 0 OR c_nationkey < 3",
    ),
    "remove": (["MATCH (c:Customer) WHERE c.c_acctbal < 5000 REMOVE c.c_mktsegment", "MATCH (c:Customer) RETURN c.c_mktsegment AS s, count(*) AS n"], "SELECT CASE WHEN c_acctbal >= 5000 THEN c_mktsegment END AS s, count(*) AS n FROM customer GROUP BY 1"),
    "delete": (
        ["MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE o.o_orderstatus = 'F' DELETE r", "MATCH (o:Order) OPTIONAL MATCH (c:Customer)-[:PLACED]->(o) RETURN o.o_orderstatus AS s, count(o) AS n, count(c) AS placed"],
        "SELECT o_orderstatus AS s, count(*) AS n, count(CASE WHEN o_orderstatus <> 'F' THEN c_custkey END) AS placed FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    ),
    "detach_delete": (
        ["MATCH (p:Part) WHERE p.p_size > 25 DETACH DELETE p", "MATCH (s:Supplier) OPTIONAL MATCH (s)-[:SUPPLIES]->(p) RETURN s.s_suppkey AS k, count(p) AS n"],
        "WITH x AS (SELECT DISTINCT l_suppkey k, l_partkey p FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25) SELECT s_suppkey AS k, count(p) AS n FROM supplier LEFT JOIN x ON k = s_suppkey GROUP BY 1",
    ),
    "delete_all": (["MATCH (n) DETACH DELETE n", "MATCH (n) RETURN count(n) AS n"], "SELECT CAST(0 AS BIGINT) AS n"),
    "merge": (
        ["MATCH (c:Customer) MERGE (s:Segment {name: c.c_mktsegment}) ON CREATE SET s.made = true", "MERGE (s:Segment {name: 'BUILDING'}) ON CREATE SET s.late = true ON MATCH SET s.seen = true", "MATCH (s:Segment) RETURN s.name AS name, s.made AS made, coalesce(s.seen, false) AS seen, count(*) AS n"],
        "SELECT DISTINCT c_mktsegment AS name, true AS made, c_mktsegment = 'BUILDING' AS seen, CAST(1 AS BIGINT) AS n FROM customer",
    ),
    "merge_rel": (
        ["MATCH (c:Customer)-[:IN_NATION]->(n:Nation) MERGE (n)-[:HAS_CUSTOMERS]->(n)", "MATCH (n:Nation)-[r:HAS_CUSTOMERS]->(n) RETURN n.n_nationkey AS k, count(r) AS n"],
        "SELECT DISTINCT c_nationkey AS k, CAST(1 AS BIGINT) AS n FROM customer",
    ),
    "clause_order": (
        ["MATCH (r:Region) SET r.mark = r.r_regionkey + 1 CREATE (t:Tag {m: r.mark}) SET t.double = t.m * 2 RETURN r.r_regionkey AS k, t.m AS m, t.double AS d"],
        "SELECT r_regionkey AS k, CAST(r_regionkey + 1 AS BIGINT) AS m, CAST((r_regionkey + 1) * 2 AS BIGINT) AS d FROM region",
    ),
}


def _run(texts: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        session = GraphSession(spark, trade_graph(spark, d))
        return [session.query(text) for text in texts][-1].df

    return query


QUERIES = {f"w_{name}": _run(texts) for name, (texts, _) in UPDATES.items()}
ORACLE = {f"w_{name}": sql for name, (_, sql) in UPDATES.items()}
