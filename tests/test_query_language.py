"""The query language on small graphs: results, order, errors and updates."""

import itertools
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from graphloom.cypher import queries
from graphloom.cypher.ast import QueryError
from graphloom.cypher.parser import parse
from graphloom.model import Graph, NodeTable, RelTable
from graphloom.operators import reach, traverse
from graphloom.operators.traverse import ResourceLimitError
from graphloom.session import GraphSession


def make(spark, nodes, rels):
    """nodes: (id, labels, name, age); rels: (source, target, type, since)."""
    n = spark.createDataFrame(nodes, "id bigint, labels array<string>, name string, age bigint")
    r = spark.createDataFrame([(100 + i, *x) for i, x in enumerate(rels)], "id bigint, source bigint, target bigint, rel_type string, since bigint")
    return Graph((NodeTable(n),), (RelTable(r),))


PEOPLE = [(1, ["Person", "Actor"], "Ann", 30), (2, ["Person"], "Bob", 25), (3, ["Person", "Director"], "Cid", None), (4, ["Person"], "Dan", 40), (5, ["Movie"], "Up", None)]
KNOWS = [(1, 2, "KNOWS", 2001), (2, 3, "KNOWS", 2005), (3, 4, "KNOWS", None), (4, 1, "KNOWS", 2010), (1, 5, "ACTED_IN", None), (3, 5, "DIRECTED", None), (2, 2, "KNOWS", 1999)]


@pytest.fixture(scope="module")
def people(spark):
    return GraphSession(spark, make(spark, PEOPLE, KNOWS))


CASES = [
    ("MATCH (n:Person:Actor) RETURN n.name", [("Ann",)]),
    ("MATCH (n:Actor|Director) RETURN n.name", [("Ann",), ("Cid",)]),
    ("MATCH (n:Actor|Movie:Person) RETURN n.name", [("Ann",)]),
    ("MATCH (n {name: 'Bob'}) RETURN n.age, labels(n)", [(25, ["Person"])]),
    ("MATCH (n) WHERE n.age > 26 RETURN n.name", [("Ann",), ("Dan",)]),
    ("MATCH (n:Person) WHERE NOT n.age > 26 RETURN n.name", [("Bob",), ("Cid",)]),
    ("MATCH (n:Person) WHERE n.age <> 25 RETURN n.name", [("Ann",), ("Cid",), ("Dan",)]),
    ("MATCH (n) WHERE n.age IS NULL RETURN n.name", [("Cid",), ("Up",)]),
    ("MATCH (n:Person) WHERE n.name = 25 RETURN n.name", []),
    ("MATCH (n:Person) WHERE n.nothing CONTAINS 'x' RETURN n.name", []),
    ("MATCH (a)-[:KNOWS]->(b) RETURN a.name, b.name", [("Ann", "Bob"), ("Bob", "Bob"), ("Bob", "Cid"), ("Cid", "Dan"), ("Dan", "Ann")]),
    ("MATCH (a:Person)<-[:KNOWS]-(b) WHERE a.name = 'Bob' RETURN b.name", [("Ann",), ("Bob",)]),
    ("MATCH (a {name: 'Bob'})-[:KNOWS]-(b) RETURN b.name", [("Ann",), ("Bob",), ("Cid",)]),
    ("MATCH (a)-[r:KNOWS {since: 2005}]->(b) RETURN a.name, r.since", [("Bob", 2005)]),
    ("MATCH (a)-[r]->(m:Movie) RETURN type(r), a.name", [("ACTED_IN", "Ann"), ("DIRECTED", "Cid")]),
    ("MATCH (a)-[:KNOWS]->(b)-[:KNOWS]->(c) WHERE a.name = 'Ann' RETURN b.name, c.name", [("Bob", "Bob"), ("Bob", "Cid")]),
    ("MATCH (a {name: 'Bob'})-[:KNOWS]->(b)-[:KNOWS]->(a) RETURN b.name", []),
    ("MATCH (a {name: 'Ann'})-[:KNOWS*2]->(b) RETURN b.name", [("Cid",)]),
    ("MATCH (a {name: 'Ann'})-[:KNOWS*1..9]->(b) RETURN b.name", [("Bob",), ("Cid",), ("Dan",)]),
    ("MATCH (a {name: 'Ann'})-[:KNOWS*0..9]->(b) RETURN count(b)", [(3,)]),
    ("MATCH (a {name: 'Ann'})-[r:KNOWS*3]->(b) RETURN [x IN r | x.since]", [([2001, 2005, None],)]),
    ("MATCH (b)<-[:KNOWS*1..2]-(a {name: 'Ann'}) RETURN b.name", [("Bob",), ("Cid",)]),
    ("MATCH p = shortestPath((a {name: 'Ann'})-[:KNOWS*]->(b {name: 'Dan'})) RETURN length(p), [n IN nodes(p) | id(n)]", [(3, [1, 2, 3, 4])]),
    ("MATCH (a {name: 'Ann'}), (b {name: 'Cid'}), p = shortestPath((a)-[*]-(b)) RETURN length(p)", [(2,)]),
    ("MATCH p = allShortestPaths((a {name: 'Ann'})-[*]-(b {name: 'Cid'})) RETURN length(p)", [(2,), (2,), (2,)]),
    ("MATCH p = (a {name: 'Ann'})-[:KNOWS]->()-[:KNOWS*1..2]->(c) RETURN length(p), c.name", [(2, "Cid"), (3, "Dan")]),
    ("MATCH p = (a)-[:KNOWS*1..2]->(b) WHERE ALL(r IN relationships(p) WHERE r.since > 2002) RETURN a.name, b.name", [("Bob", "Cid"), ("Dan", "Ann")]),
    ("MATCH (n:Person) OPTIONAL MATCH (n)-[:DIRECTED]->(m) RETURN n.name, m.name", [("Ann", None), ("Bob", None), ("Cid", "Up"), ("Dan", None)]),
    ("MATCH (n:Person) OPTIONAL MATCH (n)-[:ACTED_IN]->(m) WHERE n.age > 99 RETURN n.name, m", [("Ann", None), ("Bob", None), ("Cid", None), ("Dan", None)]),
    ("OPTIONAL MATCH (n:Nobody) RETURN n", [(None,)]),
    ("MATCH (n:Person) WHERE (n)-[:ACTED_IN]->(:Movie) RETURN n.name", [("Ann",)]),
    ("MATCH (n:Person) WHERE NOT (n)-[:ACTED_IN|DIRECTED]->() AND n.age > 1 RETURN n.name", [("Bob",), ("Dan",)]),
    ("MATCH (n:Person) RETURN n.name, exists((n)-[:DIRECTED]->()) AS d", [("Ann", False), ("Bob", False), ("Cid", True), ("Dan", False)]),
    ("MATCH (n) RETURN count(*), count(n.age), sum(n.age), avg(n.age), min(n.name), max(n.age)", [(5, 3, 95, 95 / 3, "Ann", 40)]),
    ("MATCH (n:Nobody) RETURN count(*), sum(n.age), avg(n.age), collect(n.name)", [(0, 0, None, [])]),
    ("MATCH (a)-[:KNOWS]->(b) RETURN b.name, count(a) AS n, count(DISTINCT a.age) AS d", [("Ann", 1, 1), ("Bob", 2, 2), ("Cid", 1, 1), ("Dan", 1, 0)]),
    ("MATCH (a)-[:KNOWS]->(b) WITH b, count(*) AS n WHERE n > 1 RETURN b.name, n", [("Bob", 2)]),
    ("MATCH (n:Person) WITH n.age > 26 AS old, count(*) AS c RETURN old, c * 10", [(False, 20), (True, 20)]),
    ("UNWIND [3, 1, null, 1] AS x RETURN DISTINCT x", [(1,), (3,), (None,)]),
    ("UNWIND [] AS x RETURN x", []),
    ("RETURN 7 / 2, -7 / 2, 7 % 4, 7.0 / 2, 2 ^ 3, 1 / 0, 0x1F, 1e2", [(3, -3, 3, 3.5, 8.0, None, 31, 100.0)]),
    ("RETURN 'a' + 1, [1, 2] + 3, \"q\\n\\u0041\"", [("a1", [1, 2, 3], "q\nA")]),
    ("RETURN [1, 2, 3][-1], [1, 2, 3][0..2], [1][5], {a: 2}.a, size([]), head([])", [(3, [1, 2], None, 2, 0, None)]),
    ("RETURN CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END, CASE WHEN false THEN 1 END, coalesce(null, 4)", [("b", None, 4)]),
    ("RETURN null = null, null <> null, NOT null = 1, 1 = 1.0, '1' = 1, true < false", [(False, True, True, True, False, False)]),
    ("RETURN 1 IN [1, null], null IN [null], 'x' IN [1], 1 < 2 < 3, 3 > 2 > 2, true XOR true", [(True, False, False, True, False, False)]),
    ("RETURN range(1, 5, 2), range(3, 1), split('a.b', '.'), reverse([1, 2]), tail([1, 2]), substring('hello', 1, 3)", [([1, 3, 5], [], ["a", "b"], [2, 1], [2], "ell")]),
    ("RETURN toInteger('x'), toInteger('3.7'), toFloat('1.5'), toString(2), toBoolean('true'), round(2.5), sqrt(-1)", [(None, 3, 1.5, "2", True, 3.0, None)]),
    ("RETURN all(x IN [] WHERE x > 1), any(x IN [1, 2] WHERE x > 1), none(x IN [1] WHERE x = 1), single(x IN [1, 1] WHERE x = 1)", [(True, True, False, False)]),
    ("MATCH (n {name: 'Ann'}) RETURN keys(n), properties(n).age, id(n), n.id", [(["name", "age"], 30, 1, None)]),
    ("MATCH (n:Person) RETURN n.name AS x UNION MATCH (n:Actor) RETURN n.name AS x", [("Ann",), ("Bob",), ("Cid",), ("Dan",)]),
    ("MATCH (n:Actor) RETURN n.name AS x UNION ALL MATCH (n:Actor) RETURN 'GenericAll' AS x", [("Ann",), ("GenericAll",)]),
    ("MATCH (n:Actor) RETURN n.age AS x UNION ALL MATCH (n:Actor) RETURN 1.5 AS x", [(1.5,), (30.0,)]),
    ("MATCH (a:Actor), (b:Director) RETURN *", [((1, ["Person", "Actor"], "Ann", 30), (3, ["Person", "Director"], "Cid", None))]),
    ("MATCH (a)-[:KNOWS]->(b), (b)-[:DIRECTED]->(m) RETURN a.name, m.name", [("Bob", "Up")]),
    ("MATCH (a {name: 'Ann'}) MATCH (x {age: a.age}) RETURN x.name", [("Ann",)]),
    ("MATCH (m:Movie)<-[:DIRECTED]-(d)<-[:KNOWS]-(b) RETURN b.name", [("Bob",)]),
    ("MATCH (a)-[r:KNOWS]->(b) WITH r MATCH (x)-[r]->(y) WHERE x.name = 'Ann' RETURN y.name", [("Bob",)]),
    ("MATCH (n) WHERE n:Movie OR n:Actor RETURN n.name", [("Ann",), ("Up",)]),
]


def plain(x):
    return tuple(plain(y) for y in x) if isinstance(x, tuple) else [plain(y) for y in x] if isinstance(x, list) else x


def key(row):
    return repr(row)


@pytest.mark.parametrize("text,want", CASES)
def test_rows(people, text, want):
    assert sorted(map(plain, people.query(text).rows()), key=key) == sorted(want, key=key)


ORDERED = [
    ("MATCH (n:Person) RETURN n.age AS a ORDER BY a", [(25,), (30,), (40,), (None,)]),
    ("MATCH (n:Person) RETURN n.age AS a ORDER BY a DESC", [(None,), (40,), (30,), (25,)]),
    ("MATCH (n:Person) RETURN n.name ORDER BY n.age DESC, n.name SKIP 1 LIMIT 2", [("Dan",), ("Ann",)]),
    ("MATCH (n) RETURN n.name ORDER BY size(n.name), n.name LIMIT $k", [("Up",), ("Ann",)]),
    ("MATCH (a)-[:KNOWS]->(b) RETURN b.name, count(*) ORDER BY count(*) DESC, b.name LIMIT 2", [("Bob", 2), ("Ann", 1)]),
    ("MATCH (n:Person) WITH n ORDER BY n.name DESC LIMIT 2 RETURN n.name ORDER BY n.name", [("Cid",), ("Dan",)]),
]


@pytest.mark.parametrize("text,want", ORDERED)
def test_order(people, text, want):
    assert people.query(text, k=2).rows() == want


def test_column_names(people):
    assert people.query("MATCH (n) RETURN n.name, count(*), 1 + 2 AS three, n.age  >  3").columns == ["n.name", "count(*)", "three", "n.age > 3"]


@pytest.mark.parametrize(
    "text",
    ["", "MATCH (n)", "RETURN", "MATCH (n RETURN n", "MATCH (n) RETURN m", "RETURN nothing(1)", "RETURN 1 AS a, 2 AS a", "RETURN 1 AS a UNION RETURN 2 AS b", "RETURN 1 LIMIT -1", "RETURN $p", "MATCH (n) WHERE 1 RETURN n"]
    + ["RETURN 1 RETURN 2", "RETURN 'x", "MATCH p = shortestPath((a)-->(b)-->(c)) RETURN p", "CREATE (n:A|B)", "CREATE (a)-[:X*2]->(b)", "MATCH (n) SET 1 = 2", "MATCH (n) DELETE n.name", "CREATE (a) WITH a RETURN a"],
)
def test_errors(people, text):
    with pytest.raises(QueryError):
        people.query(text)


def test_frontier_limit(spark):
    star = make(spark, [(i, ["N"], str(i), i) for i in range(20)], [(0, i, "E", None) for i in range(1, 20)])
    with pytest.raises(ResourceLimitError):
        GraphSession(spark, star, frontier_limit=10).query("MATCH (a {name: '0'})-[*1..2]->(b) RETURN b")


def test_updates(spark):
    g = GraphSession(spark, make(spark, PEOPLE, KNOWS))
    stats = g.query("CREATE (a:City {name: 'Oslo', size: 3})-[:NEAR {km: 7}]->(b:City {name: 'Ski'})").stats
    assert (stats.nodes_created, stats.relationships_created, stats.properties_set, stats.labels_added) == (2, 1, 4, 2)
    assert g.query("MATCH (a)-[r:NEAR]->(b) RETURN a.name, r.km, b.name, a.size").rows() == [("Oslo", 7, "Ski", 3)]
    assert g.query("MATCH (p:Person), (c:City {name: 'Ski'}) WHERE p.age > 26 CREATE (p)-[:LIVES_IN]->(c) RETURN count(*)").rows() == [(2,)]
    assert sorted(g.query("MATCH (p)-[:LIVES_IN]->(:City) RETURN p.name").rows()) == [("Ann",), ("Dan",)]
    assert g.query("MATCH (p {name: 'Bob'}) SET p.age = 26, p.rank = 'x', p:Tall RETURN p.age, p.rank, labels(p)").rows() == [(26, "x", ["Person", "Tall"])]
    assert g.query("MATCH (p:Tall) RETURN p.name, p.age, p.rank").rows() == [("Bob", 26, "x")]
    assert g.query("MATCH (p:Tall) SET p += {rank: null, age: 27} REMOVE p:Tall RETURN p.rank").rows() == [(None,)]
    assert g.query("MATCH (p {name: 'Bob'}) RETURN p.rank, p.age, labels(p)").rows() == [(None, 27, ["Person"])]
    g.query("MATCH (a {name: 'Ann'})-[r:KNOWS]->() SET r.since = 1990")
    assert g.query("MATCH ({name: 'Ann'})-[r:KNOWS]->() RETURN r.since").rows() == [(1990,)]
    with pytest.raises(QueryError):
        g.query("MATCH (n {name: 'Ann'}) DELETE n")
    stats = g.query("MATCH (n {name: 'Ann'}) DETACH DELETE n").stats
    assert (stats.nodes_deleted, stats.relationships_deleted) == (1, 4)
    assert g.query("MATCH (n:Person) RETURN count(*)").rows() == [(3,)]
    assert g.query("MATCH ()-[r:KNOWS]->() DELETE r").stats.relationships_deleted == 3
    assert g.query("MATCH ()-[r:KNOWS]->() RETURN count(r)").rows() == [(0,)]


def test_merge(spark):
    g = GraphSession(spark, make(spark, PEOPLE, KNOWS))
    assert g.query("MERGE (n:Person {name: 'Eve'}) ON CREATE SET n.age = 1 ON MATCH SET n.age = 2 RETURN n.age").rows() == [(1,)]
    assert g.query("MERGE (n:Person {name: 'Eve'}) ON CREATE SET n.age = 1 ON MATCH SET n.age = 2 RETURN n.age").rows() == [(2,)]
    g.query("MATCH (p:Person) MERGE (p)-[:ACTED_IN]->(m:Movie {name: 'Up'})")
    assert g.query("MATCH (p)-[:ACTED_IN]->(m) RETURN count(*), count(DISTINCT p)").rows() == [(5, 5)]
    assert g.query("MATCH (n {name: 'Eve'}) RETURN count(*)").rows() == [(1,)]


def test_read_only_cache_history(spark):
    g = GraphSession(spark, make(spark, PEOPLE, KNOWS), read_only=True)
    assert g.query("MATCH (n) RETURN count(*)") is g.query("MATCH  (n)  RETURN  count(*)")
    with pytest.raises(QueryError):
        g.query("CREATE (n)")
    assert g.history(0, 1) == ["CREATE (n)"] and len(g.history()) == 3
    assert g.query("RETURN 1 AS a, null AS b").json().collect()[0].row == '{"a":1,"b":null}'


def test_empty_graph(spark):
    g = GraphSession(spark, make(spark, [], []))
    assert g.query("MATCH (a)-[*1..3]->(b) RETURN a, b").rows() == []
    assert g.query("MATCH (a) RETURN count(*)").rows() == [(0,)]


def test_parse_keeps_names():
    assert parse("MATCH (`a b`) RETURN `a b`.x AS `y``z`").parts[0].clauses[1].items[0][1] == "y`z"


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id bigint, name string, age int").write.parquet(str(tmp_path / "n"))
    n = spark.read.parquet(str(tmp_path / "n"))
    rel = spark.createDataFrame([], T.StructType.fromDDL("id bigint, source bigint, target bigint"))
    g = GraphSession(spark, Graph((NodeTable(n, ("A",)),), (RelTable(rel, "R", ("A",), ("A",)),)))
    plan = g.query("MATCH (n:A) WHERE n.age > 1 AND n.name IN ['b'] RETURN n.age").df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,1)" in plan and "name" in plan.split("PushedFilters")[1] and "id" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    """Two hops, variable length and shortest paths against a plain evaluator."""
    rnd = random.Random(seed)
    n = 7
    nodes = [(i, [rnd.choice("AB")], f"n{i}", rnd.choice([None, 1, 2])) for i in range(n)]
    rels = [(rnd.randrange(n), rnd.randrange(n), rnd.choice("XY"), None) for _ in range(12)]
    g = GraphSession(spark, make(spark, nodes, rels))
    two = [(a, c) for i, (a, b, t, _) in enumerate(rels) for j, (b2, c, u, _) in enumerate(rels) if b == b2 and t == "X" and i != j and u == "Y"]
    assert sorted(g.query("MATCH (a)-[:X]->()-[:Y]->(c) RETURN id(a), id(c)").rows()) == sorted(two)
    dist = {}
    for s in range(n):
        level, seen, d = {s}, {s}, 0
        while level:
            d += 1
            level = {b for a, b, _, _ in rels if a in level} | {a for a, b, _, _ in rels if b in level}
            level -= seen
            seen |= level
            dist |= {(s, v): d for v in level}
    want = sorted((s, v) for (s, v), d in dist.items() if 2 <= d <= 3)
    assert sorted(g.query("MATCH (a)-[*2..3]-(b) RETURN id(a), id(b)").rows()) == want
    want = sorted((s, v, d) for (s, v), d in dist.items() if nodes[v][1] == ["A"])
    assert sorted(g.query("MATCH p = shortestPath((a)-[*]-(b:A)) RETURN id(a), id(b), length(p)").rows()) == want
    pairs = [(a, b) for a, b in itertools.product(range(n), repeat=2) if nodes[a][3] is not None and nodes[a][3] == nodes[b][3]]
    assert sorted(g.query("MATCH (a), (b) WHERE a.age = b.age RETURN id(a), id(b)").rows()) == pairs


def test_loops_from_all_seeds(spark, sf):
    """The loops from every event and supplier, against plain Python."""
    run = lambda name: [tuple(r) for r in queries.QUERIES[name](spark, sf).collect()]
    read = lambda name: pd.read_parquet(f"{sf}/{name}.parquet")
    chains = [list(g.event_id) for _, g in read("events").sort_values(["ts", "event_id"]).groupby("user_id")]
    assert sorted(run("q_varlen_next_all")) == sorted((c[i], b) for c in chains for i in range(len(c)) for b in c[i + 1 : i + 5])
    assert sorted(run("q_varlen_exact_all")) == sorted((c[i], c[i + 3], 3) for c in chains for i in range(len(c) - 3))
    lines, orders, customers = read("lineitem"), read("orders"), read("customer")
    parts = lines.groupby("l_suppkey").l_partkey.agg(set)
    sellers = lines.groupby("l_partkey").l_suppkey.agg(set)
    assert sorted(run("q_expand_unique_rels_all")) == sorted((s, n) for s, ps in parts.items() if (n := sum(len(sellers[p]) - 1 for p in ps)))
    placed = dict(zip(orders.o_orderkey, orders.o_custkey))
    buyers: dict = {}
    for o, p in zip(lines.l_orderkey, lines.l_partkey):
        buyers.setdefault(p, set()).add(placed[o])
    near = customers.groupby("c_nationkey").c_custkey.agg(set)
    want = []
    for s, nation in zip(*(read("supplier")[c] for c in ("s_suppkey", "s_nationkey"))):
        two = near.get(nation, set())
        three = set().union(*(buyers[p] for p in parts.get(s, ()))) - two
        want += [(s, k, len(x)) for k, x in ((2, two), (3, three)) if x]
    assert sorted(run("q_shortest_len_all")) == sorted(want)


def test_searches_keep_relationships_apart(spark):
    g = lambda edges: Graph((NodeTable(spark.createDataFrame([(i, c) for i, c in enumerate("abcd")], "id bigint, name string"), ("N",)),), (RelTable(spark.createDataFrame(edges, "id bigint, source bigint, target bigint"), "R"),))
    one = GraphSession(spark, g([(1, 0, 1)]))
    assert one.query("MATCH (a {name: 'a'})-[r]-(b)-[*1..2]-(c) RETURN a.name, b.name, c.name").rows() == []
    assert one.query("MATCH (a {name: 'a'})-[*1..2]-(b), (c)-[r]->(d) RETURN count(*) AS n").rows() == [(0,)]
    ring = GraphSession(spark, g([(1, 0, 1), (2, 1, 2), (3, 2, 0)]))
    got = ring.query("MATCH (a {name: 'a'})-[r]-(b)-[s*1..2]-(c) RETURN b.name AS b, c.name AS c, size(s) AS n ORDER BY b, c").rows()
    assert got == [("b", "a", 2), ("b", "c", 1), ("c", "a", 2), ("c", "b", 1)]
    assert ring.query("MATCH (a {name: 'a'})-[s*1..1]->(b)-[t*1..1]->(c) RETURN c.name AS c").rows() == [("c",)]


def test_shortest_paths_between_segments_need_no_product(spark):
    n = 40
    graph = Graph((NodeTable(spark.range(n).selectExpr("id", "id as k", "id % 2 = 0 as even"), ("N",)),), (RelTable(spark.range(n - 1).selectExpr("id", "id as source", "id + 1 as target"), "R"),))
    s = GraphSession(spark, graph)
    got = s.query("MATCH (a:N), (b:N), (x:N {k: 3}) WHERE a.even AND b.k > 35 AND x.even = false MATCH p = shortestPath((a)-[*1..4]->(b)) RETURN a.k AS a, b.k AS b, x.k AS x, length(p) AS len")
    assert sorted(got.rows()) == sorted((a, b, 3, b - a) for a in range(0, n, 2) for b in range(36, n) if 1 <= b - a <= 4)
    two = s.query("MATCH (a:N), (b:N) WHERE a.even AND b.k > 35 MATCH p = shortestPath((a)-[*1..4]->(b)) RETURN a.k AS a, b.k AS b")
    plan = two.df._jdf.queryExecution().toString()
    assert len(two.rows()) == 8 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    both = s.query("MATCH (a:N), (b:N) WHERE a.k < 2 AND b.k < 6 AND a.k + b.k = 5 MATCH p = shortestPath((a)-[*]->(b)) RETURN a.k AS a, b.k AS b, length(p) AS len")
    assert sorted(both.rows()) == [(0, 5, 5), (1, 4, 3)]


def stages_graph(spark, monkeypatch):
    """A to B to C, and many D that lead nowhere; all frames that a search checkpoints."""
    node = lambda label, a, b: NodeTable(spark.range(a, b).selectExpr("id", "id as k"), (label,))
    rel = lambda rows, kind, s, t: RelTable(spark.createDataFrame(rows, "id bigint, source bigint, target bigint"), kind, (s,), (t,))
    rels = rel([(1, 0, 10), (2, 0, 11), (3, 1, 11)], "R", "A", "B"), rel([(4, 10, 20), (5, 11, 20), (6, 11, 21), (7, 10, 20)], "S", "B", "C"), rel([(8 + i, 0, 30 + i) for i in range(10)], "T", "A", "D")
    frames, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: frames.append(df) or cut(df))
    return GraphSession(spark, Graph((node("A", 0, 2), node("B", 10, 13), node("C", 20, 23), node("D", 30, 40)), rels)), frames


def test_searches_take_only_what_leads_to_the_end(spark, monkeypatch):
    s, frames = stages_graph(spark, monkeypatch)
    got = s.query("MATCH p = shortestPath((a:A)-[*1..2]-(c:C)) RETURN a.k AS a, length(p) AS len, count(*) AS n").rows()
    assert sorted(got) == [(0, 2, 2), (1, 2, 2)]
    assert max(df.agg({"node": "max"}).first()[0] for df in frames if "node" in df.columns) == 11
    assert sorted(s.query("MATCH p = shortestPath((a:A)-[*1..3]-(c)) RETURN a.k AS a, c.k AS c, length(p) AS len").rows()) == sorted(
        [(0, 10, 1), (0, 11, 1), (0, 20, 2), (0, 21, 2), (0, 1, 2), (1, 11, 1), (1, 20, 2), (1, 21, 2), (1, 0, 2), (1, 10, 3)] + [(a, d, k) for a, k in ((0, 1), (1, 3)) for d in range(30, 40)]
    )


def test_all_shortest_paths_are_counted_without_the_paths(spark, monkeypatch):
    s, frames = stages_graph(spark, monkeypatch)
    for end, want in (("c.k", [(20, 2, 4), (21, 2, 2)]), ("a.k", [(0, 2, 4), (1, 2, 2)]), ("0", [(0, 2, 6)])):
        assert sorted(s.query(f"MATCH p = allShortestPaths((a:A)-[*1..2]-(c:C)) RETURN {end} AS k, length(p) AS len, count(*) AS n").rows()) == want
    assert sorted(s.query("MATCH p = allShortestPaths((a:A)-[*1..2]-(c:C {k: 20})) RETURN a.k AS a, c.k AS c, length(p) AS len").rows()) == [(0, 20, 2)] * 3 + [(1, 20, 2)]
    assert frames and not any("rels" in df.columns for df in frames)
    assert traverse.repeated(spark.sql("select 1 as k, 70000L as times"), "times").count() == 70_000


def test_counted_paths_are_kept_by_node_where_no_level_meets_an_earlier_one(spark, monkeypatch):
    s, frames = stages_graph(spark, monkeypatch)
    assert s.query("MATCH p = allShortestPaths((a:A)-[*1..2]-(c:C)) RETURN c.k AS k, length(p) AS len, count(*) AS n ORDER BY k").rows() == [(20, 2, 4), (21, 2, 2)]
    assert len(frames) == 2 and not any("seed" in df.columns for df in frames) and frames[1].count() == 2
    del frames[:]
    assert sorted(s.query("MATCH p = allShortestPaths((a:A)-[*1..2]-(c:C)) RETURN a.k AS k, length(p) AS len, count(*) AS n").rows()) == [(0, 2, 4), (1, 2, 2)]
    assert all("seed" in df.columns for df in frames)


def test_a_level_leaves_no_shuffle_files(spark):
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    blocks = lambda: {b for b in map(str, (lambda s: [s.apply(i) for i in range(s.size())])(store.getAllBlocks())) if b.startswith("shuffle_")}
    before = blocks()
    level = traverse._level(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count())
    for _ in range(50):  # they are removed in the background
        if not (left := blocks() - before):
            break
        time.sleep(0.1)
    assert not left and level.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("seed", range(2))
def test_counted_paths_where_some_levels_meet(spark, seed):
    """A to B, C and B again, and on to D and E: seeds are needed up to the second level only; against paths listed in Python."""
    rnd = random.Random(seed)
    ids = {label: range(10 * i, 10 * i + 4) for i, label in enumerate("ABCDE")}
    pairs = {kind: [(rnd.choice(ids[kind[0]]), rnd.choice(ids[kind[1]])) for _ in range(7)] for kind in ("AB", "AC", "CB", "CD", "DE")}
    tables = [RelTable(spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(some)], "id bigint, source bigint, target bigint"), kind, (kind[0],), (kind[1],)) for kind, some in pairs.items()]
    graph = Graph(tuple(NodeTable(spark.range(r.start, r.stop).selectExpr("id", "id as k"), (label,)) for label, r in ids.items()), tuple(tables))
    edges, want = [e for some in pairs.values() for e in some], Counter()
    for a in ids["A"]:
        level, seen = Counter([a]), {a}
        for depth in (1, 2, 3):
            ahead: Counter = Counter()
            for s, t in edges:
                if s in level and t not in seen:
                    ahead[t] += level[s]
            seen |= set(ahead)
            level = ahead
            for node, n in level.items():
                want[node, depth] += n
    got = GraphSession(spark, graph).query("MATCH p = allShortestPaths((a:A)-[*1..3]->(e)) RETURN e.k AS k, length(p) AS len, count(*) AS n").rows()
    assert sorted(got) == sorted((*k, n) for k, n in want.items()) and {k[1] for k in want} == {1, 2, 3}


def test_counted_nodes_are_reached_without_pairs(spark, monkeypatch):
    s, frames = stages_graph(spark, monkeypatch)
    text = "MATCH p = shortestPath((a:A)-[*1..2]-(c:C)) RETURN a.k AS a, length(p) AS len, count(*) AS n"
    monkeypatch.setattr(traverse, "MANY_SEEDS", 2)
    monkeypatch.setattr(traverse, "MANY_EDGES", 7)
    got = s.query(text).df
    assert sorted(map(tuple, got.collect())) == [(0, 2, 2), (1, 2, 2)]
    assert len(frames) == 1 and frames[0].count() == 2  # the seeds
    assert "Generate" not in got._jdf.queryExecution().toString()  # no row for a pair that is only counted
    assert s.query(text.replace("count(*)", "count(*) + 0.5")).rows() == [(0, 2, 2.5), (1, 2, 2.5)]
    assert s.query("MATCH p = shortestPath((a:A)-[*1..2]-(c:C)) RETURN sum(length(p)) AS n, count(*) AS m").rows() == [(8, 4)]
    assert s.query("MATCH p = shortestPath((a:A)-[*1..2]->(c:C)) WHERE length(p) = 1 RETURN count(*) AS n").rows() == [(0,)]


@pytest.mark.parametrize("seed", range(2))
def test_counted_nodes_by_arrays_as_by_rows(spark, seed, monkeypatch):
    """Labels that a search meets at several depths, seeds of several labels, and relationships that are there twice."""
    rnd = random.Random(seed)
    ids = {label: range(100 * i, 100 * i + 8) for i, label in enumerate("ABCDE")}
    pairs = {kind: [(rnd.choice(ids[kind[0]]), rnd.choice(ids[kind[1]])) for _ in range(12)] for kind in ("AB", "AC", "BC", "BD", "CD", "CE", "DE")}
    tables = [RelTable(spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(some)], "id bigint, source bigint, target bigint"), kind, (kind[0],), (kind[1],)) for kind, some in pairs.items()]
    graph = Graph(tuple(NodeTable(spark.range(r.start, r.stop).selectExpr("id", "id as k"), (label,)) for label, r in ids.items()), tuple(tables))
    used, numbers = [], reach.numbers
    monkeypatch.setattr(reach, "numbers", lambda *a: used.append(numbers(*a)) or used[-1])
    for text, arrays in (
        ("MATCH p = shortestPath((a)-[*1..4]->(e)) RETURN a.k AS a, length(p) AS len, count(*) AS n", True),
        ("MATCH p = shortestPath((a:A|B)-[*1..3]->(e:D|E)) RETURN a.k AS a, length(p) AS len, count(*) AS n", True),
        ("MATCH (a:A)-[*2..3]->(e) RETURN a.k AS a, count(*) AS n", True),
        ("MATCH p = shortestPath((a:A)-[*1..3]-(e:D)) RETURN a.k AS a, length(p) AS len, count(*) AS n", False),
    ):
        monkeypatch.setattr(traverse, "MANY_SEEDS", 10**9)
        want = sorted(GraphSession(spark, graph).query(text).rows())
        monkeypatch.setattr(traverse, "MANY_SEEDS", 1)
        monkeypatch.setattr(traverse, "MANY_EDGES", 1)
        assert sorted(GraphSession(spark, graph).query(text).rows()) == want and len(want) > 5
        assert (used.pop() is not None) == arrays and not used


@pytest.mark.parametrize("steps", (1, 3, 1 << 20))
def test_searches_some_seeds_at_a_time(steps, monkeypatch):
    """Nodes 0 to 19 of label 1 lead to 30 of label 0, those to 30 of label 2, of which some are known by a shorter way."""
    monkeypatch.setattr(reach, "STEPS", steps)
    rnd = random.Random(steps)
    links = {h: {v: {rnd.randrange(30) for _ in range(rnd.choice((0, 2, 90)))} for v in range(n)} for h, n in ((0, 20), (1, 30), (2, 20))}
    flat = {h: (np.cumsum([0, *(len(some[v]) for v in sorted(some))]), np.array([t for v in sorted(some) for t in sorted(some[v])], np.int32)) for h, some in links.items()}
    starts = [sorted({rnd.randrange(20) for _ in range(3)}) for _ in range(7)]
    search = reach.Search([[(9, 3, 1)], [(0, 1, 0), (2, 1, 2)], [(1, 0, 2)]], flat, {0, 2}, 1, 7)
    search.arrive({1: np.array([k << 32 | v for k, some in enumerate(starts) for v in some])}, {}, 1)
    for k, some in enumerate(starts):
        zero, two = (set().union(*(links[h][v] for v in some)) for h in (0, 2))
        three = set().union(*(links[1][v] for v in zero)) - two
        assert list(search.found[:, k]) == [0, 0, len(zero) + len(two), len(three)]


def test_session_catalogs(spark):
    s = GraphSession(spark, make(spark, [(1, ["A"], "x", 1), (2, ["B"], "y", None)], [(1, 2, "R", 5)]), cached=2)
    for text in ("MATCH (n) RETURN n.name AS n", "MATCH (n:A) RETURN n.name AS n", "MATCH (n:B) RETURN n.name AS n"):
        s.query(text)
    assert len(s._cache) == 2 and s.history(0, 1) == ["MATCH (n:B) RETURN n.name AS n"]
    s.forget(s.history_ids()[0])
    assert s.history(0, 1) == ["MATCH (n:A) RETURN n.name AS n"]
    s.forget()
    assert s.history() == [] and s.size() == (2, 1)
    s.create_index("node", "age")
    s.create_index("rel", "since")
    assert s.indexes() == [("node", "age"), ("rel", "since")] and s.drop_index("rel", "since") and not s.drop_index("rel", "since")
    assert s.clustered().node_frame().count() == 2
    assert sorted(map(tuple, s.graph.label_counts_without("age").collect())) == [("B", 1)]
    s.clear()
    assert s.size() == (0, 0) and s.query("MATCH (n) RETURN count(n) AS n").rows() == [(0,)]
