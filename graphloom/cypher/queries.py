"""Registered queries of the query language, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.model import Graph
from graphloom.session import GraphSession
from graphloom.sources.tables import object_graph, trade_graph

# name: (query, SQL) over the trade graph
TRADE = {
    "flagship_region_balance": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE c.c_acctbal > 0 RETURN r.r_name AS region, count(c) AS customers, round(avg(c.c_acctbal), 4) AS avg_bal ORDER BY customers DESC",
        "SELECT r_name AS region, count(*) AS customers, round(avg(c_acctbal), 4) AS avg_bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 GROUP BY r_name",
    ),
    "scan_label": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name", "SELECT n_nationkey AS k, n_name AS name FROM nation"),
    "scan_label_or": (
        "MATCH (x:Region|Nation) RETURN coalesce(x.r_name, x.n_name) AS name",
        "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation",
    ),
    "scan_all_label_counts": (
        "MATCH (x) WHERE NOT x:User RETURN head(labels(x)) AS label, count(*) AS n",
        "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events",
    ),
    "scan_property_inline": ("MATCH (c:Customer {c_mktsegment: 'BUILDING'}) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "count_nodes": ("MATCH (o:Order) RETURN count(o) AS n", "SELECT count(*) AS n FROM orders"),
    "count_rels": ("MATCH ()-[r:PLACED]->() RETURN count(r) AS n", "SELECT count(*) AS n FROM orders"),
    "types_scan": (
        "MATCH (c:Customer)-[r]-() RETURN DISTINCT type(r) AS t ORDER BY t",
        "SELECT unnest(['IN_NATION', 'PLACED']) AS t",
    ),
    "pred_comparisons": (
        "MATCH (p:Part) WHERE p.p_size >= 10 AND p.p_size < 20 AND p.p_retailprice <> 1000.0 AND NOT p.p_size = 15 RETURN p.p_partkey AS k",
        "SELECT p_partkey AS k FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice <> 1000.0 AND NOT p_size = 15",
    ),
    "pred_chained": ("MATCH (p:Part) WHERE 10 < p.p_size <= 12 RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE 10 < p_size AND p_size <= 12"),
    "pred_null_two_valued": (
        "MATCH (n:Nation) WHERE NOT (n.missing = 1) AND n.missing <> 2 AND n.missing IS NULL RETURN n.n_nationkey AS k",
        "SELECT n_nationkey AS k FROM nation",
    ),
    "pred_mixed_kinds": ("MATCH (n:Nation) WHERE n.n_name = 1 OR n.n_nationkey = '1' RETURN count(*) AS n", "SELECT CAST(0 AS BIGINT) AS n"),
    "pred_strings": (
        "MATCH (p:Part) WHERE p.p_name STARTS WITH 'P' AND p.p_name CONTAINS '1' AND NOT p.p_name ENDS WITH '0' RETURN p.p_name AS name",
        "SELECT p_name AS name FROM part WHERE starts_with(p_name, 'P') AND contains(p_name, '1') AND NOT ends_with(p_name, '0')",
    ),
    "pred_regex": ("MATCH (c:Customer) WHERE c.c_name =~ '0[0-4]$' RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE regexp_matches(c_name, '0[0-4]$')"),
    "pred_in": ("MATCH (n:Nation) WHERE n.n_nationkey IN [1, 3, null, 99] RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (1, 3)"),
    "pred_xor": (
        "MATCH (p:Part) WHERE p.p_size < 10 XOR p.p_retailprice > 1500 RETURN p.p_partkey AS k",
        "SELECT p_partkey AS k FROM part WHERE (p_size < 10) <> (p_retailprice > 1500)",
    ),
    "pred_label": ("MATCH (x)-[:IN_NATION]->(n:Nation {n_nationkey: 3}) WHERE x:Supplier RETURN x.s_suppkey AS k", "SELECT s_suppkey AS k FROM supplier WHERE s_nationkey = 3"),
    "expand_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 RETURN c.c_name AS c, o.o_orderkey AS o", "SELECT c_name AS c, o_orderkey AS o FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000"),
    "expand_in": ("MATCH (o:Order {o_orderstatus: 'F'})<-[:PLACED]-(c:Customer) RETURN c.c_mktsegment AS s, count(o) AS n", "SELECT c_mktsegment AS s, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1"),
    "expand_both": (
        "MATCH (n:Nation)--(x) RETURN n.n_name AS name, count(x) AS n",
        "SELECT n_name AS name, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation",
    ),
    "expand_types": (
        "MATCH (n:Nation)-[r:IN_REGION|IN_NATION]-(x) RETURN type(r) AS t, count(*) AS n",
        "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)",
    ),
    "expand_rel_props": (
        "MATCH (o:Order)-[r:CONTAINS {l_returnflag: 'R'}]->(p:Part) WHERE r.l_quantity > 45 RETURN p.p_brand AS brand, count(*) AS n, round(sum(r.l_quantity), 2) AS q",
        "SELECT p_brand AS brand, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1",
    ),
    "expand_multihop": (
        "MATCH (r:Region)<-[:IN_REGION]-(:Nation)<-[:IN_NATION]-(s:Supplier)-[:SUPPLIES]->(p:Part) RETURN r.r_name AS region, count(DISTINCT p) AS parts",
        "SELECT r_name AS region, count(DISTINCT l_partkey) AS parts FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1",
    ),
    "expand_unique_rels": (
        "MATCH (a:Supplier)-[:SUPPLIES]->(p:Part)<-[:SUPPLIES]-(b:Supplier) WHERE a.s_suppkey < 3 RETURN a.s_suppkey AS a, count(*) AS n",
        "WITH s AS (SELECT DISTINCT l_suppkey k, l_partkey p FROM lineitem) SELECT x.k AS a, count(*) AS n FROM s x JOIN s y ON x.p = y.p AND x.k <> y.k WHERE x.k < 3 GROUP BY 1",
    ),
    "expand_cycle": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier)-[:SUPPLIES]->(p:Part)<-[:CONTAINS]-(o:Order)<-[:PLACED]-(c) RETURN n.n_name AS name, count(*) AS n",
        "WITH s AS (SELECT DISTINCT l_suppkey k, l_partkey p FROM lineitem) SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey JOIN s ON s.k = s_suppkey JOIN lineitem l ON l.l_partkey = s.p JOIN orders ON o_orderkey = l.l_orderkey AND o_custkey = c_custkey GROUP BY 1",
    ),
    "path_functions": (
        "MATCH p = (s:Supplier)-[:IN_NATION]->(:Nation)-[:IN_REGION]->(:Region) WHERE ALL(r IN relationships(p) WHERE type(r) STARTS WITH 'IN') RETURN length(p) AS len, size(nodes(p)) AS n_nodes, [r IN relationships(p) | type(r)][1] AS second, count(*) AS n",
        "SELECT CAST(2 AS BIGINT) AS len, CAST(3 AS BIGINT) AS n_nodes, 'IN_REGION' AS second, count(*) AS n FROM supplier",
    ),
    "cross_join": ("MATCH (a:Region), (b:Region) WHERE a.r_regionkey < b.r_regionkey RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey < b.r_regionkey"),
    "shared_var_join": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN n.n_name AS name, count(*) AS n",
        "SELECT n_name AS name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "two_matches": (
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) MATCH (s:Supplier)-[:IN_NATION]->(n) RETURN r.r_name AS r, count(s) AS n",
        "SELECT r_name AS r, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "entity_inequality": (
        "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) WHERE a <> b RETURN r.r_name AS r, count(*) AS n",
        "SELECT r_name AS r, count(*) AS n FROM region JOIN nation a ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_regionkey = r_regionkey WHERE a.n_nationkey <> b.n_nationkey GROUP BY 1",
    ),
    "optional_match": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 250000 RETURN c.c_custkey AS k, count(o) AS n, max(o.o_totalprice) AS top",
        "SELECT c_custkey AS k, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY 1",
    ),
    "exists_pattern": ("MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {o_orderpriority: '1-URGENT'}) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "not_exists": ("MATCH (p:Part) WHERE NOT EXISTS { MATCH (p)<-[r:CONTAINS]-() WHERE r.l_discount > 0.09 } RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = p_partkey AND l_discount > 0.09)"),
    "exists_in_or": ("MATCH (s:Supplier) WHERE s.s_acctbal < 0 OR (s)-[:IN_NATION]->(:Nation {n_nationkey: 7}) RETURN s.s_suppkey AS k", "SELECT s_suppkey AS k FROM supplier WHERE s_acctbal < 0 OR s_nationkey = 7"),
    "agg_all": (
        "MATCH (o:Order) RETURN o.o_orderstatus AS s, count(*) AS n, round(sum(o.o_totalprice), 2) AS total, round(avg(o.o_totalprice), 4) AS mean, min(o.o_totalprice) AS low, max(o.o_totalprice) AS high",
        "SELECT o_orderstatus AS s, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1",
    ),
    "agg_distinct": ("MATCH (p:Part) RETURN count(DISTINCT p.p_brand) AS brands, sum(DISTINCT p.p_size) AS sizes, count(p.missing) AS none", "SELECT count(DISTINCT p_brand) AS brands, CAST(sum(DISTINCT p_size) AS BIGINT) AS sizes, CAST(0 AS BIGINT) AS none FROM part"),
    "agg_empty": ("MATCH (p:Part) WHERE p.p_size > 1000 RETURN count(*) AS n, sum(p.p_size) AS s, avg(p.p_size) AS a", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(NULL AS DOUBLE) AS a"),
    "agg_collect": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n ORDER BY n.n_nationkey WITH r, collect(n.n_nationkey) AS ks RETURN r.r_name AS r, size(ks) AS n", "SELECT r_name AS r, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "agg_expression": ("MATCH (c:Customer) RETURN c.c_mktsegment AS s, count(c) * 2 + 1 AS n", "SELECT c_mktsegment AS s, count(*) * 2 + 1 AS n FROM customer GROUP BY 1"),
    "distinct": ("MATCH (p:Part) RETURN DISTINCT p.p_brand AS b, p.p_type AS t", "SELECT DISTINCT p_brand AS b, p_type AS t FROM part"),
    "having_with": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 15 RETURN c.c_name AS name, n", "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 15"),
    "with_pipeline": (
        "MATCH (s:Supplier)-[:SUPPLIES]->(p:Part) WITH s, count(p) AS parts ORDER BY parts DESC, s.s_suppkey LIMIT 5 MATCH (s)-[:IN_NATION]->(n:Nation) RETURN s.s_name AS s, parts, n.n_name AS n",
        "WITH t AS (SELECT l_suppkey k, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) SELECT s_name AS s, parts, n_name AS n FROM t JOIN supplier ON s_suppkey = k JOIN nation ON n_nationkey = s_nationkey",
    ),
    "with_distinct": ("MATCH (s:Supplier)-[:IN_NATION]->(n:Nation) WITH DISTINCT n RETURN n.n_nationkey AS k", "SELECT DISTINCT s_nationkey AS k FROM supplier"),
    "sort_skip_limit": ("MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_acctbal AS b ORDER BY b DESC, k SKIP 10 LIMIT 20", "SELECT c_custkey AS k, c_acctbal AS b FROM customer ORDER BY b DESC, k LIMIT 20 OFFSET 10"),
    "sort_hidden": ("MATCH (p:Part) RETURN p.p_name AS name ORDER BY p.p_retailprice, p.p_partkey LIMIT 7", "SELECT p_name AS name FROM part ORDER BY p_retailprice, p_partkey LIMIT 7"),
    "union_all": ("MATCH (r:Region) RETURN r.r_name AS x UNION ALL MATCH (n:Nation) RETURN n.n_name AS x", "SELECT r_name AS x FROM region UNION ALL SELECT n_name FROM nation"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "unwind": ("UNWIND [1, 2, 3] AS x MATCH (n:Nation {n_nationkey: x}) RETURN x, n.n_name AS name", "SELECT CAST(n_nationkey AS BIGINT) AS x, n_name AS name FROM nation WHERE n_nationkey IN (1, 2, 3)"),
    "unwind_collect": ("MATCH (n:Nation) WITH collect(n.n_nationkey) AS ks UNWIND ks AS k RETURN k, k % 5 AS m", "SELECT n_nationkey AS k, n_nationkey % 5 AS m FROM nation"),
    "case_searched": (
        "MATCH (p:Part) RETURN CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'medium' ELSE 'large' END AS size, count(*) AS n",
        "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM part GROUP BY 1",
    ),
    "case_simple": ("MATCH (o:Order) RETURN CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN null THEN 2 ELSE 0 END AS f, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS f, count(*) AS n FROM orders GROUP BY 1"),
    "fn_strings": (
        "MATCH (n:Nation) RETURN toLower(n.n_name) AS lo, toUpper(n.n_name) AS up, size(n.n_name) AS len, substring(n.n_name, 0, 3) AS sub, replace(n.n_name, '_', '-') AS rep, split(n.n_name, '_')[1] AS part, reverse(n.n_name) AS rev, left(n.n_name, 2) + right(n.n_name, 1) AS ends",
        "SELECT lower(n_name) AS lo, upper(n_name) AS up, length(n_name) AS len, substr(n_name, 1, 3) AS sub, replace(n_name, '_', '-') AS rep, split_part(n_name, '_', 2) AS part, reverse(n_name) AS rev, left(n_name, 2) || right(n_name, 1) AS ends FROM nation",
    ),
    "fn_numbers": (
        "MATCH (c:Customer) RETURN c.c_custkey AS k, abs(c.c_acctbal) AS a, floor(c.c_acctbal) AS f, ceil(c.c_acctbal) AS c, sign(c.c_acctbal) AS s, c.c_custkey / 7 AS q, c.c_custkey % 7 AS m, toString(c.c_custkey) AS t, toInteger('12') + 1 AS i",
        "SELECT c_custkey AS k, abs(c_acctbal) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, CAST(sign(c_acctbal) AS BIGINT) AS s, c_custkey // 7 AS q, c_custkey % 7 AS m, CAST(c_custkey AS VARCHAR) AS t, CAST(13 AS BIGINT) AS i FROM customer",
    ),
    "fn_lists": (
        "MATCH (r:Region) WITH range(1, r.r_regionkey + 2) AS l RETURN size(l) AS n, head(l) AS h, last(l) AS e, size([x IN l WHERE x > 1 | x * 2]) AS big, size(l[1..3]) AS cut, any(x IN l WHERE x = 5) AS five, none(x IN l WHERE x > 5) AS small, single(x IN l WHERE x = 2) AS one",
        "SELECT CAST(r_regionkey + 2 AS BIGINT) AS n, CAST(1 AS BIGINT) AS h, CAST(r_regionkey + 2 AS BIGINT) AS e, CAST(r_regionkey + 1 AS BIGINT) AS big, CAST(least(2, r_regionkey + 1) AS BIGINT) AS cut, r_regionkey + 2 >= 5 AS five, r_regionkey + 2 <= 5 AS small, true AS one FROM region",
    ),
    "fn_coalesce": ("MATCH (n:Nation) RETURN coalesce(n.missing, n.n_name, 'x') AS a, n.missing IS NULL AS b", "SELECT n_name AS a, true AS b FROM nation"),
    "varlen_next": (
        "MATCH (e:Event)-[:NEXT_EVENT*1..4]->(f:Event) WHERE e.event_id < 50 RETURN e.event_id AS a, f.event_id AS b",
        "WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT a.event_id AS a, b.event_id AS b FROM x a JOIN x b ON a.user_id = b.user_id AND b.i - a.i BETWEEN 1 AND 4 WHERE a.event_id < 50",
    ),
    "varlen_exact": (
        "MATCH (e:Event)-[r:NEXT_EVENT*3]->(f:Event) WHERE e.event_id < 50 RETURN e.event_id AS a, f.event_id AS b, size(r) AS n",
        "WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT a.event_id AS a, b.event_id AS b, CAST(3 AS BIGINT) AS n FROM x a JOIN x b ON a.user_id = b.user_id AND b.i = a.i + 3 WHERE a.event_id < 50",
    ),
    "shortest_len": (
        "MATCH p = shortestPath((a:Supplier {s_suppkey: 1})-[*1..3]-(b:Customer)) RETURN b.c_custkey AS k, length(p) AS len",
        "WITH near AS (SELECT c_custkey FROM customer JOIN supplier ON s_suppkey = 1 AND c_nationkey = s_nationkey), far AS (SELECT DISTINCT o_custkey FROM lineitem l JOIN lineitem m ON m.l_partkey = l.l_partkey JOIN orders ON o_orderkey = m.l_orderkey WHERE l.l_suppkey = 1) SELECT c_custkey AS k, CAST(2 AS BIGINT) AS len FROM near UNION ALL SELECT o_custkey, 3 FROM far WHERE o_custkey NOT IN (SELECT c_custkey FROM near)",
    ),
    "varlen_next_all": (
        "MATCH (e:Event)-[:NEXT_EVENT*1..4]->(f:Event) RETURN e.event_id AS a, f.event_id AS b",
        "WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT a.event_id AS a, b.event_id AS b FROM x a JOIN x b ON a.user_id = b.user_id AND b.i - a.i BETWEEN 1 AND 4",
    ),
    "varlen_exact_all": (
        "MATCH (e:Event)-[r:NEXT_EVENT*3]->(f:Event) RETURN e.event_id AS a, f.event_id AS b, size(r) AS n",
        "WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT a.event_id AS a, b.event_id AS b, CAST(3 AS BIGINT) AS n FROM x a JOIN x b ON a.user_id = b.user_id AND b.i = a.i + 3",
    ),
    "expand_unique_rels_all": (
        "MATCH (a:Supplier)-[:SUPPLIES]->(p:Part)<-[:SUPPLIES]-(b:Supplier) RETURN a.s_suppkey AS a, count(*) AS n",
        "WITH s AS (SELECT DISTINCT l_suppkey k, l_partkey p FROM lineitem) SELECT x.k AS a, count(*) AS n FROM s x JOIN s y ON x.p = y.p AND x.k <> y.k GROUP BY 1",
    ),
    "shortest_len_all": (
        "MATCH p = shortestPath((a:Supplier)-[*1..3]-(b:Customer)) RETURN a.s_suppkey AS s, length(p) AS len, count(*) AS n",
        "WITH near AS (SELECT s_suppkey AS s, c_custkey AS c FROM customer JOIN supplier ON c_nationkey = s_nationkey), far AS (SELECT DISTINCT l.l_suppkey AS s, o_custkey AS c FROM lineitem l JOIN lineitem m ON m.l_partkey = l.l_partkey JOIN orders ON o_orderkey = m.l_orderkey) SELECT s, CAST(2 AS BIGINT) AS len, count(*) AS n FROM near GROUP BY 1 UNION ALL SELECT s, 3, count(*) FROM far WHERE (s, c) NOT IN (SELECT (s, c) FROM near) GROUP BY 1",
    ),
    "pred_strings_found": (
        "MATCH (p:Part) WHERE p.p_name STARTS WITH 'blue' AND p.p_name CONTAINS 'e b' AND NOT p.p_name ENDS WITH 'x' RETURN p.p_partkey AS k, p.p_name AS name",
        "SELECT p_partkey AS k, p_name AS name FROM part WHERE starts_with(p_name, 'blue') AND contains(p_name, 'e b') AND NOT ends_with(p_name, 'x')",
    ),
    "pred_bare_booleans": (
        "MATCH (c:Customer) WITH c, c.c_acctbal > 0 AS good WHERE good AND true AND NOT false RETURN c.c_custkey AS k, good",
        "SELECT c_custkey AS k, true AS good FROM customer WHERE c_acctbal > 0",
    ),
    "id_lookup": (
        "MATCH (n:Nation) WITH n, id(n) AS i MATCH (m:Nation) WHERE id(m) = i RETURN n.n_nationkey AS a, m.n_nationkey AS b, i = id(m) AS same",
        "SELECT n_nationkey AS a, n_nationkey AS b, true AS same FROM nation",
    ),
    "default_names": ("MATCH (n:Nation) RETURN n.n_name, n.n_nationkey % 3, count(*)", 'SELECT n_name AS "n.n_name", n_nationkey % 3 AS "n.n_nationkey % 3", count(*) AS "count(*)" FROM nation GROUP BY ALL'),
    "return_star": ("MATCH (n:Nation) WITH n.n_name AS name, n.n_nationkey AS k RETURN *", "SELECT n_name AS name, n_nationkey AS k FROM nation"),
    "literals": (
        "MATCH (r:Region) RETURN r.r_regionkey AS k, 1 AS i, -2.5 AS f, 1e3 AS e, 'it\\'s' AS q, \"a\\tb\" AS t, true AS b, null IS NULL AS n, size([1, 2, 3]) AS l, {a: 1, b: 'x'}.b AS m, 0x1F AS h",
        "SELECT r_regionkey AS k, CAST(1 AS BIGINT) AS i, -2.5::DOUBLE AS f, 1000::DOUBLE AS e, 'it''s' AS q, 'a' || chr(9) || 'b' AS t, true AS b, true AS n, CAST(3 AS BIGINT) AS l, 'x' AS m, CAST(31 AS BIGINT) AS h FROM region",
    ),
    "varlen_unique": (
        "MATCH (a:Nation {n_nationkey: 3})-[r:IN_REGION]-(b:Region)-[:IN_REGION*1..2]-(c:Nation) RETURN c.n_nationkey AS k, count(*) AS n",
        "SELECT n_nationkey AS k, count(*) AS n FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) AND n_nationkey <> 3 GROUP BY 1",
    ),
    "varlen_unique_all": (
        "MATCH (a:Nation)-[r:IN_REGION]-(b:Region)-[:IN_REGION*1..2]-(c:Nation) RETURN a.n_nationkey AS a, count(*) AS n",
        "SELECT a.n_nationkey AS a, count(*) AS n FROM nation a JOIN nation c ON a.n_regionkey = c.n_regionkey AND a.n_nationkey <> c.n_nationkey GROUP BY 1",
    ),
    "shortest_all_paths": (
        "MATCH p = allShortestPaths((s:Supplier)-[:SUPPLIES|CONTAINS*1..2]-(o:Order {o_orderstatus: 'P'})) RETURN s.s_suppkey AS s, length(p) AS len, count(*) AS n",
        "SELECT l.l_suppkey AS s, CAST(2 AS BIGINT) AS len, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) l JOIN lineitem m ON m.l_partkey = l.l_partkey JOIN orders ON o_orderkey = m.l_orderkey AND o_orderstatus = 'P' GROUP BY 1",
    ),
    "shortest_target_props": (
        "MATCH p = shortestPath((r:Region)-[*1..2]-(s:Supplier {s_nationkey: 15})) RETURN r.r_name AS r, s.s_suppkey AS s, length(p) AS len",
        "SELECT r_name AS r, s_suppkey AS s, CAST(2 AS BIGINT) AS len FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_nationkey = 15",
    ),
    "shortest_segments": (
        "MATCH (r:Region), (s:Supplier) WHERE r.r_regionkey > 0 AND s.s_acctbal > 0 MATCH p = shortestPath((r)-[:IN_REGION|IN_NATION*1..4]-(s)) RETURN r.r_name AS r, length(p) AS len, count(*) AS n",
        "SELECT r_name AS r, CAST(2 AS BIGINT) AS len, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey > 0 AND s_acctbal > 0 GROUP BY 1",
    ),
    "path_nodes": (
        "MATCH p = (s:Supplier)-[:IN_NATION]->(:Nation)-[:IN_REGION]->(:Region) WHERE s.s_acctbal > 0 RETURN s.s_suppkey AS k, [n IN nodes(p) | head(labels(n))][1] AS label, nodes(p)[1].n_name AS nation, [n IN nodes(p) WHERE (n:Region) | n.r_name][0] AS region",
        "SELECT s_suppkey AS k, 'Nation' AS label, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal > 0",
    ),
    "path_nodes_varlen": (
        "MATCH p = (s:Supplier)-[:IN_NATION|IN_REGION*2..2]->(r:Region) RETURN r.r_name AS region, nodes(p)[1].n_name AS nation, count(*) AS n",
        "SELECT r_name AS region, n_name AS nation, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2",
    ),
    "params": ("MATCH (n:Nation) WHERE n.n_nationkey IN $ks RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (2, 4)"),
}
PARAMS = {"params": {"ks": [2, 4]}}

_EDGES = """
e AS (SELECT source s, target t, rel_type ty FROM graph_edges WHERE source IS NOT NULL AND target IS NOT NULL AND rel_type IS NOT NULL GROUP BY 1, 2, 3),
o AS (SELECT objectid, arg_max(coalesce(label, 'Base'), (loaded_at, id)) AS label, max(CASE WHEN false THEN name END) AS x FROM nodes WHERE objectid IS NOT NULL GROUP BY 1
      UNION ALL SELECT objectid, label, NULL FROM well_known_principals)
"""

# name: (query, SQL) over the object graph
OBJECTS = {
    "objects_rel_types": ("MATCH (a)-[r]->(b) RETURN type(r) AS t, count(*) AS n", f"WITH {_EDGES} SELECT ty AS t, count(*) AS n FROM e JOIN o a ON a.objectid = s JOIN o b ON b.objectid = t GROUP BY 1"),
    "objects_admin_by_label": (
        "MATCH (a)-[:AdminTo|CanRDP]->(c:Computer) RETURN head(labels(a)) AS label, count(DISTINCT a) AS n",
        f"WITH {_EDGES} SELECT a.label, count(DISTINCT s) AS n FROM e JOIN o a ON a.objectid = s JOIN o b ON b.objectid = t AND b.label = 'Computer' WHERE ty IN ('AdminTo', 'CanRDP') GROUP BY 1",
    ),
    "objects_suffix": ("MATCH (g:Group) WHERE g.objectid ENDS WITH '-512' OR g.objectid ENDS WITH '-519' RETURN g.objectid AS id", f"WITH {_EDGES} SELECT objectid AS id FROM o WHERE label = 'Group' AND (ends_with(objectid, '-512') OR ends_with(objectid, '-519'))"),
    "objects_suffix_found": (
        "MATCH (g:Group) WHERE g.objectid ENDS WITH '1' OR g.objectid ENDS WITH '-S-1-5-11' RETURN g.objectid AS id",
        f"WITH {_EDGES} SELECT objectid AS id FROM o WHERE label = 'Group' AND (ends_with(objectid, '1') OR ends_with(objectid, '-S-1-5-11'))",
    ),
    "objects_shortest_risk": (
        "MATCH (d:Domain), (c:Computer) MATCH p = shortestPath((d)-[:Contains*1..4]->(c)) WHERE ALL(r IN relationships(p) WHERE r.exploit_likelihood >= 0.1) RETURN d.objectid AS d, length(p) AS len, count(*) AS n",
        # every object has one container, so there is one path
        f"""WITH RECURSIVE {_EDGES}, c AS (SELECT source s, target t, arg_min(try_cast(json_extract_string(properties, '$.exploit_likelihood') AS DOUBLE) IS NOT NULL AND try_cast(json_extract_string(properties, '$.exploit_likelihood') AS DOUBLE) >= 0.1, (loaded_at, edge_id)) AS ok
             FROM graph_edges WHERE rel_type = 'Contains' AND source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2),
        w(s, t, d, ok) AS (SELECT s, t, 1, ok FROM c UNION SELECT w.s, c.t, d + 1, w.ok AND c.ok FROM w JOIN c ON c.s = w.t WHERE d < 4), m AS (SELECT s, t, min(d) AS d, arg_min(ok, d) AS ok FROM w GROUP BY 1, 2)
        SELECT s AS d, CAST(d AS BIGINT) AS len, count(*) AS n FROM m JOIN o a ON a.objectid = s AND a.label = 'Domain' JOIN o b ON b.objectid = t AND b.label = 'Computer' WHERE ok GROUP BY s, m.d""",
    ),
    "objects_members_varlen": (
        "MATCH (u:User)-[:MemberOf*1..3]->(g:Group) RETURN g.objectid AS id, count(u) AS n",
        f"WITH RECURSIVE {_EDGES}, w(s, t, d) AS (SELECT s, t, 1 FROM e WHERE ty = 'MemberOf' UNION SELECT w.s, e.t, d + 1 FROM w JOIN e ON e.s = w.t AND e.ty = 'MemberOf' WHERE d < 3) SELECT t AS id, count(DISTINCT w.s) AS n FROM w JOIN o a ON a.objectid = w.s AND a.label = 'User' JOIN o b ON b.objectid = w.t AND b.label = 'Group' WHERE w.s <> w.t GROUP BY 1",
    ),
    "objects_shortest_filtered": (
        "MATCH (d:Domain), (c:Computer) MATCH p = shortestPath((d)-[:Contains*1..4]->(c)) WHERE ALL(r IN relationships(p) WHERE r.exploit_likelihood >= 0.0 OR r.exploit_likelihood IS NULL) RETURN length(p) AS len, count(*) AS n",
        f"WITH RECURSIVE {_EDGES}, w(s, t, d) AS (SELECT s, t, 1 FROM e WHERE ty = 'Contains' UNION SELECT w.s, e.t, d + 1 FROM w JOIN e ON e.s = w.t AND e.ty = 'Contains' WHERE d < 4), m AS (SELECT s, t, min(d) AS d FROM w GROUP BY 1, 2) SELECT CAST(d AS BIGINT) AS len, count(*) AS n FROM m JOIN o a ON a.objectid = s AND a.label = 'Domain' JOIN o b ON b.objectid = t AND b.label = 'Computer' GROUP BY 1",
    ),
}


_GRAPHS: dict[tuple, Graph] = {}


def _graph(make: Callable, spark: SparkSession, d: str) -> Graph:
    """The graph's table plans, made once per application and folder (no data is kept)."""
    key = (make.__name__, spark.sparkContext.applicationId, d)
    if key not in _GRAPHS:
        _GRAPHS[key] = make(spark, d)
    return _GRAPHS[key]


def _query(make: Callable, text: str, params: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: GraphSession(spark, _graph(make, spark, d)).query(text, **params).df


QUERIES = {f"q_{n}": _query(trade_graph, q, PARAMS.get(n, {})) for n, (q, _) in TRADE.items()} | {f"q_{n}": _query(object_graph, q, {}) for n, (q, _) in OBJECTS.items()}
ORACLE = {f"q_{n}": sql for n, (_, sql) in (TRADE | OBJECTS).items()}
