"""Registered queries of graph analytics and of the import of collector files, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators import analytics
from graphloom.runtime import cut, table
from graphloom.sources import collector
from graphloom.sources.tables import object_edges, object_graph


def _objects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, name, label) and edges (id, source, target, rel_type) of the object graph."""
    g = object_graph(spark, d)
    nodes = g.node_frame().select("id", "name", "label")
    return nodes, g.rels[0].df


def g_components(spark, d):
    nodes, edges = _objects(spark, d)
    return analytics.connected_components(edges, nodes)


def g_reaching(spark, d):
    nodes, edges = _objects(spark, d)
    seeds = nodes.where("id like '%S-1-5-11'").select(F.col("id").alias("node"))
    return analytics.reaching(edges, seeds, without=["Contains"])


def g_reach_report(spark, d):
    nodes, edges = _objects(spark, d)
    return analytics.reach_report(nodes, edges, "S-1-5-11")


def g_out_neighbours(spark, d):
    return analytics.out_neighbours(_objects(spark, d)[1])


def g_degrees(spark, d):
    return analytics.degree_table(*_objects(spark, d))


def g_search(spark, d):
    return analytics.search(_objects(spark, d)[0].dropDuplicates(["id"]), "pel")


def g_connections(spark, d):
    return analytics.connections(_objects(spark, d)[1], "S-1-5-11", "members").select("source", "target", "rel_type")


def g_edges_between(spark, d):
    nodes, edges = _objects(spark, d)
    return analytics.edges_between(edges, nodes.where("label = 'Computer' or label = 'Group'")).select("source", "target", "rel_type")


def g_label_report(spark, d):
    return analytics.label_report(*_objects(spark, d))


def g_edge_betweenness(spark, d):
    """Betweenness of every edge of the object graph, whatever its type, from a sample of 100 of all nodes as sources."""
    nodes, _ = _objects(spark, d)
    return analytics.edge_betweenness(nodes, object_edges(spark, d)).withColumn("score", F.round("score", 6))


def i_edges(spark, d):
    return collector.collector_tables(table(spark, d, "collector_files"))[1]


def i_nodes(spark, d):
    return collector.collector_tables(table(spark, d, "collector_files"))[0].drop("properties")


def i_node_names(spark, d):
    return i_nodes(spark, d).select("id", "name", "label", "placeholder", "domain")


def i_properties(spark, d):
    """All properties of the imported nodes, lists joined by a comma."""
    nodes = collector.collector_tables(table(spark, d, "collector_files"))[0]
    text = F.when(F.startswith("value", F.lit("[")), F.array_join(F.from_json("value", "array<string>"), ",")).otherwise(F.col("value"))
    return nodes.select("id", F.explode("properties").alias("key", "value")).select("id", "key", text.alias("value"))


def i_edge_list(spark, d):
    return i_edges(spark, d).select("source", "target", "rel_type")


def u_upsert(spark, d):
    """All loads of the nodes table merged in order into an empty graph: id, key, value."""
    loads = table(spark, d, "nodes").distinct().select(F.col("objectid").alias("id"), F.array(F.coalesce("label", F.lit("Base"))).alias("labels"), F.from_json("properties", "map<string,string>").alias("properties"), F.struct("loaded_at", F.col("id").alias("n")).alias("o"))
    merged = analytics.upsert_properties(loads.limit(0), loads.where("id is not null"), "o")
    return merged.select("id", F.array_join("labels", ",").alias("labels"), F.explode_outer("properties").alias("key", "value"))


def u_insert_edges(spark, d):
    """Edges loaded in the first half inserted before those of the second: types and numbers of distinct edges."""
    edges = table(spark, d, "graph_edges").where("source is not null and target is not null and rel_type is not null").select("source", "target", "rel_type", "edge_id")
    return analytics.insert_edges(edges.where("edge_id % 2 = 0").dropDuplicates(["source", "target", "rel_type"]), edges.where("edge_id % 2 = 1")).groupBy("rel_type").agg(F.count("*").alias("n"))


def _some_user(spark, d) -> str:
    """The user with the smallest id among the members of the principal all users are in."""
    nodes, edges = _objects(spark, d)
    users = nodes.where("label = 'User'").select(F.col("id").alias("source"))
    return edges.where("rel_type = 'MemberOf' and target = 'S-1-5-11'").join(users, "source", "left_semi").agg(F.min("source")).first()[0]


def g_members(spark, d):
    nodes, edges = _objects(spark, d)
    groups = nodes.where("id like '%S-1-5-11'").select(F.col("id").alias("node"))
    return analytics.members_of(nodes, edges, groups, "User").select("id", "hops")


def g_memberships(spark, d):
    nodes, edges = _objects(spark, d)
    return analytics.memberships(nodes, edges, _some_user(spark, d)).select("id", "hops")


def g_is_member(spark, d):
    edges, who = _objects(spark, d)[1], _some_user(spark, d)
    return spark.createDataFrame([(g, analytics.is_member_of(edges, who, g)) for g in ("S-1-5-11", "S-1-1-0", "S-0")], "id string, member boolean")


def g_path(spark, d):
    nodes, edges = _objects(spark, d)
    return analytics.shortest_path(nodes, edges, _some_user(spark, d), "S-1-5-11")


def g_resolve(spark, d):
    return analytics.resolve(_objects(spark, d)[0].dropDuplicates(["id"]), "S-1-5-11")


def i_edge_counts(spark, d):
    return i_edges(spark, d).groupBy("rel_type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (g_components, g_reaching, g_reach_report, g_out_neighbours, g_degrees, g_search, g_connections, g_edges_between, g_label_report, g_edge_betweenness, i_edges, i_nodes, i_edge_counts, i_node_names, i_properties, i_edge_list, u_upsert, u_insert_edges, g_resolve, g_members, g_memberships, g_is_member, g_path)}

_BASE = """
e AS (SELECT source s, target t, rel_type ty FROM graph_edges WHERE source IS NOT NULL AND target IS NOT NULL AND rel_type IS NOT NULL GROUP BY 1, 2, 3),
o AS (SELECT objectid id, arg_max({name: name, label: coalesce(label, 'Base')}, (loaded_at, id)) AS v FROM nodes WHERE objectid IS NOT NULL GROUP BY 1),
n AS (SELECT id, v.name AS name, v.label AS label FROM o UNION ALL SELECT objectid, name, label FROM well_known_principals)
"""
_ADMIN = ", ".join(f"'{t}'" for t in analytics.ADMIN_TYPES)
_DOCS = """
f AS (SELECT DISTINCT file_id, CASE WHEN content[1] = chr(65279) THEN content[2:] ELSE content END AS c FROM collector_files),
v AS (SELECT file_id, c::JSON AS j FROM f WHERE json_valid(c)),
ent AS (SELECT file_id, lower(j->>'$.meta.type') AS ty, unnest(json_transform(j->'data', '["JSON"]')) AS x FROM v),
me AS (SELECT file_id, ty, x, x->>'$.ObjectIdentifier' AS me FROM ent WHERE json_type(x) = 'OBJECT' AND x->>'$.ObjectIdentifier' <> '')
"""

ORACLE = {
    "g_out_neighbours": f"WITH {_BASE} SELECT s AS source, count(DISTINCT t) AS n_targets FROM e WHERE ty <> 'MemberOf' GROUP BY 1",
    "g_degrees": f"WITH {_BASE}, a AS (SELECT s AS id, count(DISTINCT t) AS o, count(DISTINCT CASE WHEN ty = 'MemberOf' THEN t END) AS m, count(DISTINCT CASE WHEN ty IN ({_ADMIN}) AND t IN (SELECT id FROM n WHERE label = 'Computer') THEN t END) AS c FROM e GROUP BY 1), "
    "b AS (SELECT t AS id, count(DISTINCT s) AS i, count(DISTINCT CASE WHEN ty = 'MemberOf' THEN s END) AS m FROM e GROUP BY 1) "
    "SELECT n.id, coalesce(b.i, 0) AS incoming, coalesce(a.o, 0) AS outgoing, coalesce(a.c, 0) AS admin_to, coalesce(a.m, 0) AS member_of, coalesce(b.m, 0) AS members FROM n LEFT JOIN a USING (id) LEFT JOIN b USING (id)",
    "g_search": f"WITH {_BASE} SELECT id, name, label FROM n WHERE contains(lower(name), 'pel') OR contains(lower(id), 'pel') ORDER BY CASE label WHEN 'Domain' THEN 0 WHEN 'User' THEN 1 WHEN 'Group' THEN 2 WHEN 'Computer' THEN 3 ELSE 4 END, lower(name), id LIMIT 50",
    "g_connections": f"WITH {_BASE} SELECT s AS source, t AS target, ty AS rel_type FROM e WHERE t = 'S-1-5-11' AND ty = 'MemberOf'",
    "g_edges_between": f"WITH {_BASE}, k AS (SELECT id FROM n WHERE label IN ('Computer', 'Group')) SELECT s AS source, t AS target, ty AS rel_type FROM e WHERE s IN (SELECT id FROM k) AND t IN (SELECT id FROM k)",
    "g_label_report": f"WITH {_BASE} SELECT 'node' AS kind, label AS name, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'relationship', ty, count(*) FROM e GROUP BY ALL",
    "g_reaching": f"WITH RECURSIVE {_BASE}, r(id, d) AS (SELECT id, 0 FROM n WHERE ends_with(id, 'S-1-5-11') UNION SELECT e.s, d + 1 FROM r JOIN e ON e.t = r.id AND e.ty <> 'Contains' WHERE d < 12) SELECT id AS node, CAST(min(d) AS INTEGER) AS hops FROM r GROUP BY 1",
    "g_reach_report": f"WITH RECURSIVE {_BASE}, m(id) AS (SELECT id FROM n WHERE ends_with(id, 'S-1-5-11') UNION SELECT e.s FROM m JOIN e ON e.t = m.id AND e.ty = 'MemberOf'), "
    "r(id, d) AS (SELECT id, 0 FROM n WHERE ends_with(id, 'S-1-5-11') UNION SELECT e.s, d + 1 FROM r JOIN e ON e.t = r.id WHERE d < 12), x AS (SELECT id, min(d) AS d FROM r GROUP BY 1), us AS (SELECT id FROM n WHERE label = 'User') "
    "SELECT (SELECT count(*) FROM us) AS n_nodes, (SELECT count(*) FROM us JOIN m USING (id)) AS n_member, count(*) AS n_any, max(d) AS most_hops FROM us JOIN x USING (id)",
}


def i_member_edges(spark, d):
    return collector.entity_edges(collector.collector_rows(table(spark, d, "collector_files"))).where("rel_type in ('MemberOf', 'GPLink', 'AllowedToDelegate')").select("source", "target", "rel_type")


QUERIES["i_member_edges"] = i_member_edges
ORACLE["i_member_edges"] = f"""WITH {_DOCS},
list AS (SELECT me, unnest(json_transform(x->'Members', '["JSON"]')) AS m, 'Members' AS kind, ty FROM me WHERE json_type(x->'Members') = 'ARRAY'
         UNION ALL SELECT me, unnest(json_transform(x->'Links', '["JSON"]')), 'Links', ty FROM me WHERE json_type(x->'Links') = 'ARRAY'
         UNION ALL SELECT me, unnest(json_transform(x->'AllowedToDelegate', '["JSON"]')), 'Delegate', ty FROM me WHERE json_type(x->'AllowedToDelegate') = 'ARRAY'),
pairs AS (SELECT CASE kind WHEN 'Members' THEN m->>'$.ObjectIdentifier' WHEN 'Links' THEN m->>'$.GUID' ELSE me END AS source, CASE kind WHEN 'Delegate' THEN m->>'$.ObjectIdentifier' ELSE me END AS target,
                 CASE kind WHEN 'Members' THEN 'MemberOf' WHEN 'Links' THEN 'GPLink' ELSE 'AllowedToDelegate' END AS rel_type FROM list
          UNION ALL SELECT me, x->>'$.PrimaryGroupSID', 'MemberOf' FROM me
          UNION ALL SELECT me || p.a, me || p.b, 'MemberOf' FROM me, (VALUES ('-501', '-S-1-1-0'), ('-513', '-S-1-5-11'), ('-515', '-S-1-5-11'), ('-S-1-5-11', '-S-1-1-0')) p(a, b) WHERE ty IN ('domains', 'domain'))
SELECT DISTINCT source, target, rel_type FROM pairs WHERE source <> '' AND target <> ''"""


_LABEL = "CASE regexp_replace(ty, 's$', '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in collector.LABELS.items()) + " ELSE 'Base' END"
_IN = lambda names: ", ".join(f"'{n}'" for n in names)
_GROUP = " ".join(f"WHEN ends_with(g, '{k}') THEN '{v}'" for k, v in collector.LOCAL_GROUP_SUFFIXES.items()) + " " + " ".join(f"WHEN contains(upper(gn), '{k}') THEN '{v}'" for k, v in collector.LOCAL_GROUP_NAMES.items())


def _list(path: str, of: str = "me", more: str = "") -> str:
    return f"(SELECT me, label{more}, unnest(json_transform(json_extract(x, '{path}'), '[\"JSON\"]')) AS i FROM {of} WHERE json_type(json_extract(x, '{path}')) = 'ARRAY')"


_SESSIONS = " UNION ALL ".join(f"SELECT me, i->>'$.UserSID', 'HasSession' FROM {_list(p)}" for a in ("Sessions", "PrivilegedSessions", "RegistrySessions") for p in (f"$.{a}", f"$.{a}.Results"))
_IMPORT = f"""{_DOCS.replace("me AS (", "me0 AS (")}, me AS (SELECT me, x, ty, file_id, {_LABEL} AS label FROM me0),
lg AS (SELECT me, label, g, gn, unnest(json_transform(r, '["JSON"]')) AS i FROM (SELECT me, label, i->>'$.ObjectIdentifier' AS g, i->>'$.Name' AS gn, i->'Results' AS r FROM {_list('$.LocalGroups')}) WHERE json_type(r) = 'ARRAY'),
tr AS (SELECT me, i->>'$.TargetDomainSid' AS o, lower(i->>'$.TrustDirection') AS dir, CASE WHEN lower(i->>'$.TrustType') IN ({_IN(collector.SAME_FOREST)}) THEN 'SameForestTrust' ELSE 'CrossForestTrust' END AS k FROM {_list('$.Trusts')}),
raw(s, t, k) AS (
SELECT i->>'$.ObjectIdentifier', me, 'MemberOf' FROM {_list('$.Members')} UNION ALL {_SESSIONS}
UNION ALL SELECT i->>'$.ObjectIdentifier', me, CASE {_GROUP} END FROM lg
UNION ALL SELECT i->>'$.PrincipalSID', me, i->>'$.RightName' FROM {_list('$.Aces')} WHERE i->>'$.RightName' IN ({_IN(collector.RIGHTS)}) AND i->>'$.PrincipalSID' <> me
UNION ALL SELECT me, i->>'$.ObjectIdentifier', 'AllowedToDelegate' FROM {_list('$.AllowedToDelegate')} UNION ALL SELECT i->>'$.ObjectIdentifier', me, 'AllowedToAct' FROM {_list('$.AllowedToAct')}
UNION ALL SELECT i->>'$.GUID', me, 'GPLink' FROM {_list('$.Links')}
UNION ALL SELECT me, o, k FROM tr WHERE dir IN ('2', '3', 'outbound', 'bidirectional') UNION ALL SELECT o, me, k FROM tr WHERE dir IN ('1', '3', 'inbound', 'bidirectional')
UNION ALL SELECT i->>'$.ObjectIdentifier', me, 'PublishedTo' FROM {_list('$.EnabledCertTemplates')} WHERE label = 'EnterpriseCA'
UNION ALL SELECT me, i->>'$.ObjectIdentifier', 'IssuedSignedBy' FROM {_list('$.CARegistryData.CertChain')} WHERE label = 'EnterpriseCA'
UNION ALL SELECT i->>'$.PrincipalSID', me, i->>'$.RightName' FROM {_list('$.CARegistryData.CASecurity.Data')} WHERE label = 'EnterpriseCA' AND i->>'$.RightName' IN ({_IN(collector.CA_RIGHTS)}) AND i->>'$.PrincipalSID' <> me
UNION ALL SELECT i->>'$.ObjectIdentifier', me, 'TrustedForNTAuth' FROM {_list('$.NTAuthCertificates')} WHERE label = 'NTAuthStore'
UNION ALL SELECT me, x->>'$.PrimaryGroupSID', 'MemberOf' FROM me UNION ALL SELECT x->>'$.ContainedBy.ObjectIdentifier', me, 'Contains' FROM me
UNION ALL SELECT me || p.a, me || p.b, 'MemberOf' FROM me, (VALUES {", ".join(f"('{a}', '{b}')" for a, b in collector.IMPLIED_MEMBERS)}) p(a, b) WHERE label = 'Domain'
UNION ALL SELECT x->>'$.HostingComputer', me, 'HostsCAService' FROM me WHERE label = 'EnterpriseCA' UNION ALL SELECT me, x->>'$.Properties.domainsid', 'EnterpriseCAFor' FROM me WHERE label = 'EnterpriseCA'
UNION ALL SELECT me, x->>'$.DomainSID', 'RootCAFor' FROM me WHERE label = 'RootCA' UNION ALL SELECT me, x->>'$.DomainSID', 'NTAuthStoreFor' FROM me WHERE label = 'NTAuthStore'
UNION ALL SELECT me, x->>'$.Properties.domainsid', 'CoerceToTGT' FROM me WHERE label = 'Computer' AND x->>'$.Properties.unconstraineddelegation' = 'true'),
found AS (SELECT DISTINCT s, t, k FROM raw WHERE s <> '' AND t <> '' AND k IS NOT NULL),
held AS (SELECT s, t, k FROM found WHERE k IN ('GetChanges', 'GetChangesAll')),
every AS (FROM found UNION ALL SELECT s, t, 'DCSync' FROM (FROM held UNION ALL SELECT m.s, h.t, h.k FROM held h JOIN found m ON m.k = 'MemberOf' AND m.t = h.s) GROUP BY s, t HAVING count(DISTINCT k) = 2)"""
ORACLE["i_edge_list"] = f"WITH {_IMPORT} SELECT s AS source, t AS target, k AS rel_type FROM every"
ORACLE["i_edge_counts"] = f"WITH {_IMPORT} SELECT k AS rel_type, count(*) AS n FROM every GROUP BY 1"
_LAST = """lm AS (SELECT file_id, ty, x, pos, x->>'$.ObjectIdentifier' AS me FROM (SELECT file_id, ty, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM (SELECT file_id, lower(j->>'$.meta.type') AS ty, json_transform(j->'data', '["JSON"]') AS l FROM v)) WHERE json_type(x) = 'OBJECT' AND x->>'$.ObjectIdentifier' <> ''),
b AS (SELECT me AS id, arg_max(x, (file_id, pos)) AS x, arg_max(coalesce(ty, ''), (file_id, pos)) AS ty FROM lm GROUP BY 1)"""
ORACLE["i_node_names"] = f"""WITH {_IMPORT}, {_LAST}, known AS (SELECT id, coalesce(x->>'$.Properties.name', id) AS name, {_LABEL} AS label, false AS placeholder FROM b),
ends AS (SELECT s AS id FROM every UNION SELECT t FROM every), tn AS (SELECT i->>'$.TargetDomainSid' AS id, min(i->>'$.TargetDomainName') AS name FROM {_list('$.Trusts')} WHERE i->>'$.TargetDomainName' IS NOT NULL GROUP BY 1),
whole AS (FROM known UNION ALL SELECT ends.id, coalesce(tn.name, ends.id), CASE WHEN tn.id IS NULL THEN 'Base' ELSE 'Domain' END, true FROM ends LEFT JOIN tn USING (id) WHERE ends.id NOT IN (SELECT id FROM known)),
d AS (SELECT id AS did, name AS domain FROM whole WHERE label = 'Domain' AND name IS NOT NULL),
near AS (SELECT w.id, arg_max({{did: did, domain: domain}}, length(did)) AS d FROM whole w JOIN d ON w.id = did OR starts_with(w.id, did || '-') GROUP BY 1)
SELECT w.id, CASE WHEN w.name = w.id AND d.domain <> d.did AND NOT starts_with(d.domain, 'S-1-') AND w.id <> d.did THEN d.domain || w.id[length(d.did) + 1:] ELSE w.name END AS name, label, placeholder, d.domain AS domain FROM whole w LEFT JOIN near USING (id)"""
ORACLE["i_properties"] = f"""WITH {_DOCS}, {_LAST}, k AS (SELECT id, x->'Properties' AS p, unnest(json_keys(x->'Properties')) AS key FROM b WHERE json_type(x->'Properties') = 'OBJECT'),
r AS (SELECT id, key, json_extract(p, '$."' || key || '"') AS val FROM k WHERE key NOT IN ('objectid', 'name', 'label'))
SELECT id, key, CASE WHEN json_type(val) = 'ARRAY' THEN array_to_string(json_transform(val, '["VARCHAR"]'), ',') ELSE val->>'$' END AS value FROM r WHERE json_type(val) <> 'NULL' AND NOT (json_type(val) = 'ARRAY' AND json_array_length(val) = 0)"""
ORACLE["u_upsert"] = """WITH n AS (SELECT DISTINCT * FROM nodes WHERE objectid IS NOT NULL), k AS (SELECT objectid AS id, loaded_at, id AS i, properties::JSON AS p, unnest(json_keys(properties::JSON)) AS key FROM n WHERE properties IS NOT NULL),
w AS (SELECT id, key, arg_max({v: json_extract_string(p, '$."' || key || '"')}, (loaded_at, i)) AS v FROM k GROUP BY 1, 2), l AS (SELECT objectid AS id, string_agg(DISTINCT coalesce(label, 'Base'), ',' ORDER BY coalesce(label, 'Base')) AS labels FROM n GROUP BY 1)
SELECT l.id, labels, x.key, x.v.v AS value FROM l LEFT JOIN (FROM w WHERE w.v.v IS NOT NULL) x ON x.id = l.id"""
ORACLE["u_insert_edges"] = "SELECT rel_type, count(DISTINCT (source, target)) AS n FROM graph_edges WHERE source IS NOT NULL AND target IS NOT NULL AND rel_type IS NOT NULL GROUP BY 1"
ORACLE["g_resolve"] = f"WITH {_BASE} SELECT id, name, label FROM n WHERE id = 'S-1-5-11' OR name = 'S-1-5-11' ORDER BY id = 'S-1-5-11' DESC, id LIMIT 1"
ORACLE["g_components"] = f"""WITH RECURSIVE {_BASE}, u AS (SELECT s AS a, t AS b FROM e UNION SELECT t, s FROM e), r(id, c, d) AS (SELECT id, id, 0 FROM n UNION SELECT u.b, min(r.c), d + 1 FROM r JOIN u ON u.a = r.id WHERE d < 12 GROUP BY u.b, d)
SELECT n.id, min(c) AS component FROM n JOIN r USING (id) GROUP BY 1"""
_WHO = "who AS (SELECT min(s) AS id FROM e JOIN n ON n.id = s AND label = 'User' WHERE t = 'S-1-5-11' AND ty = 'MemberOf')"
_UP = f"{_WHO}, up(id, d) AS (SELECT id, 0 FROM who UNION SELECT e.t, d + 1 FROM up JOIN e ON e.s = up.id AND ty = 'MemberOf' WHERE d < 80)"
ORACLE["g_members"] = f"WITH RECURSIVE {_BASE}, m(id, d) AS (SELECT id, 0 FROM n WHERE ends_with(id, 'S-1-5-11') UNION SELECT e.s, d + 1 FROM m JOIN e ON e.t = m.id AND ty = 'MemberOf' WHERE d < 80), x AS (SELECT id, min(d) AS d FROM m GROUP BY 1) SELECT id, CAST(d AS INTEGER) AS hops FROM x JOIN n USING (id) WHERE label = 'User' AND d > 0"
ORACLE["g_memberships"] = f"WITH RECURSIVE {_BASE}, {_UP} SELECT id, CAST(min(d) AS INTEGER) AS hops FROM up GROUP BY 1 HAVING min(d) > 0"
ORACLE["g_is_member"] = f"WITH RECURSIVE {_BASE}, {_UP} SELECT id, id IN (SELECT id FROM up WHERE d > 0) AS member FROM (VALUES ('S-1-5-11'), ('S-1-1-0'), ('S-0')) v(id)"
# the path has one step
ORACLE["g_path"] = f"WITH {_BASE}, {_WHO}, r AS (SELECT arg_min(rel_type, (loaded_at, edge_id)) AS ty FROM (SELECT rel_type, min(edge_id) AS edge_id, min(loaded_at) AS loaded_at FROM graph_edges WHERE source = (SELECT id FROM who) AND target = 'S-1-5-11' GROUP BY 1)) SELECT CAST(0 AS INTEGER) AS step, id, name, label, CAST(NULL AS VARCHAR) AS rel_type FROM n JOIN who USING (id) UNION ALL SELECT 1, id, name, label, ty FROM n, r WHERE id = 'S-1-5-11'"
