"""The registered queries of problems 1 to 5 and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import drift, heavy, hierarchy, nested, references
from graphloom.runtime import table

def _contains(spark, d):
    return table(spark, d, "graph_edges").where("rel_type = 'Contains'")


def p1_found(spark, d):
    return nested.nested_items(table(spark, d, "collector_files")).select("file_id", "entity_pos", "array_path", "item_pos")


def p1_files(spark, d):
    return nested.files(table(spark, d, "collector_files"))


def p1_entities(spark, d):
    return nested.entities(table(spark, d, "collector_files"), ["ObjectIdentifier", "Properties.name", "Properties.domainsid", "PrimaryGroupSID"])


def p1_aces(spark, d):
    return nested.child_table(table(spark, d, "collector_files"), "Aces", ["PrincipalSID", "RightName", "PrincipalType", "IsInherited"])


def p1_local_group_members(spark, d):
    return nested.child_table(table(spark, d, "collector_files"), "LocalGroups.Results", ["ObjectIdentifier", "ObjectType"])


def p1_items(spark, d):
    return nested.all_items(table(spark, d, "collector_files"))


def p2_found(spark, d):
    return hierarchy.hierarchy(_contains(spark, d), "source", "target", with_path=False).select(F.col("node").alias("objectid"), "root_id", "depth")


def p2_hierarchy(spark, d):
    full = hierarchy.hierarchy(_contains(spark, d), "source", "target")
    return full.select(F.col("node").alias("objectid"), "root_id", "depth", "subtree_size", F.array_join("path", "/").alias("path"))


def p2_descendants(spark, d):
    """Without nodes on a cycle or below one, as its SQL has it; ``p2_descendants_all`` has all."""
    return hierarchy.tree_descendants(hierarchy.hierarchy(_contains(spark, d), "source", "target"))


def p2_descendants_all(spark, d):
    return hierarchy.descendants(hierarchy.hierarchy(_contains(spark, d), "source", "target"))


def _orphans(spark, d):
    return references.edge_orphans(table(spark, d, "graph_edges"), table(spark, d, "nodes"), table(spark, d, "well_known_principals"))


def p3_found(spark, d):
    return _orphans(spark, d).select("edge_id", "endpoint", "kind")


def p3_report(spark, d):
    return references.orphan_report(_orphans(spark, d), "graph_edges")


def p4_found(spark, d):
    return drift.schema_changes(table(spark, d, "collector_files"))


def p4_trusts(spark, d):
    return drift.consistent_table(table(spark, d, "collector_files"), typed=True)


def p4_moves(spark, d):
    """The whole edit scripts, with nested fields and moves, counted by change and depth."""
    return drift.all_changes(table(spark, d, "collector_files")).groupBy("change", "depth").agg(F.count("*").alias("n"))


def p5_found(spark, d):
    return heavy.dominant_keys(table(spark, d, "graph_edges"), ["target", "rel_type"], "source", "loaded_at", 0.015).select("target", "rel_type")


def p5_summary(spark, d):
    found = heavy.skewed_summary(table(spark, d, "graph_edges"), ["target", "rel_type"], "source", "loaded_at")
    return found.select("target", "rel_type", "n_rows", "n_distinct", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


QUERIES = {f.__name__: f for f in (p1_found, p1_files, p1_entities, p1_aces, p1_local_group_members, p1_items, p2_found, p2_hierarchy, p2_descendants, p2_descendants_all, p3_found, p3_report, p4_found, p4_trusts, p4_moves, p5_found, p5_summary)}

_REFS = """
n AS (SELECT DISTINCT * FROM nodes), e AS (SELECT DISTINCT * FROM graph_edges),
r AS (SELECT edge_id, 'source' AS endpoint, source AS k, loaded_at AS t FROM e UNION ALL SELECT edge_id, 'target', target, loaded_at FROM e),
j AS (SELECT edge_id, endpoint, t, k, count(n.objectid) AS rows_of,
             coalesce(bool_or(n.loaded_at <= t AND (n.deleted_at IS NULL OR n.deleted_at > t)), false) AS present,
             coalesce(bool_or(n.deleted_at <= t), false) AS gone
      FROM r LEFT JOIN n ON n.objectid = r.k WHERE k IS NOT NULL AND k NOT IN (SELECT objectid FROM well_known_principals)
      GROUP BY edge_id, endpoint, t, k),
o AS (SELECT edge_id, endpoint, t, CASE WHEN rows_of = 0 THEN 'missing' WHEN gone THEN 'deleted' ELSE 'late' END AS kind FROM j WHERE NOT present)
"""

_LINKS = """
l AS (SELECT target AS node, min(source) AS parent FROM graph_edges WHERE rel_type = 'Contains' AND source IS NOT NULL AND target IS NOT NULL GROUP BY target),
v AS (SELECT node FROM l UNION SELECT parent FROM l),
up(node, anc, dist) AS (SELECT node, node, 0 FROM v UNION SELECT up.node, l.parent, dist + 1 FROM up JOIN l ON l.node = up.anc WHERE dist < 400),
top AS (SELECT node, max(dist) AS depth FROM up GROUP BY node),
roots AS (SELECT up.node, up.anc AS root_id, up.dist AS depth FROM up JOIN top ON up.node = top.node AND up.dist = top.depth WHERE up.anc NOT IN (SELECT node FROM l)),
loops AS (SELECT a.node, min(b.anc) AS root_id FROM (SELECT node, anc FROM up WHERE dist = 400) a JOIN up b ON b.node = a.anc GROUP BY a.node)
"""

_CLOSURE = """
l AS (SELECT target AS node, min(source) AS parent FROM graph_edges WHERE rel_type = 'Contains' AND source IS NOT NULL AND target IS NOT NULL GROUP BY target),
down(anc, node, dist) AS (SELECT parent, node, 1 FROM l UNION SELECT d.anc, l.node, dist + 1 FROM down d JOIN l ON l.parent = d.node WHERE dist < 400),
bad AS (SELECT DISTINCT node FROM down WHERE dist = 400)
"""

_DOCS = """
f AS (SELECT DISTINCT file_id, CASE WHEN content[1] = chr(65279) THEN content[2:] ELSE content END AS c FROM collector_files),
v AS (SELECT file_id, c::JSON AS j FROM f WHERE json_valid(c))
"""

_ENTITIES = f"""{_DOCS},
a AS (SELECT file_id, json_transform(j->'data', '["JSON"]') AS l FROM v WHERE json_type(j->'data') = 'ARRAY'),
x AS (SELECT file_id, unnest(l) AS x, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS entity_pos FROM a)
"""


def _children(path: str) -> str:
    """SQL for the elements of one array field of the entities: c with the key columns and the element i."""
    return f"""{_ENTITIES}, b AS (SELECT file_id, entity_pos, json_transform(json_extract(x, '{path}'), '["JSON"]') AS l FROM x WHERE json_type(x) = 'OBJECT' AND json_type(json_extract(x, '{path}')) = 'ARRAY'),
    c AS (SELECT file_id, entity_pos, unnest(l) AS i, CAST(generate_subscripts(l, 1) - 1 AS VARCHAR) AS item_pos FROM b)"""


_CHANGES = """
f AS (SELECT DISTINCT file_id, collector, collected_at, CASE WHEN content[1] = chr(65279) THEN content[2:] ELSE content END AS c FROM collector_files),
v AS (SELECT file_id, collector, collected_at, c::JSON AS j FROM f WHERE json_valid(c)),
d AS (SELECT * FROM v WHERE j->>'$.meta.type' = 'domains'),
m AS (SELECT file_id, 'meta' AS part, '' AS place, j->'meta' AS o, unnest(json_keys(j->'meta')) AS name FROM d),
e AS (SELECT file_id, unnest(json_transform(j->'data', '["JSON"]')) AS x FROM d WHERE json_type(j->'data') = 'ARRAY'),
t AS (SELECT file_id, who, unnest(l) AS o, generate_subscripts(l, 1) AS pos FROM (SELECT file_id, x->>'$.ObjectIdentifier' AS who, json_transform(x->'Trusts', '["JSON"]') AS l FROM e WHERE json_type(x) = 'OBJECT' AND json_type(x->'Trusts') = 'ARRAY')),
p AS (SELECT file_id, part, place, name, json_extract(o, '$."' || name || '"') AS val FROM (FROM m UNION ALL SELECT file_id, 'Trusts', who || chr(10) || pos, o, unnest(json_keys(o)) FROM t WHERE json_type(o) = 'OBJECT')),
q AS (SELECT *, CASE WHEN json_type(val) IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN 'number' ELSE json_type(val) END AS ty, CASE WHEN json_type(val) IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN CAST(CAST(val AS DOUBLE) AS VARCHAR) ELSE lower(CAST(val AS VARCHAR)) END AS vk FROM p WHERE json_type(val) <> 'NULL'),
fld AS (SELECT file_id, part, name, string_agg(DISTINCT ty, ',' ORDER BY ty) AS types FROM q GROUP BY ALL),
s AS (SELECT file_id, lag(file_id) OVER (PARTITION BY collector ORDER BY collected_at, file_id) AS prev FROM d),
a AS (SELECT s.file_id, prev, part, name, types FROM s JOIN fld ON fld.file_id = prev),
b AS (SELECT s.file_id, prev, part, name, types FROM s JOIN fld USING (file_id) WHERE prev IS NOT NULL),
gone AS (SELECT * FROM a ANTI JOIN b USING (file_id, part, name)), came AS (SELECT * FROM b ANTI JOIN a USING (file_id, part, name)),
pair AS (SELECT g.file_id, g.part, g.name AS o, c.name AS n FROM gone g JOIN came c USING (file_id, part, types) JOIN q x ON x.file_id = g.prev AND x.part = g.part AND x.name = g.name
         JOIN q y ON y.file_id = g.file_id AND y.part = g.part AND y.name = c.name AND y.place = x.place GROUP BY ALL HAVING bool_and(x.vk = y.vk)),
changes AS (SELECT file_id, part || '.' || a.name AS field, '' AS new_field, 'retyped' AS change FROM a JOIN b USING (file_id, part, name) WHERE a.types <> b.types
  UNION ALL SELECT file_id, part || '.' || o, part || '.' || n, 'renamed' FROM pair
  UNION ALL SELECT file_id, part || '.' || name, '', 'removed' FROM gone WHERE (file_id, part, name) NOT IN (SELECT (file_id, part, o) FROM pair)
  UNION ALL SELECT file_id, part || '.' || name, '', 'added' FROM came WHERE (file_id, part, name) NOT IN (SELECT (file_id, part, n) FROM pair))
"""


def _flag(*names: str) -> str:
    """SQL for a yes or no of a trust, however it is written, by the first of several names that is there."""
    return "coalesce(" + ", ".join(f"lower(CASE WHEN json_type(i->'$.{n}') = 'OBJECT' THEN i->>'$.{n}.raw' ELSE i->>'$.{n}' END) IN ('true', '1')" for n in names) + ")"


ORACLE = {
    "p4_found": f"WITH {_CHANGES} SELECT file_id, field, new_field, change FROM changes",
    "p4_moves": f"WITH {_CHANGES} SELECT change, CAST(1 AS INTEGER) AS depth, count(*) AS n FROM changes GROUP BY change",  # no nested change up to this size
    # the names that are renamed up to this size
    "p4_trusts": f"""WITH {_children('$.Trusts')}, own AS (SELECT c.* FROM c JOIN v USING (file_id) WHERE lower(j->>'$.meta.type') = 'domains' AND json_type(i) = 'OBJECT')
SELECT file_id, entity_pos, item_pos, i->>'$.CreatedAt' AS createdat, {_flag('IsTransitive')} AS istransitive, {_flag('SidFilteringEnabled', 'SidFiltering')} AS sidfilteringenabled, i->>'$.TargetDomainName' AS targetdomainname,
  coalesce(i->>'$.TargetDomainSid', i->>'$.TargetDomainSID', i->>'$.TargetSid') AS targetdomainsid, i->>'$.TrustAttributes' AS trustattributes,
  CASE i->>'$.TrustDirection' WHEN '0' THEN 'Disabled' WHEN '1' THEN 'Inbound' WHEN '2' THEN 'Outbound' WHEN '3' THEN 'Bidirectional' ELSE i->>'$.TrustDirection' END AS trustdirection, i->>'$.TrustType' AS trusttype, CAST(NULL AS VARCHAR) AS conflicts FROM own""",
    "p1_entities": f"WITH {_ENTITIES} SELECT file_id, entity_pos, x->>'$.ObjectIdentifier' AS objectidentifier, x->>'$.Properties.name' AS properties_name, x->>'$.Properties.domainsid' AS properties_domainsid, x->>'$.PrimaryGroupSID' AS primarygroupsid FROM x WHERE json_type(x) = 'OBJECT'",
    "p1_aces": f"WITH {_children('$.Aces')} SELECT file_id, entity_pos, item_pos, i->>'$.PrincipalSID' AS principalsid, i->>'$.RightName' AS rightname, i->>'$.PrincipalType' AS principaltype, i->>'$.IsInherited' AS isinherited FROM c WHERE json_type(i) = 'OBJECT'",
    "p1_local_group_members": f"""WITH {_children('$.LocalGroups')}, m AS (SELECT file_id, entity_pos, item_pos, json_transform(json_extract(i, '$.Results'), '["JSON"]') AS l FROM c WHERE json_type(i) = 'OBJECT' AND json_type(json_extract(i, '$.Results')) = 'ARRAY'),
    n AS (SELECT file_id, entity_pos, item_pos || '.' || CAST(generate_subscripts(l, 1) - 1 AS VARCHAR) AS item_pos, unnest(l) AS i FROM m) SELECT file_id, entity_pos, item_pos, i->>'$.ObjectIdentifier' AS objectidentifier, i->>'$.ObjectType' AS objecttype FROM n WHERE json_type(i) = 'OBJECT'""",
    "p1_found": f"""WITH {_DOCS}, t AS (SELECT file_id, k.fullkey AS key FROM v, json_tree(v.j) k WHERE k.type = 'OBJECT' AND regexp_matches(k.fullkey, '^\\$\\.data\\[\\d+\\]\\..*\\]$'))
SELECT file_id, CAST(regexp_extract(key, '^\\$\\.data\\[(\\d+)\\]', 1) AS INTEGER) AS entity_pos, regexp_replace(regexp_replace(key, '^\\$\\.data\\[\\d+\\]\\.', ''), '\\[\\d+\\]', '', 'g') AS array_path,
       array_to_string(regexp_extract_all(regexp_replace(key, '^\\$\\.data\\[\\d+\\]\\.', ''), '\\[(\\d+)\\]', 1), '.') AS item_pos FROM t""",
    "p1_files": f"WITH {_DOCS} SELECT file_id, json_valid(c) AS valid, CASE WHEN json_valid(c) THEN lower(c->>'$.meta.type') END AS data_type, CASE WHEN json_valid(c) THEN c->>'$.meta.version' END AS version, CASE WHEN json_valid(c) THEN CAST(json_array_length(c->'data') AS INTEGER) ELSE 0 END AS n_elements, CASE WHEN json_valid(c) THEN CAST(len(list_filter(json_transform(c->'data', '[\"JSON\"]'), lambda x: json_type(x) = 'OBJECT')) AS INTEGER) ELSE 0 END AS n_entities FROM f",
    "p2_descendants": f"WITH RECURSIVE {_CLOSURE} SELECT anc AS ancestor, node, CAST(dist AS INTEGER) AS distance FROM down WHERE node NOT IN (SELECT node FROM bad)",
    "p2_descendants_all": f"WITH RECURSIVE {_CLOSURE} SELECT anc AS ancestor, node, CAST(min(dist) AS INTEGER) AS distance FROM down WHERE anc <> node GROUP BY 1, 2",
    "p2_hierarchy": f"""WITH RECURSIVE {_CLOSURE},
below AS (SELECT anc AS node, count(DISTINCT node) AS n FROM down WHERE anc <> node GROUP BY 1),
v AS (SELECT node FROM l UNION SELECT parent FROM l),
t(node, root_id, depth, path) AS (SELECT node, node, 0, node FROM v WHERE node NOT IN (SELECT node FROM l) UNION ALL SELECT l.node, root_id, depth + 1, path || '/' || l.node FROM t JOIN l ON l.parent = t.node),
far AS (SELECT DISTINCT node, anc FROM down WHERE dist = 400),
loops AS (SELECT far.node, min(least(far.anc, o.anc)) AS root_id FROM far JOIN down o ON o.node = far.anc GROUP BY far.node),
every AS (SELECT node, root_id, depth, path FROM t UNION ALL SELECT node, root_id, -1, NULL FROM loops)
SELECT every.node AS objectid, root_id, CAST(depth AS INTEGER) AS depth, coalesce(n, 0) + 1 AS subtree_size, path FROM every LEFT JOIN below ON below.node = every.node""",
    "p2_found": f"WITH RECURSIVE {_LINKS} SELECT node AS objectid, root_id, CAST(depth AS INTEGER) AS depth FROM roots UNION ALL SELECT node, root_id, -1 FROM loops",
    "p3_found": f"WITH {_REFS} SELECT edge_id, endpoint, kind FROM o",
    "p3_report": f"WITH {_REFS} SELECT 'graph_edges' AS table_name, endpoint, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month, kind, count(*) AS n_orphans FROM o GROUP BY ALL",
    "p5_found": "SELECT target, rel_type FROM graph_edges WHERE target IS NOT NULL AND rel_type IS NOT NULL GROUP BY target, rel_type HAVING count(*) >= 0.015 * (SELECT count(*) FROM graph_edges)",
    "p5_summary": "SELECT target, rel_type, count(*) AS n_rows, count(DISTINCT source) AS n_distinct, epoch_us(min(loaded_at)) AS first_us, epoch_us(max(loaded_at)) AS last_us FROM graph_edges GROUP BY target, rel_type",
}
