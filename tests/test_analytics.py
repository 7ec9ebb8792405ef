"""Graph analytics and the import of collector files on small graphs."""

import json
import random

import pytest

from graphloom.operators import analytics, graph_queries
from graphloom.operators.betweenness import whole_graph_scores
from graphloom.operators.traverse import bfs, distances
from graphloom.session import GraphSession
from graphloom.sources import collector


def graph(spark, pairs, names=None):
    ids = sorted({x for p in pairs for x in p[:2]} | set(names or ()))
    nodes = spark.createDataFrame([(i, f"name {i}", (names or {}).get(i, "User")) for i in ids], "id string, name string, label string")
    edges = spark.createDataFrame([(k, *p[:2], p[2] if len(p) > 2 else "NEXT") for k, p in enumerate(pairs)], "id bigint, source string, target string, rel_type string")
    return nodes, edges


def scores(df):
    return {(r.source, r.target): r.score for r in df.collect()}


def test_betweenness_chain_star_types(spark):
    chain = graph(spark, [("A", "B"), ("B", "C"), ("C", "D")])
    assert scores(analytics.edge_betweenness(*chain)) == {("A", "B"): 3.0, ("B", "C"): 4.0, ("C", "D"): 3.0}
    assert scores(analytics.edge_betweenness(*chain, directed=False)) == {("A", "B"): 3.0, ("B", "C"): 4.0, ("C", "D"): 3.0}
    star = graph(spark, [("X", c) for c in "abcd"])
    assert set(scores(analytics.edge_betweenness(*star, directed=False)).values()) == {4.0}
    typed = graph(spark, [("A", "B", "IMPORTANT"), ("B", "C", "TRIVIAL")])
    assert scores(analytics.edge_betweenness(*typed, types=["IMPORTANT"])) == {("A", "B"): 1.0}
    assert scores(analytics.edge_betweenness(*graph(spark, [("A", "B"), ("A", "B"), ("B", "C")]))) != {}
    top = analytics.choke_points(chain[0], analytics.edge_betweenness(*chain), 1).collect()
    assert [(r.source_name, r.target_name, r.score) for r in top] == [("name B", "name C", 4.0)]
    assert scores(analytics.edge_betweenness(chain[0], chain[1].limit(0))) == {}


def brandes(n, pairs):
    """Plain version, directed, parallel edges apart."""
    out = [0.0] * len(pairs)
    for s in range(n):
        dist, sigma, order, preds = {s: 0}, {s: 1.0}, [], {}
        queue = [s]
        while queue:
            v = queue.pop(0)
            order.append(v)
            for k, (a, b) in enumerate(pairs):
                if a == v:
                    if b not in dist:
                        dist[b] = dist[v] + 1
                        queue.append(b)
                    if dist[b] == dist[v] + 1:
                        sigma[b] = sigma.get(b, 0) + sigma[v]
                        preds.setdefault(b, []).append((v, k))
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v, k in preds.get(w, []):
                c = sigma[v] / sigma[w] * (1 + delta[w])
                delta[v] += c
                out[k] += c
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_random(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(8), rnd.randrange(8)) for _ in range(18)]
    nodes, edges = graph(spark, [(str(a), str(b)) for a, b in pairs], {str(i): "N" for i in range(8)})
    got = {r.id: r.score for r in analytics.edge_betweenness(nodes, edges).collect()}
    assert [got[k] for k in range(len(pairs))] == pytest.approx(brandes(8, pairs))


def test_betweenness_needs_no_round_of_joins_a_level(spark, monkeypatch):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(150)] + [(i, i + 1) for i in range(40, 46)] + [(3, 3), (5, 40), (5, 40)]
    nodes, edges = graph(spark, [(str(a), str(b)) for a, b in pairs], {"alone": "N"})
    edges = edges.unionByName(edges.selectExpr("-1L as id", "cast(null as string) as source", "target", "rel_type").limit(1))
    rows = {(w, d): {r.id: r.score for r in _betweenness(monkeypatch, w, nodes, edges, d)} for w in (0, 1_000) for d in (True, False)}
    for d in (True, False):
        assert rows[0, d] == pytest.approx(rows[1_000, d]) and rows[1_000, d][-1] == 0.0 and len(rows[0, d]) == len(pairs) + 1
    assert [rows[1_000, True][k] for k in range(len(pairs))] == pytest.approx(brandes(47, pairs))
    clash = spark.createDataFrame([(1, 7, 8, 1 << 32 | 2), (2, 7, 9, 2 << 32 | 3)], "id bigint, src bigint, dst bigint, check bigint")
    assert whole_graph_scores(clash, [7]) is None and whole_graph_scores(clash.where("id = 1"), [7]).collect() == [(1, 1.0)]


def _betweenness(monkeypatch, whole, nodes, edges, directed):
    def no_rounds(df):
        raise AssertionError("a round of joins")

    with monkeypatch.context() as m:
        m.setattr(analytics, "WHOLE_GRAPH", whole, raising=False)
        if whole:
            m.setattr(analytics, "cut", no_rounds)
        return analytics.edge_betweenness(nodes, edges, directed).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    pairs = [(f"{rnd.randrange(60):02}", f"{rnd.randrange(60):02}") for _ in range(40)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)]
    nodes, edges = graph(spark, pairs, {"alone": "N"})
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    assert {r.id: r.component for r in analytics.connected_components(edges, nodes).collect()} == {r.id: find(r.id) for r in nodes.collect()}
    assert analytics.connected_components(edges.limit(0)).count() == 0


def test_reaching_and_counts(spark):
    pairs = [("u1", "g1", "MemberOf"), ("g1", "da-512", "MemberOf"), ("u2", "c1", "AdminTo"), ("c1", "u1", "HasSession"), ("u2", "c1", "GenericAll"), ("x", "x", "MemberOf")]
    nodes, edges = graph(spark, pairs, {"g1": "Group", "da-512": "Group", "c1": "Computer"})
    seeds = nodes.where("id = 'da-512'").selectExpr("id as node")
    assert {r.node: r.hops for r in analytics.reaching(edges, seeds).collect()} == {"da-512": 0, "g1": 1, "u1": 2, "c1": 3, "u2": 4}
    assert {r.node for r in analytics.reaching(edges, seeds, ["MemberOf"]).collect()} == {"da-512", "g1", "u1"}
    assert tuple(analytics.reach_report(nodes, edges).first()) == (3, 1, 2, 4)
    degrees = {r.id: tuple(r)[1:] for r in analytics.degree_table(nodes, edges).collect()}
    assert degrees["u2"] == (0, 1, 1, 0, 0) and degrees["u1"] == (1, 1, 0, 1, 0) and degrees["g1"] == (1, 1, 0, 1, 1)
    assert analytics.connections(edges, "u2", "admin").count() == 2 and analytics.connections(edges, "g1", "members").count() == 1
    assert [r.id for r in analytics.search(nodes, "NAME U").collect()] == ["u1", "u2"] and analytics.search(nodes, "n").count() == 0
    assert [r.id for r in analytics.resolve(nodes, "name g1").collect()] == ["g1"]
    assert analytics.edges_between(edges, nodes.where("label = 'Group'")).count() == 1
    new = spark.createDataFrame([("u1", "New", None, 2), ("u1", "Newer", None, 3), ("z", "Zed", "Base", 1)], "id string, name string, label string, n int")
    assert {r.id: (r.name, r.label) for r in analytics.upsert_nodes(nodes, new, "n").collect() if r.id in ("u1", "z")} == {"u1": ("Newer", "User"), "z": ("Zed", "Base")}
    assert analytics.insert_edges(edges, edges.withColumn("id", edges.id + 10)).count() == edges.count()


def test_bfs_pairs_and_all(spark):
    edges = spark.createDataFrame([(1, 2, 10), (1, 3, 11), (2, 4, 12), (3, 4, 13), (4, 1, 14)], "src bigint, dst bigint, i bigint").selectExpr("src", "dst", "struct(i as id) as rel")
    seeds = spark.createDataFrame([(1,), (9,), (None,)], "seed bigint")
    every = bfs(edges, seeds, paths=True, every=True)
    assert sorted((r.node, r.depth, [x.id for x in r.rels]) for r in every.collect()) == [(2, 1, [10]), (3, 1, [11]), (4, 2, [10, 12]), (4, 2, [11, 13])]
    pairs = spark.createDataFrame([(1, 4)], "seed bigint, node bigint")
    assert [(r.seed, r.node, r.depth) for r in bfs(edges, seeds, pairs=pairs).collect()] == [(1, 4, 2)]
    assert {r.node: r.hops for r in distances(edges, spark.createDataFrame([(2,), (3,)], "node bigint")).collect()} == {2: 0, 3: 0, 4: 1, 1: 2}


def entity(ident, **more):
    return {"ObjectIdentifier": ident, "Properties": {"name": f"N-{ident}", **more.pop("props", {})}, **more}


def member(ident, kind="User"):
    return {"ObjectIdentifier": ident, "ObjectType": kind}


FILES = {
    "groups": [entity("G1", Members=[member("U1"), member("U9"), None, 5]), entity("G2", Members=None)],
    "Users": [entity("U1", PrimaryGroupSID="G2", AllowedToDelegate=[member("C1", "Computer")], props={"useraccountcontrol": 0x80002}), entity("U2", PrimaryGroupSID="", ContainedBy=member("OU1", "OU"))],
    "computers": [
        entity(
            "C1",
            Sessions={"Results": [{"UserSID": "U1"}]},
            PrivilegedSessions=[{"UserSID": "U2"}],
            LocalGroups=[{"Name": "x", "ObjectIdentifier": "C1-544", "Results": [member("G1")]}, None, {"Name": "Remote Desktop Users", "Results": [member("U2")]}, {"Name": "other", "Results": [member("U1")]}],
            AllowedToAct=[member("C2")],
            props={"unconstraineddelegation": True, "domainsid": "D1"},
        )
    ],
    "domains": [
        entity(
            "D1",
            Aces=[{"PrincipalSID": "G1", "RightName": "GetChanges", "IsInherited": True}, {"PrincipalSID": "G1", "RightName": "GetChangesAll"}, {"PrincipalSID": "D1", "RightName": "Owns"}, {"PrincipalSID": "U1", "RightName": "Odd"}],
            Links=[{"GUID": "P1", "IsEnforced": True}],
            Trusts=[{"TargetDomainSid": "D2", "TargetDomainName": "TWO", "TrustDirection": 3, "TrustType": "ParentChild"}, {"TargetDomainSid": "D3", "TrustDirection": "Inbound", "TrustType": 2}],
        )
    ],
    "enterprisecas": [entity("CA1", HostingComputer="C1", EnabledCertTemplates=[member("T1")], CARegistryData={"CASecurity": {"Data": [{"PrincipalSID": "G1", "RightName": "Enroll"}, {"PrincipalSID": "G1", "RightName": "Owns"}]}, "CertChain": [member("R1")]}, props={"domainsid": "D1"})],
    "ntauthstores": [entity("NT1", DomainSID="D1", NTAuthCertificates=[member("CA1")])],
    "rootcas": [entity("R1", DomainSID="D1")],
}
EDGES = {
    ("U1", "G1", "MemberOf"), ("U9", "G1", "MemberOf"), ("U1", "G2", "MemberOf"), ("U1", "C1", "AllowedToDelegate"), ("OU1", "U2", "Contains"), ("C1", "U1", "HasSession"), ("C1", "U2", "HasSession"),
    ("G1", "C1", "AdminTo"), ("U2", "C1", "CanRDP"), ("C2", "C1", "AllowedToAct"), ("C1", "D1", "CoerceToTGT"), ("G1", "D1", "GetChanges"), ("G1", "D1", "GetChangesAll"), ("P1", "D1", "GPLink"),
    ("D1", "D2", "SameForestTrust"), ("D2", "D1", "SameForestTrust"), ("D3", "D1", "CrossForestTrust"), ("D1-501", "D1-S-1-1-0", "MemberOf"), ("D1-513", "D1-S-1-5-11", "MemberOf"), ("D1-515", "D1-S-1-5-11", "MemberOf"),
    ("D1-S-1-5-11", "D1-S-1-1-0", "MemberOf"), ("T1", "CA1", "PublishedTo"), ("C1", "CA1", "HostsCAService"), ("CA1", "D1", "EnterpriseCAFor"), ("CA1", "R1", "IssuedSignedBy"), ("G1", "CA1", "Enroll"),
    ("NT1", "D1", "NTAuthStoreFor"), ("CA1", "NT1", "TrustedForNTAuth"), ("R1", "D1", "RootCAFor"), ("G1", "D1", "DCSync"), ("U1", "D1", "DCSync"), ("U9", "D1", "DCSync"),
}


def test_collector_import(spark):
    data = [(i, json.dumps({"meta": {"type": t}, "data": e})) for i, (t, e) in enumerate(FILES.items())] + [(90, "broken {"), (0, json.dumps({"meta": {"type": "groups"}, "data": FILES["groups"]}))]
    nodes, edges = collector.collector_tables(spark.createDataFrame(data, "file_id bigint, content string"))
    assert {(r.source, r.target, r.rel_type) for r in edges.collect()} == EDGES
    by_id = {r.id: r for r in nodes.collect()}
    assert (by_id["U1"].label, by_id["U1"].enabled, by_id["U1"].trusted_for_delegation, by_id["U1"].useraccountcontrol_hex) == ("User", False, True, "0x80002")
    assert (by_id["U9"].label, by_id["U9"].placeholder, by_id["D2"].label, by_id["D2"].name) == ("Base", True, "Domain", "TWO")
    assert by_id["D1-513"].domain == "N-D1" and by_id["C1"].domain is None and len(by_id) == nodes.count()
    flags = {(r.source, r.rel_type): (r.inherited, r.enforced) for r in edges.collect()}
    assert flags[("G1", "GetChanges")] == (True, None) and flags[("P1", "GPLink")] == (None, True)


def test_read_files_and_archives(spark, tmp_path):
    import zipfile

    (tmp_path / "a.json").write_text(json.dumps({"meta": {"type": "groups"}, "data": FILES["groups"]}))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("c.json", json.dumps({"meta": {"type": "users"}, "data": FILES["Users"]}))
        z.writestr("readme.txt", "no")
    (tmp_path / "bad.zip").write_text("no archive")
    files = collector.read_collector_files(spark, str(tmp_path))
    (tmp_path / "wide.json").write_bytes(json.dumps({"meta": {"type": "ous"}, "data": []}).encode("utf-16"))
    (tmp_path / "bytes.json").write_bytes(b"\xff\xfa{}")
    files = collector.read_collector_files(spark, str(tmp_path))
    good, errors = files.where("error is null"), {r.file_name.rsplit("/", 1)[1]: r.error for r in files.where("error is not null").collect()}
    assert good.count() == 3 and files.select("file_id").distinct().count() == 5
    assert sorted(errors) == ["bad.zip", "bytes.json"] and "BadZipFile" in errors["bad.zip"] and "UnicodeDecodeError" in errors["bytes.json"]
    assert collector.entity_nodes(collector.collector_rows(files)).count() == 4


def test_betweenness_of_all_labels_and_types(spark, tmp_path):
    t = "timestamp'2024-01-01'"
    spark.sql(f"select * from values (1L, 'u', 'u', 'User'), (2L, 'g', 'g', 'Group'), (3L, 'c', 'c', 'Computer') as n(id, objectid, name, label)").selectExpr("*", f"{t} as loaded_at", "cast(null as timestamp) as deleted_at", "cast(null as string) as properties").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.sql("select 'w' as objectid, 'w' as name, 'Group' as label").write.parquet(f"{tmp_path}/well_known_principals.parquet")
    links = spark.sql("select * from values (1L, 'u', 'g', 'MemberOf'), (2L, 'g', 'c', 'AdminTo'), (3L, 'c', 'w', 'Contains') as e(edge_id, source, target, rel_type)")
    links.selectExpr("*", f"{t} as loaded_at", "'{}' as properties").write.parquet(f"{tmp_path}/graph_edges.parquet")
    got = {r.rel_type: r.score for r in graph_queries.QUERIES["g_edge_betweenness"](spark, str(tmp_path)).collect()}
    assert got == {"MemberOf": 3.0, "AdminTo": 4.0, "Contains": 3.0}


def test_properties_names_and_columns_of_imported_nodes(spark):
    def entity(i, **props):
        return {"ObjectIdentifier": i, "Properties": {"objectid": "no", "name": None, **props}, "Members": [{"ObjectIdentifier": "D-1-7"}]}

    data = [entity("D-1", name="ONE", Level=3, List=["a"], none=None, empty=[], Deep={"x": 1}), entity("D-1-5", level=4, on=True, name="D-1-5")]
    files = [(1, json.dumps({"meta": {"type": "domains"}, "data": data[:1]})), (2, json.dumps({"meta": {"type": "groups"}, "data": data[1:]}))]
    df = spark.createDataFrame(files, "file_id bigint, content string")
    nodes = {r.id: r for r in collector.collector_tables(df)[0].collect()}
    assert nodes["D-1"].properties == {"Level": "3", "List": '["a"]', "Deep": '{"x": 1}'} and nodes["D-1-5"].properties == {"level": "4", "on": "true"}
    assert (nodes["D-1"].name, nodes["D-1-5"].name, nodes["D-1-7"].name, nodes["D-1-7"].domain) == ("ONE", "ONE-5", "ONE-7", "ONE")
    graph = collector.collector_graph(spark, df)
    assert GraphSession(spark, graph).query("MATCH (n)<-[:MemberOf]-(m) WHERE n.level > 3 RETURN n.level + 1 AS l, n.on AS o, m.name AS m").rows() == [(5, True, "ONE-7")]


def test_upsert_properties(spark):
    shape = "id string, labels array<string>, properties map<string,string>"
    old = spark.createDataFrame([("a", ["Base"], {"placeholder": "true", "x": "1", "y": "2"}), ("b", ["User"], {"x": "1"}), (None, ["N"], {})], shape)
    new = spark.createDataFrame([("a", ["User"], {"x": None, "z": "3"}, 1), ("b", ["Base"], {"placeholder": "true"}, 2), ("a", ["User", "Admin"], {"z": "4"}, 2), ("c", [], {}, 1), (None, ["N"], {"k": "v"}, 1)], shape + ", o int")
    got = sorted(((r.id or "", r.labels, r.properties) for r in analytics.upsert_properties(old, new, "o").collect()), key=lambda x: (x[0], len(x[2])))
    assert got == [("", ["N"], {}), ("", ["N"], {"k": "v"}), ("a", ["Admin", "Base", "User"], {"y": "2", "z": "4"}), ("b", ["Base", "User"], {"placeholder": "true", "x": "1"}), ("c", [], {})]
    assert analytics.upsert_properties(old.limit(0), new.limit(0), "o").count() == 0
