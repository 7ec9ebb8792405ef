"""Generated graphs, streams and result extraction."""

import pytest

from graphloom.session import GraphSession
from graphloom.sources.generator import TOPOLOGIES, topology
from graphloom.sources.tables import object_graph
from graphloom.streaming.ingest import daily_counts, ingest, read_edges

EDGE = "edge_id bigint, source string, target string, rel_type string, observed_at timestamp, loaded_at timestamp"


@pytest.mark.parametrize("kind", TOPOLOGIES)
def test_topologies(spark, kind):
    g = topology(spark, kind, 50)
    first, again = (sorted(map(tuple, x.rels[0].df.collect())) for x in (g, topology(spark, kind, 50)))
    assert first == again and g.nodes[0].df.count() == 50
    n = GraphSession(spark, g).query("MATCH (a {id: 0}) RETURN count(a)").rows()
    assert n == [(0,)]  # id is no property
    reached = GraphSession(spark, g).query("MATCH (a)-[:LINK*1..3]->(b) WHERE id(a) = 0 RETURN count(b)").rows()[0][0]
    assert reached == {"long_chain": 3, "wide_fanout": 49}.get(kind, reached) and reached > 0
    with pytest.raises(ValueError):
        topology(spark, "ring", 3)


def test_stream_ingest(spark, tmp_path):
    rows = [(1, "a", "b", "R"), (1, "a", "b", "R"), (2, "a", "b", "R"), (3, None, "b", "R"), (4, "b", "c", "R")]

    def land(part, data):
        from datetime import datetime

        spark.createDataFrame([(*r, datetime(2024, 1, i + 1), datetime(2024, 1, i + 1)) for i, r in enumerate(data)], EDGE).write.parquet(str(tmp_path / "in" / part))

    def run():
        stream = spark.readStream.schema(EDGE).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = ingest(stream, str(tmp_path / "store"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    assert read_edges(spark, str(tmp_path / "store")) is None
    land("1", rows)
    run()
    land("2", [(5, "a", "b", "R"), (6, "c", "d", "R")])
    run()
    got = sorted((r.source, r.target, r.edge_id) for r in read_edges(spark, str(tmp_path / "store")).collect())
    assert got == [("a", "b", 1), ("b", "c", 4), ("c", "d", 6)]


def test_stream_daily_counts(spark, tmp_path):
    from datetime import datetime

    spark.createDataFrame([(i, "a", "b", "R", datetime(2024, 1, 1 + i // 3), datetime(2024, 1, 1)) for i in range(6)], EDGE).write.parquet(str(tmp_path / "in"))
    q = daily_counts(spark.readStream.schema(EDGE).parquet(str(tmp_path / "in")), "1 hour").writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.day.day, r.n) for r in spark.table("daily").collect()) == [(1, 3), (2, 3)]


def test_result_graph(spark):
    g = topology(spark, "long_chain", 5)
    s = GraphSession(spark, g)
    nodes, rels = s.query("MATCH p = (a)-[:LINK*2]->(b) WHERE id(a) = 0 RETURN p, a").graph(g)
    assert sorted(r.id for r in nodes.collect()) == [0, 1, 2] and rels.count() == 2
    nodes, rels = s.query("MATCH (a)-[r]->(b) WHERE id(a) = 3 RETURN r").graph(g)
    assert sorted(r.id for r in nodes.collect()) == [3, 4] and rels.count() == 1
    nodes, rels = s.query("MATCH (a) RETURN count(*)").graph(g)
    assert nodes.count() == rels.count() == 0


def test_object_graph(spark, sf):
    g = object_graph(spark, sf)
    assert g.node_frame().groupBy("id").count().where("count > 1").count() == 0
    assert g.rels[0].df.groupBy("source", "target", "rel_type").count().where("count > 1").count() == 0
    assert g.label_counts().where("label = 'User'").first().n > 0 and g.rel_types().count() > 5 and g.all_labels().count() > 3


def test_enterprise_graph(spark):
    from graphloom.sources.generator import enterprise

    g = enterprise(spark, domains=2, users=50, computers=20, groups=10, ous=5)
    s = GraphSession(spark, g)
    assert dict(s.query("MATCH (n) RETURN head(labels(n)) AS l, count(*) AS n").rows()) == {"Domain": 2, "User": 100, "Computer": 40, "Group": 20, "OU": 10}
    assert s.query("MATCH (d:Domain)-[:Contains*1..10]->(u:User) RETURN count(u) AS n").rows() == [(100,)]
    assert s.query("MATCH (a)-[r]->(b) RETURN count(r) AS n").rows() == [(g.rels[0].df.count(),)]  # both ends exist
    assert s.query("MATCH (u:User)-[:MemberOf*1..10]->(g:Group)-[:AdminTo]->(c:Computer) RETURN count(*) > 0 AS some").rows() == [(True,)]
    assert enterprise(spark, domains=1, users=0, computers=0, groups=0, ous=0).node_frame().count() == 1
