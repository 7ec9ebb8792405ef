"""Problems 1 to 5 against plain Python versions of their definitions, and on small awkward inputs."""

import json
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import shred
from graphloom.operators import drift, heavy, hierarchy, nested, queries, references

T = datetime


def documents(sf):
    for r in pd.read_parquet(f"{sf}/collector_files.parquet").drop_duplicates().itertuples():
        try:
            doc = json.loads(r.content[1:] if r.content[:1] == "﻿" else r.content)
        except ValueError:
            continue
        if isinstance(doc, dict):
            yield r, doc


def elements(value, path, pos):
    if isinstance(value, list):
        for i, x in enumerate(value):
            if isinstance(x, dict):
                yield ".".join(path), ".".join([*pos, str(i)])
            yield from elements(x, path, [*pos, str(i)])
    elif isinstance(value, dict):
        for k, x in value.items():
            yield from elements(x, [*path, k], pos)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_nested_items_of_test_data(spark, sf):
    want = sorted((r.file_id, p, a, b) for r, doc in documents(sf) if isinstance(doc.get("data"), list) for p, e in enumerate(doc["data"]) if isinstance(e, dict) for a, b in elements(e, [], []))
    assert rows(queries.p1_found(spark, sf)) == want


FILES = "file_id bigint, file_name string, content string"


def test_nested_edge_cases(spark):
    deep = {"data": [{"A": [[{"x": 1}, 2], None, [[{"y": [{"z": 0}]}]]], "B": {"C.D": [{}]}, "E": [1, {"F": []}]}, [{"A": [{}]}], None, {"A": {"Results": [{"q": "é"}]}}]}
    data = [
        (1, "a", "﻿" + json.dumps(deep)),
        (1, "a", "﻿" + json.dumps(deep)),
        (2, None, '{"data": [{"A": [NaN]}]}'),
        (3, None, None),
        (4, "", ""),
        (5, "x", '{"data": {"A": [{}]}}'),
        (6, "x", "[1]"),
        (7, "x", '{"data": [{"A": [{"s": "\\ud800", "n": ' + "9" * 5000 + '}]}], "meta": {"type": "USERS", "version": 5}}'),
        (None, "n", '{"data": [{"A": [{"k": 1}]}]}'),
        (8, "long", json.dumps({"data": [{"A": [{"t": "x" * 100}] * 50_000}]})),
        (9, "map", json.dumps({"data": [{f"k{i}": [{"v": i}]} for i in range(300)]})),
    ]
    df = spark.createDataFrame(data, FILES).withColumn("array_path", F.lit(1))
    got = nested.nested_items(df)
    assert rows(got.where("file_id = 1"), "entity_pos", "array_path", "item_pos", "parent_path", "parent_pos") == [
        (0, "A", "0.0", "A", "0"),
        (0, "A", "2.0.0", "A", "2.0"),
        (0, "A.y", "2.0.0.0", "A", "2.0.0"),
        (0, "B.C.D", "0", "", ""),
        (0, "E", "1", "", ""),
        (3, "A.Results", "0", "", ""),
    ]
    assert got.where("file_id is null").count() == 1
    assert got.where("file_id in (2, 3, 4, 5, 6)").count() == 0
    assert (got.where("file_id = 8").count(), got.where("file_id = 9").count()) == (50_000, 300)
    assert rows(nested.child_table(df, "A", ["s"]).where("file_id = 7"), "s") == [("?",)]
    assert rows(nested.child_table(df, "A.Results", ["q", "Q"], ["a", "b"]).where("file_id = 1"), "a", "b") == [("é", None)]
    assert rows(nested.files(df).where("file_id in (2, 7)")) == [(2, False, None, None, 0, 0), (7, True, "users", "5", 1, 1)]
    assert nested.nested_items(df.limit(0)).count() == 0
    assert nested.entities(df, ["A.Results"]).where("file_id = 1").count() == 2


def all_elements(value, path, pos):
    if isinstance(value, list):
        for i, x in enumerate(value):
            if not isinstance(x, list):
                fields = {k: shred.scalar_text(v) for k, v in x.items() if not isinstance(v, list)} if isinstance(x, dict) else None
                yield ".".join(path), ".".join([*pos, str(i)]), fields, None if isinstance(x, dict) else shred.scalar_text(x)
            yield from all_elements(x, path, [*pos, str(i)])
    elif isinstance(value, dict):
        for k, x in value.items():
            yield from all_elements(x, [*path, k], pos)


def test_all_items_of_test_data(spark, sf):
    key = lambda r: repr((*r[:4], sorted(r[4].items()) if r[4] is not None else None, r[5]))
    want = [
        (r.file_id, i, *x)
        for r, doc in documents(sf)
        for i, e in enumerate(doc["data"] if isinstance(doc.get("data"), list) else [])
        if isinstance(e, dict)
        for x in all_elements(e, [], [])
    ]
    got = [tuple(r) for r in queries.p1_items(spark, sf).select("file_id", "entity_pos", "array_path", "item_pos", "fields", "value").collect()]
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert sum(r[2] == "Properties.serviceprincipalnames" and r[5] is not None for r in got)


def test_files_of_any_depth(spark):
    n = 5000
    lists = '{"data": [{"A": ' + "[" * n + '{"x": 1}' + "]" * n + "}]}"
    names = '{"data": [{"A": ' + '{"b": ' * n + '[{"y": 2}]' + "}" * n + "}]}"
    both = '{"data": [{"A": [' + '{"c": [' * 300 + "{}" + "]}" * 300 + "]}]}"
    df = spark.createDataFrame([(1, "a", lists), (2, "b", names), (3, "c", both), (4, "d", "[" * 200_000), (5, "e", '{"data": [{"A": [{"k": [1, {"z": 3}]}]}]}')], FILES)
    got = nested.nested_items(df)
    assert [tuple(r) for r in got.where("file_id = 1").select("array_path", "item_pos").collect()] == [("A", ".".join(["0"] * n))]
    assert [(len(r[0]), r[1]) for r in got.where("file_id = 2").select("array_path", "item_pos").collect()] == [(2 * n + 1, "0")]
    assert got.where("file_id = 3").count() == 301 and got.where("file_id = 4").count() == 0
    assert rows(got.where("file_id = 5"), "array_path", "item_pos", "parent_pos") == [("A", "0", ""), ("A.k", "0.1", "0")]
    assert {r.file_id: r.valid for r in nested.files(df).collect()} == {1: True, 2: True, 3: True, 4: False, 5: True}
    assert drift.schema_changes(df.withColumn("collector", F.lit("c")).withColumn("collected_at", F.current_timestamp())).count() == 0


def test_repeated_names_and_related_tables(spark):
    data = [(1, "a", '{"meta": {"type": "Users", "version": 5}, "data": [{"A": [{"x": 1}, {"x": 2}], "N": "n", "A": [{"x": 3, "x": "4"}, 5]}, {"A": null}]}'), (2, "b", "{}")]
    tables = nested.related_tables(spark.createDataFrame(data, FILES), {"entities": ["N"], "A": ["x"]})
    assert rows(tables["files"]) == [(1, "true", "users", "5"), (2, "true", None, None)]
    assert rows(tables["entities"]) == [(1, 0, "n"), (1, 1, None)]
    assert rows(tables["A"], "entity_pos", "item_pos", "x", "value") == sorted([(0, "0", "4", None), (0, "1", None, "5")])


JSON_PARTS = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(JSON_PARTS, min_size=1, max_size=4), st.booleans())
def test_values_of_any_json(docs, plain):
    values = shred.Values(pa.array([json.dumps(d, ensure_ascii=plain, indent=1 if plain else None) for d in docs]))
    assert values.valid.all()

    def build(row):
        kind = values.kind[row]
        _, items, places = values.below(np.array([row]))
        if kind == shred.ARRAY:
            return [build(i) for i in items]
        if kind == shred.OBJECT:
            return {values.names[values.name[i]]: build(i) for i in items}
        text = values.text(np.array([row])).to_pylist()[0]
        return text if kind == shred.STRING else None if text is None else json.loads(text)

    assert [build(r) for r in values.root] == docs


def test_parse_is_strict():
    assert shred.parse("[Infinity]") is shred.INVALID and shred.parse("﻿﻿1") is shred.INVALID and shred.parse("null") is None
    assert shred.parse("[" * 100_000) is shred.INVALID


def expected_hierarchy(links):
    up = {}
    for p, c in links:
        if p is not None and c is not None:
            up[c] = min(p, up.get(c, p))
    out = []
    for x in set(up) | {p for p, c in links if p is not None and c is not None}:
        path = [x]
        while path[-1] in up and up[path[-1]] not in path:
            path.append(up[path[-1]])
        if path[-1] in up:
            out.append((x, min(path[path.index(up[path[-1]]) :]), -1, None))
        else:
            out.append((x, path[-1], len(path) - 1, path[::-1]))
    return sorted(out, key=lambda r: r[0])


def expected_sizes(links):
    """Every node with all nodes below it, itself included once."""
    below = {x: {x} for x in {n for link in links if None not in link for n in link}}
    for anc, node, _ in expected_descendants(links):
        below[anc].add(node)
    return {x: len(b) for x, b in below.items()}


LINKS = [("r", "a"), ("r", "a"), ("r", "b"), ("a", "c"), ("c", "d"), ("s", "s"), ("s", "t"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("w", "v"), (None, "q"), ("q", None), ("m2", "k"), ("m1", "k"), ("", "e")]


@pytest.mark.parametrize("local_rows", [1000, 6, 0])
def test_hierarchy(spark, local_rows):
    links = LINKS + [(f"n{i}", f"n{i + 1}") for i in range(12)]
    h = hierarchy.hierarchy(spark.createDataFrame(links, "p string, node string"), "p", "node", local_rows=local_rows)
    got = sorted(((r.node, r.root_id, r.depth, r.path) for r in h.collect()), key=lambda r: r[0])
    assert got == expected_hierarchy(links)
    assert {r.node: r.subtree_size for r in h.collect()} == expected_sizes(links)
    assert rows(hierarchy.descendants(h).where("ancestor = 'r'")) == [("r", "a", 1), ("r", "b", 1), ("r", "c", 2), ("r", "d", 3)]


def expected_descendants(links):
    up = {}
    for p, c in links:
        if p is not None and c is not None:
            up[c] = min(p, up.get(c, p))
    out = []
    for x in up:
        seen, at = {x}, up.get(x)
        while at is not None and at not in seen:
            out.append((at, x, len(seen)))
            seen.add(at)
            at = up.get(at)
    return sorted(out)


@pytest.mark.parametrize("local_rows", [1000, 0])
def test_descendants_of_cycles(spark, local_rows):
    links = [*LINKS, ("v", "u"), ("y", "y1"), ("y1", "y2"), ("t", "t1")]
    h = hierarchy.hierarchy(spark.createDataFrame(links, "p string, node string"), "p", "node", local_rows=local_rows)
    got = rows(hierarchy.descendants(h))
    assert got == expected_descendants(links)
    assert {("w", "u", 2), ("x", "u", 5), ("x", "z", 2), ("s", "t1", 2)} <= set(got)
    only = spark.createDataFrame([("s", "s")], "p string, node string")
    assert rows(hierarchy.descendants(hierarchy.hierarchy(only, "p", "node"))) == []


def test_descendants_of_test_data(spark, sf):
    e = pd.read_parquet(f"{sf}/graph_edges.parquet")
    e = e[(e.rel_type == "Contains") & e.source.notna() & e.target.notna()]
    assert rows(queries.p2_descendants_all(spark, sf)) == expected_descendants(list(zip(e.source, e.target)))


@pytest.mark.parametrize("with_path", [True, False])
def test_hierarchy_of_long_chains(spark, with_path):
    links = LINKS + [(f"n{i:03}", f"n{i + 1:03}") for i in range(90)] + [(f"o{i:03}", f"o{(i + 1) % 70:03}") for i in range(70)] + [("o005", "below"), ("below", "deeper")]
    h = hierarchy.hierarchy(spark.createDataFrame(links, "p string, c string"), "p", "c", with_path=with_path, local_rows=0, slow_rounds=1)
    got = sorted(((r.node, r.root_id, r.depth, r.path if with_path else None) for r in h.collect()), key=lambda r: r[0])
    assert got == [(*x[:3], x[3] if with_path else None) for x in expected_hierarchy(links)]
    assert {r.node: r.subtree_size for r in h.collect()} == expected_sizes(links)


def test_paths_of_long_chains_come_in_chunks():
    n = 30_000
    ids = [f"{i:05}" for i in range(n)]
    table = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([None, *ids[:-1]]), pa.array([1] * n)], ["node", "parent", "size"])
    total = most = 0
    for k, batch in enumerate(hierarchy._peel_locally(True)(iter([table]))):
        lengths = pc.list_value_length(batch.column("path")).to_pylist()
        total, most = total + batch.num_rows, max(most, sum(lengths))
        assert lengths == [d + 1 for d in batch.column("depth").to_pylist()]
        assert batch.column("path")[0].as_py() == ids[: lengths[0]]
        if k == 40:
            break
    assert total > 4000 and most <= hierarchy._STEPS


def test_hierarchy_empty(spark):
    empty = spark.createDataFrame([], "p string, c string")
    assert hierarchy.hierarchy(empty, "p", "c").count() == 0
    assert hierarchy.hierarchy(spark.createDataFrame([(None, "a")], "p string, c string"), "p", "c").count() == 0


def test_hierarchy_of_test_data(spark, sf):
    e = pd.read_parquet(f"{sf}/graph_edges.parquet")
    e = e[(e.rel_type == "Contains") & e.source.notna() & e.target.notna()]
    want = [x[:3] for x in expected_hierarchy(list(zip(e.source, e.target)))]
    assert rows(queries.p2_found(spark, sf)) == want


def at(day):
    return T(2024, 1, day)


PARENTS = [("a", at(5), None), ("b", at(1), at(3)), ("b", at(6), None), ("c", at(4), at(2)), ("d", None, at(9)), (None, at(1), None), ("b", at(1), at(3))]
REFS = [(1, "a", at(5)), (2, "a", at(4)), (3, "b", at(1)), (4, "b", at(3)), (5, "b", at(7)), (6, "c", at(5)), (7, "c", at(1)), (8, "d", at(1)), (9, "d", at(9)), (10, "zz", at(1)), (11, None, at(1)), (12, "w", at(1)), (13, "a", None), (14, "A", at(6))]
ORPHANS = [(2, "late"), (4, "deleted"), (6, "deleted"), (7, "late"), (9, "deleted"), (10, "missing"), (14, "missing")]


@pytest.mark.parametrize("many", [64, 0])
def test_orphans(spark, many):
    parents = spark.createDataFrame(PARENTS, "key string, start timestamp, kind timestamp")
    refs = spark.createDataFrame(REFS, "n int, ref string, t timestamp")
    always = spark.createDataFrame([("w",), (None,)], "objectid string")
    assert rows(references.orphans(refs, "ref", "t", parents, "key", "start", "kind", always, many=many), "n", "kind") == ORPHANS
    assert references.orphans(refs.limit(0), "ref", "t", parents, "key", "start", "kind", many=many).count() == 0
    assert {r.kind for r in references.orphans(refs, "ref", "t", parents.limit(0), "key", "start", "kind").collect()} == {"missing"}


@pytest.mark.parametrize("together", [100_000, 1])
def test_hot_parent_in_slices(spark, together):
    spans = [("h", T(2024, 1 + i % 12, 1 + i // 12), T(2024, 1 + i % 12, 2 + i // 12)) for i in range(0, 300, 2) if i // 12 < 26]
    refs = [(d * 12 + m, "h", T(2024, m, d, 12)) for m in range(1, 13) for d in range(1, 28)]
    want = sorted((n, "deleted" if any(e <= t for _, _, e in spans) else "late") for n, _, t in refs if not any(s <= t < e for _, s, e in spans))
    got = references.orphans(spark.createDataFrame(refs, "n int, key string, t timestamp"), "key", "t", spark.createDataFrame(spans, "key string, a timestamp, b timestamp"), "key", "a", "b", many=10, together=together)
    assert rows(got, "n", "kind") == want


def field_view(doc):
    """{(part, name): (types, {place: value})} straight from the definition."""
    seen = {}

    def put(key, place, v):
        if v is not None:
            kind = "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else {str: "string", list: "array", dict: "object"}[type(v)]
            types, places = seen.setdefault(key, (set(), {}))
            types.add(kind)
            places[place] = json.dumps(v, sort_keys=True).lower()

    for k, v in doc["meta"].items():
        put(("meta", k), "meta", v)
    for e in doc.get("data") or []:
        if isinstance(e, dict) and isinstance(e.get("Trusts"), list):
            for i, t in enumerate(e["Trusts"]):
                if isinstance(t, dict):
                    for k, v in t.items():
                        put(("Trusts", k), (e.get("ObjectIdentifier"), i), v)
    return seen


def test_schema_changes_of_test_data(spark, sf):
    files = [(r.collector, r.collected_at, r.file_id, field_view(d)) for r, d in documents(sf) if isinstance(d.get("meta"), dict) and d["meta"].get("type") == "domains"]
    want, last = [], {}
    for collector, _, file_id, new in sorted(files, key=lambda x: x[:3]):
        old = last.get(collector)
        last[collector] = new
        if old is None:
            continue
        gone, come = set(old) - set(new), set(new) - set(old)
        for k in set(old) & set(new):
            if old[k][0] != new[k][0]:
                want.append((file_id, ".".join(k), "", "retyped"))
        for a in sorted(gone):
            for b in sorted(come):
                common = old[a][1].keys() & new[b][1].keys()
                if a[0] == b[0] and old[a][0] == new[b][0] and common and all(old[a][1][p] == new[b][1][p] for p in common):
                    want.append((file_id, ".".join(a), ".".join(b), "renamed"))
                    gone, come = gone - {a}, come - {b}
                    break
        want += [(file_id, ".".join(k), "", "removed") for k in gone] + [(file_id, ".".join(k), "", "added") for k in come]
    assert want and rows(queries.p4_found(spark, sf)) == sorted(want)


def test_schema_changes_edge_cases(spark):
    def doc(meta, trusts, **more):
        return json.dumps({"meta": {"type": "domains", **meta}, "data": [None, {"ObjectIdentifier": "D", "Trusts": trusts, **more}]})

    data = [
        (1, "c", at(1), doc({"v": 1}, [{"A": "x", "N": 1}, None, {"A": "y"}])),
        (2, "c", at(1), doc({"v": "1"}, [{"B": "X", "N": 1.0}, None, {"B": "y", "C": []}])),
        (2, "c", at(1), doc({"v": "1"}, [{"B": "X", "N": 1.0}, None, {"B": "y", "C": []}])),
        (3, "c", at(9), "not json"),
        (4, "c", at(10), doc({"v": None}, None)),
        (5, None, at(2), doc({}, [])),
        (6, None, at(3), doc({"w": 0}, [{"A": True}])),
        (7, "d", at(3), doc({"type": "Domains"}, [])),
    ]
    df = spark.createDataFrame(data, "file_id bigint, collector string, collected_at timestamp, content string")
    assert rows(drift.schema_changes(df)) == sorted(
        [(2, "meta.v", "", "retyped"), (2, "Trusts.A", "Trusts.B", "renamed"), (2, "Trusts.C", "", "added"), (4, "meta.v", "", "removed")]
        + [(4, f"Trusts.{x}", "", "removed") for x in "BCN"]
        + [(6, "meta.w", "", "added"), (6, "Trusts.A", "", "added")]
    )
    assert rows(drift.consistent_table(df, ["A"]), "file_id", "item_pos", "a") == [(1, "0", "x"), (1, "2", "y"), (2, "0", "X"), (2, "2", "y"), (6, "0", "true")]
    assert drift.schema_changes(df.limit(0)).count() == 0


def test_edit_scripts_of_nested_schemas():
    def node(types, **at):
        return {"types": types, "at": at}

    old = {("T", "A"): node(4, p="1"), ("T", "B"): node(32, p="o"), ("T", "B", "x"): node(8, p="v"), ("T", "B", "y"): node(8, p="w"), ("T", "S"): node(8, p="s")}
    new = {("T", "A2"): node(4, p="1"), ("T", "B"): node(32, p="n"), ("T", "B", "x"): node(4, p="v"), ("T", "B", "S"): node(8, p="s"), ("T", "B", "z"): node(8, p="q")}
    assert drift.edit_script(old, new) == sorted(
        [(("T", "A"), ("T", "A2"), "renamed"), (("T", "B", "x"), (), "retyped"), (("T", "S"), ("T", "B", "S"), "moved"), (("T", "B", "y"), (), "removed"), (("T", "B", "z"), (), "added")]
    )
    assert drift.edit_distance(old, old) == 0 and drift.edit_distance({}, old) == len(old)
    # a largest matching: a fits two, b only one
    two = drift.edit_script({("T", "a"): node(4, p="1"), ("T", "b"): node(4, p="1", q="2")}, {("T", "c"): node(4, p="1", q="2"), ("T", "d"): node(4, p="1", q="3")})
    assert [c for _, _, c in two] == ["renamed", "renamed"]


def test_escaped_type_names(spark):
    data = [(1, "c", at(1), '{"meta": {"type": "domains", "a": 1}, "data": []}'), (2, "c", at(2), '{"meta": {"type": "\\u0064omains", "a": "x"}, "data": []}'), (3, "c", at(3), '{"meta": {"type": "users"}, "data": []}')]
    df = spark.createDataFrame(data, "file_id bigint, collector string, collected_at timestamp, content string")
    assert rows(drift.schema_changes(df)) == [(2, "meta.a", "", "retyped")]


def test_consistent_table_keeps_all_fields(spark):
    def doc(trusts):
        return json.dumps({"meta": {"type": "domains"}, "data": [{"ObjectIdentifier": "D", "Trusts": trusts}]})

    data = [(1, "c", at(1), doc([{"Old": "x", "Flag": True, "N": 1}])), (2, "c", at(2), doc([{"New": "x", "Flag": {"raw": "False"}, "N": "2", "Late": [1]}])), (3, "d", at(1), doc([{"Old": "p", "New": "q", "flag": None, "N": 3}]))]
    df = spark.createDataFrame(data, "file_id bigint, collector string, collected_at timestamp, content string")
    got = drift.consistent_table(df, typed=True)
    assert got.columns == ["file_id", "entity_pos", "item_pos", "flag", "late", "n", "old", "conflicts"] and dict(got.dtypes)["n"] == "bigint" and dict(got.dtypes)["flag"] == "boolean"
    assert rows(got, "file_id", "flag", "late", "n", "old", "conflicts") == [(1, True, None, 1, "x", None), (2, False, "[1]", 2, "x", None), (3, None, None, 3, "p", '{"New":"q"}')]
    moved = [(1, "c", at(1), doc([{"S": "v", "F": {"a": 1}}])), (2, "c", at(2), doc([{"F": {"a": 1, "S": "v"}}]))]
    df = spark.createDataFrame(moved, df.schema)
    assert rows(drift.all_changes(df), "field", "new_field", "change", "depth") == [("Trusts.S", "Trusts.F.S", "moved", 1)]
    assert rows(drift.schema_changes(df)) == [(2, "Trusts.S", "", "removed")]


def test_skewed_summary(spark):
    data = [("hot", "r", f"s{i % 7}", at(1 + i % 20)) for i in range(3000)] + [(f"k{i}", None, None, at(2)) for i in range(40)] + [(None, "r", "s", None)] * 3
    df = spark.createDataFrame(data, "target string, rel_type string, source string, n_rows timestamp").withColumnRenamed("n_rows", "loaded_at").withColumn("value", F.lit(1))
    keys = heavy.heavy_keys(df, ["target", "rel_type"], share=0.1)
    assert keys.count() == 1
    for chosen in (keys, keys.limit(0), None):
        got = {(r.target, r.rel_type): (r.n_rows, r.n_distinct, r.first_at, r.last_at) for r in heavy.skewed_summary(df, ["target", "rel_type"], "source", "loaded_at", chosen).collect()}
        assert got[("hot", "r")] == (3000, 7, at(1), at(20)) and got[("k1", None)] == (1, 0, at(2), at(2)) and got[(None, "r")] == (3, 1, None, None) and len(got) == 42
    assert [r.target for r in heavy.dominant_keys(df, ["target", "rel_type"], "source", "loaded_at", 0.015).collect()] == ["hot"]
    assert heavy.skewed_summary(df.limit(0), ["target", "rel_type"], "source", "loaded_at").count() == 0
