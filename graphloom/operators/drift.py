"""Schemas that drift between files (problem 4).

Each file of a series becomes a schema tree: below the root the parts (``meta``, ``Trusts``), below them their fields, below
fields that hold objects their fields, to any depth. A node has its set of JSON types and a short hash of its value for each
place. Consecutive files of a series are compared by a tree edit distance: keeping a name costs 0, another type 1, a rename
1, a move to another parent 1, adding or deleting 1 for each node. Nodes map top-down and siblings are unordered, so for
the children of each mapped pair the minimum is a matching: equal names are kept, and as many as possible of the rest are
renamed, where a rename needs equal types and equal values at all common places. What is left over anywhere is then matched
for moves: the same name under another parent, again with equal types and values. (Unordered tree edit distance without
these restrictions is NP-hard.) The scripts of all files give one projection (old names to one canonical name), which
``consistent_table`` applies to every file.

A file is parsed once; profiles are written to the checkpoint folder. Predecessors are found on ids alone, and without one
task per series: a lag within (series, day), and for the first file of a day the last file of the series' last day before.

Defined results: content that is not valid JSON or whose ``meta.type`` is another has no schema and is passed over; exact
duplicate rows count once; files of a series with the same time go by file id; a null series is a series of its own; a
field whose values are all null is not there; places without an ObjectIdentifier are no evidence for a rename.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions.shred import ARRAY, NUMBER, OBJECT, Values
from graphloom.operators import nested
from graphloom.runtime import cut

MOST_NAMES = 10_000

# Names of the numeric trust directions.
TRUST_DIRECTIONS = {"0": "Disabled", "1": "Inbound", "2": "Outbound", "3": "Bidirectional"}

Path = tuple[str, ...]
Tree = dict[Path, dict]  # path -> {"types": bits, "at": {place: hash of the value}}


def _value_key(kind: int, text: str) -> str:
    """Equal for values that are the same, letters compared without case."""
    if kind == NUMBER and not text.lstrip("-").isdigit():
        value = float(text)
        text = str(int(value)) if value.is_integer() else repr(value)
    return text.lower()


def _short(text: str) -> str:
    return blake2b(text.encode(), digest_size=8).hexdigest()


def schema_trees(values: Values, docs: np.ndarray, part: str) -> dict[int, Tree]:
    """The schema trees of some documents of a batch, one round for each depth."""
    trees: dict[int, Tree] = {d: {} for d in docs.tolist()}
    meta = values.field(values.root[docs], "meta")
    entities = nested.Entities(pa.array(np.zeros(len(values.root), np.int64)), values)
    mine = np.isin(entities.document, docs)
    owners, of_doc = entities.rows[mine], entities.document[mine]
    who = values.strings(values.field(owners, "ObjectIdentifier")).to_pylist()
    lists = values.field(owners, part)
    some = np.flatnonzero((lists >= 0) & (values.kind[lists] == ARRAY)) if len(lists) else np.zeros(0, np.int64)
    above, items, places = values.below(lists[some])
    rows = np.concatenate([meta, items])
    docs_of = np.concatenate([docs, of_doc[some[above]]])
    paths: list[Path] = [("meta",)] * len(meta) + [(part,)] * len(items)
    at: list[str | None] = [""] * len(meta) + [None if (w := who[some[a]]) is None else f"{w}\n{p}" for a, p in zip(above.tolist(), places.tolist(), strict=True)]
    while len(rows):
        objects = np.flatnonzero((rows >= 0) & (values.kind[rows] == OBJECT))
        parent, fields, _ = values.below(rows[objects])
        kinds, texts = values.kind[fields].tolist(), values.text(fields).to_pylist()
        next_paths, next_at, keep = [], [], []
        for i, (p, name, kind, text) in enumerate(zip(parent.tolist(), values.name[fields].tolist(), kinds, texts, strict=True)):
            owner = int(objects[p])
            path, place = (*paths[owner], values.names[name]), at[owner]
            if text is None:
                continue
            node = trees[int(docs_of[owner])].setdefault(path, {"types": 0, "at": {}})
            node["types"] |= 1 << kind
            if place is not None:
                node["at"].setdefault(_short(place), _short(_value_key(kind, text)))
            if kind == OBJECT:
                keep.append(i)
                next_paths.append(path)
                next_at.append(place)
        docs_of = docs_of[objects[parent[keep]]] if keep else np.zeros(0, np.int64)
        rows, paths, at = fields[keep] if keep else np.zeros(0, np.int64), next_paths, next_at
    return trees


def _same(a: dict, b: dict) -> bool:
    common = a["at"].keys() & b["at"].keys()
    return a["types"] == b["types"] and bool(common) and all(a["at"][p] == b["at"][p] for p in common)


def _matching(gone: list[Path], new: list[Path], may: dict[Path, list[Path]]) -> dict[Path, Path]:
    """A largest matching (augmenting paths, names in order)."""
    taken: dict[Path, Path] = {}

    def place(old: Path, tried: set[Path]) -> bool:
        for n in may[old]:
            if n not in tried:
                tried.add(n)
                if n not in taken or place(taken[n], tried):
                    taken[n] = old
                    return True
        return False

    for old in gone:
        place(old, set())
    return {o: n for n, o in taken.items()}


def _children(tree: Tree) -> dict[Path, list[Path]]:
    out: dict[Path, list[Path]] = {}
    for path in sorted(tree):
        out.setdefault(path[:-1], []).append(path)
    return out


def edit_script(old: Tree, new: Tree) -> list[tuple[Path, Path, str]]:
    """Cheapest (path, new path, change) list that turns one schema tree into another; each entry costs 1."""
    out: list[tuple[Path, Path, str]] = []
    below_old, below_new = _children(old), _children(new)
    lost: list[Path] = []
    made: list[Path] = []
    pairs = [(p, p) for p in sorted({x[:1] for x in old} | {x[:1] for x in new})]
    while pairs:
        a, b = pairs.pop()
        mine, other = {p[-1]: p for p in below_old.get(a, [])}, {p[-1]: p for p in below_new.get(b, [])}
        gone, came = [mine[n] for n in sorted(mine.keys() - other.keys())], [other[n] for n in sorted(other.keys() - mine.keys())]
        renamed = _matching(gone, came, {g: [c for c in came if _same(old[g], new[c])] for g in gone})
        out += [(g, c, "renamed") for g, c in renamed.items()]
        for name in sorted(mine.keys() & other.keys()):
            if old[mine[name]]["types"] != new[other[name]]["types"]:
                out.append((mine[name], (), "retyped"))
            pairs.append((mine[name], other[name]))
        pairs += renamed.items()
        lost += [p for g in gone if g not in renamed for p in sorted(old) if p[: len(g)] == g]
        made += [p for c in came if c not in renamed.values() for p in sorted(new) if p[: len(c)] == c]
    moved = _matching(lost, made, {g: [c for c in made if c[-1] == g[-1] and _same(old[g], new[c])] for g in lost})
    out += [(g, c, "moved") for g, c in moved.items()]
    out += [(g, (), "removed") for g in lost if g not in moved]
    out += [(c, (), "added") for c in made if c not in moved.values()]
    return sorted(out)


def edit_distance(old: Tree, new: Tree) -> int:
    return len(edit_script(old, new))


def _candidates(files: DataFrame, data_type: str) -> DataFrame:
    """The files that can have this meta.type: their content names it, or has escapes that could spell it. Decided in the JVM,
    so that files of other types are neither shuffled nor parsed."""
    return files.where(F.col("content").rlike(rf'(?i)"{re.escape(data_type)}"|\\u'))


def schema_profiles(df: DataFrame, data_type: str, part: str) -> DataFrame:
    """file_id and schema tree (JSON) of each file with the given meta.type."""

    def emit(ids, values):
        kinds = values.strings(values.field(nested.top_fields(values, "meta", OBJECT), "type")).to_pylist()
        docs = np.array([i for i, k in enumerate(kinds) if k == data_type], np.int64)
        if len(docs):
            trees = schema_trees(values, docs, part)
            profiles = [json.dumps([[*path, node] for path, node in sorted(trees[d].items())]) for d in docs.tolist()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(docs)), pa.array(profiles, pa.string())], ["file_id", "profile"])

    return nested.map_documents(_candidates(df, data_type), "file_id", "content", "file_id bigint, profile string", emit)


def _tree(profile: str) -> Tree:
    return {tuple(path): node for *path, node in json.loads(profile)}


def with_predecessor(rows: DataFrame, series: str, time: str, tie: str, value: str) -> DataFrame:
    """Adds ``before``: the value of the row before, per series in order of time and tie."""
    order = F.struct(time, tie)
    within = Window.partitionBy(series, "day").orderBy(time, tie)
    rows = rows.withColumn("day", F.to_date(time))
    last = rows.groupBy(series, "day").agg(F.max_by(value, order).alias("day_last"))
    days = last.select(F.col(series).alias("s"), F.col("day").alias("d"), F.lag("day_last").over(Window.partitionBy(series).orderBy("day")).alias("carried"))
    lagged = rows.withColumn("inside", F.lag(value).over(within))
    same = F.col(series).eqNullSafe(F.col("s")) & F.col("day").eqNullSafe(F.col("d"))
    return lagged.join(days, same, "left").withColumn("before", F.coalesce("inside", "carried")).drop("s", "d", "day", "inside", "carried")


_CHANGES = "file_id bigint, field string, new_field string, change string, depth int"


def all_changes(files: DataFrame, data_type: str = "domains", part: str = "Trusts") -> DataFrame:
    """file_id, field, new_field, change, depth: the whole edit script of every file against the one before it in its
    collector's series. ``depth``: 1 for fields directly in a part; nested fields and moves are there too."""
    keys = files.select("file_id", "collector", "collected_at").distinct()
    profiles = cut(schema_profiles(files, data_type, part))
    pairs = with_predecessor(profiles.select("file_id").join(keys, "file_id"), "collector", "collected_at", "file_id", "file_id").where("before is not null").select("file_id", "before")
    old = profiles.select(F.col("file_id").alias("before"), F.col("profile").alias("old"))
    rows = pairs.join(old, "before").join(profiles, "file_id").where("old <> profile").select("file_id", "old", "profile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                out += [(i, ".".join(f), ".".join(n), change, len(f) - 1) for f, n, change in edit_script(_tree(a), _tree(b))]
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["file_id", "field", "new_field", "change", "depth"])

    return rows.mapInArrow(run, _CHANGES)


def schema_changes(files: DataFrame, data_type: str = "domains", part: str = "Trusts") -> DataFrame:
    """file_id, field, new_field, change of the fields directly in a part. A move between parents is a removal and an
    addition here, each where it concerns such a field."""
    every = all_changes(files, data_type, part)
    direct = every.where("depth = 1 and change <> 'moved'").select("file_id", "field", "new_field", "change")
    ends = F.explode(F.array(F.struct(F.col("field"), F.lit("removed").alias("change")), F.struct(F.col("new_field").alias("field"), F.lit("added").alias("change")))).alias("e")
    moved = every.where("change = 'moved'").select("file_id", ends).select("file_id", "e.field", F.lit("").alias("new_field"), "e.change")
    level = F.size(F.split("field", r"\."))  # of a moved field: names with dots count as nested
    return direct.unionByName(moved.where(level == 2))


def compile_projection(changes: DataFrame, part: str = "Trusts") -> dict[str, str]:
    """Name -> canonical name of the part's fields, from all rename scripts.

    Distinct names only (bounded: more than MOST_NAMES raise an error). Renamed names form groups; the canonical name
    is the one most often renamed away from or first in order, so that it doesn't depend on file order."""
    prefix = f"{part}."
    pairs = changes.where((F.col("change") == "renamed") & F.col("field").startswith(prefix)).groupBy("field", "new_field").count().limit(MOST_NAMES + 1).collect()
    if len(pairs) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} distinct renames")
    group: dict[str, str] = {}

    def top(x: str) -> str:
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    votes: dict[str, int] = {}
    for old, new, n in pairs:
        a, b = top(old), top(new)
        group[max(a, b)] = min(a, b)
        votes[old] = votes.get(old, 0) + n
        votes.setdefault(new, 0)
    best: dict[str, str] = {}
    for name in sorted(votes, key=lambda x: (-votes[x], x)):
        best.setdefault(top(name), name)
    return {name[len(prefix) :]: best[top(name)][len(prefix) :] for name in votes}


def _unwrapped(text: Column) -> Column:
    """A value wrapped in an object of one field counts as the value."""
    inner = F.from_json(text, "map<string,string>")
    return F.when(text.startswith("{") & (F.size(inner) == 1), F.element_at(F.map_values(inner), 1)).otherwise(text)


def _kind(values: str) -> list[Column]:
    """What all values of a column have in common."""
    v = F.col(values)
    low = F.lower(v)
    return [
        F.coalesce(F.bool_and(low.isin("true", "false", "0", "1")) & F.bool_or(low.isin("true", "false")), F.lit(False)).alias(f"{values}_b"),
        F.coalesce(F.bool_and(v.rlike(r"^-?(0|[1-9]\d{0,17})$")), F.lit(False)).alias(f"{values}_i"),
        F.coalesce(F.bool_and(v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")), F.lit(False)).alias(f"{values}_f"),
    ]


def consistent_table(files: DataFrame, fields: list[str] | None = None, data_type: str = "domains", part: str = "Trusts", changes: DataFrame | None = None, typed: bool = False) -> DataFrame:
    """All elements of the part in one table: file_id, entity_pos, item_pos and one column for each canonical field.

    ``fields`` None: every field that any file has (found in the files; more than MOST_NAMES are an error). Old names go to
    their canonical name; of several names of one field in one element the canonical one counts, and what another name
    says differently is kept in ``conflicts`` (name and value as JSON, else null). Columns are text, or with ``typed``
    boolean, bigint or double where all values of the field are such, whatever they were written as."""
    canonical = compile_projection(schema_changes(files, data_type, part) if changes is None else changes, part)

    def emit(ids, values):
        found = nested.Entities(ids, values)
        kinds = values.strings(values.field(nested.top_fields(values, "meta", OBJECT), "type")).to_pylist()
        mine = np.array([k is not None and k.lower() == data_type for k in kinds], bool)
        for level, at in found.levels():
            if level.path == part:
                at = at[mine[found.document[level.owner[at]]]]
                keys = found.keys(level, at)
                yield pa.RecordBatch.from_arrays([keys[0], keys[1], keys[3], nested.field_maps(values, level.items[at], True)], ["file_id", "entity_pos", "item_pos", "fields"])

    elements = cut(nested.map_documents(_candidates(files, data_type), "file_id", "content", "file_id bigint, entity_pos int, item_pos string, fields map<string,string>", emit))
    if fields is None:
        there = elements.select(F.explode(F.map_keys(F.map_filter("fields", lambda _, v: v.isNotNull()))).alias("name")).groupBy("name").count().limit(MOST_NAMES + 1).collect()
        if len(there) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} different fields")
        fields = sorted({canonical.get(r["name"], r["name"]) for r in there})
    names = {f: sorted({n for n, c in canonical.items() if c == canonical.get(f, f)} | {f}, key=lambda n: (n != f, n)) for f in fields}
    columns: dict[str, str] = {}
    for f in fields:  # fields that differ only in case stay apart
        own, k = f.lower(), 2
        while own in columns.values():
            own, k = f"{f.lower()}_{k}", k + 1
        columns[f] = own

    def value(name: str, field: str) -> Column:
        text = F.col("fields")[name]
        if typed:
            text = _unwrapped(text)
        if field.endswith("TrustDirection"):
            named = F.create_map(*(F.lit(x) for pair in TRUST_DIRECTIONS.items() for x in pair))
            text = F.coalesce(named[text], text)
        return text

    texts, others = [], []
    for i, (f, ns) in enumerate(names.items()):
        chosen = F.coalesce(*(value(n, f) for n in ns))
        texts.append(chosen.alias(f"f_{i}"))
        others += [F.when(F.lower(value(n, f)) != F.lower(chosen), F.struct(F.lit(n).alias("k"), value(n, f).alias("v"))) for n in ns[1:]]
    kept = F.filter(F.array(*others), lambda x: x.isNotNull()) if others else None
    conflicts = F.lit(None).cast("string") if kept is None else F.when(F.size(kept) > 0, F.to_json(F.map_from_entries(kept)))
    table = elements.select("file_id", "entity_pos", "item_pos", *texts, conflicts.alias("conflicts"))
    kinds = table.agg(*(c for i in range(len(names)) for c in _kind(f"f_{i}"))).first() if typed and names else None  # one row

    def shown(i: int) -> Column:
        c, low = F.col(f"f_{i}"), F.lower(f"f_{i}")
        if kinds is None:
            return c
        if kinds[f"f_{i}_b"]:
            return F.when(c.isNotNull(), low.isin("true", "1"))
        return c.cast("bigint") if kinds[f"f_{i}_i"] else c.cast("double") if kinds[f"f_{i}_f"] else c

    return table.select("file_id", "entity_pos", "item_pos", *(shown(i).alias(columns[f]) for i, f in enumerate(names)), "conflicts")
