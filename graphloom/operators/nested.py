"""Nested records to flat, linked tables (problem 1).

Each row of the input carries one JSON document ``{"meta": {...}, "data": [entity, ...]}``. The documents of a batch
become one table of values (functions/shred.py); every array below an entity is then flattened by its list offsets:
parent-index kernels give each element its parent, and the keys (file id, entity position, item position) go down by take.
No document and no record is walked by itself, so depth and size of one don't matter to the others.

Defined results: content that is null or not valid JSON has no entities and ``valid`` false; a top level that is no
object, or a ``data`` that is no array, has none either; elements of ``data`` that are not objects are no entities but
count in positions; exact duplicate rows count once; rows with a null id are kept and told apart by nothing but content.
An array that stands directly in an array leaves no mark in the path; a name that holds a dot is kept as it is. Of repeated
names in one object the last counts. JSON of any depth is read. Empty tables give empty tables; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from graphloom.functions import shred
from graphloom.functions.shred import ARRAY, OBJECT, Values
from graphloom.runtime import cut, spread

_KEY = "__row_key"


def _deduplicated(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """id, content, and a key equal for exact duplicates; duplicates are brought into one partition.

    Partitioned by the hash of the whole row, so neither a null id nor a repeated one makes a hot partition."""
    key = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(F.col(id_col).cast("bigint").alias("file_id"), F.col(content_col).cast("string").alias("content"), key.alias(_KEY))
    return rows.repartition(spread(rows), _KEY)


def map_documents(df: DataFrame, id_col: str, content_col: str, schema: str, emit: Callable[[pa.Array, Values], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``emit`` makes of the ids and values of batches of different rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            for part in shred.slices(batch, "content"):
                keys = zip(*(part.column(c).to_pylist() for c in ("file_id", _KEY)), pc.binary_length(part.column("content")).to_pylist(), strict=True)
                new = []
                for i, k in enumerate(keys):
                    if k not in seen:
                        seen.add(k)
                        new.append(i)
                if new:
                    some = part.take(pa.array(new))
                    yield from emit(some.column("file_id"), Values(some.column("content")))

    return _deduplicated(df, id_col, content_col).mapInArrow(run, schema)


def top_fields(values: Values, name: str, kind: int) -> np.ndarray:
    """For each document, the top-level field of a kind; -1 where there is none."""
    root = np.where((values.root >= 0) & (values.kind[values.root] == OBJECT), values.root, -1) if len(values.kind) else values.root
    found = values.field(root, name)
    return np.where((found >= 0) & (values.kind[found] == kind), found, -1) if len(values.kind) else found


class Entities:
    """The objects in ``data`` of a batch of documents: their values, documents, file ids and positions."""

    def __init__(self, ids: pa.Array, values: Values):
        data = top_fields(values, "data", ARRAY)
        parent, items, places = values.below(data[data >= 0])
        objects = values.kind[items] == OBJECT
        self.values, self.rows = values, items[objects]
        self.document = np.flatnonzero(data >= 0)[parent[objects]]
        self.file_id = ids.take(pa.array(self.document, pa.int64()))
        self.pos = pa.array(places[objects], pa.int32())

    def __len__(self) -> int:
        return len(self.rows)

    def levels(self, plain: bool = False) -> Iterator[tuple[shred.Level, np.ndarray]]:
        """The levels of arrays with the places of their objects; with ``plain`` of all elements that aren't arrays."""
        for level in shred.array_items(self.values, self.rows):
            kinds = self.values.kind[level.items]
            at = np.flatnonzero(kinds != ARRAY if plain else kinds == OBJECT)
            if len(at):
                yield level, at

    def keys(self, level: shred.Level, at: np.ndarray) -> list[pa.Array]:
        """file_id, entity_pos, array_path, item_pos, parent_path, parent_pos of some elements of a level."""
        who, n = pa.array(level.owner[at]), len(at)
        above = _same("", n) if level.outer_pos is None else level.outer_pos.take(pa.array(at))
        return [self.file_id.take(who), self.pos.take(who), _same(level.path, n), level.item_pos.take(pa.array(at)), _same(level.outer, n), above]


def _same(text: str, n: int) -> pa.Array:
    return pa.array([text], pa.string()).take(pa.array(np.zeros(n, np.int64)))


_KEYS = {"file_id": "bigint", "entity_pos": "int", "array_path": "string", "item_pos": "string", "parent_path": "string", "parent_pos": "string"}


def _schema(more: dict[str, str]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in more.items())


def nested_items(df: DataFrame, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """One row for each object that is an element of an array at any depth inside an entity, with its parent link.

    ``parent_path``/``parent_pos`` name the array element it lies in; both are empty strings for the entity itself."""

    def emit(ids, values):
        entities = Entities(ids, values)
        for level, at in entities.levels():
            yield pa.RecordBatch.from_arrays(entities.keys(level, at), list(_KEYS))

    return map_documents(df, id_col, content_col, _schema(_KEYS), emit)


def field_maps(values: Values, rows: np.ndarray, arrays: bool = False) -> pa.Array:
    """The fields of each object, as a map of texts, arrays only if asked for; null for values that aren't objects."""
    objects = np.flatnonzero(values.kind[rows] == OBJECT)
    parent, items, _ = values.below(rows[objects])
    kept = (values.kind[items] != ARRAY) | arrays
    counts = np.zeros(len(rows), np.int64)
    counts[objects] = np.bincount(parent[kept], minlength=len(objects))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    names = pa.array(values.names, pa.string()).take(pa.array(values.name[items[kept]]))
    whole = pa.MapArray.from_arrays(pa.array(offsets), names, values.text(items[kept]))
    return pc.if_else(pa.array(values.kind[rows] == OBJECT), whole, pa.scalar(None, whole.type))


def all_items(df: DataFrame, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """All kinds of nested array in one pass: one row for each element of an array at any depth inside an entity.

    array_path tells the kinds apart and parent_path/parent_pos link a row to the element it lies in, as in ``nested_items``.
    ``fields``: all fields of an object as text (null for other elements), without those that are arrays, which have rows of
    their own; ``value``: a plain element as text. Arrays directly in an array have no row, only their elements."""

    def emit(ids, values):
        entities = Entities(ids, values)
        for level, at in entities.levels(plain=True):
            rows = level.items[at]
            yield _item_batch(entities.keys(level, at), values, rows)

    return map_documents(df, id_col, content_col, _schema(_KEYS | _ITEM), emit)


_ITEM = {"kind": "string", "fields": "map<string,string>", "value": "string"}


def _item_batch(keys: list[pa.Array], values: Values, rows: np.ndarray) -> pa.RecordBatch:
    kinds = pa.array(shred.KIND_NAMES).take(pa.array(values.kind[rows]))
    plain = values.text(np.where(values.kind[rows] == OBJECT, -1, rows))
    return pa.RecordBatch.from_arrays([*keys, kinds, field_maps(values, rows), plain], [*_KEYS, *_ITEM])


def related_tables(df: DataFrame, spec: dict[str, list[str]], id_col: str = "file_id", content_col: str = "content") -> dict[str, DataFrame]:
    """Flat tables of all the named kinds of array, ``files`` and ``entities``, from one parse of the documents.

    ``spec``: array path -> fields (``entities`` for the entities themselves). The values of all kinds are written once to
    the checkpoint folder as (keys, fields); each table is a projection of that."""

    def emit(ids, values):
        entities = Entities(ids, values)
        meta = top_fields(values, "meta", OBJECT)
        n = len(values.root)
        blank = [pa.array(np.arange(n), pa.int32()), _same("\0files", n), *(_same("", n) for _ in range(3))]
        about = [("valid", pc.cast(pa.array(values.valid), pa.string())), ("data_type", pc.utf8_lower(values.strings(values.field(meta, "type")))), ("version", values.text(values.field(meta, "version")))]
        items = pa.chunked_array([x for _, x in about], pa.string()).combine_chunks().take(pa.array(np.arange(3 * n).reshape(3, n).T.ravel()))
        names = pa.array([k for k, _ in about], pa.string()).take(pa.array(np.tile(np.arange(3), n)))
        fields = pa.MapArray.from_arrays(pa.array(np.arange(0, 3 * n + 1, 3), pa.int32()), names, items)
        yield pa.RecordBatch.from_arrays([ids, *blank, _same("object", n), fields, pa.nulls(n, pa.string())], [*_KEYS, *_ITEM])
        n = len(entities)
        if n:
            yield _item_batch([entities.file_id, entities.pos, _same("\0entities", n), *(_same("", n) for _ in range(3))], values, entities.rows)
        for level, at in entities.levels(plain=True):
            if level.path in spec:
                yield _item_batch(entities.keys(level, at), values, level.items[at])

    every = cut(map_documents(df, id_col, content_col, _schema(_KEYS | _ITEM), emit))
    out = {"files": every.where(F.col("array_path") == "\0files").select("file_id", *(F.col("fields")[c].alias(c) for c in ("valid", "data_type", "version")))}
    for path, names in spec.items():
        own = every.where(F.col("array_path") == ("\0entities" if path == "entities" else path))
        keys = ["file_id", "entity_pos"] if path == "entities" else list(_KEYS)
        out[path] = own.select(*keys, *(F.col("fields")[c].alias(c) for c in names), *([] if path == "entities" else ["value"]))
    return out


def child_table(df: DataFrame, array_path: str, fields: list[str], names: list[str] | None = None, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """The flat table of one kind of nested array: keys of the parent and the named fields as text.

    ``names``: the columns' names, by default the fields' in lower case."""
    names = names or [f.replace(".", "_").lower() for f in fields]

    def emit(ids, values):
        entities = Entities(ids, values)
        for level, at in entities.levels():
            if level.path == array_path:
                keys = entities.keys(level, at)
                yield pa.RecordBatch.from_arrays([keys[0], keys[1], keys[3], *(values.text(values.dotted(level.items[at], f)) for f in fields)], ["file_id", "entity_pos", "item_pos", *names])

    return map_documents(df, id_col, content_col, _schema({"file_id": "bigint", "entity_pos": "int", "item_pos": "string"} | dict.fromkeys(names, "string")), emit)


def child_rows(df: DataFrame, spec: dict[str, list[str]], entity_fields: list[str], outer_fields: list[str], id_col: str = "file_id", content_col: str = "content", properties: str | None = None) -> DataFrame:
    """Many kinds of nested array in one pass: array_path ('' for the entity itself), data_type of the file, the entity's
    fields e0.., the fields o0.. of the array element around it, and the element's own fields f0.. in the spec's order.

    ``properties``: name of an object of the entity whose plain fields come out as a map (only in the entity's own row)."""
    width = max(map(len, spec.values()))
    texts = ["array_path", "data_type", *(f"e{i}" for i in range(len(entity_fields))), *(f"o{i}" for i in range(len(outer_fields))), *(f"f{i}" for i in range(width))]
    schema = {"file_id": "bigint", "entity_pos": "int"} | dict.fromkeys(texts, "string") | ({"properties": "map<string,string>"} if properties else {})

    def emit(ids, values):
        entities = Entities(ids, values)
        if not len(entities):
            return
        kinds = pc.utf8_lower(values.strings(values.field(top_fields(values, "meta", OBJECT), "type"))).take(pa.array(entities.document))
        own = [values.text(values.dotted(entities.rows, f)) for f in entity_fields]

        def batch(path, who, outer, fields, maps=None):
            n, who = len(who), pa.array(who)
            blank = [pa.nulls(n, pa.string())] * (width - len(fields))
            columns = [entities.file_id.take(who), entities.pos.take(who), _same(path, n), kinds.take(who), *(c.take(who) for c in own), *outer, *fields, *blank]
            if properties:
                columns.append(pa.nulls(n, pa.map_(pa.string(), pa.string())) if maps is None else maps)
            return pa.RecordBatch.from_arrays(columns, list(schema))

        empty = [pa.nulls(len(entities), pa.string())] * len(outer_fields)
        maps = None
        if properties:
            inner = values.field(entities.rows, properties)
            there = (inner >= 0) & (values.kind[inner] == OBJECT)
            maps = field_maps(values, inner[there], True).take(pa.array(np.cumsum(there) - 1, mask=~there))
        yield batch("", np.arange(len(entities)), empty, [values.text(values.dotted(entities.rows, f)) for f in spec.get("", [])], maps)
        for level, at in entities.levels():
            if level.path not in spec:
                continue
            outer = [pa.nulls(len(at), pa.string())] * len(outer_fields)
            if level.outer_item is not None:
                outer = [values.text(values.dotted(level.outer_item[at], f)) for f in outer_fields]
            yield batch(level.path, level.owner[at], outer, [values.text(values.dotted(level.items[at], f)) for f in spec[level.path]])

    return map_documents(df, id_col, content_col, _schema(schema), emit)


def entities(df: DataFrame, fields: list[str], id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """One row for each entity, with the named fields (dotted through objects) as text."""
    names = [f.replace(".", "_").lower() for f in fields]

    def emit(ids, values):
        found = Entities(ids, values)
        if len(found):
            yield pa.RecordBatch.from_arrays([found.file_id, found.pos, *(values.text(values.dotted(found.rows, f)) for f in fields)], ["file_id", "entity_pos", *names])

    return map_documents(df, id_col, content_col, _schema({"file_id": "bigint", "entity_pos": "int"} | dict.fromkeys(names, "string")), emit)


def files(df: DataFrame, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """One row for each file: data_type (meta.type in lower case), version, number of elements and of entities."""

    def emit(ids, values):
        meta, data = top_fields(values, "meta", OBJECT), top_fields(values, "data", ARRAY)
        some = np.flatnonzero(data >= 0)
        parent, items, _ = values.below(data[some])
        elements = np.bincount(some[parent], minlength=len(data))
        objects = np.bincount(some[parent[values.kind[items] == OBJECT]], minlength=len(data))
        columns = [ids, pa.array(values.valid), pc.utf8_lower(values.strings(values.field(meta, "type"))), values.text(values.field(meta, "version")), pa.array(elements.astype(np.int32)), pa.array(objects.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["file_id", "valid", "data_type", "version", "n_elements", "n_entities"])

    return map_documents(df, id_col, content_col, "file_id bigint, valid boolean, data_type string, version string, n_elements int, n_entities int", emit)
