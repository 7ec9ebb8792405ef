"""JSON texts to columns: a whole batch of texts becomes one table of values, without walking any of them.

The bytes of all texts of a batch are looked at together. Quotes (less the escaped ones) tell what is inside strings; the
brackets outside give every token its depth, and the bracket around it by one sorted search; whether a text is valid JSON is
decided by a table of which token may follow which in what kind of bracket. What is left is one row for each value: kind,
parent, name (as a code) and place in the bytes. Children of all values stand in one Arrow list array, so the next level
down is a take over the lists, with parent indices and flattened items. Depth costs rounds, not recursion, so JSON of any
depth is read, and no text can break the others.

Of repeated names in an object the last counts. NaN and Infinity are no JSON. A leading U+FEFF is passed over.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NULL, BOOL, NUMBER, STRING, ARRAY, OBJECT = range(6)
KIND_NAMES = ("null", "boolean", "number", "string", "array", "object")
_SCALAR = re.compile(r"null|true|false|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")

# kinds of token; KEY is a string that names a field
_OPEN_OBJ, _OPEN_ARR, _CLOSE_OBJ, _CLOSE_ARR, _COMMA, _COLON, _STR, _SCALARS, _KEY, _START = range(10)
_TOP, _IN_OBJ, _IN_ARR = range(3)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token kind of a byte (white space is _KEY, which no byte is), escapes allowed, hex digits, may[bracket, before, token]."""
    kind, escape, hexes = np.full(256, _SCALARS, np.int8), np.zeros(256, bool), np.zeros(256, bool)
    for k, c in enumerate(b'{[}],:"'):
        kind[c] = k
    kind[list(b" \t\n\r")] = _KEY
    escape[list(b'"\\/bfnrtu')] = True
    hexes[list(b"0123456789abcdefABCDEF")] = True
    may = np.zeros((3, 10, 10), bool)
    values, ends = [_STR, _SCALARS, _OPEN_OBJ, _OPEN_ARR], [_STR, _SCALARS, _CLOSE_OBJ, _CLOSE_ARR]
    may[_TOP, _START, values] = True
    for before, inside in ((_OPEN_ARR, values), (_COMMA, values), (_OPEN_ARR, [_CLOSE_ARR]), *((e, [_COMMA, _CLOSE_ARR]) for e in ends)):
        may[_IN_ARR, before, inside] = True
    for before, inside in ((_OPEN_OBJ, [_KEY, _CLOSE_OBJ]), (_COMMA, [_KEY]), (_KEY, [_COLON]), (_COLON, values), *((e, [_COMMA, _CLOSE_OBJ]) for e in ends)):
        may[_IN_OBJ, before, inside] = True
    return kind, escape, hexes, may


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes between starts and ends as an array of strings."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[_runs(starts, lengths)])).cast(pa.string())


def _unescaped(raw: str) -> str:
    return json.loads(f'"{raw}"').encode("utf-8", "replace").decode("utf-8")


def _plain(texts: pa.Array) -> pa.Array:
    """The contents of JSON strings; only different ones with a backslash are taken apart one by one."""
    escaped = pc.match_substring(texts, "\\")
    if not pc.any(escaped).as_py():
        return texts
    some = texts.filter(escaped).dictionary_encode()
    words = pa.array([_unescaped(t) for t in some.dictionary.to_pylist()], pa.string())
    return pc.replace_with_mask(texts, escaped, words.take(some.indices))


class Values:
    """The values of a batch of JSON texts. ``valid``: for each text, whether it is JSON; ``root``: its value (-1 if not).

    For each value: ``kind``, ``doc`` (its text), ``parent`` (-1 at the top), ``name`` (code of its field name in ``names``, -1
    if it has none), ``start`` and ``end`` (its bytes). ``children``: one list for each value."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        whole = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]].copy()
        self._parse(offsets - offsets[0], len(texts))

    def _parse(self, offsets: np.ndarray, n_texts: int) -> None:
        kind_of_byte, escape, hexes, may = _tables()
        data, n = self.data, len(self.data)
        first = offsets[:-1]
        marked = first[(np.diff(offsets) >= 3)]
        marked = marked[(data[marked] == 0xEF) & (data[marked + 1] == 0xBB) & (data[marked + 2] == 0xBF)] if len(marked) else marked
        for k in range(3):
            data[marked + k] = 32
        bad = np.zeros(n_texts, bool)

        def doc_at(places: np.ndarray) -> np.ndarray:
            return np.searchsorted(offsets, places, side="right") - 1

        # escaped characters: after an odd run of backslashes
        slashes = np.flatnonzero(data == 92)
        quote = data == 34
        if len(slashes):
            begins = np.concatenate([[True], (np.diff(slashes) != 1) | (doc_at(slashes[1:]) != doc_at(slashes[:-1]))])
            place = np.arange(len(slashes)) - np.maximum.accumulate(np.where(begins, np.arange(len(slashes)), 0))
            escaping = slashes[place % 2 == 0]
            last = offsets[doc_at(escaping) + 1]
            cut_off = escaping + 1 >= last
            bad[doc_at(escaping[cut_off])] = True
            escaping, last = escaping[~cut_off], last[~cut_off]
            quote[escaping[data[escaping + 1] == 34] + 1] = False
            bad[doc_at(escaping[~escape[data[escaping + 1]]])] = True
            unicode, last = escaping[data[escaping + 1] == 117], last[data[escaping + 1] == 117]
            short = unicode + 6 > last
            bad[doc_at(unicode[short])] = True
            unicode = unicode[~short]
            fits = np.ones(len(unicode), bool)
            for k in range(2, 6):
                fits &= hexes[data[unicode + k]]
            bad[doc_at(unicode[~fits])] = True
        # strings
        quotes = np.flatnonzero(quote)
        before = np.searchsorted(quotes, offsets)
        per_text = np.diff(before)
        of_quote = np.repeat(np.arange(n_texts), per_text)
        bad |= per_text % 2 == 1
        opening = (np.arange(len(quotes)) - before[of_quote]) % 2 == 0
        odd = np.flatnonzero(per_text % 2 == 1)  # what is open at the end of a text ends there
        closed = offsets[odd + 1]
        flips = quote.view(np.uint8).copy()
        np.bitwise_xor.at(flips, closed[closed < n], 1)
        inside = np.bitwise_xor.accumulate(flips).view(bool) if n else flips.view(bool)
        low = np.flatnonzero(data < 32)
        bad[doc_at(low[inside[low]])] = True
        # scalars
        kinds = np.take(kind_of_byte, data)
        kinds[inside] = _KEY
        other = np.concatenate([[False], kinds == _SCALARS, [False]])
        edges = np.flatnonzero(other[1:] != other[:-1])
        other = other[1:-1]
        begins, stops = edges[::2], edges[1::2]
        if len(begins):  # two texts that touch
            inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
            inner = np.unique(inner[other[inner] & other[inner - 1]])
            begins, stops = np.union1d(begins, inner), np.union1d(stops, inner)
        scalars = _cut(data, begins, stops).dictionary_encode()
        fine = np.array([_SCALAR.fullmatch(t) is not None for t in scalars.dictionary.to_pylist()], bool)
        codes = scalars.indices.to_numpy()
        if len(codes):
            bad[doc_at(begins[~fine[codes]])] = True
        # tokens, with the texts that are bad so far left out
        strings = quotes[opening]
        marks = kinds < _STR
        marks[strings] = True
        marks[begins] = True
        at = np.flatnonzero(marks)
        token = kind_of_byte[data[at]]
        stop = at + 1
        stop[token == _SCALARS] = stops
        head = np.searchsorted(at, offsets)
        doc = np.repeat(np.arange(n_texts), np.diff(head))
        bad |= np.diff(head) == 0
        step = np.where(token <= _OPEN_ARR, 1, np.where((token == _CLOSE_OBJ) | (token == _CLOSE_ARR), -1, 0))
        depth = np.cumsum(step)
        base = np.concatenate([[0], depth])[head]
        depth = depth - base[doc]
        bad[doc[depth < 0]] = True
        bad |= (base[1:] - base[:-1]) != 0
        keep = ~bad[doc]
        at, token, stop, doc, depth, step = at[keep], token[keep], stop[keep], doc[keep], depth[keep], step[keep]
        # the bracket around each token: the last opening one, one level up
        m = len(at)
        level = np.where(step > 0, depth - 1, depth)
        opens = np.flatnonzero(step > 0)
        closing = step < 0
        wanted = np.where(closing, level, level - 1)
        some = np.flatnonzero(wanted >= 0)
        # by level, the opening brackets of a level and the tokens that ask for one of it, in order; the last one counts
        asked = np.concatenate([level[opens], wanted[some]])
        who = np.concatenate([opens * 2, some * 2 + 1])
        narrow = asked.astype(np.uint16) if len(asked) and asked.max() < 1 << 16 else asked
        mixed = np.argsort(who, kind="stable")
        mixed = mixed[np.argsort(narrow[mixed], kind="stable")]
        opened = np.maximum.accumulate(np.where(mixed < len(opens), np.arange(len(mixed)), 0)) if len(mixed) else mixed
        asking = mixed >= len(opens)
        around = np.full(m, -1)
        around[some[mixed[asking] - len(opens)]] = opens[mixed[opened[asking]]]
        bracket = np.where(around < 0, _TOP, np.where(token[around] == _OPEN_OBJ, _IN_OBJ, _IN_ARR))
        starts = np.concatenate([[True], doc[1:] != doc[:-1]]) if m else np.zeros(0, bool)
        previous = np.concatenate([[_START], token[:-1]]).astype(np.int8) if m else np.zeros(0, np.int8)
        previous[starts] = _START
        names_field = (token == _STR) & (bracket == _IN_OBJ) & ((previous == _OPEN_OBJ) | (previous == _COMMA))
        token = np.where(names_field, _KEY, token)
        previous = np.concatenate([[_START], token[:-1]]) if m else previous
        previous[starts] = _START
        bad[doc[~may[bracket, previous, token]]] = True
        self.valid = ~bad
        # values
        stop[(token == _STR) | (token == _KEY)] = self._string_ends(at[(token == _STR) | (token == _KEY)], strings, quotes[~opening]) if m else 0
        stop[around[closing]] = at[closing] + 1
        value = np.flatnonzero((token != _KEY) & (token != _COMMA) & (token != _COLON) & ~closing & ~bad[doc])
        row = np.full(m + 1, -1)
        row[value] = np.arange(len(value))
        self.doc, self.start, self.end = doc[value], at[value], stop[value]
        self.parent = row[around[value]] if m else np.zeros(0, np.int64)
        self.parent[around[value] < 0] = -1
        first_byte = data[self.start]
        self.kind = np.select([first_byte == 123, first_byte == 91, first_byte == 34, first_byte == 110, (first_byte == 116) | (first_byte == 102)], [OBJECT, ARRAY, STRING, NULL, BOOL], NUMBER).astype(np.int8)
        named = (self.parent >= 0) & (self.kind[self.parent] == OBJECT)
        key = value[named] - 2
        raw = _cut(data, at[key] + 1, stop[key] - 1).dictionary_encode()
        words = [_unescaped(t) if "\\" in t else t for t in raw.dictionary.to_pylist()]
        self.codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
        self.names = list(self.codes)
        self.name = np.full(len(value), -1)
        self.name[named] = np.array([self.codes[w] for w in words], np.int64)[raw.indices.to_numpy()] if len(words) else -1
        self._drop_repeated(named)
        self._link()
        self.root = np.full(n_texts, -1)
        top = np.flatnonzero(self.parent < 0)
        self.root[self.doc[top]] = top

    @staticmethod
    def _string_ends(at: np.ndarray, opening: np.ndarray, closing: np.ndarray) -> np.ndarray:
        """Place after the closing quote of strings that begin at ``at``; texts with an odd number of quotes are not among them."""
        after = np.searchsorted(closing, at, side="right")
        return closing[np.minimum(after, len(closing) - 1)] + 1

    def _drop_repeated(self, named: np.ndarray) -> None:
        """Of fields with the same name in one object the last stays; the others go with all that is in them."""
        rows = np.flatnonzero(named)
        pair = self.parent[rows] * (len(self.names) + 1) + self.name[rows]
        order = np.argsort(pair, kind="stable")
        again = order[:-1][pair[order][1:] == pair[order][:-1]]
        if not len(again):
            return
        change = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(change, self.start[rows[again]], 1)
        np.add.at(change, self.end[rows[again]], -1)
        stays = np.cumsum(change)[self.start] == 0
        new = np.cumsum(stays) - 1
        parent = np.where(self.parent >= 0, new[self.parent], -1)
        self.doc, self.start, self.end, self.kind, self.name, self.parent = (x[stays] for x in (self.doc, self.start, self.end, self.kind, self.name, parent))

    def _link(self) -> None:
        inner = np.flatnonzero(self.parent >= 0)
        order = inner[np.argsort(self.parent[inner], kind="stable")]
        counts = np.bincount(self.parent[inner], minlength=len(self.kind)) if len(self.kind) else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.children = pa.ListArray.from_arrays(pa.array(offsets), pa.array(order, pa.int64()))
        self._pairs = None

    def below(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The children of some values: place of the parent among ``rows``, the children, their positions under the parent."""
        lists = self.children.take(pa.array(rows))
        parent = pc.list_parent_indices(lists).to_numpy()
        items = pc.list_flatten(lists).to_numpy()
        lengths = pc.list_value_length(lists).to_numpy()
        return parent, items, np.arange(len(items)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def field(self, rows: np.ndarray, name: str) -> np.ndarray:
        """The field of each object (-1: not there, or no object)."""
        code = self.codes.get(name)
        if code is None or not len(rows):
            return np.full(len(rows), -1)
        if self._pairs is None:
            fields = np.flatnonzero(self.name >= 0)
            pair = self.parent[fields] * len(self.names) + self.name[fields]
            order = np.argsort(pair, kind="stable")
            self._pairs = pair[order], fields[order]
        pairs, fields = self._pairs
        wanted = rows * len(self.names) + code
        at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
        return np.where((rows >= 0) & (pairs[at] == wanted), fields[at], -1)

    def dotted(self, rows: np.ndarray, dotted: str) -> np.ndarray:
        """The value at a dotted name through objects; a name that holds the dots itself wins if it is not null."""
        out = self.field(rows, dotted)
        if "." in dotted:
            deep = rows
            for name in dotted.split("."):
                deep = self.field(deep, name)
            out = np.where((out >= 0) & (self.kind[out] != NULL), out, deep)
        return out

    def text(self, rows: np.ndarray) -> pa.Array:
        """Scalars as they stand in JSON, strings without quotes, arrays and objects as JSON; null for null and -1."""
        there = rows >= 0
        kind = np.where(there, self.kind[rows] if len(self.kind) else NULL, NULL)
        out = np.full(len(rows), -1)
        parts = []
        for group, trim in ((kind == STRING, 1), ((kind == NUMBER) | (kind == BOOL), 0), (kind >= ARRAY, 0)):
            some = np.flatnonzero(group)
            out[some] = sum(map(len, parts)) + np.arange(len(some))
            texts = _cut(self.data, self.start[rows[some]] + trim, self.end[rows[some]] - trim)
            parts.append(_plain(texts) if trim else texts if not (group & (kind >= ARRAY)).any() else pa.array([_compact(t) for t in texts.to_pylist()], pa.string()))
        return pa.chunked_array(parts, pa.string()).combine_chunks().take(pa.array(out, mask=out < 0))

    def strings(self, rows: np.ndarray) -> pa.Array:
        """Only strings; null for everything else."""
        return self.text(np.where((rows >= 0) & (self.kind[rows] == STRING), rows, -1) if len(self.kind) else rows)


def _compact(text: str) -> str:
    try:
        return json.dumps(json.loads(text), ensure_ascii=True)
    except (RecursionError, ValueError):  # deeper than the interpreter goes, or a number too long for it: as it stands
        return text


class Level:
    """The elements of all arrays at one path and depth: ``items`` (values), and for each the row of its owner, its item_pos,
    and the element around it (item_pos ``outer_pos``, value ``outer_item``; None directly below the owner)."""

    __slots__ = ("item_pos", "items", "outer", "outer_item", "outer_pos", "owner", "path")

    def __init__(self, path, outer, items, owner, item_pos, outer_pos, outer_item):
        self.path, self.outer, self.items, self.owner = path, outer, items, owner
        self.item_pos, self.outer_pos, self.outer_item = item_pos, outer_pos, outer_item


def array_items(values: Values, owners: np.ndarray) -> Iterator[Level]:
    """All array elements inside some values, one round for each depth: all branches of all texts go down together.

    The path of a value is a number; a round gives each new (path, name) its number. Keys go down by take."""
    paths: list[tuple[int, int]] = [(-1, -1)]  # path -> (path above, name)
    spelled: dict[int, str] = {0: ""}

    def spell(path: int) -> str:
        steps, at = [], path
        while at not in spelled:
            steps.append(at)
            at = paths[at][0]
        for at in reversed(steps):
            above, name = paths[at]
            spelled[at] = f"{spelled[above]}.{values.names[name]}" if above else values.names[name]
        return spelled[path]

    rows, owner, path, outer = owners, np.arange(len(owners)), np.zeros(len(owners), np.int64), np.full(len(owners), -1)
    pos, around = pa.nulls(len(rows), pa.string()), np.full(len(rows), -1)
    while len(rows):
        parent, items, place = values.below(rows)
        if not len(items):
            return
        in_array = values.kind[rows[parent]] == ARRAY
        here = pos.take(pa.array(parent))
        owner, outer, around = owner[parent], outer[parent], around[parent]
        new_path = path[parent]
        if (~in_array).any():  # fields: the path grows by the name
            fields = np.flatnonzero(~in_array)
            pair = new_path[fields] * len(values.names) + values.name[items[fields]]
            different, back = np.unique(pair, return_inverse=True)
            new_path[fields] = len(paths) + back
            paths += [(int(p) // len(values.names), int(p) % len(values.names)) for p in different]
        new_pos, new_outer, new_around = here, outer, around
        if in_array.any():
            some = np.flatnonzero(in_array)
            above = here.take(pa.array(some))
            number = pc.cast(pa.array(place[some]), pa.string())
            item_pos = pc.if_else(pc.is_null(above), number, pc.binary_join_element_wise(pc.fill_null(above, ""), number, "."))
            codes = new_path[some]
            order = np.argsort(codes, kind="stable")
            bounds = np.flatnonzero(np.diff(codes[order])) + 1
            for part in np.split(order, bounds):  # one for each path at this depth
                at = some[part]
                inside = outer[at] >= 0
                split = [part] if inside.all() or not inside.any() else [part[~inside], part[inside]]
                for p in split:
                    a = some[p]
                    top = outer[a[0]] < 0
                    # elements of arrays at one path may lie in elements of different paths
                    for o in np.unique(outer[a]).tolist() if not top else [-1]:
                        q = p if top else p[outer[a] == o]
                        b = some[q]
                        yield Level(spell(int(codes[q[0]])), "" if top else spell(o), items[b], owner[b], item_pos.take(pa.array(q)), None if top else here.take(pa.array(b)), None if top else around[b])
            where = np.full(len(items), -1)
            where[some] = np.arange(len(some))
            new_pos = pc.if_else(pa.array(in_array), item_pos.take(pa.array(np.where(where < 0, 0, where))), here)
            new_outer, new_around = np.where(in_array, new_path, outer), np.where(in_array, items, around)
        deeper = values.kind[items] >= ARRAY
        rows, owner, path, outer, around = items[deeper], owner[deeper], new_path[deeper], new_outer[deeper], new_around[deeper]
        pos = new_pos.filter(pa.array(deeper)) if isinstance(new_pos, pa.Array) else new_pos.combine_chunks().filter(pa.array(deeper))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a text column, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


INVALID = object()


def parse(text: str | None):
    """One JSON text as Python values, for texts of no great depth; INVALID if it is none."""
    if text is None or not Values(pa.array([text])).valid[0]:
        return INVALID
    return json.loads(text[1:] if text[:1] == "\ufeff" else text, parse_int=lambda digits: int(digits) if len(digits) < 4000 else float(digits))


def scalar_text(value) -> str | None:
    """Text of a scalar as it stands in JSON, strings without quotes; None for null, JSON for arrays and objects."""
    if value is None:
        return None
    if type(value) is str:
        return value.encode("utf-8", "replace").decode("utf-8")
    return json.dumps(value, ensure_ascii=True)
