"""How many nodes the searches from many seeds reach, by tasks that map the relationships into memory as arrays.

A row for every pair of seed and node is what makes such a search large: 60,000 suppliers and 900,000 customers are
thousands of millions of pairs. The relationships are 4 bytes each as arrays. They are written once to the checkpoint
folder, every task maps them and searches from its share of the seeds, some seeds at a time; only one number a seed and
depth comes back.

Nodes are numbered within their labels, the labels in an order in which every relationship leads to earlier ones. The nodes
of a label are dealt out by a hash of their id; a task numbers its own, writes the relationships that leave them, and deals
out those that come in by their other end."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from graphloom.runtime import cut, freed

ROW = "g int, half int, p int, n bigint, src binary, dst binary"
DEALT = 1 << 20  # relationships a task reads before it deals them out
STEPS = 1 << 20  # steps that searches make at once, unless those of one seed are more
LOW = 0xFFFFFFFF
SEEDS, NODES = -2, -1  # instead of a half's number: rows with seeds, with the number of a task's nodes


def order(halves: list[tuple]) -> list | None:
    """The labels of (near, far), each after those its relationships lead to; None where they lead back."""
    left, out = {x for h in halves for x in h}, []
    while left:
        some = sorted(x for x in left if not any(near == x and far in left for near, far in halves))
        if not some:
            return None
        out += some
        left -= set(some)
    return out


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(folder).path)
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _write(folder: str, name: str, arrays: Iterator[np.ndarray]) -> None:
    """By way of another name, so that a task that is run twice leaves a whole file."""
    files, path = _open(folder)
    other = f"{path}/{uuid.uuid4().hex}"
    with files.open_output_stream(other) as out:
        for array in arrays:
            out.write(pa.py_buffer(array))
    files.move(other, f"{path}/{name}")


def _read(folder: str, name: str, kind: type) -> np.ndarray:
    files, path = _open(folder)
    if not files.get_file_info(f"{path}/{name}").size:  # nothing to map
        return np.empty(0, kind)
    if isinstance(files, fs.LocalFileSystem):
        with pa.memory_map(f"{path}/{name}") as some:
            return np.frombuffer(some.read_buffer(), kind)
    with files.open_input_file(f"{path}/{name}") as some:
        return np.frombuffer(some.read_buffer(), kind)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds, strict=True)], ["g", "half", "p", "n", "src", "dst"])


def _dealt(half: int, p: int, src: np.ndarray, dst: np.ndarray, by: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    group = ((by.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(groups)).astype(np.uint16)
    turn = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[turn], np.arange(groups + 1))
    src, dst = src[turn], dst[turn]
    rows = [(g, half, p, b - a, src[a:b].tobytes(), dst[a:b].tobytes()) for g, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if a < b]
    if rows:
        yield _batch(rows)


def _deal(half: int, by: str, groups: int) -> Callable:
    """Rows of src and dst as bytes, one for each group of nodes and so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            src, dst = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in some]) for c in ("src", "dst"))
            return _dealt(half, 0, src, dst, src if by == "src" else dst, groups)

        for batch in batches:
            if batch.num_rows:
                some.append(batch)
                n += batch.num_rows
            if n >= DEALT:
                yield from out()
                some, n = [], 0
        if some:
            yield from out()

    return run


def distinct(keys: np.ndarray) -> np.ndarray:
    if len(keys) < 2 or (keys[1:] > keys[:-1]).all():
        return keys
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def _taken(batches: Iterator[pa.RecordBatch], offsets: dict[int, np.ndarray]) -> tuple[int | None, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The group, and src and dst by half; ends that have numbers (halves with ``offsets``) by numbers within the label."""
    got, g = defaultdict(lambda: ([], [])), None
    for batch in batches:
        for group, half, p, src, dst in zip(*(batch.column(c) for c in ("g", "half", "p", "src", "dst")), strict=True):
            g, h = group.as_py(), half.as_py()
            got[h][0].append(np.frombuffer(src.as_buffer(), np.int64))
            got[h][1].append(np.frombuffer(dst.as_buffer(), np.int32) + offsets[h][p.as_py()] if h in offsets else np.frombuffer(dst.as_buffer(), np.int64))
    return g, {h: (np.concatenate(s), np.concatenate(d).astype(np.int64)) for h, (s, d) in got.items()}


def _keys(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Place of src in ``nodes`` and dst in one number, sorted, each once; without others."""
    at = nodes.searchsorted(src)
    there = nodes[at.clip(max=len(nodes) - 1)] == src if len(nodes) else np.zeros(len(src), bool)
    return distinct(at[there] << 32 | dst[there])


def _number(near: dict[int, np.ndarray], far: list[int], folder: str, groups: int) -> Callable:
    """Of one label, numbers of a group's nodes: ``far`` halves come in, ``near`` ones leave (with the first numbers of the
    groups of their far label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, got = _taken(batches, near)
        if g is None:
            return
        none = np.empty(0, np.int64)
        nodes = distinct(np.concatenate([none, *(got[h][1] for h in far if h in got)]))
        yield _batch([(-1, NODES, g, len(nodes), b"", b"")])
        for h in near if len(nodes) else []:
            keys = _keys(nodes, *got.pop(h, (none, none)))
            _write(folder, f"{h}-{g}.to", iter([(keys & LOW).astype(np.int32)]))
            _write(folder, f"{h}-{g}.n", iter([np.bincount(keys >> 32, minlength=len(nodes)).astype(np.int32)]))
        for h in far:
            if h in got:
                src, dst = got.pop(h)
                yield from _dealt(h, g, src, nodes.searchsorted(dst).astype(np.int32), src, groups)

    return run


def _join(groups: dict[int, list[int]], folder: str) -> Callable:
    """Of each half, its files of the groups as one, and where each node's relationships begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = sorted(groups)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                h = halves[k]
                _write(folder, f"{h}.to", (_read(folder, f"{h}-{g}.to", np.int32) for g in groups[h]))
                n = np.concatenate([np.zeros(1, np.int32), *(_read(folder, f"{h}-{g}.n", np.int32) for g in groups[h])])
                _write(folder, f"{h}.at", iter([np.cumsum(n, dtype=np.int64)]))
            yield batch

    return run


def ahead(at: np.ndarray, to: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Seed and next node for each seed and node, maybe more than once."""
    v = keys & LOW
    first = at[v]
    n = at[v + 1] - first
    total = int(n.sum())
    if total > 8 * STEPS and len(keys) > 1:
        mid = len(keys) // 2
        return distinct(np.concatenate([distinct(ahead(at, to, some)) for some in (keys[:mid], keys[mid:])]))
    seeds = keys & ~LOW
    if total > 64 * len(keys):
        out, here = np.empty(total, np.int64), 0
        for seed, a, many in zip(seeds, first.tolist(), n.tolist(), strict=True):
            np.bitwise_or(to[a : a + many], seed, out=out[here : here + many])
            here += many
        return out
    places = np.repeat(first - (np.cumsum(n) - n), n)
    places += np.arange(total)
    out = np.repeat(seeds, n)
    out |= to[places]
    return out


class Search:
    """Numbers of new nodes by depth and seed. A node of a seed is one number, the seed's place and its own; all sorted."""

    def __init__(self, levels: list[list[tuple]], graph: dict[int, tuple[np.ndarray, np.ndarray]], goal: set, low: int, seeds: int):
        self.levels, self.graph, self.goal, self.low = levels, graph, goal, low
        self.found = np.zeros((len(levels) + 1, seeds), np.int64)
        self.later = [{far for level in levels[depth:] for _, _, far in level} for depth in range(len(levels) + 1)]

    def arrive(self, came: dict, seen: dict, depth: int) -> None:
        """``came``: by label what a level leads to, still with nodes that were there before."""
        front, seen = {}, {label: keys for label, keys in seen.items() if label in self.later[depth - 1]}
        for label, keys in came.items():
            old = seen.get(label)
            if old is not None and len(old):
                keys = keys[old[old.searchsorted(keys).clip(max=len(old) - 1)] != keys]
            if label in self.goal and depth >= self.low and len(keys):
                a, b = keys[0] >> 32, (keys[-1] >> 32) + 1
                self.found[depth, a:b] += np.diff(keys.searchsorted(np.arange(a, b + 1) << 32))
            front[label] = keys
            if label in self.later[depth]:
                seen[label] = keys if old is None else np.sort(np.concatenate([old, keys]))
        if depth < len(self.levels):
            self.go(front, seen, depth + 1)

    def go(self, front: dict, seen: dict, depth: int) -> None:
        """One level on, as many seeds at a time as their steps allow."""
        level = [(h, near, far) for h, near, far in self.levels[depth - 1] if len(front.get(near, ()))]
        if not level:
            return
        start = min(int(front[near][0] >> 32) for _, near, _ in level)
        seeds = max(int(front[near][-1] >> 32) for _, near, _ in level) + 1 - start
        steps = np.zeros(seeds)
        for h, near, _ in level:
            at, v = self.graph[h][0], front[near] & LOW
            steps += np.bincount((front[near] >> 32) - start, at[v + 1] - at[v], seeds)
        total, a = np.cumsum(steps), 0
        while a < seeds:
            b = max(a + 1, int(total.searchsorted((total[a - 1] if a else 0) + STEPS, "right")))
            few = lambda some: {label: keys[slice(*keys.searchsorted([(start + a) << 32, (start + b) << 32]))] for label, keys in some.items()}  # noqa: B023, E731
            here, came = few(front), defaultdict(list)
            for h, near, far in level:
                if len(here[near]):
                    came[far].append(ahead(*self.graph[h], here[near]))
            self.arrive({far: distinct(np.concatenate(some)) for far, some in came.items()}, few(seen), depth)
            a = b


def _search(levels: list[list[tuple]], offsets: dict[int, np.ndarray], there: set[int], folder: str, goal: set, low: int, kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, got = _taken(batches, offsets)
        if SEEDS not in got:
            return
        seeds = distinct(got.pop(SEEDS)[0])
        none = np.zeros(1, np.int64), np.empty(0, np.int32)
        graph = {h: (_read(folder, f"{h}.at", np.int64), _read(folder, f"{h}.to", np.int32)) if h in there else none for level in levels[1:] for h, _, _ in level}
        # no task had nodes of a label that isn't there, so nothing leads to it
        search, came = Search(levels, graph, goal, low, len(seeds)), defaultdict(list)
        for h, _, far in levels[0]:
            if h in got:
                came[far].append(_keys(seeds, *got.pop(h)))
        search.arrive({far: distinct(np.concatenate(some)) for far, some in came.items()}, {}, 1)
        depth, seed = np.nonzero(search.found)
        yield pa.RecordBatch.from_arrays([pa.array(seeds[seed]).cast(kind), pa.array(depth.astype(np.int32)), pa.array(search.found[depth, seed])], ["seed", "depth", "times"])

    return run


def numbers(levels: list[list], edges: dict[int, DataFrame], seeds: DataFrame, goal: set, low: int) -> DataFrame | None:
    """seed, depth, times: how many nodes with the goal's labels are reached from each of the distinct ``seeds`` first at
    that depth. ``edges``: src, dst of each half of the levels, by its ``id()``.

    None where labels lead back to themselves, or ids are no whole numbers."""
    spark = seeds.sparkSession
    halves = list({id(h): h for level in levels for h in level}.values())
    whole = ("bigint", "int")
    if any(edges[id(h)].schema[c].dataType.simpleString() not in whole for h in halves for c in ("src", "dst")) or seeds.schema["seed"].dataType.simpleString() not in whole:
        return None
    labels = order([(h.near, h.far) for h in halves])
    if labels is None:
        return None
    number = {id(h): k for k, h in enumerate(halves)}
    numbered = [[(number[id(h)], labels.index(h.near), labels.index(h.far)) for h in level] for level in levels]
    on = {h for level in numbered[1:] for h, _, _ in level}
    groups = min(60_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    folder = f"{spark.sparkContext.getCheckpointDir()}/reach-{uuid.uuid4().hex}"
    files, path = _open(folder)
    files.create_dir(path)

    def deal(df: DataFrame, half: int, by: str) -> DataFrame:
        return df.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).mapInArrow(_deal(half, by, groups), ROW)

    def done(frames: list[DataFrame], f: Callable, shape: str) -> DataFrame:
        with freed(spark):
            return cut(reduce(DataFrame.unionByName, frames).repartitionById(groups, "g").mapInArrow(f, shape))

    try:
        offsets, there, came = {}, {}, {}
        for label in range(len(labels)):
            far = [k for k, h in enumerate(halves) if labels.index(h.far) == label]
            near = [k for k in on if labels.index(halves[k].near) == label]
            if not far:  # seeds only
                continue
            frames = [deal(edges[id(halves[k])], k, "dst") for k in far] + [came[k].where(F.col("half") == k) for k in near]
            df = done(frames, _number({k: offsets[k] for k in near}, far, folder, groups), ROW)
            n = np.zeros(groups + 1, np.int64)
            for p, many in df.where(F.col("half") == NODES).select("p", "n").collect():
                n[p + 1] = many
            if n.sum() >= 1 << 31:
                return None
            there |= {k: [g for g in range(groups) if n[g + 1]] for k in near if n.any()}
            for k in far:
                offsets[k], came[k] = np.cumsum(n)[:-1], df
        if there:
            spark.range(0, len(there), 1, len(there)).mapInArrow(_join(there, folder), "id bigint").count()
        first = {h for h, _, _ in numbered[0]}
        frames = [came[h].where(F.col("half") == h) for h in sorted(first)] + [deal(seeds.select(F.col("seed").alias("src"), F.col("seed").alias("dst")), SEEDS, "src")]
        kind = seeds.schema["seed"].dataType.simpleString()
        run = _search(numbered, {h: offsets[h] for h in first}, set(there), folder, {k for k, x in enumerate(labels) if x in goal}, low, pa.int64() if kind == "bigint" else pa.int32())
        return done(frames, run, f"seed {kind}, depth int, times bigint")
    finally:
        files.delete_dir(path)
