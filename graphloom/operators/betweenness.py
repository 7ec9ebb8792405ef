"""Edge betweenness by tasks that each hold the whole graph as arrays and take some of the sources.

A row for every pair of source and node (and three joins of them with the edges) is what makes Brandes' algorithm large:
100 sources that reach 400,000 nodes over 2.4 million edges are 39 million pairs and 220 million steps. The graph alone is
8 bytes an edge, so up to a bound it goes to every task, and only one number an edge and task comes back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.runtime import cut

CHUNK = 32_768  # edges a row


def _index(sources: list[int]):
    """Edges by hashes of their ends to edges by numbers, in order; ahead of them a row with the numbers of the sources.

    ``check`` has 32 more bits of each end's hash: where two nodes share a hash, there is a row -2 instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(chunk: int, n: int, src: bytes, dst: bytes, ids: pa.Array) -> pa.RecordBatch:
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([n], pa.int32()), pa.array([src], pa.binary()), pa.array([dst], pa.binary()), listed], ["chunk", "n", "src", "dst", "ids"])

        table = pa.Table.from_batches(rows) if (rows := list(batches)) else None
        if table is None or not table.num_rows:
            return
        del rows
        ids = table.column("id")
        column = lambda name: table.column(name).to_numpy()
        keys = np.union1d(np.unique(column("src")), np.unique(column("dst")))
        src, dst = (keys.searchsorted(column(c)).astype(np.int32) for c in ("src", "dst"))
        more = np.empty(len(keys), np.int32)
        ends = [(x, ((column("check") >> shift) & 0xFFFFFFFF).astype(np.uint32).view(np.int32)) for x, shift in ((src, 32), (dst, 0))]
        for x, low in ends:
            more[x] = low
        none = pa.array([], ids.type)
        if any((more[x] != low).any() for x, low in ends):
            yield row(-2, len(keys), b"", b"", none)
            return
        del ends, more
        want = np.array(sources, np.int64)
        found = keys.searchsorted(want).clip(max=len(keys) - 1)
        yield row(-1, len(keys), np.where(keys[found] == want, found, -1).astype(np.int32).tobytes(), b"", none)
        order = np.argsort(src.astype(np.int64) << 32 | dst)
        for k, start in enumerate(range(0, len(order), CHUNK)):
            some = order[start : start + CHUNK]
            yield row(k, len(keys), src[some].tobytes(), dst[some].tobytes(), pa.concat_arrays(ids.take(pa.array(some)).chunks))

    return run


def dependencies(src: np.ndarray, dst: np.ndarray, n: int, sources: list[int]) -> np.ndarray:
    """Of every edge (sorted by ``src``), its share of the shortest paths from the sources to all nodes, summed."""
    first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
    total = np.zeros(len(src))
    seen, mark = np.empty(n, bool), np.empty(n, np.int32)
    for s in sources:
        seen[:] = False
        sigma, delta, steps, frontier = np.zeros(n), np.zeros(n), [], np.array([s], np.int32)
        seen[s], sigma[s] = True, 1.0
        while True:
            counts = first[frontier + 1] - first[frontier]
            ends = np.cumsum(counts)
            at = np.repeat((first[frontier] - ends + counts).astype(np.int32), counts)
            at += np.arange(len(at), dtype=np.int32)
            at = at[~seen[dst[at]]]
            if not len(at):
                break
            w = dst[at]
            np.add.at(sigma, w, sigma[src[at]])
            seen[w] = True
            turn = np.arange(len(w), dtype=np.int32)
            mark[w] = turn
            frontier = w[mark[w] == turn]  # each node once
            steps.append(at)
        while steps:
            at = steps.pop()
            v, w = src[at], dst[at]
            part = sigma[v] / sigma[w] * (1 + delta[w])
            total[at] += part
            np.add.at(delta, v, part)
    return total


def _advance(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, starts, n, g = {}, np.array([], np.int32), 0, 0
        for batch in batches:
            for chunk, group, size, src, dst in zip(*(batch.column(c) for c in ("chunk", "g", "n", "src", "dst")), strict=True):
                n, g = size.as_py(), group.as_py()
                arrays = [np.frombuffer(x.as_buffer(), np.int32).copy() for x in (src, dst)]
                if chunk.as_py() < 0:
                    starts = arrays[0]
                else:
                    chunks[chunk.as_py()] = arrays
        mine = [int(s) for s in starts[g::groups] if s >= 0]
        if not chunks or not mine:
            return
        numbers = sorted(chunks)
        lengths = [len(chunks[k][0]) for k in numbers]
        src, dst = (np.concatenate([chunks[k][i] for k in numbers]) for i in (0, 1))
        chunks.clear()
        total, start = dependencies(src, dst, n, mine), 0
        for k, length in zip(numbers, lengths, strict=True):
            part = total[start : start + length]
            start += length
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([g], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "g", "scores"])

    return run


def _add(table: pa.Table) -> pa.Table:
    """Of one chunk, its ids with the sums of all tasks, added in the order of the tasks."""
    ids, parts = None, {}
    for g, listed, scores in zip(*(table.column(c) for c in ("g", "ids", "scores")), strict=True):
        if listed.is_valid:
            ids = listed.values
        else:
            parts[g.as_py()] = np.frombuffer(scores.as_buffer())
    total = np.zeros(len(ids))
    for g in sorted(parts):
        total += parts[g]
    return pa.table({"id": ids, "c": total})


def whole_graph_scores(hops: DataFrame, sources: list[int]) -> DataFrame | None:
    """id, c: summed dependencies of all edges (``hops``: id, src, dst, check; the ends are hashes, as ``sources`` are).

    None where two nodes share a hash."""
    spark = hops.sparkSession
    kind = hops.schema["id"].dataType.simpleString()
    shape = f"chunk int, n int, src binary, dst binary, ids array<{kind}>"
    graph = cut(hops.select("id", "src", "dst", "check").repartition(1).mapInArrow(_index(sources), shape))
    if graph.where("chunk = -2").count():
        return None
    groups = max(1, min(len(sources), spark.sparkContext.defaultParallelism))
    dealt = graph.select("chunk", "n", "src", "dst", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")).repartitionById(groups, "g")
    parts = dealt.mapInArrow(_advance(groups), "chunk int, g int, scores binary")
    listed = graph.where("chunk >= 0").select("chunk", F.lit(-1).alias("g"), "ids", F.lit(None).cast("binary").alias("scores"))
    both = listed.unionByName(parts.withColumn("ids", F.lit(None).cast(f"array<{kind}>")))
    return both.groupBy("chunk").applyInArrow(_add, f"id {kind}, c double")
