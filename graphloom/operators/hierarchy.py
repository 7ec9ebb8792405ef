"""Parent-child links to full hierarchies (problem 2).

Bottom-up leaf peeling. Each node keeps the number of children that still wait and the size of the subtree received so
far. A round peels every node without waiting children: it sends its subtree size to its parent, which counts it off. The
messages are summed map-side, so a parent with a third of all children is no hot group. What is left when nothing can be
peeled any more are the nodes on cycles. The reverse peel order then gives each level root, depth and path from the level
above it. Round i handles only what level i-1 left, so all rounds together move little more than the first.

Once no more than ``local_rows`` nodes are left (a bound, not a share of the input), one task finishes both directions for
the remainder by the same peeling over integer arrays; larger remainders go on in distributed rounds. A remainder of long
chains, which would take a round for every link, goes on by pointer doubling instead, with the same columns. State between
rounds is kept by checkpoints in the shared folder.

A descendant list of one root may hold a third of all nodes, so lists are rows (``descendants``), never arrays.

Defined results: links with a null end are ignored; repeated links count once; a node with several distinct parents keeps
the smallest (byte order); a link of a node to itself is a cycle of one. Nodes on a cycle or below one get the smallest id
on that cycle as root, depth -1 and a null path. subtree_size counts the node and all nodes below it; of a node on a cycle
that are all nodes of the cycle and below it. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from graphloom.runtime import cut

_CHUNK = 20_000  # nodes in a batch at most
_STEPS = 500_000  # path elements in a batch at most, a single path aside


def _node_table(links: DataFrame, parent: str, child: str) -> DataFrame:
    pairs = links.select(F.col(parent).cast("string").alias("parent"), F.col(child).cast("string").alias("node")).where("parent is not null and node is not null")
    kept = pairs.groupBy("node").agg(F.min("parent").alias("parent"))
    rows = kept.select("node", "parent", F.lit(0).cast("bigint").alias("kids")).unionByName(
        kept.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(1).cast("bigint").alias("kids"))
    )
    lost = pairs.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("kids"))
    return rows.unionByName(lost).groupBy("node").agg(F.max("parent").alias("parent"), F.sum("kids").alias("kids"), F.lit(1).cast("bigint").alias("size"))


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Paths:
    """Paths in a forest as slices: every node hands its path on to its largest child, so a path is made of few slices."""

    def __init__(self, parent: np.ndarray, size: np.ndarray, depth: np.ndarray, levels: list[np.ndarray]):
        n = len(parent)
        self.parent, self.length = parent, np.where(depth < 0, 0, depth + 1)
        heir, by_size = np.full(n, -1), np.argsort(size, kind="stable")
        inner = by_size[parent[by_size] >= 0]
        heir[parent[inner]] = inner  # the largest is written last
        self.head = np.arange(n)
        for level in reversed(levels):
            own = level[(parent[level] >= 0)]
            own = own[(heir[parent[own]] == own) & (depth[own] >= 0)]
            self.head[own] = self.head[parent[own]]
        self.order = np.lexsort((depth, self.head))
        self.pos = np.empty(n, np.int64)
        self.pos[self.order] = np.arange(n)

    def of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and nodes of the paths of some nodes, from the root down."""
        at, starts, lengths = some.copy(), [], []
        live = self.length[some] > 0
        while live.any():
            head = self.head[at]
            starts.append(self.pos[head])
            lengths.append(np.where(live, self.pos[at] - self.pos[head] + 1, 0))
            live = live & (self.parent[head] >= 0)
            at = np.where(live, self.parent[head], at)
        offsets = np.concatenate([[0], np.cumsum(self.length[some])])
        if not starts:
            return offsets, np.zeros(0, np.int64)
        return offsets, self.order[_runs(np.stack(starts[::-1], 1).ravel(), np.stack(lengths[::-1], 1).ravel())]

    def chunks(self) -> Iterator[np.ndarray]:
        """All nodes in order, cut by the number of nodes and by the summed length of their paths."""
        ends, start = np.cumsum(self.length), 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + _CHUNK, int(np.searchsorted(ends, before + _STEPS, side="right"))))
            yield np.arange(start, stop)
            start = stop


def _peel_locally(with_path: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        ids, parents = whole.column("node").combine_chunks(), whole.column("parent").combine_chunks()
        parent = pc.fill_null(pc.index_in(parents, value_set=ids), -1).to_numpy().astype(np.int64)
        size = whole.column("size").to_numpy().astype(np.int64).copy()
        n = len(parent)
        kids = np.bincount(parent[parent >= 0], minlength=n)
        levels, leaves = [], np.flatnonzero(kids == 0)
        while len(leaves):
            levels.append(leaves)
            inner = leaves[parent[leaves] >= 0]
            up, count = np.unique(parent[inner], return_counts=True)
            np.add.at(size, parent[inner], size[inner])
            kids[up] -= count
            leaves = up[kids[up] == 0]
        root, depth = np.arange(n), np.zeros(n, np.int64)
        stuck = np.flatnonzero(kids > 0)
        if len(stuck):
            order = pc.sort_indices(ids).to_numpy()
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            done = np.zeros(n, bool)
            for start in stuck.tolist():
                if not done[start]:
                    ring, at = [], start
                    while not done[at]:
                        done[at] = True
                        ring.append(at)
                        at = int(parent[at])
                    ring = np.asarray(ring)
                    root[ring], depth[ring], size[ring] = ring[rank[ring].argmin()], -1, size[ring].sum()
        for level in reversed(levels):
            inner = level[parent[level] >= 0]
            above = parent[inner]
            root[inner] = root[above]
            depth[inner] = np.where(depth[above] < 0, -1, depth[above] + 1)
        paths = _Paths(parent, size, depth, levels) if with_path else None
        for some in paths.chunks() if with_path else (np.arange(k, min(n, k + _CHUNK)) for k in range(0, n, _CHUNK)):
            columns = [ids.slice(some[0], len(some)), parents.slice(some[0], len(some)), ids.take(pa.array(root[some])), pa.array(depth[some].astype(np.int32)), pa.array(size[some])]
            names = ["node", "parent", "root_id", "depth", "subtree_size"]
            if with_path:
                offsets, steps = paths.of(some)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ids.take(pa.array(steps)), mask=pa.array(depth[some] < 0)).cast(pa.list_(pa.string())))
                names.append("path")
            columns = [c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _cycle_roots(stuck: DataFrame) -> DataFrame:
    """Smallest id and summed size of each cycle by pointer doubling, for a remainder of cycle nodes beyond the local bound."""
    state = cut(stuck.select("node", "parent", "size", F.col("parent").alias("hop"), F.least("node", "parent").alias("low")))
    while True:
        other = state.select(F.col("node").alias("hop"), F.col("hop").alias("hop2"), F.col("low").alias("low2"))
        state = cut(state.join(other, "hop").select("node", "parent", "size", F.col("hop2").alias("hop"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("changed")))
        if not state.where("changed").limit(1).count():
            break
    total = state.groupBy("low").agg(F.sum("size").alias("subtree_size"))
    return state.join(total, "low").select("node", "parent", F.col("low").alias("root_id"), F.lit(-1).alias("depth"), "subtree_size")


def _doubled(state: DataFrame, rounds: int, with_path: bool) -> DataFrame:
    """node, parent, reach, dist, done, path, size: the ancestor as many steps up as the rounds so far allow.

    Every round doubles the steps. ``done``: reach is a root. ``path``: the nodes below reach down to the node. ``size``: the
    summed sizes of the nodes less than that many steps below, of which each round adds those of the nodes exactly so far
    below; messages are summed map-side."""
    top = F.col("parent").isNull()
    path = F.when(top, F.expr("cast(array() as array<string>)")).otherwise(F.array("node")) if with_path else F.lit(None).cast("array<string>")
    known = state.select("node", "parent", F.coalesce("parent", "node").alias("reach"), F.when(top, 0).otherwise(1).cast("bigint").alias("dist"), top.alias("done"), path.alias("path"), "size")
    known = cut(known)
    for k in range(rounds):
        up = known.select(F.col("node").alias("reach"), F.col("reach").alias("reach2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"), F.col("path").alias("path2"))
        moved = known.where("not done").join(up, "reach").select(
            "node", "parent", F.col("reach2").alias("reach"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"), (F.concat("path2", "path") if with_path else F.col("path")).alias("path"), "size"
        )
        below = known.where(F.col("dist") == 1 << k).groupBy(F.col("reach").alias("node")).agg(F.sum("size").alias("more"))
        known = cut(known.where("done").unionByName(moved).join(below, "node", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more"))
        if not known.where(~F.col("done") | (F.col("dist") >= 1 << (k + 1))).limit(1).count():
            break
    return known


def _by_doubling(state: DataFrame, n: int, with_path: bool) -> DataFrame:
    """Root, depth, size and path of a remainder that peels too slowly (long chains)."""
    rounds = max(1, n.bit_length() + 1)
    known = _doubled(state, rounds, False)
    done, stuck = known.where("done"), known.where("not done")
    ring = cut(stuck.select(F.col("reach").alias("node")).distinct())  # after more steps than nodes every reach is on a cycle
    hanging = stuck.join(ring, "node", "left_anti")
    own = state.join(ring, "node", "left_semi").select("node", "parent", "size")
    sent = hanging.join(ring.withColumnRenamed("node", "parent"), "parent", "left_semi").groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("more"))
    low = cut(_cycle_roots(own.join(sent, "node", "left").select("node", "parent", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))))
    root = low.select(F.col("node").alias("reach"), F.col("root_id").alias("low"))
    below = hanging.join(root, "reach").select("node", "parent", F.col("low").alias("root_id"), F.lit(-1).alias("depth"), F.col("size").alias("subtree_size"))
    tree = done.select("node", "parent", F.col("reach").alias("root_id"), F.col("dist").cast("int").alias("depth"), F.col("size").alias("subtree_size"))
    caught = low.unionByName(below)
    if with_path:  # only for nodes below a root: a path round a cycle would not end
        whole = _doubled(state.join(done.select("node"), "node", "left_semi"), rounds, True).select("node", F.concat(F.array("reach"), "path").alias("path"))
        tree, caught = tree.join(whole, "node"), caught.withColumn("path", F.lit(None).cast("array<string>"))
    return tree.unionByName(caught)


def hierarchy(links: DataFrame, parent: str, child: str, with_path: bool = True, local_rows: int = 200_000, slow_rounds: int = 64) -> DataFrame:
    """node, parent, root_id, depth, subtree_size (the node counts) and, if asked for, path (array from the root down).

    After ``slow_rounds`` rounds, a remainder beyond ``local_rows`` of which a round peels less than a 64th goes on by
    pointer doubling."""
    state = cut(_node_table(links, parent, child))
    peeled: list[DataFrame] = []
    doubling = False
    while True:
        seen = state.agg(F.count("*").alias("n"), F.count(F.when(F.col("kids") == 0, 1)).alias("leaves")).first()
        doubling = bool(seen["leaves"]) and len(peeled) >= slow_rounds and seen["leaves"] * 64 < seen["n"]
        if seen["n"] <= local_rows or not seen["leaves"] or doubling:
            break
        leaves = state.where("kids = 0")
        peeled.append(leaves.select("node", "parent", "size"))
        sent = leaves.where("parent is not null").select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(-1).cast("bigint").alias("kids"), "size")
        state = cut(
            state.where("kids > 0").select("node", "parent", "kids", "size").unionByName(sent).groupBy("node").agg(F.max("parent").alias("parent"), F.sum("kids").alias("kids"), F.sum("size").alias("size"))
        )
    if seen["n"] <= local_rows:
        schema = "node string, parent string, root_id string, depth int, subtree_size bigint" + (", path array<string>" if with_path else "")
        assigned = state.select("node", "parent", "size").coalesce(1).mapInArrow(_peel_locally(with_path), schema)
    elif doubling:
        assigned = _by_doubling(state, seen["n"], with_path)
    else:
        assigned = _cycle_roots(state)
        if with_path:
            assigned = assigned.withColumn("path", F.lit(None).cast("array<string>"))
    parts = [cut(assigned) if peeled else assigned]
    for turn, level in enumerate(reversed(peeled)):
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        if turn and turn % 8 == 0:
            whole = cut(whole)
            parts = [whole]
        keep = ["root_id", "depth", *(["path"] if with_path else [])]
        above = whole.select(F.col("node").alias("parent"), *(F.col(c).alias(f"up_{c}") for c in keep))
        columns = [
            "node",
            "parent",
            F.coalesce("up_root_id", "node").alias("root_id"),
            F.when(F.col("parent").isNull(), 0).when(F.col("up_depth") < 0, -1).otherwise(F.col("up_depth") + 1).cast("int").alias("depth"),
            F.col("size").alias("subtree_size"),
        ]
        if with_path:
            columns.append(F.when(F.col("parent").isNull(), F.array("node")).otherwise(F.concat("up_path", F.array("node"))).alias("path"))
        below = level.join(above, "parent", "left").select(*columns)
        parts.append(below if turn == len(peeled) - 1 else cut(below))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tree_descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor, node, distance) rows from the paths of ``hierarchy``: every node below every node, without nodes on a cycle or below one."""
    at = F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("pos", "ancestor")
    return nodes.where("depth > 0").select("node", "depth", at).select("ancestor", "node", (F.col("depth") - F.col("pos")).alias("distance"))


def caught_descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor, node, distance) rows for the nodes on a cycle or below one.

    The link into the smallest id of each cycle is left out, which makes the rest an ordinary tree with that id on top. The
    path of the cycle's last node is then the whole cycle; what of it is not in a node's own path lies above the top."""
    caught = cut(nodes.where("depth < 0").select("node", "parent", "root_id"))
    if not caught.where("node <> root_id").limit(1).count():
        return tree_descendants(nodes.where("depth < 0"))  # only cycles of one
    opened = cut(hierarchy(caught.where("node <> root_id"), "parent", "node").select("node", "root_id", "depth", "path"))
    last = caught.where("node = root_id").select(F.col("parent").alias("node"))
    rings = opened.join(last, "node").select("root_id", F.col("path").alias("ring"))
    joined = opened.join(rings, "root_id").select("node", "depth", "ring", F.size(F.array_intersect("path", "ring")).alias("shared"))
    at = F.posexplode(F.slice("ring", F.col("shared") + 1, F.size("ring"))).alias("pos", "ancestor")
    above = joined.select("node", "depth", (F.size("ring") - F.col("shared")).alias("n_above"), at)
    return tree_descendants(opened).unionByName(above.select("ancestor", "node", (F.col("depth") + F.col("n_above") - F.col("pos")).alias("distance")))


def descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor, node, distance) rows of every node below every other node, at the least number of links.

    Nodes on a cycle are below all others on it, nodes below a cycle are below all of it; no node is below itself."""
    return tree_descendants(nodes).unionByName(caught_descendants(nodes))
