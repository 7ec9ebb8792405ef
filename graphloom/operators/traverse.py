"""Breadth-first traversal as a loop of joins, one level a round, state kept in checkpoints."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from graphloom.operators import reach
from graphloom.runtime import cut, freed

SMALL_FRONTIER = 100_000  # rows (a twentieth of it with paths) up to which a counted frontier is broadcast
MANY_SEEDS, MANY_EDGES = 100, 100_000  # from which on reached nodes that are only counted are counted by arrays (``reach``)


def _ahead(frontier: DataFrame, n: int, most: int) -> DataFrame:
    """A frontier counted as small goes to the edges, so they stay where they are; a larger one is shuffled with them."""
    return F.broadcast(frontier) if n <= most else frontier


def _level(df: DataFrame) -> DataFrame:
    """A checkpoint after which nothing is left of the shuffles that made it."""
    with freed(df.sparkSession):
        return cut(df.select("*"))  # a new plan, made under the setting


class ResourceLimitError(RuntimeError):
    """A frontier or result grew beyond its limit."""


def bfs(edges: DataFrame, seeds: DataFrame, low: int = 1, high: int = 100, paths: bool = False, every: bool = False, pairs: DataFrame | None = None, targets: DataFrame | None = None, limit: int | None = None, taken: bool = False) -> DataFrame:
    """seed, node, depth (and nodes, rels): every node reached from a seed, once, at its least depth, the seed left out.

    ``edges``: src, dst and, for ``paths``, rel. ``every``: all shortest paths instead of one. ``pairs`` (seed, node) or
    ``targets`` (node) limit the result; with ``pairs`` a seed stops once all its targets are found. ``limit``: largest
    frontier allowed. Among equal paths the one with the smallest relationship ids is kept. ``taken``: a seed is a struct of
    its node and the relationships (id, rel_type) its search may not take."""
    edges = edges.where("src is not null and dst is not null")
    # not partitioned by src ahead: a hot source would then stay one task, while a shuffle per level can be split (AQE)
    edges = (edges if paths or taken else edges.select("src", "dst")).persist()
    try:
        return _levels(edges, seeds, low, high, paths, every, pairs, targets, limit, taken)
    finally:
        edges.unpersist()


def _levels(edges: DataFrame, seeds: DataFrame, low: int, high: int, paths: bool, every: bool, pairs: DataFrame | None, targets: DataFrame | None, limit: int | None, taken: bool) -> DataFrame:
    node = "seed.node" if taken else "seed"
    most = SMALL_FRONTIER // 20 if paths else SMALL_FRONTIER
    first = seeds.select("seed").where(f"{node} is not null").distinct()
    start = [F.col("seed"), F.col(node).alias("node")]
    if paths:
        rel = edges.schema["rel"].dataType.simpleString()
        start += [F.array(node).alias("nodes"), F.expr(f"cast(array() as array<{rel}>)").alias("rels")]
    frontier = cut(first.select(*start))
    visited, levels = frontier.select("seed", "node"), []
    waiting = None if pairs is None else cut(pairs.select("seed", "node").distinct())
    depth, n = 0, frontier.count()
    wanted = None if targets is None else targets.select("node").where("node is not null").distinct()
    missing = None
    if wanted is not None and n <= SMALL_FRONTIER and not every:  # all seeds times all targets: the search ends once it has them
        wanted = cut(wanted)
        missing = n * wanted.count()
    while depth < high:
        depth += 1
        out = ["seed", F.col("dst").alias("node")]
        if paths:
            out += [F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("rels", F.array("rel")).alias("rels")]
        free = ~F.exists("seed.taken", lambda t: (t["id"] == F.col("rel.id")) & (t["rel_type"] == F.col("rel.rel_type"))) if taken else F.lit(True)
        step = edges.join(_ahead(frontier, n, most), F.col("node") == F.col("src")).where(free).select(*out)
        step = step.join(visited, ["seed", "node"], "left_anti")
        if not paths:
            step = step.distinct()
        elif not every:
            best = F.min_by(F.struct("nodes", "rels"), F.transform("rels", lambda r: r["id"])).alias("best")
            step = step.groupBy("seed", "node").agg(best).select("seed", "node", "best.nodes", "best.rels")
        frontier = cut(step)
        if missing:
            n, hits = frontier.join(wanted.withColumn("is_wanted", F.lit(1)), "node", "left").agg(F.count("*"), F.count("is_wanted")).first()
            missing -= hits
        else:
            n = frontier.count()
        if limit is not None and n > limit:
            raise ResourceLimitError(f"level {depth} has {n} rows, more than {limit}")
        if not n:
            break
        visited = visited.unionByName(frontier.select("seed", "node"))
        if depth >= low:
            levels.append(frontier.withColumn("depth", F.lit(depth)))
        if waiting is not None:
            waiting = cut(waiting.join(frontier.select("seed", "node").distinct(), ["seed", "node"], "left_anti"))
            if not waiting.limit(1).count():
                break
            frontier = frontier.join(waiting.select("seed").distinct(), "seed", "left_semi")  # n stays an upper bound
        if missing == 0:
            break
        if depth % 8 == 0:
            visited = cut(visited)
    if not levels:
        levels = [frontier.where(F.lit(False)).withColumn("depth", F.lit(0))]
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    if pairs is not None:
        found = found.join(pairs.select("seed", "node").distinct(), ["seed", "node"], "left_semi")
    if targets is not None:
        found = found.join(wanted, "node", "left_semi")
    return found


@dataclass(frozen=True)
class Half:
    """Relationships in one direction: ``edges`` (src, dst), whose ends have exactly these labels."""

    edges: DataFrame
    near: tuple[str, ...]
    far: tuple[str, ...]


def stages(halves: list[Half], start: set[tuple[str, ...]], goal: set[tuple[str, ...]], high: int) -> list[list[Half]]:
    """For each level the relationships that lead on from labels the search can have come to, and to labels from which
    the goal can still be reached."""
    left = [goal]
    for _ in range(high):
        left.append(left[-1] | {h.near for h in halves if h.far in left[-1]})
    here, out = start, []
    for depth in range(1, high + 1):
        some = [h for h in halves if h.near in here & left[high - depth + 1] and h.far in left[high - depth]]
        if not some:
            break
        out.append(some)
        here = {h.far for h in some}
    return out


def staged(levels: list[list[Half]], seeds: DataFrame, goal: set[tuple[str, ...]], low: int, every: bool, targets: DataFrame | None = None, filtered: bool = False, limit: int | None = None, drop_seed: bool = False, drop_node: bool = False) -> DataFrame:
    """What ``bfs`` finds, as seed, node, depth and times, with the relationships of each level known by labels (``stages``).

    ``times``: how many rows a row stands for: with ``every`` the number of shortest paths. ``drop_seed`` (only with
    ``every``; then rows of equal seeds count) and ``drop_node``: without that column, rows summed. ``targets`` (node) end
    the search once all seeds have them; ``filtered``: they are fewer than all nodes with the goal's labels. Levels meet
    earlier ones only where labels are shared, and the last level is neither counted nor checkpointed. After the last level
    that can meet an earlier one, ``drop_seed`` also keeps the seeds out of the levels: one row a node instead of one a seed
    and node. Where many seeds only count what they reach in a large graph, no row is made for a pair at all (``reach``)."""
    uses = Counter(id(h) for level in levels for h in level)
    kept = {id(h): h.edges.where("src is not null and dst is not null").select("src", "dst") for level in levels for h in level}
    shared = [kept[k].persist() for k, n in uses.items() if n > 1]
    weight = [F.sum("times").alias("times")]
    seen, apart = {h.near for h in levels[0]} if levels else set(), 1  # the first level from which on none meets an earlier one
    for depth, level in enumerate(levels, 1):
        far = {h.far for h in level}
        apart = depth + 1 if seen & far else apart
        seen |= far
    apart = apart if drop_seed and limit is None else len(levels) + 1
    try:
        first = seeds.select("seed").where("seed is not null")
        first = first.groupBy("seed").agg(F.count("*").alias("times")) if drop_seed else first.distinct().withColumn("times", F.lit(1).cast("bigint"))
        frontier = _level(first.select(*(["seed"] if apart > 1 else []), F.col("seed").alias("node"), "times"))
        n = frontier.count()
        if drop_node and not every and limit is None and len(levels) > 1 and n >= MANY_SEEDS and _many(levels, kept):
            counted = reach.numbers(levels, kept, frontier.select("seed"), goal, low)
            if counted is not None:
                return counted
        missing = None
        if targets is not None and n <= SMALL_FRONTIER and not every:
            wanted = targets.select("node").where("node is not null").distinct()
            wanted = cut(wanted) if filtered else wanted
            missing = n * wanted.count()
        visited, found = [({h.near for h in levels[0]}, frontier.select("seed", "node"))] if levels and apart > 1 else [], []
        for depth, level in enumerate(levels, 1):
            far = {h.far for h in level}
            last = depth == len(levels) and limit is None
            met = [df for labels, df in visited if labels & far]
            ahead = frontier.drop("hit").withColumnRenamed("node", "at")
            edges = reduce(DataFrame.unionByName, (kept[id(h)].withColumn("hit", F.lit(h.far in goal)) for h in level))
            key = ["seed", "node", "hit"]
            if depth >= apart:  # paths on from a node are the same whatever seed they came from
                ahead, key = ahead.groupBy("at").agg(*weight) if "seed" in ahead.columns else ahead, ["node", "hit"]
            step = edges.join(_ahead(ahead, n, SMALL_FRONTIER), F.col("at") == F.col("src")).select(*(["seed"] if "seed" in key else []), F.col("dst").alias("node"), "hit", "times")
            if met:
                step = step.join(reduce(DataFrame.unionByName, met), ["seed", "node"], "left_anti")
            if last and depth < low:
                break
            if last:
                found.append((step if every else step.select(*key).distinct().withColumn("times", F.lit(1).cast("bigint"))).where("hit").withColumn("depth", F.lit(depth)))
                break
            step = step.groupBy(*key).agg(*weight) if every else step.select(*key).distinct().withColumn("times", F.lit(1).cast("bigint"))
            frontier = _level(step)
            if missing and filtered:
                n, hits = frontier.join(wanted.withColumn("is_wanted", F.lit(1)), "node", "left").agg(F.count("*"), F.count("is_wanted")).first()
            else:
                n, hits = frontier.agg(F.count("*"), F.count_if("hit")).first()
            if limit is not None and n > limit:
                raise ResourceLimitError(f"level {depth} has {n} rows, more than {limit}")
            if not n:
                break
            if depth < apart:
                visited.append((far, frontier.select("seed", "node")))
            if depth >= low:
                found.append(frontier.where("hit").withColumn("depth", F.lit(depth)))
            if missing is not None:
                missing -= hits
                if missing == 0:
                    break
        if not found:
            found = [frontier.where(F.lit(False)).withColumn("depth", F.lit(0))]
        columns = [*([] if drop_seed else ["seed"]), *([] if drop_node else ["node"]), "depth"]
        every_level = reduce(DataFrame.unionByName, (df.select(*columns, "times") for df in found))
        return every_level.groupBy(*columns).agg(*weight) if drop_seed or drop_node else every_level
    finally:
        for df in shared:
            df.unpersist()


def _many(levels: list[list[Half]], edges: dict[int, DataFrame]) -> bool:
    """Counted from the end, until they are enough."""
    n = 0
    for k in dict.fromkeys(id(h) for level in reversed(levels) for h in level):
        n += edges[k].count()
        if n >= MANY_EDGES:
            return True
    return False


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as the column says, without it; never more than 65,536 at once."""
    block, one = f"{times}_block", f"{times}_one"
    df = df.withColumn(block, F.explode(F.expr(f"sequence(1L, (`{times}` + 65535) div 65536)")))
    rest = F.least(F.lit(65_536), F.col(times) - (F.col(block) - 1) * 65_536).cast("int")
    return df.withColumn(one, F.explode(F.array_repeat(F.lit(True), rest))).drop(times, block, one)


def distances(edges: DataFrame, seeds: DataFrame, high: int = 1_000_000) -> DataFrame:
    """node, hops: distance from the nearest seed, all seeds at once (hops 0 for the seeds). ``edges``: src, dst."""
    edges = edges.select("src", "dst").where("src is not null and dst is not null").persist()
    try:
        frontier = cut(seeds.select("node").where("node is not null").distinct().withColumn("hops", F.lit(0)))
        found, depth, n = frontier, 0, frontier.count()
        while depth < high:
            depth += 1
            step = edges.join(_ahead(frontier, n, SMALL_FRONTIER), F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
            frontier = cut(step.join(found.select("node"), "node", "left_anti").withColumn("hops", F.lit(depth)))
            if not (n := frontier.count()):
                break
            found = found.unionByName(frontier)
            if depth % 8 == 0:
                found = cut(found)
        return found
    finally:
        edges.unpersist()
