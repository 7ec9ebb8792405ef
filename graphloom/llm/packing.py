"""Filling fixed-capacity containers with texts (problem 6).

Sizes are tokens of a public byte-level BPE vocabulary (its path is a parameter). An instance of bin packing with integer
sizes up to a capacity C is no more than its histogram: at most C counts. That histogram, whose size the capacity bounds
whatever the number of documents, is solved on the driver:

1. Martello-Toth dominance reduction. For an item j, a set of j and at most ``MOST_ITEMS`` others that dominates every other
   feasible set with j is fixed for good, for as many copies as the counts allow, and the instance shrinks.
2. The remainder is packed best-fit, sizes descending, again for whole groups of equal containers at a time.

The solution is a list of segments (size, ranks, first container, items per container). Documents find their container
by their rank within their size: ranks come from counts per (size, bucket), so a size that a third of all documents have
is no hot group, and the lookup is a binary search in the broadcast segments.

Defined results: a text longer than the capacity is cut into full pieces, each a container of its own, and a rest that is
packed like any text; no other text is cut. Empty and null texts have size 0 and are spread over the containers. Document
ids are taken as unique; a window without a capacity of at least 1 is an error. Empty tables give empty results.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from graphloom.runtime import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern of this vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 256
MOST_WINDOWS = 1000
MOST_ITEMS = 8  # items beside the first in a dominating set
MOST_CAPACITY = 1 << 22
MOST_SIZES = 1 << 22  # summed capacities of the windows that are solved and broadcast together
_RANK = 41  # bits of a rank within a size: two trillion documents of one size


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and number of tokens of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "tokens"])

    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, tokens bigint")


class _Stock:
    """Counts by size, with the sizes in order."""

    def __init__(self, hist: dict[int, int]):
        self.count = {s: n for s, n in hist.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest size up to ``most`` of which a copy is left besides those in ``without``."""
        at = bisect_right(self.sizes, most)
        while at:
            at -= 1
            if self.count[self.sizes[at]] > without.count(self.sizes[at]):
                return self.sizes[at]
        return None

    def smallest(self, n: int, without: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.count[s] - (s == without))
            if len(out) >= n:
                break
        return out


def _dominating(stock: _Stock, j: int, capacity: int, most: int = MOST_ITEMS) -> tuple[int, ...] | None:
    """A set with j that dominates all feasible sets with j, or None.

    At most k further items fit beside j (the k + 1 smallest don't). Take a1, the largest that fits, a2, the largest that
    fits beside it, and so on. The i-th largest item of any feasible set is at most room / i; so if each a_i is at least the
    largest item up to room / i, the items of any set with j can change places with a1, a2, ... and j's set is dominated.
    An a1 that fills the room dominates whatever else fits."""
    room = capacity - j
    low = stock.smallest(most + 1, j)
    if not low or low[0] > room:
        return (j,)
    group, left = (j,), room
    for i in range(1, most + 1):
        a = stock.largest(left, group)
        if a is None or a < (stock.largest(room // i, (j,)) or 0):
            return None
        group, left = (*group, a), left - a
        if a == room or len(low) <= i or sum(low[: i + 1]) > room:
            return group
    return None


def _copies(stock: _Stock, group: tuple[int, ...]) -> int:
    return min(stock.count[s] // group.count(s) for s in set(group))


def reduce_instance(stock: _Stock, capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Fixes dominating sets until there is none; what is left of the stock is the reduced instance. Segments, containers."""
    segments: list[tuple[int, int, int, int]] = []
    opened, changed = 0, True
    while changed:
        changed = False
        for j in reversed(list(stock.sizes)):
            while j in stock.count and (group := _dominating(stock, j, capacity)):
                n = _copies(stock, group)
                for s in set(group):
                    segments.append((s, opened, n, group.count(s)))
                    stock.take(s, n * group.count(s))
                opened += n
                changed = True
    return segments, opened


def solve(hist: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Segments (size, first container, containers, items of the size in each) and the number of containers."""
    stock = _Stock(hist)
    segments, opened = reduce_instance(stock, capacity)
    rooms: list[int] = []  # residual capacities in order, and the groups of containers that have them
    groups: dict[int, list[tuple[int, int]]] = {}

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for size in reversed(list(stock.sizes)):
        left = stock.count[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, first, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            each = room // size
            full = min(n, left // each)
            if full:
                segments.append((size, first, full, each))
                keep(room - each * size, first, full)
                left -= full * each
            used = full
            if left and used < n:
                segments.append((size, first + used, 1, left))
                keep(room - left * size, first + used, 1)
                used, left = used + 1, 0
            keep(room, first + used, n - used)
    return segments, opened


def _lookup(segments: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sizes in order; sorted keys (place of the size and first rank), first container and items per container of each
    segment."""
    sizes = np.array(sorted({s[0] for s in segments}), np.int64)
    place = {s: i for i, s in enumerate(sizes.tolist())}
    next_rank: dict[int, int] = {}
    rows = []
    for size, first, n, each in segments:
        rank = next_rank.get(size, 0)
        next_rank[size] = rank + n * each
        rows.append(((place[size] << _RANK) + rank, first, each))
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return sizes, table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


def _in_groups(windows: list[tuple[str, int]]) -> list[list[tuple[str, int]]]:
    """Windows in groups of at most MOST_SIZES summed capacity: the bound of what the driver holds and broadcasts at once."""
    out, total = [[]], 0
    for name, cap in windows:
        if out[-1] and total + cap > MOST_SIZES:
            out.append([])
            total = 0
        out[-1].append((name, cap))
        total += cap
    return out


def pack(sizes: DataFrame, windows: list[tuple[str, int]]) -> DataFrame:
    """window_id, doc_id, piece, tokens, container of every document (or its pieces) for every window.

    ``sizes``: doc_id and tokens, from a table that is cheap to read again (see ``pack_documents``)."""
    if len(windows) > MOST_WINDOWS or any(not c or not 1 <= c <= MOST_CAPACITY for _, c in windows):
        raise ValueError(f"windows need a capacity of 1 to {MOST_CAPACITY}, and there may be no more than {MOST_WINDOWS}")
    if len(groups := _in_groups(windows)) > 1:
        return reduce(DataFrame.unionByName, (pack(sizes, g) for g in groups))
    spark = sizes.sparkSession
    if not windows:
        return spark.createDataFrame([], "window_id string, doc_id bigint, piece int, tokens bigint, container string")
    caps = F.array(*(F.struct(F.lit(i).alias("w"), F.lit(int(c)).cast("bigint").alias("cap")) for i, (_, c) in enumerate(windows)))
    counted = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    per_bucket = counted.groupBy("tokens", "bucket").count()
    hist = per_bucket.groupBy("tokens").agg(F.sum("count").alias("n"))
    by_window = hist.select("tokens", "n", F.explode(caps).alias("c")).select("tokens", "n", "c.w", (F.col("tokens") % F.col("c.cap")).alias("rest"), "c.cap")
    by_window = by_window.withColumn("item", F.when(F.col("tokens") > F.col("cap"), F.col("rest")).otherwise(F.col("tokens")))
    # at most one row for each size up to each capacity, so MOST_SIZES bounds it
    found = by_window.where("item > 0").groupBy("w", "item").agg(F.sum("n").alias("n")).collect()
    tables, bins = [], []
    for i, (_, cap) in enumerate(windows):
        segments, opened = solve({r["item"]: r["n"] for r in found if r["w"] == i}, cap)
        tables.append(_lookup(segments))
        bins.append(opened)
    shared = spark.sparkContext.broadcast((tables, bins, [w for w, _ in windows], [int(c) for _, c in windows]))

    before = Window.partitionBy("w", "item").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)
    classes = by_window.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("w", "item", "offset"))).alias("classes"))
    up_to = Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("tokens", "bucket", F.coalesce(F.sum("count").over(up_to), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("doc_id")) - 1
    ranked = counted.withColumn("at", within).join(starts, ["tokens", "bucket"]).withColumn("rank", F.col("at") + F.col("start"))
    rows = ranked.join(classes, "tokens").select("doc_id", "tokens", "rank", F.posexplode("classes").alias("k", "c")).select("doc_id", "tokens", "c.w", "c.item", (F.col("rank") + F.col("c.offset")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, bins, names, caps = shared.value
        for batch in batches:
            doc, tokens, w, item, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            for i in np.unique(w).tolist():
                sizes, keys, firsts, each = tables[i]
                mine = w == i
                d, t, size, r = doc[mine], tokens[mine], item[mine], rank[mine]
                full = np.where(t > caps[i], t // caps[i], 0)
                bin_of = np.zeros(len(d), np.int64)
                some = size > 0
                at = np.searchsorted(keys, (np.searchsorted(sizes, size[some]) << _RANK) + r[some], side="right") - 1
                bin_of[some] = firsts[at] + (r[some] - (keys[at] & ((1 << _RANK) - 1))) // each[at]
                bin_of[~some] = r[~some] % max(1, bins[i])
                whole = np.repeat(np.arange(len(d)), full)
                piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
                own = [f"d{a}.{b}" for a, b in zip(d[whole].tolist(), piece.tolist(), strict=True)]
                last = np.flatnonzero(some | (full == 0))
                docs = np.concatenate([d[whole], d[last]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[i]] * len(docs), pa.string()),
                        pa.array(docs),
                        pa.array(np.concatenate([piece, full[last]]).astype(np.int32)),
                        pa.array(np.concatenate([np.full(len(whole), caps[i]), size[last]])),
                        pa.array(own + [f"b{b}" for b in bin_of[last].tolist()], pa.string()),
                    ],
                    ["window_id", "doc_id", "piece", "tokens", "container"],
                )

    return rows.mapInArrow(run, "window_id string, doc_id bigint, piece int, tokens bigint, container string")


def pack_documents(documents: DataFrame, windows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` for a documents table; token sizes are computed once and kept as (doc_id, tokens)."""
    caps = [(r["window_id"], r["capacity_tokens"]) for r in windows.select("window_id", "capacity_tokens").orderBy("window_id").limit(MOST_WINDOWS + 1).collect()]
    return pack(cut(token_sizes(documents, vocabulary=vocabulary)), caps)


def fill_report(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """Containers, tokens and share of space used per window; ``least`` is the bound no packing can beat."""
    used = packed.groupBy("window_id", "container").agg(F.sum("tokens").alias("used")).groupBy("window_id").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"))
    cap = F.col("capacity_tokens")
    return used.join(windows.select("window_id", "capacity_tokens"), "window_id").select(
        "window_id", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / cap).alias("least"), F.round(F.col("n_tokens") / (F.col("n_containers") * cap), 6).alias("filled")
    )


def reduction_report(sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """window_id, n_items, n_fixed: how many items (texts and rests of cut texts) the reduction alone puts away.

    One row for each window; a histogram of at most one row for each size up to the capacity is solved on the driver."""
    rows = []
    for r in windows.select("window_id", "capacity_tokens").orderBy("window_id").limit(MOST_WINDOWS).collect():
        cap = F.lit(r["capacity_tokens"]).cast("bigint")
        item = F.when(F.col("tokens") > cap, F.col("tokens") % cap).otherwise(F.col("tokens"))
        hist = {x["item"]: x["count"] for x in sizes.select(item.alias("item")).where("item > 0").groupBy("item").count().collect()}
        segments, _ = reduce_instance(_Stock(hist), r["capacity_tokens"])
        rows.append((r["window_id"], sum(hist.values()), sum(n * each for _, _, n, each in segments)))
    return sizes.sparkSession.createDataFrame(rows, "window_id string, n_items bigint, n_fixed bigint")


def validity(packed: DataFrame, documents: DataFrame, windows: DataFrame) -> DataFrame:
    """For each window: documents, containers over capacity, documents lost, pieces there twice, texts cut without need,
    and documents whose pieces don't sum up to the same size as in the other windows."""
    caps = windows.select("window_id", F.col("capacity_tokens").alias("cap"))
    over = packed.groupBy("window_id", "container").agg(F.sum("tokens").alias("used")).join(F.broadcast(caps), "window_id").groupBy("window_id").agg(F.count(F.when(F.col("used") > F.col("cap"), 1)).alias("n_over"))
    whole = packed.groupBy("window_id", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.count_distinct("piece").alias("n_pieces"), F.max("piece").alias("last"))
    one = whole.join(F.broadcast(caps), "window_id").withColumn("needless", (F.col("n") > 1) & (F.col("tokens") <= F.col("cap")))
    most = whole.groupBy("doc_id").agg(F.max("tokens").alias("most"))
    per = one.join(most, "doc_id").groupBy("window_id").agg(
        F.count("*").alias("n_packed"), F.count(F.when((F.col("n") != F.col("n_pieces")) | (F.col("last") + 1 != F.col("n")), 1)).alias("n_twice"), F.count(F.when(F.col("needless"), 1)).alias("n_needless"), F.count(F.when(F.col("tokens") != F.col("most"), 1)).alias("n_unequal")
    )
    total = documents.agg(F.count("*").alias("n_documents"))  # one row
    out = windows.select("window_id").join(over, "window_id", "left").join(per, "window_id", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("window_id", "n_documents", (F.col("n_documents") - zero("n_packed")).alias("n_lost"), *(zero(c).alias(c) for c in ("n_over", "n_twice", "n_needless", "n_unequal")))
