"""References to records that do not exist (problem 3).

References and parents are co-partitioned and sorted by key and merged in one linear pass (Spark's sort-merge join; AQE
splits a hot key's reference partitions). A parent key carries its validity intervals; where the reference's time lies in
none of them, the reference is an orphan: ``missing`` (no interval at all), ``deleted`` (some interval had ended) or
``late`` (all begin later).

Parents with more than ``MANY`` distinct intervals are not held as one array: their intervals and references go through a
merge in time slices (running count within a slice, plus what earlier slices carry over), and slices with very many
references are dealt out, so no key is one task's work.

Defined results: a null key is no reference; exact duplicate references count once; a reference without a time is judged
after the last interval; an interval without a start always was; one that ends before it starts is never valid, but has
ended. Keys compare byte for byte. Empty parents make every reference missing; empty references give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

MANY = 64
ALWAYS_BROADCAST_ROWS = 100_000
SLICES = 1024
MOST_TOGETHER = 100_000  # references to one parent in one slice that one task takes
_BEGIN, _END, _NEVER = "timestamp'0001-01-01 00:00:00'", "timestamp'9999-12-30 00:00:00'", "timestamp'9999-12-31 00:00:00'"


def _merge_in_slices(refs: DataFrame, spans: DataFrame, most: int = MOST_TOGETHER) -> DataFrame:
    """Orphans among references to parents with many intervals: running counts of starts and ends over time.

    A slice of a parent that more than ``most`` references fall into (a burst, or references without a time) is dealt out to
    several tasks, each with all intervals of the slice."""
    low, high = spans.agg(F.min(F.unix_micros("start")), F.max(F.unix_micros(F.least(F.coalesce("stop", F.expr(_END)), F.expr("timestamp'2200-01-01'"))))).first()
    width = max(1, (high - low) // SLICES)
    ref_columns = [c for c in refs.columns if c not in ("key", "t")]
    none = [F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in ref_columns]
    place = F.greatest(F.lit(0), F.least(F.lit(SLICES), ((F.unix_micros("t") - F.lit(low)) / width).cast("int"))).alias("slice")
    valid = spans.where("stop is null or stop > start")
    ends = F.when(F.col("stop") > F.col("start"), -1).otherwise(0).alias("up")
    turns = (
        valid.select("key", F.col("start").alias("t"), F.lit(1).alias("up"), F.lit(0).alias("over"))
        .unionByName(spans.where("stop is not null").select("key", F.col("stop").alias("t"), ends, F.lit(1).alias("over")))
        .select("key", "t", "up", "over", place)
    )
    asked = refs.select("key", "t", *ref_columns, place)
    parts = asked.groupBy("key", "slice").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = asked.join(parts, ["key", "slice"]).select("key", "slice", F.pmod(F.xxhash64("t", *ref_columns), F.col("parts")).cast("int").alias("part"), "t", F.lit(1).alias("side"), F.lit(0).alias("up"), F.lit(0).alias("over"), *ref_columns)
    everywhere = turns.join(parts, ["key", "slice"]).select("key", "slice", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "t", F.lit(0).alias("side"), "up", "over", *none)
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.groupBy("key", "slice").agg(F.sum("up").alias("up"), F.sum("over").alias("over")).join(parts.select("key", "slice"), ["key", "slice"], "full")
    carried = sums.select("key", "slice", F.coalesce(F.sum("up").over(before), F.lit(0)).alias("up0"), F.coalesce(F.sum("over").over(before), F.lit(0)).alias("over0"))
    within = Window.partitionBy("key", "slice", "part").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = dealt.unionByName(everywhere)
    merged = events.withColumn("up", F.sum("up").over(within)).withColumn("over", F.sum("over").over(within)).where("side = 1").join(carried, ["key", "slice"])
    return merged.where("up + up0 <= 0").select("key", "t", *ref_columns, F.when(F.col("over") + F.col("over0") > 0, "deleted").otherwise("late").alias("kind"))


def orphans(refs: DataFrame, key: str, time: str, parents: DataFrame, parent_key: str, start: str, stop: str, always: DataFrame | None = None, always_key: str = "objectid", many: int = MANY, together: int = MOST_TOGETHER) -> DataFrame:
    """The rows of ``refs`` whose ``key`` has no parent valid at ``time``, with ``kind``; other columns are kept."""
    extra = [c for c in refs.columns if c not in (key, time)]
    r = refs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(time, F.expr(_END)).alias("t"), *(F.col(f"`{c}`").alias(f"x_{i}") for i, c in enumerate(extra)))
    spans = parents.where(F.col(parent_key).isNotNull()).select(F.col(parent_key).alias("key"), F.coalesce(start, F.expr(_BEGIN)).alias("start"), F.col(stop).alias("stop"))
    if always is not None:
        fixed = always.where(F.col(always_key).isNotNull()).select(F.col(always_key).alias("key")).distinct()
        if fixed.limit(ALWAYS_BROADCAST_ROWS + 1).count() <= ALWAYS_BROADCAST_ROWS:
            r = r.join(F.broadcast(fixed), "key", "left_anti")
        else:
            spans = spans.unionByName(fixed.select("key", F.expr(_BEGIN).alias("start"), F.lit(None).cast("timestamp").alias("stop")))
    crowded = spans.groupBy("key").count().where(F.col("count") > many).select("key")
    sliced = None
    if crowded.limit(1).count():
        heavy = spans.distinct().join(crowded, "key", "left_semi")
        sliced = _merge_in_slices(r.join(crowded, "key", "left_semi"), heavy, together)
        r, spans = r.join(crowded, "key", "left_anti"), spans.join(crowded, "key", "left_anti")
    held = spans.groupBy("key").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans"), F.count("*").alias("n"), F.min("start").alias("start"), F.max(F.coalesce("stop", F.expr(_NEVER))).alias("stop"), F.min("stop").alias("first_stop")
    )
    t = F.col("t")
    one = (F.col("start") <= t) & (F.col("stop") > t)
    some = F.exists("spans", lambda s: (s["start"] <= t) & (s["stop"].isNull() | (s["stop"] > t)))
    present = F.when(F.col("n").isNull(), False).when(F.col("n") == 1, one).otherwise(one & some)
    kind = F.when(F.col("n").isNull(), "missing").when(F.col("first_stop") <= t, "deleted").otherwise("late")
    found = r.join(held.hint("merge"), "key", "left").where(~present).select(*r.columns, kind.alias("kind"))
    if sliced is not None:
        found = found.unionByName(sliced.select(*found.columns))
    return found.select(F.col("key").alias(key), F.when(t == F.expr(_END), None).otherwise(t).alias(time), *(F.col(f"x_{i}").alias(c) for i, c in enumerate(extra)), "kind")


def endpoint_references(edges: DataFrame) -> DataFrame:
    """(edge_id, endpoint, key, t): both ends of each edge as references, one pass over the table."""
    ends = F.explode(F.array(F.struct(F.lit("source").alias("endpoint"), F.col("source").alias("key")), F.struct(F.lit("target").alias("endpoint"), F.col("target").alias("key"))))
    return edges.select("edge_id", F.col("loaded_at").alias("t"), ends.alias("e")).select("edge_id", "t", "e.endpoint", "e.key")


def edge_orphans(edges: DataFrame, nodes: DataFrame, principals: DataFrame) -> DataFrame:
    """edge_id, endpoint, kind, loaded_at of each orphan reference; exact duplicate edge rows count once."""
    found = orphans(endpoint_references(edges), "key", "t", nodes, "objectid", "loaded_at", "deleted_at", always=principals)
    return found.select("edge_id", "endpoint", "kind", F.col("t").alias("loaded_at")).distinct()


def orphan_report(found: DataFrame, table: str) -> DataFrame:
    """Counts per table, endpoint, kind and month."""
    return found.groupBy(F.lit(table).alias("table_name"), "endpoint", F.date_format("loaded_at", "yyyy-MM").alias("month"), "kind").agg(F.count("*").alias("n_orphans"))
