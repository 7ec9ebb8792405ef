"""Per-key results where a few keys hold most records (problem 5).

A frequent-items sketch over the key columns finds the heavy keys (JVM-side, one small state per task). Their rows are
marked by a broadcast join (at most ``most`` keys, a fixed bound), aggregated under (key, salt of the counted value) and
merged; the remaining rows go through an ordinary shuffle on the key; both results are united. The sketch decides only
which way a key takes: every key's result is exact, whatever the sketch missed.

Defined results: a null in a key column is a key of its own, like in GROUP BY; null counted values are not counted as
distinct; repeated rows count as often as they are there. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 32


def heavy_keys(df: DataFrame, keys: list[str], most: int = 256, share: float = 0.001) -> DataFrame:
    """Keys that hold about ``share`` of the rows or more, at most ``most`` of them, as one small local table."""
    marked = df.select(F.xxhash64(*keys).alias("key_hash"))
    tracked = min(100_000, max(most, int(8 / share)))
    top = marked.agg(F.expr(f"approx_top_k(key_hash, {most}, {tracked})").alias("top"), F.count("*").alias("n")).first()
    least = max(2, int((top["n"] or 0) * share))
    hashes = [(x["item"],) for x in (top["top"] or []) if x["count"] >= least]
    return df.sparkSession.createDataFrame(hashes, "key_hash bigint")


def skewed_summary(df: DataFrame, keys: list[str], distinct: str, time: str, heavy: DataFrame | None = None) -> DataFrame:
    """For each key: n_rows, n_distinct of a column, first and last of a time column."""
    heavy = heavy_keys(df, keys) if heavy is None else heavy
    rows = df.select(*keys, F.col(distinct).alias("value"), F.col(time).alias("t")).withColumn("key_hash", F.xxhash64(*keys))
    marked = F.broadcast(heavy)
    hot = rows.join(marked, "key_hash", "left_semi").withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)))
    measures = [F.count("*").alias("n_rows"), F.count_distinct("value").alias("n_distinct"), F.min("t").alias("first_at"), F.max("t").alias("last_at")]
    salted = hot.groupBy(*keys, "salt").agg(*measures)
    merged = salted.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_distinct").alias("n_distinct"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    rest = rows.join(marked, "key_hash", "left_anti").groupBy(*keys).agg(*measures)
    return merged.unionByName(rest)


def dominant_keys(df: DataFrame, keys: list[str], distinct: str, time: str, share: float) -> DataFrame:
    """The summaries of keys without nulls that hold at least ``share`` of all rows."""
    total = df.count()
    least = -(-total * round(share * 1_000_000) // 1_000_000)
    found = skewed_summary(df, keys, distinct, time).where(F.col("n_rows") >= F.lit(least))
    for k in keys:
        found = found.where(F.col(k).isNotNull())
    return found
