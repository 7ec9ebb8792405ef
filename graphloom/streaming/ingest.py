"""Edges that arrive as a stream, kept as tables that can be queried at any time.

Each micro-batch is reduced to its first row per (source, target, rel_type) and the edges not stored yet are appended
under the batch's number; a batch that is run again after a failure replaces its own folder, so the sink is exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

KEY = ["source", "target", "rel_type"]


def read_edges(spark: SparkSession, store: str) -> DataFrame | None:
    """All edges stored so far; None before the first batch."""
    try:
        return spark.read.parquet(store)
    except Exception as e:  # no folder or no file yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def ingest(stream: DataFrame, store: str, checkpoint: str, late: str = "30 days"):
    """Starts a query that appends new edges of ``stream`` (source, target, rel_type, loaded_at, ...) to ``store``.

    Exact repeats within ``late`` of event time are dropped by the stream's state; later ones by the stored keys."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.where("source is not null and target is not null and rel_type is not null").groupBy(*KEY).agg(F.min_by(F.struct(*(c for c in batch.columns if c not in KEY)), "loaded_at").alias("r")).select(*KEY, "r.*")
        known = read_edges(spark, store)
        if known is not None:
            known = known.where(F.col("batch") != number) if "batch" in known.columns else known
            first = first.join(known.select(*KEY), KEY, "left_anti")
        first.write.mode("overwrite").parquet(f"{store}/batch={number}")

    unique = stream.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["edge_id"]) if "edge_id" in stream.columns else stream
    return unique.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def daily_counts(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Edges per type and day of observation, complete once the watermark has passed the day."""
    day = F.window("observed_at", "1 day")
    return stream.withWatermark("observed_at", late).groupBy(day, "rel_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "rel_type", "n")
