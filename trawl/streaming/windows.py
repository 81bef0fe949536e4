"""Metrics over event time, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of latency buckets.
BUCKETS = (10.0, 25.0, 50.0, 75.0, 100.0)
#: Windows in a stretch of time within which islands are found.
STRETCH = 4096


def rates(events: DataFrame, length: str = "5 minutes", slide: str | None = None, by: str = "event_type") -> DataFrame:
    """window_start, ``by``, n and per_second of each window; with a watermark first, it runs on streams."""
    seconds = F.unix_timestamp("window_end") - F.unix_timestamp("window_start")
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = events.groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n").withColumn("per_second", F.col("n") / seconds).drop("window_end")


def error_share(events: DataFrame, length: str = "5 minutes", error: str = "error") -> DataFrame:
    """window_start and error_percent of each window."""
    share = 100 * F.sum((F.col("event_type") == error).cast("int")) / F.count(F.lit(1))
    return events.groupBy(F.window("ts", length).alias("w")).agg(share.alias("error_percent")).select(F.col("w.start").alias("window_start"), "error_percent")


def bucket_quantile(events: DataFrame, share: float, by: str = "event_type", value: str = "value", bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """A quantile estimated from bucket counts by linear interpolation, as from scraped histograms."""
    counts = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"le_{i}") for i, b in enumerate(bounds)]
    table = events.where(F.col(value).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("total"), *counts)
    rank = F.col("total") * share
    out = F.lit(bounds[-1])  # beyond the last bound
    for i in reversed(range(len(bounds))):
        low, below = (bounds[i - 1], F.col(f"le_{i - 1}")) if i else (0.0, F.lit(0))
        inside = F.col(f"le_{i}") - below
        at = F.when(inside > 0, low + (bounds[i] - low) * (rank - below) / inside).otherwise(F.lit(low))
        out = F.when(F.col(f"le_{i}") >= rank, at).otherwise(out)
    return table.select(by, out.alias("quantile"))


def alerts(measured: DataFrame, condition: str, hold: int, order: str = "window_start", step: int = 300) -> DataFrame:
    """Islands of at least ``hold`` windows, ``step`` seconds apart, for which ``condition`` holds: alert_start, alert_end, n_windows.

    A window that is missing, for want of events, breaks an island. Islands are
    found within stretches of STRETCH steps; only those that touch a stretch's
    edge, two of each at most, are then put together over all time.
    """
    place = F.floor(F.unix_timestamp(order) / step)
    on = measured.where(F.expr(condition)).select(order, place.alias("place"), F.floor(place / STRETCH).alias("stretch"))
    within = Window.partitionBy("stretch").orderBy("place")
    cut = on.withColumn("island", F.col("place") - F.row_number().over(within))
    parts = cut.groupBy("stretch", "island").agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))
    edge = (F.pmod("first", F.lit(STRETCH)) == 0) | (F.pmod("last", F.lit(STRETCH)) == STRETCH - 1)
    line = Window.orderBy("first")
    joined = parts.where(edge).withColumn("new", (F.col("first") != F.lag("last", 1, -2).over(line) + 1).cast("int"))
    joined = joined.withColumn("whole", F.sum("new").over(line)).groupBy("whole").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"))
    both = parts.where(~edge).select("a", "b", "n").unionByName(joined.select("a", "b", "n"))
    return both.where(F.col("n") >= hold).select(F.col("a").alias("alert_start"), F.col("b").alias("alert_end"), F.col("n").alias("n_windows"))


def health(components: DataFrame) -> DataFrame:
    """healthy if all are, degraded if some are, else unhealthy."""
    status = F.when(F.every("healthy"), "healthy").when(F.some("healthy"), "degraded").otherwise("unhealthy")
    return components.groupBy("service").agg(status.alias("status"))


def stream(events: DataFrame, lateness: str = "10 minutes", key: str | None = "event_id") -> DataFrame:
    """A stream of events with a watermark, repeated ones dropped."""
    marked = events.withWatermark("ts", lateness)
    return marked.dropDuplicatesWithinWatermark([key]) if key else marked


def sessions(events: DataFrame, gap: str = "30 minutes", by: str = "user_id") -> DataFrame:
    """session_start, session_end and n of each user's sessions."""
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
