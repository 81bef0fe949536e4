"""What keeps an ingestion going: sinks, retries, lag, counters, timing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import kafka_rows

T = TypeVar("T")
# A sink's settings, and how retries and lag alerts are paced.
PRODUCER = {"kafka.acks": "all", "kafka.compression.type": "gzip", "kafka.linger.ms": "10"}
ATTEMPTS, FIRST_PAUSE, LONGEST_PAUSE = 5, 0.1, 30.0
LAG_WARNING, LAG_CRITICAL = 1_000, 10_000


def retried(action: Callable[[], T], *, attempts: int = ATTEMPTS, pause: float = FIRST_PAUSE, longest: float = LONGEST_PAUSE, sleep: Callable[[float], None] = time.sleep) -> T:
    """``action()``, again after doubling pauses if it raises; the last error is raised. For driver-side calls: tasks are retried by Spark."""
    for k in range(attempts):
        try:
            return action()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(min(pause * 2**k, longest))
    raise ValueError("at least one attempt")


def job_rows(jobs: DataFrame) -> DataFrame:
    """key and value of indexing jobs (job_id, ...)."""
    return kafka_rows(jobs.withColumn("id", F.col("job_id")), "indexing_job")


def send(rows: DataFrame, servers: str, topic: str, *, on_error: Callable[[Exception], None] | None = None, format: str = "kafka", **options: str) -> bool:
    """Write key and value rows to a topic in one job; an error goes to ``on_error`` if there is one. Needs Spark's Kafka connector."""
    settings = {"kafka.bootstrap.servers": servers, "topic": topic, **PRODUCER, **options} if format == "kafka" else options
    try:
        rows.write.format(format).options(**settings).save()
    except Exception as error:
        if on_error is None:
            raise
        on_error(error)
        return False
    return True


def lag(progress: dict) -> int:
    """Rows that wait, from a streaming query's progress: latest offsets less those read, over all sources."""
    import json

    total = 0
    for source in progress.get("sources", []):
        ends, latest = (json.loads(v) if isinstance(v := source.get(k) or {}, str) else v for k in ("endOffset", "latestOffset"))
        if isinstance(latest, dict) and isinstance(ends, dict):
            for topic, parts in latest.items():
                if isinstance(parts, dict):
                    total += sum(max(0, n - (ends.get(topic) or {}).get(p, 0)) for p, n in parts.items())
    return total


def lag_level(rows: int) -> str:
    return "critical" if rows > LAG_CRITICAL else "warning" if rows > LAG_WARNING else "ok"


def lag_alerts(samples: DataFrame, *, hold: int = 5) -> DataFrame:
    """group, level and since of groups whose lag (samples: consumer_group, ts, lag; one a minute) has been above a bound for ``hold`` samples."""
    from pyspark.sql import Window

    last = F.row_number().over(Window.partitionBy("consumer_group").orderBy(F.desc("ts")))
    recent = samples.withColumn("nth", last).where(F.col("nth") <= hold)
    held = recent.groupBy("consumer_group").agg(F.count(F.lit(1)).alias("n"), F.min("lag").alias("least"), F.min("ts").alias("since")).where((F.col("n") == hold) & (F.col("least") > LAG_WARNING))
    return held.select("consumer_group", F.when(F.col("least") > LAG_CRITICAL, "critical").otherwise("warning").alias("level"), "since")


def counters(events: DataFrame, labels: list[str], *, value: str | None = None, bounds: tuple[float, ...] = ()) -> DataFrame:
    """n of each combination of labels; with ``value`` its sum, last maximum and cumulative bucket counts le_0, le_1, ..."""
    found = [F.count(F.lit(1)).alias("n")]
    if value:
        found += [F.sum(value).alias("total"), F.max(value).alias("most")]
        found += [F.sum((F.col(value) <= b).cast("long")).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return events.groupBy(*labels).agg(*found)


def throughput(done: int, seconds: float, total: int | None = None) -> dict[str, float]:
    """Items a second and, with ``total``, the seconds left."""
    rate = done / max(seconds, 1e-6)
    return {"per_second": rate} | ({"seconds_left": (total - done) / max(rate, 1e-6)} if total is not None else {})


def utc_now() -> str:
    return datetime.now(UTC).isoformat()


def run_id(at: datetime | None = None) -> str:
    return (at or datetime.now(UTC)).strftime("%Y%m%d_%H%M%S")


@contextmanager
def timed(into: dict[str, float], name: str) -> Iterator[None]:
    """Milliseconds of a block, added to ``into[name]``, also where it raises."""
    began = time.perf_counter()
    try:
        yield
    finally:
        into[name] = into.get(name, 0.0) + 1000 * (time.perf_counter() - began)
