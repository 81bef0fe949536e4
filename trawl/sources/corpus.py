"""Readers and writers of passages, queries, judgments, triplets and embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import first_seen, judged

#: Passages in the two sample modes.
DEV, SMALL = 5_000, 100_000


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def read_through(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """What lies at ``path``, computed and written there first if nothing does."""
    if not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def passages(raw: DataFrame, mode: str = "full", *, qrels: DataFrame | None = None, limit: int | None = None, seed: int = 42, order: str | None = None) -> DataFrame:
    """Passages (passage_id, text, title, ...) of a collection.

    ``dev``: judged ones, up to ``limit``; ``small``: a repeatable sample of
    ``limit``; ``full``: the first of each id, by ``order`` where given, else as
    the rows are read.
    """
    if mode == "dev":
        if qrels is None:
            raise ValueError("dev mode needs judgments")
        return judged(raw, qrels).orderBy("passage_id").limit(limit or DEV)
    if mode == "small":
        return raw.orderBy(F.xxhash64(F.lit(seed), F.col("passage_id")), "passage_id").limit(limit or SMALL)
    if mode == "full":
        if order:
            return first_seen(raw, "passage_id", order)
        return first_seen(raw.withColumn("read at", F.monotonically_increasing_id()), "passage_id", "read at").drop("read at")
    raise ValueError(f"unknown mode {mode!r}")


def queries(raw: DataFrame) -> DataFrame:
    """Queries with an id and a text."""
    return raw.select(F.col("query_id").cast("string").alias("query_id"), "query_text").where("query_id <> '' and query_text <> ''")


def qrels(raw: DataFrame, order: str = "position") -> DataFrame:
    """Judgments; of a pair's several the last in ``order`` counts."""
    return raw.groupBy(F.col("query_id").cast("string").alias("query_id"), F.col("passage_id").cast("string").alias("passage_id")).agg(F.max_by("grade", order).cast("int").alias("grade"))


def selected(nested: DataFrame) -> DataFrame:
    """Judgments of grade 1 from ``is_selected`` flags (query_id, passage_id, is_selected)."""
    return nested.where("is_selected > 0").select("query_id", "passage_id", F.lit(1).alias("grade"))


def store_embeddings(passages: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, *, resume: bool = True) -> int:
    """Append embeddings of passages that ``path`` lacks; returns how many. ``resume`` off starts anew."""
    spark = passages.sparkSession
    left = passages
    if resume and exists(spark, f"{path}/_SUCCESS"):
        left = passages.join(load_embeddings(spark, path), "passage_id", "left_anti")
    before = load_embeddings(spark, path).count() if resume and exists(spark, f"{path}/_SUCCESS") else 0
    encode(left).select("passage_id", "embedding").write.mode("append" if resume else "overwrite").parquet(path)
    return load_embeddings(spark, path).count() - before


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """passage_id and embedding; raises where the columns are missing."""
    found = spark.read.parquet(path)
    missing = {"passage_id", "embedding"} - set(found.columns)
    if missing:
        raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
    return found.select("passage_id", "embedding")
