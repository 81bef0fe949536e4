"""Streaming ingestion: parse, route, keep the latest of each id, dead-letter the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import latest_by_key
from ..sources.tables import KeyedTable

MESSAGE = "_type string, id string, text string, title string, job_id string, version long, _corrupt_record string"


def file_messages(spark: SparkSession, folder: str) -> DataFrame:
    """``value`` of every line of text files that arrive in ``folder``."""
    return spark.readStream.format("text").load(folder)


def kafka_messages(spark: SparkSession, servers: str, topic: str, *, starting: str = "earliest", **options: str) -> DataFrame:
    """``value`` of a topic's messages; needs Spark's Kafka connector."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).options(**options).load().select(F.col("value").cast("string").alias("value"))


def kafka_rows(passages: DataFrame, kind: str = "passage") -> DataFrame:
    """key and value of messages for ``df.write.format("kafka")``."""
    body = F.to_json(F.struct(F.lit(kind).alias("_type"), *[F.col(c) for c in passages.columns]))
    return passages.select(F.col("id").cast("string").alias("key"), body.alias("value"))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with their fields and ``route``: passage, job, skip or invalid; a missing type means passage."""
    fields = F.from_json("value", MESSAGE, {"columnNameOfCorruptRecord": "_corrupt_record"})
    out = messages.select("value", fields.alias("m")).select("value", "m.*")
    kind = F.coalesce("_type", F.lit("passage"))
    valid = (F.coalesce("id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")
    broken = F.col("_corrupt_record").isNotNull() | F.get_json_object("value", "$").isNull()
    route = F.when(broken, "invalid").when(kind == "indexing_job", "job").when(kind != "passage", "skip").when(valid, "passage").otherwise("invalid")
    return out.withColumn("route", route)


def dead_letters(bad: DataFrame, topic: str, error: str) -> DataFrame:
    return bad.select(F.lit(topic).alias("topic"), F.lit(0).alias("partition"), F.lit(None).cast("long").alias("offset"), F.col("value").alias("payload"), F.lit(error).alias("error"), F.unix_timestamp().cast("double").alias("timestamp"))


def ingest(messages: DataFrame, table: KeyedTable, letters: str, checkpoint: str, *, topic: str = "documents", enrich: Callable[[DataFrame], DataFrame] | None = None, on_job: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Upsert valid passages into ``table`` and write invalid messages to ``letters``, then stop.

    A micro-batch is the unit of retry: dead letters go to a folder named by
    the batch and passages are replaced by key, so a batch that is run again
    changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            found = parsed(batch)
            good = found.where("route = 'passage'").select(F.col("id").alias("passage_id"), "text", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("version", F.lit(0).cast("long")).alias("version"))
            good = latest_by_key(good, "passage_id", "version")
            table.upsert(enrich(good) if enrich else good)
            dead_letters(found.where("route = 'invalid'"), topic, "invalid message").write.mode("overwrite").json(f"{letters}/batch={number}")
            if on_job:
                on_job(found.where("route = 'job'"))
        finally:
            batch.unpersist()

    query = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
