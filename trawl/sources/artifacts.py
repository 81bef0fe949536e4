"""Files that training leaves behind: checkpoints, logs, settings, models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import exists


def write_record(spark: SparkSession, path: str, record: dict) -> None:
    """Settings or figures as one JSON line."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict | None:
    """What ``write_record`` wrote, or any JSON file; None if there is none."""
    if not exists(spark, path):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small file


def checkpoints(spark: SparkSession, folder: str, marker: str = "trainer_state.json") -> list[str]:
    """Folders below ``folder`` that hold a ``marker`` file, in order."""
    if not exists(spark, folder):
        return []
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", marker).load(folder).select("path")
    return sorted(r[0].rsplit("/", 1)[0] for r in found.collect())


def training_log(spark: SparkSession, folder: str, marker: str = "trainer_state.json") -> DataFrame:
    """checkpoint, step, epoch, loss and eval_loss of every logged step below ``folder``."""
    schema = "log_history array<struct<step:long,epoch:double,loss:double,eval_loss:double>>"
    files = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", marker).json(folder)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("checkpoint"), F.inline("log_history"))


def save_model(spark: SparkSession, path: str, model: bytes, settings: dict) -> None:
    """A plug-in model's bytes and settings."""
    spark.createDataFrame([(bytearray(model), json.dumps(settings, sort_keys=True))], "model binary, settings string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[bytes, dict]:
    """Bytes and settings of a saved model, for the plug-in's factory, which tasks call."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    row = spark.read.parquet(path).first()
    return bytes(row["model"]), json.loads(row["settings"])
