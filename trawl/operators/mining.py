"""Training data: hard negatives, triplets, labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similar import overlapping


def pick(value: Column, seed: int, *key: Column) -> Column:
    """An aggregate that picks one value a group, the same in any engine: that of the least MD5 of seed, key and value."""
    return F.min_by(value, F.md5(F.concat_ws("|", F.lit(str(seed)), *key, value).cast("binary")))


def hard_negatives(candidates: DataFrame, positives: DataFrame, *, seed: int = 42, threshold: float = 0.9) -> DataFrame:
    """One negative a query among ``candidates`` (query_id, passage_id, text) that isn't one of its ``positives`` (the same columns).

    A candidate is a positive if it has a positive's id or overlaps its text;
    queries whose candidates are all positive are left out.
    """
    known = positives.select("query_id", F.col("passage_id").alias("right_id"), "text")
    offered = candidates.select("query_id", F.col("passage_id").alias("left_id"), "text")
    same = offered.select("query_id", "left_id").join(known.select("query_id", F.col("right_id").alias("left_id")), ["query_id", "left_id"], "left_semi")
    excluded = same.unionByName(overlapping(offered, known, threshold, ["query_id"]).select("query_id", "left_id")).distinct().withColumnRenamed("left_id", "passage_id")
    left = candidates.join(excluded, ["query_id", "passage_id"], "left_anti")
    return left.groupBy("query_id").agg(pick(F.col("passage_id"), seed, F.col("query_id")).alias("negative_id"), F.count(F.lit(1)).alias("n_candidates"))


def triplets(positives: DataFrame, negatives: DataFrame, *, seed: int = 42) -> DataFrame:
    """query_id, positive_id and negative_id: one of each a query, queries without either left out."""
    chosen = positives.groupBy("query_id").agg(pick(F.col("passage_id"), seed, F.col("query_id")).alias("positive_id"))
    return chosen.join(negatives.groupBy("query_id").agg(pick(F.col("passage_id"), seed + 1, F.col("query_id")).alias("negative_id")), "query_id")


def labelled_pairs(found: DataFrame, copies: int = 4) -> DataFrame:
    """query, passage, label of ``found`` (query, positive, negative): the positive once, the negative ``copies`` times."""
    good = found.select("query", F.col("positive").alias("passage"), F.lit(1).alias("label"))
    bad = found.select("query", F.col("negative").alias("passage"), F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    return good.unionByName(bad.select("query", "passage", F.lit(0).alias("label")))


def exploded_passages(nested: DataFrame) -> DataFrame:
    """query_id, passage_text and is_selected of rows with parallel arrays ``passage_text`` and ``is_selected``."""
    return nested.select("query_id", F.explode(F.arrays_zip("passage_text", "is_selected")).alias("p")).select("query_id", "p.passage_text", "p.is_selected")


def label_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def loss_curve(log: DataFrame) -> DataFrame:
    """step, loss and eval_loss of a trainer's log where either is present."""
    return log.where("loss is not null or eval_loss is not null").select("step", "loss", "eval_loss")
