"""Functions of scores and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import let


def min_max(score: Column, lowest: Column, highest: Column) -> Column:
    """(score - lowest) / span; 1 where all scores are equal."""
    return F.when(highest == lowest, 1.0).otherwise((score - lowest) / (highest - lowest))


def normalise(score: Column, lowest: Column, highest: Column, epsilon: float = 1e-10) -> Column:
    """(score - lowest) / (span + epsilon), held within 0 and 1; 0 where all scores are equal."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - lowest) / (highest - lowest + epsilon)))


def with_min_max(run: DataFrame, by: str = "query_id", column: str = "score", how=min_max) -> DataFrame:
    """``run`` with ``column`` normalised within each ``by``."""
    group = Window.partitionBy(by)
    return run.withColumn(column, how(F.col(column), F.min(column).over(group), F.max(column).over(group)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relevance(logits: Column) -> Column:
    """One logit: its sigmoid. Two: softmax of the second. More: sigmoid of the largest."""
    return F.when(F.size(logits) == 1, sigmoid(F.get(logits, 0))).when(F.size(logits) == 2, sigmoid(F.get(logits, 1) - F.get(logits, 0))).otherwise(sigmoid(F.array_max(logits)))


def dot(a: Column, b: Column) -> Column:
    """Inner product, accumulated in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """``v`` divided by its length, at least 1e-9."""
    return let(F.greatest(norm(v), F.lit(1e-9)), lambda length: F.transform(v, lambda x: x.cast("double") / length))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def backoff(attempt: Column, base: float = 0.1, most: float = 30.0) -> Column:
    """Seconds to wait before an attempt, doubling up to a limit."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by ``|``."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
