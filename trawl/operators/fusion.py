"""Merging ranked lists by scores or by ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import with_min_max
from .ranking import rank_or_position, ranked

#: The constant of reciprocal rank fusion.
RRF_K = 60


def by_scores(lexical: DataFrame, dense: DataFrame, *, alpha: float = 0.5, k: int | None = None) -> DataFrame:
    """alpha * dense + (1 - alpha) * lexical of min-max normalised scores; a missing one is zero."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    left = with_min_max(lexical.select("query_id", "passage_id", "score")).withColumnRenamed("score", "l")
    right = with_min_max(dense.select("query_id", "passage_id", "score")).withColumnRenamed("score", "d")
    score = alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("l", F.lit(0.0))
    return ranked(left.join(right, ["query_id", "passage_id"], "full_outer").select("query_id", "passage_id", score.alias("score")), k)


def by_ranks(*lists: DataFrame, constant: int = RRF_K, k: int | None = None) -> DataFrame:
    """Sum of 1 / (constant + rank) over any number of lists; a rank below 1 is replaced by the place by score."""
    if constant <= 0:
        raise ValueError("the constant must be positive")
    legs = None
    for run in lists:
        if "rank" in run.columns:
            placed = ranked(run.withColumnRenamed("rank", "given"))
            leg = placed.select("query_id", "passage_id", rank_or_position(F.col("given"), F.col("rank")).alias("rank"))
        else:
            leg = ranked(run).select("query_id", "passage_id", "rank")
        legs = leg if legs is None else legs.unionByName(leg)
    return ranked(legs.groupBy("query_id", "passage_id").agg(F.sum(1 / (constant + F.col("rank"))).alias("score")), k)


STRATEGIES: dict[str, Callable] = {
    "score": by_scores,
    "score_fusion": by_scores,
    "rrf": by_ranks,
    "reciprocal_rank_fusion": by_ranks,
}


def strategy(name: str) -> Callable:
    """A fusion by name, in any case."""
    if name.lower() not in STRATEGIES:
        raise ValueError(f"unknown fusion {name!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[name.lower()]
