"""Comparing systems query by query: paired bootstrap and paired t-test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "ord int, system_a string, system_b string, n_queries int, mean_a double, mean_b double, delta double, p_value double, ci_lower double, ci_upper double, effect_size double, is_significant boolean"

#: Numbers of a resampling matrix that are held at once.
HELD = 4_000_000


def bootstrap(a: np.ndarray, b: np.ndarray, *, resamples: int = 10_000, alpha: float = 0.05, seed: int = 42, two_sided: bool = False) -> dict:
    """Paired bootstrap of mean(b) - mean(a).

    p is the share of resampled differences on the other side of zero; it is
    one tail, doubled with ``two_sided``.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    if len(a) != len(b) or not len(a):
        raise ValueError("two equally long, non-empty lists of scores are needed")
    apart, n = b - a, len(a)
    observed, rng = apart.mean(), np.random.default_rng(seed)
    step = max(1, HELD // n)  # drawn in order, so slices give the matrix drawn at once
    means = np.concatenate([apart[rng.integers(0, n, size=(min(step, resamples - k), n))].mean(1) for k in range(0, resamples, step)])
    p = float((means <= 0).mean() if observed >= 0 else (means >= 0).mean())
    lower, upper = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    spread = apart.std(ddof=1) if n > 1 else 0.0
    if two_sided:
        p = min(1.0, 2 * p)
    return {"n_queries": n, "mean_a": float(a.mean()), "mean_b": float(b.mean()), "delta": float(observed), "p_value": p, "ci_lower": float(lower), "ci_upper": float(upper), "effect_size": float(observed / spread) if spread > 0 else 0.0, "is_significant": p < alpha}


def pairs(scores: DataFrame) -> DataFrame:
    """ord, system_a, system_b, query_id, a, b of every pair of systems on their shared queries.

    ``scores``: system, ord (the systems' order), query_id, value.
    """
    left = scores.select(F.col("system").alias("system_a"), F.col("ord").alias("i"), "query_id", F.col("value").alias("a"))
    right = scores.select(F.col("system").alias("system_b"), F.col("ord").alias("j"), "query_id", F.col("value").alias("b"))
    both = left.join(right, "query_id").where("i < j")
    numbers = both.select("i", "j").distinct().selectExpr("i", "j", "cast(row_number() over (order by i, j) - 1 as int) as ord")  # a few systems
    return both.join(F.broadcast(numbers), ["i", "j"]).select("ord", "system_a", "system_b", "query_id", "a", "b")


def compare_all(scores: DataFrame, *, resamples: int = 10_000, alpha: float = 0.05, seed: int = 42, two_sided: bool = False) -> DataFrame:
    """Bootstrap of every pair; the seed of a pair is ``seed`` and its number. Largest difference first.

    A group holds one number per query and system, not a corpus.
    """

    def test(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("query_id")
        head = group.iloc[0]
        found = bootstrap(group["a"].to_numpy(), group["b"].to_numpy(), resamples=resamples, alpha=alpha, seed=seed + int(head["ord"]), two_sided=two_sided)
        return pd.DataFrame([{"ord": int(head["ord"]), "system_a": head["system_a"], "system_b": head["system_b"], **found}])

    return pairs(scores).groupBy("ord").applyInPandas(test, RESULT).orderBy(F.abs("delta").desc(), "ord")


def compare(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    """Bootstrap of two systems' (query_id, value); raises where they share no query."""
    scores = a.select(F.lit("a").alias("system"), F.lit(0).alias("ord"), "query_id", "value").unionByName(b.select(F.lit("b").alias("system"), F.lit(1).alias("ord"), "query_id", "value"))
    if a.join(b, "query_id", "left_semi").isEmpty():
        raise ValueError("the systems share no query")
    return compare_all(scores, **options)


def exclusive(a: DataFrame, b: DataFrame) -> DataFrame:
    """Queries that only one of two systems has."""
    left = a.join(b, "query_id", "left_anti").select("query_id", F.lit("a").alias("system"))
    return left.unionByName(b.join(a, "query_id", "left_anti").select("query_id", F.lit("b").alias("system")))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_tail(t: float, df: int) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: int) -> float:
    """The value that Student's t stays below with probability p >= 0.5, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_tail(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def paired_t(paired: DataFrame, alpha: float = 0.05) -> dict:
    """Paired t-test of ``paired`` (a, b): statistic, p, confidence interval, Cohen's d."""
    apart = F.col("b") - F.col("a")
    row = paired.agg(F.count(F.lit(1)).alias("n"), F.avg(apart).alias("delta"), F.stddev_samp(apart).alias("sd")).first()
    n, delta, sd = row["n"], row["delta"] or 0.0, row["sd"] or 0.0
    if n < 2 or sd == 0:
        return {"n_queries": n, "delta": delta, "t": 0.0, "p_value": 1.0 if delta == 0 else 0.0, "ci_lower": delta, "ci_upper": delta, "effect_size": 0.0, "is_significant": delta != 0 and n > 1}
    error = sd / math.sqrt(n)
    p, reach = t_tail(delta / error, n - 1), t_quantile(1 - alpha / 2, n - 1) * error
    return {"n_queries": n, "delta": delta, "t": delta / error, "p_value": p, "ci_lower": delta - reach, "ci_upper": delta + reach, "effect_size": delta / sd, "is_significant": p < alpha}


def win_loss_tie(paired: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """wins, losses and ties of b against a."""
    apart = F.col("b") - F.col("a")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return paired.agg(count(apart > epsilon).alias("wins"), count(apart < -epsilon).alias("losses"), count(F.abs(apart) <= epsilon).alias("ties"))
