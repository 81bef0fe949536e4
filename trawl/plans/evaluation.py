"""Offline evaluation: runs of several systems, metrics, significance, a report."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, significance
from ..sources.tables import ExperimentStore
from .search import Searcher

#: The six systems of a sweep: (name, mode, reranked).
SWEEP = (("bm25", "bm25", False), ("bm25+rerank", "bm25", True), ("dense", "dense", False), ("dense+rerank", "dense", True), ("hybrid", "hybrid", False), ("hybrid+rerank", "hybrid", True))


def evaluate(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = metrics.CUTS) -> tuple[DataFrame, DataFrame]:
    """Per-query metrics, and one row of means."""
    by_query = metrics.per_query(run, qrels, cuts)
    return by_query, metrics.aggregate(by_query, cuts)


def sweep(searcher: Searcher, queries: DataFrame, qrels: DataFrame, k: int = 10, pool: int = 100) -> tuple[DataFrame, dict[str, float]]:
    """Per-query metrics of all six systems with ``system`` and ``ord``, and each run's seconds."""
    from ..operators.ranking import with_payload
    from ..operators.rerank import rerank

    out, seconds = None, {}
    for number, (name, mode, reranked) in enumerate(SWEEP):
        began = time.time()
        run = searcher.search(queries, mode, pool if reranked else k)
        if reranked:
            texts = with_payload(run, searcher.passages).join(queries.select("query_id", "query_text"), "query_id")
            run = rerank(texts, k, make=searcher.reranker)
        found = metrics.per_query(run, qrels).withColumns({"system": F.lit(name), "ord": F.lit(number)}).cache()
        found.count()
        seconds[name] = time.time() - began
        out = found if out is None else out.unionByName(found)
    return out, seconds


class Runner:
    """Runs experiments and stores their results."""

    def __init__(self, searcher: Searcher, store: ExperimentStore):
        self.searcher, self.store = searcher, store

    def run(self, name: str, mode: str, queries: DataFrame, qrels: DataFrame, k: int = 100, *, number: str | None = None, **options) -> str:
        """Search, evaluate and store: means, seconds and per-query metrics; returns the experiment's id. The same ``number`` replaces a run."""
        began = time.time()
        found = self.searcher.search(queries, mode, k, **options)
        by_query = metrics.per_query(found, qrels).persist()
        try:
            n = by_query.count()
            seconds = time.time() - began
            means = metrics.aggregate(by_query).first()
            cuts = metrics.CUTS
            result = {
                "ndcg_at_10": means["ndcg_10"] if means else 0.0,
                "mrr_at_10": means["mrr_10"] if means else 0.0,
                "map": means["map"] if means else 0.0,
                "recall_k": {str(c): means[f"recall_{c}"] for c in cuts} if means else {},
                "precision_k": {str(c): means[f"precision_{c}"] for c in cuts} if means else {},
                "queries_per_second": n / max(seconds, 1e-6),
                "num_queries": n,
                "num_passages": self.searcher.passages.count(),
            }
            rows = by_query.select("query_id", F.col("ndcg_10").alias("ndcg"), "rr", F.col("ap_retrieved").alias("ap"), F.col("precision_10").alias("precision"))
            return self.store.add(name, mode, {"mode": mode, "k": k, **{o: str(v) for o, v in options.items()}}, result, rows, number=number)
        finally:
            by_query.unpersist()

    def compare(self, a: str, b: str, metric: str = "ndcg", **options) -> DataFrame:
        """Results of both experiments in one row, with the test of their per-query values; an error if either is missing."""
        both = self.store.compared(a, b)
        if both is None:
            raise ValueError("both experiments must have results")
        values = self.store.by_query().where(F.col("experiment_id").isin(a, b))
        long = values.select(F.col("experiment_id").alias("system"), F.when(F.col("experiment_id") == a, 0).otherwise(1).alias("ord"), "query_id", F.col(metric).alias("value"))
        return both.crossJoin(F.broadcast(significance.compare_all(long, **options)))  # one row each


def compare(by_query: DataFrame, metric: str = "ndcg_10", **options) -> DataFrame:
    """Bootstrap of all pairs of systems."""
    return significance.compare_all(by_query.select("system", "ord", "query_id", F.col(metric).alias("value")), **options)


def best_per_metric(by_system: DataFrame, names: list[str]) -> DataFrame:
    """metric, system, value of the best system of each metric, ties by name."""
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    long = by_system.selectExpr("system", f"stack({len(names)}, {pairs}) as (metric, value)")
    return long.groupBy("metric").agg(F.max("value").alias("value"), F.min_by("system", F.struct(-F.col("value"), F.col("system"))).alias("system"))


def deltas(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """query_id, a, b and delta of the queries that both systems have."""
    return a.select("query_id", F.col(metric).alias("a")).join(b.select("query_id", F.col(metric).alias("b")), "query_id").withColumn("delta", F.col("b") - F.col("a"))


def report(by_query: DataFrame, compared: DataFrame | None = None, names: tuple[str, ...] = ("ndcg_10", "mrr_10", "recall_100", "precision_10", "ap_retrieved")) -> str:
    """Markdown tables of the systems' means and of their comparisons."""
    rows = by_query.groupBy("ord", "system").agg(*[F.avg(n).alias(n) for n in names]).orderBy("ord").collect()
    lines = ["# Evaluation", "", "| system | " + " | ".join(names) + " |", "|" + " --- |" * (len(names) + 1)]
    lines += [f"| {r['system']} | " + " | ".join(f"{r[n]:.4f}" for n in names) + " |" for r in rows]
    if compared is not None:
        lines += ["", "## Comparisons", "", "| a | b | delta | p | 95 % interval | effect | significant |", "|" + " --- |" * 7]
        lines += [f"| {r['system_a']} | {r['system_b']} | {r['delta']:+.4f} | {r['p_value']:.4f} | {r['ci_lower']:+.4f} to {r['ci_upper']:+.4f} | {r['effect_size']:.3f} | {'yes' if r['is_significant'] else 'no'} |" for r in compared.collect()]
    return "\n".join(lines) + "\n"
