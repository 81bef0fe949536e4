"""Whole searches: one lazy plan for a set of queries."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import cache_key
from ..functions.text import strip
from ..operators import dense, lexical
from ..operators import fusion as fusing
from ..operators.ranking import filtered, non_blank, ranked, with_payload
from ..operators.rerank import rerank
from ..operators.results import check_query

MODES = ("bm25", "dense", "hybrid", "rerank")


class Retriever(Protocol):
    """Anything that ranks passages for a set of queries."""

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, passage_id, score, rank."""

    def index(self, passages: DataFrame) -> None:
        """Take passages in."""

    def healthy(self) -> bool:
        """Whether there is something to search."""


class LexicalRetriever:
    """BM25 as a retriever."""

    def __init__(self, index: lexical.Bm25Index | lexical.BlockIndex | None = None):
        self._index = index

    def index(self, passages: DataFrame) -> None:
        self._index = lexical.build(passages)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if self._index is None:
            raise ValueError("nothing has been indexed")
        return lexical.search(self._index, non_blank(queries), k)

    def healthy(self) -> bool:
        return self._index is not None and not self._index.docs.isEmpty()


class DenseRetriever:
    """Vectors as a retriever; ``encode`` adds ``embedding`` to rows with a text, queries may bring theirs."""

    def __init__(self, vectors: DataFrame | None = None, *, metric: str = "dot", encode: Callable[[DataFrame], DataFrame] | None = None):
        self._vectors, self.metric, self.encode = vectors, metric, encode

    def index(self, passages: DataFrame) -> None:
        self._vectors = (passages if "embedding" in passages.columns else self.encode(passages)).select("passage_id", "embedding")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if self._vectors is None:
            raise ValueError("nothing has been indexed")
        queries = non_blank(queries) if "query_text" in queries.columns else queries
        return dense.search(queries if "embedding" in queries.columns else self.encode(queries), self._vectors, k, metric=self.metric)

    def healthy(self) -> bool:
        return self._vectors is not None and not self._vectors.isEmpty()


class HybridRetriever:
    """Several retrievers and a fusion: its name, or a function of the list of runs, or of that and k."""

    def __init__(self, legs: list[Retriever], fusion: str | Callable = "rrf", *, reach: Callable[[int], int] = lambda k: max(3 * k, 50), **options):
        self.legs, self.fusion, self.reach, self.options = legs, fusion, reach, options

    def index(self, passages: DataFrame) -> None:
        for leg in self.legs:
            leg.index(passages)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return merged(self.fusion, [leg.search(queries, self.reach(k)) for leg in self.legs], k, **self.options)

    def healthy(self) -> bool:
        return all(leg.healthy() for leg in self.legs)


def merged(fusion: str | Callable, runs: list[DataFrame], k: int, **options) -> DataFrame:
    """``runs`` merged by a fusion's name or a caller's function; the best ``k`` of each query, ranked anew."""
    if isinstance(fusion, str):
        return fusing.strategy(fusion)(*runs, k=k, **options)
    takes = [p for p in inspect.signature(fusion).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD, p.VAR_POSITIONAL) and p.default is p.empty]
    made = fusion(runs, k) if len(takes) > 1 or any(p.kind == p.VAR_POSITIONAL for p in takes) else fusion(runs)
    return ranked(made.select("query_id", "passage_id", "score"), k)


@dataclass
class Searcher:
    """Indexes and settings of a search.

    ``queries`` of a search have query_id, query_text and, for dense legs,
    embedding. Errors are raised, never turned into another mode's results.
    """

    passages: DataFrame
    index: lexical.Bm25Index | lexical.BlockIndex | None = None
    vectors: DataFrame | None = None
    fusion: str | Callable = "rrf"
    metric: str = "dot"
    reranker: object = None
    alpha: float = 0.5
    constant: int = fusing.RRF_K
    ttl: float = 300.0
    most: int = 64
    results: dict[str, tuple[float, DataFrame]] = field(default_factory=dict)
    clock: Callable[[], float] = time.monotonic

    def search(self, queries: DataFrame, mode: str = "hybrid", k: int = 10, *, rerank_top_n: int | None = None, payload: bool = False, filters: dict | None = None, legs: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """query_id, passage_id, score, rank of the best ``k``; blank queries have none.

        ``legs``: lexical and dense runs of these queries that were searched deep enough before.

        ``filters`` (those of ``ranking.filtered``) choose passages before
        retrieval; the lexical weights stay those of the whole index.
        """
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        if not 1 <= k <= 1000 or (rerank_top_n is not None and rerank_top_n < k):
            raise ValueError("k must lie between 1 and 1000, and rerank_top_n be at least k")
        queries = non_blank(queries)
        index, vectors = self.index, self.vectors
        if filters:
            allowed = filtered(self.passages, **filters).select("passage_id")
            index = lexical.restricted(index, allowed) if index else None
            vectors = vectors.join(allowed, "passage_id", "left_semi") if vectors is not None else None

        def leg(n: int, at: int) -> DataFrame:
            if legs:
                return legs[at].where(F.col("rank") <= n)
            return dense.search(queries, vectors, n, metric=self.metric) if at else lexical.search(index, queries, n)

        if mode == "bm25":
            run = leg(k, 0)
        elif mode == "dense":
            run = leg(k, 1)
        elif mode == "hybrid":
            reach = max(3 * k, 50)
            runs = [leg(reach, 0), leg(reach, 1)]
            options = {}
            if isinstance(self.fusion, str):
                options = {"alpha": self.alpha} if fusing.strategy(self.fusion) is fusing.by_scores else {"constant": self.constant}
            run = merged(self.fusion, runs, k, **options)
        else:
            pool = self.search(queries, "hybrid", min(1000, rerank_top_n or 3 * k), filters=filters, legs=legs)
            texts = with_payload(pool.cache(), self.passages).join(queries.select("query_id", "query_text"), "query_id")
            run = rerank(texts, k, make=self.reranker).select("query_id", "passage_id", "score", "rank")
        run = run.select("query_id", "passage_id", "score", "rank")
        return with_payload(run.cache(), self.passages) if payload else run

    def search_one(self, text: str, mode: str = "hybrid", k: int = 10, *, embedding: list[float] | None = None, **options) -> DataFrame:
        """The search of one query; a blank or too long one is an error."""
        spark = self.passages.sparkSession
        row = spark.createDataFrame([("q", check_query(text), embedding)], "query_id string, query_text string, embedding array<double>")
        return self.search(row, mode, k, **options)

    def cached(self, queries: DataFrame, mode: str = "hybrid", k: int = 10, *, rerank_top_n: int | None = None, filters: dict | None = None) -> DataFrame:
        """The search's rows with a key of all parameters, kept in Spark's cache for ``ttl`` seconds; of more than ``most`` the oldest goes."""
        name = f"{mode}|{k}|{rerank_top_n}|{self.fusion}|{self.alpha}|{self.constant}|{filters}|{queries.semanticHash()}"
        now = self.clock()
        for old, (until, _) in list(self.results.items()):
            if until <= now:
                self._forget(old)
        if name not in self.results:
            while len(self.results) >= self.most:
                self._forget(next(iter(self.results)))
            keys = queries.select("query_id", cache_key(strip(F.col("query_text")), F.lit(mode), F.lit(str(k)), F.lit(str(rerank_top_n))).alias("cache_key"))
            found = self.search(queries, mode, k, rerank_top_n=rerank_top_n, filters=filters).join(keys, "query_id")
            self.results[name] = now + self.ttl, found.cache()
        return self.results[name][1]

    def _forget(self, name: str) -> None:
        self.results.pop(name)[1].unpersist()

    def forget(self) -> None:
        """Release all cached results."""
        for name in list(self.results):
            self._forget(name)

    def healthy(self) -> dict[str, bool]:
        """Whether passages, index and vectors are there and have rows."""
        return {"passages": not self.passages.isEmpty(), "index": self.index is not None and not self.index.docs.isEmpty(), "vectors": self.vectors is not None and not self.vectors.isEmpty()}

    def warm(self, queries: DataFrame, mode: str = "hybrid", k: int = 10) -> dict[str, int]:
        """Fill the cache; how many queries have results and how many have none."""
        total = queries.count()
        found = self.cached(queries, mode, k).select("query_id").distinct().count()
        return {"succeeded": found, "failed": total - found}

    def compare_modes(self, queries: DataFrame, k: int = 10, modes: tuple[str, ...] = MODES) -> DataFrame:
        """Rows of every mode, with the mode's name; each leg is searched once, as deep as the deepest mode asks."""
        asked, deepest, legs = non_blank(queries), max(3 * min(1000, 3 * k), 50), None
        if len({"hybrid", "rerank"} & set(modes)) and len(modes) > 1:
            legs = lexical.search(self.index, asked, deepest).cache(), dense.search(asked, self.vectors, deepest, metric=self.metric).cache()
        out = None
        for mode in modes:
            leg = self.search(queries, mode, k, legs=legs).withColumn("mode", F.lit(mode))
            out = leg if out is None else out.unionByName(leg)
        return out


def rerank_only(candidates: DataFrame, n: int, make=None) -> DataFrame:
    """Rerank the caller's own candidates, 200 a query at most."""
    many = candidates.groupBy("query_id").count().where("count > 200")
    if not many.isEmpty():
        raise ValueError("at most 200 candidates a query")
    return rerank(candidates, n, make=make)


__all__ = ["MODES", "DenseRetriever", "HybridRetriever", "LexicalRetriever", "Retriever", "Searcher", "merged", "ranked", "rerank_only"]
