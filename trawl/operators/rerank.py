"""Second-stage scores of (query, passage) pairs by a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import sigmoid
from ..functions.text import jaccard, let, tokenise
from .ranking import ranked


class Encoder(Protocol):
    """Texts to rows of a float matrix; called on executors."""

    dimensions: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    """Pairs of query and passage to scores; called on executors."""

    def score(self, queries: list[str], passages: list[str]) -> np.ndarray: ...


def encoded(df: DataFrame, text: str, make: Callable[[], Encoder], *, prefix: str = "", batch: int = 64) -> DataFrame:
    """``df`` with a unit ``embedding`` of its text; ``make`` builds the encoder once a worker. No rows are no error: a set is lazy; see ``encoded_list``."""

    @F.pandas_udf("array<float>")
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for texts in series:
            filled = [prefix + (t or "") for t in texts]
            parts = [np.asarray(encoder.encode(filled[k : k + batch]), np.float64) for k in range(0, len(filled), batch)]
            rows = np.concatenate(parts) if parts else np.zeros((0, encoder.dimensions))
            rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
            yield pd.Series(list(rows.astype(np.float32)))

    return df.withColumn("embedding", encode(F.col(text)))


def encoded_list(spark, texts: list[str], make: Callable[[], Encoder], **options) -> DataFrame:
    """id and embedding of a caller's texts; an empty list is an error."""
    if not texts:
        raise ValueError("no texts to encode")
    return encoded(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", make, **options).select("id", "embedding")


def hashed_words(text: Column, dimensions: int = 64) -> Column:
    """Stand-in embedding: counts of words by the first 32 bits of their MD5, as a unit vector."""
    buckets = F.transform(tokenise(text), lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dimensions)))

    def counted(held: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(held, lambda x: x == d)).cast("double"))

    def scaled(counts: Column) -> Column:
        length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return let(F.greatest(length, F.lit(1e-9)), lambda n: F.transform(counts, lambda x: x / n))

    return let(let(buckets, counted), scaled)


def overlap_score(query: Column, passage: Column) -> Column:
    """Stand-in reranker: a sigmoid of the words in common."""
    tokens = F.struct(F.array_distinct(tokenise(query)).alias("query"), F.array_distinct(tokenise(passage)).alias("passage"))
    return let(tokens, lambda held: sigmoid(8 * jaccard(held["query"], held["passage"]) - 1))  # texts are split once


def rerank(candidates: DataFrame, n: int | None = None, *, make: Callable[[], Reranker] | None = None, batch: int = 32) -> DataFrame:
    """New scores and ranks of ``candidates`` (query_id, passage_id, query_text, text), the best ``n`` a query."""
    if make is None:
        score = overlap_score(F.col("query_text"), F.col("text"))
    else:

        @F.pandas_udf("double")
        def scored(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = make()
            for queries, passages in pairs:
                parts = [np.asarray(model.score(list(queries[k : k + batch]), list(passages[k : k + batch])), float) for k in range(0, len(queries), batch)]
                yield pd.Series(np.concatenate(parts) if parts else [])

        score = scored(F.col("query_text"), F.col("text"))
    return ranked(candidates.drop("score", "rank").withColumn("score", score), n)
