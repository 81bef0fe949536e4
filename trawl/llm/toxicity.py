"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct n-grams of its lower-cased characters,
digits, symbols and the spaces between words among them, as hash buckets; a run
of white space is one space, and one stands at either end. On the labelled
documents each bucket gets the log ratio of its smoothed frequency in toxic and
other documents; the buckets whose counts stand out most by a likelihood-ratio
test are the model's features, each worth its ratio where present. Logistic
regression with an L2 penalty weighs them.

Ratios are counted on at most about ``counted`` labelled rows and weights are
fitted to at most about ``sample`` of these; everything else sees all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, crc_remainder, cut, slices

#: Lengths of n-grams.
GRAMS = (3, 4, 5)
#: Binary digits of a hash bucket's number.
BITS = 22
#: Hash buckets of n-grams.
BUCKETS = 1 << BITS
#: Labelled rows that log-count ratios are counted on at most (about; a hash of the id decides).
COUNTED = BROADCAST_ROWS // 2
#: Labelled rows that the regression is fitted to at most (about).
SAMPLE = 20_000
#: Features that a model has at most.
FEATURES = 6_000
#: Least root of a feature's likelihood ratio (G), which is sound for n-grams that one side lacks.
STANDS_OUT = 4.0
#: Added to every count.
SMOOTHING = 0.5
#: Weight of the L2 penalty on the scaled features.
PENALTY = 1.0
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: Characters of a text that are hashed at once.
STRETCH = 200_000

_TIMES = np.random.default_rng(9).integers(0, 1 << 64, (max(GRAMS) + 1, max(GRAMS)), np.uint64, endpoint=False) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.zeros(0, np.int32)


@lru_cache(maxsize=1)
def _scratch() -> np.ndarray:
    """Room for one number a bucket, kept by the worker."""
    return np.empty(BUCKETS, np.int32)


def _distinct(buckets: np.ndarray) -> np.ndarray:
    """``buckets`` without repetitions, in any order: each keeps the place that was written last."""
    at, places = _scratch(), np.arange(len(buckets), dtype=np.int32)
    at[buckets] = places
    return buckets[at[buckets] == places]


def buckets_of(text: str | None) -> np.ndarray:
    """Distinct buckets of the n-grams of one whole text; none if it has no words."""
    words = (text or "").lower().split()
    if not words:
        return _NONE
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found = []
    for start in range(0, max(1, len(points) - min(GRAMS) + 1), STRETCH):
        part = points[start : start + STRETCH + max(GRAMS) - 1]
        hashed = []
        for n in GRAMS:
            if len(part) >= n:
                sums = part[: len(part) - n + 1] * _TIMES[n, 0]
                for k in range(1, n):
                    sums += part[k : len(part) - n + 1 + k] * _TIMES[n, k]
                hashed.append(((sums ^ (sums >> np.uint64(31))) * _MIX >> np.uint64(64 - BITS)).astype(np.int32))
        found.append(_distinct(np.concatenate(hashed)))
    return found[0] if len(found) == 1 else _distinct(np.concatenate(found))


def word_buckets(word: str) -> set[int]:
    """Buckets of the n-grams of a word that stands alone."""
    return set(buckets_of(word).tolist())


class Model:
    """Weights of features and an intercept. ``weights`` already hold the log-count ratios."""

    def __init__(self, buckets: list[int], weights: np.ndarray, intercept: float):
        self.chosen = {b: i for i, b in enumerate(buckets)}
        self.weights, self.intercept = np.asarray(weights, float), float(intercept)
        self._numbers: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_numbers": None}

    def features(self, text: str | None) -> np.ndarray:
        """Numbers of the features in one whole text, in order."""
        if self._numbers is None:
            self._numbers = np.full(BUCKETS, -1, np.int32)
            self._numbers[list(self.chosen)] = np.arange(len(self.chosen), dtype=np.int32)
        found = self._numbers[buckets_of(text)]
        return np.sort(found[found >= 0])

    def score(self, features) -> float:
        value = self.intercept + float(self.weights[features].sum()) if len(features) else self.intercept
        return float(1 / (1 + np.exp(-np.clip(value, -40, 40))))


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, penalty: float = PENALTY, steps: int = 60) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on present features worth their ratios, by L-BFGS."""
    lengths = np.array([len(r) for r in rows])
    columns = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    values = ratios[columns]
    size = len(ratios)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(owner, values * w[columns], minlength=len(rows)) + w[size]
        grad = np.zeros(size + 1)
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        grad[:size] = np.bincount(columns, values * error[owner], minlength=size) + penalty * w[:size]
        grad[size] = error.sum()
        return float(np.logaddexp(0, z).sum() - labels @ z + penalty / 2 * w[:size] @ w[:size]), grad

    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    w = np.zeros(size + 1)
    w[size] = np.log(rate / (1 - rate))
    value, grad = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = grad.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            q -= a * y
            kept.append((a, s, y))
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(grad)))
        for a, s, y in reversed(kept):
            q += (a - y @ q / (s @ y)) * s
        step, slope = 1.0, float(grad @ q)
        if slope <= 1e-10:
            break
        while True:
            moved = w - step * q
            new, fresh = loss(moved)
            if new <= value - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = moved - w, fresh - grad
        if s @ y > 1e-12:
            pairs = [*pairs[-9:], (s, y)]
        done = value - new <= 1e-7 * max(1.0, abs(value))
        w, value, grad = moved, new, fresh
        if done:
            break
    return w[:size] * ratios, float(w[size])


def train(labelled: DataFrame, *, features: int = FEATURES, penalty: float = PENALTY, sample: int = SAMPLE) -> Model:
    """Fit a model to ``labelled`` (text, toxic 0/1 and, if rows are many, ``draw`` from 0 to 1), already bounded.

    Ratios are counted on all its rows; the regression takes those with the
    least draws, about ``sample``. The driver gets the chosen buckets and each
    sampled row's chosen features. Without rows of both kinds the model scores
    every text alike, by the share of toxic rows (zero without rows).
    """
    sides = {int(r["toxic"]): r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sides.get(1, 0), sides.get(0, 0)
    if not toxic or not other:
        return Model([], np.zeros(0), 40.0 if toxic else -40.0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int32)
        for batch in slices(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label, buckets_of(text)] += 1
        used = np.flatnonzero(counts.any(0))
        for k in range(0, len(used), 100_000):
            part = used[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[1, part].astype(np.int64)), pa.array(counts[0, part].astype(np.int64))], names=["bucket", "pos", "neg"])

    context = labelled.sparkSession.sparkContext
    # Each task puts out one row for each bucket it has met: no more tasks than can run at once.
    rows = labelled.select("text", F.col("toxic").cast("int")).coalesce(max(1, context.defaultParallelism))
    counts = rows.mapInArrow(counted, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pos, neg = F.col("pos") + SMOOTHING, F.col("neg") + SMOOTHING
    ratio = F.log(pos / (toxic + 2 * SMOOTHING)) - F.log(neg / (other + 2 * SMOOTHING))
    used, rest = F.col("pos") + F.col("neg"), toxic + other - F.col("pos") - F.col("neg")

    def term(seen, row, side: int):
        return F.when(seen > 0, seen * F.log(seen * float(toxic + other) / (row * float(side)))).otherwise(0.0)

    g = 2 * (term(F.col("pos"), used, toxic) + term(F.col("neg"), used, other) + term(toxic - F.col("pos"), rest, toxic) + term(other - F.col("neg"), rest, other))
    rated = counts.select("bucket", ratio.alias("ratio"), F.sqrt(F.greatest(g, F.lit(0.0))).alias("z"))
    chosen = rated.where(F.col("z") >= STANDS_OUT).orderBy(F.desc("z"), "bucket").limit(features).collect()
    model = Model([r["bucket"] for r in chosen], np.zeros(len(chosen)), 0.0)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [model.features(t).astype("<u4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], names=["features", "toxic"])

    fitted = labelled
    if toxic + other > sample and "draw" in labelled.columns:
        fitted = labelled.where(F.col("draw") < sample / (toxic + other))
    rows = fitted.select("text", F.col("toxic").cast("int")).mapInArrow(featured, "features binary, toxic int").collect()
    rows.sort(key=lambda r: (r["toxic"], bytes(r["features"])))  # sums in the same order each time
    model.weights, model.intercept = fit_weights([np.frombuffer(bytes(r["features"]), "<u4") for r in rows], np.array([r["toxic"] for r in rows], float), np.array([r["ratio"] for r in chosen], float), penalty)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = COUNTED) -> DataFrame:
    """text, toxic and draw (0 to 1, by the id) of at most about ``sample`` labelled rows outside the held-out quarter, written.

    Of repeated labels the toxic one counts; rows without a label are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("labelled").isNotNull())
    known = cut(known.where(crc_remainder(F.col("labelled"), 4) != 2).groupBy("labelled").agg(F.max("toxic").alias("toxic")))
    total = known.count()
    if total > sample:
        known = known.where(F.pmod(F.xxhash64("labelled"), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    assert sample * 2 <= BROADCAST_ROWS
    known = known.withColumn("draw", F.pmod(F.xxhash64("labelled", F.lit("draw")), F.lit(1 << 30)) / (1 << 30))
    return cut(docs.select(F.col("doc_id").cast("long").alias("labelled"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "labelled").select("text", "toxic", "draw"))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    The score uses the text alone. Null and empty texts have no features and
    get the score of the intercept. Very long texts are scored whole, repeated
    rows alike; a null doc_id is not held out. Other columns are ignored; an
    empty table gives no rows.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [model.score(model.features(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double")
    held = F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns."""
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([model.score(model.features(t)) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
