"""BM25 over an inverted index of three tables and one row of totals; postings carry their passage's length, so scoring joins on terms alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import indexed_text, let, tokenise
from . import blocks
from .blocks import BlockIndex
from .ranking import ranked


@dataclass
class Bm25Index:
    """postings (term, passage_id, tf, dl), docs (passage_id, dl), terms (term, df, idf), stats (n_docs, avgdl, average_idf)."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    stats: DataFrame
    k1: float = 1.5
    b: float = 0.75

    def save(self, folder: str) -> None:
        """Write the tables; postings by term, so that a term's rows lie in few files."""
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
        for name in ("docs", "terms", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        self.docs.sparkSession.createDataFrame([(self.k1, self.b)], "k1 double, b double").write.mode("overwrite").parquet(f"{folder}/params")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Bm25Index:
        params = spark.read.parquet(f"{folder}/params").first()
        return cls(*[spark.read.parquet(f"{folder}/{n}") for n in ("postings", "docs", "terms", "stats")], params["k1"], params["b"])

    def size(self) -> int:
        return self.docs.count()


def term_counts(tokens: Column) -> Column:
    """Array of (term, tf) of an array of tokens, by sorting it."""

    def counted(held: Column) -> Column:
        starts = F.filter(F.transform(held, lambda t, i: F.struct(t.alias("term"), i.alias("at"))), lambda s: (s["at"] == 0) | (F.get(held, s["at"] - 1) != s["term"]))
        return let(starts, lambda first: F.transform(first, lambda s, i: F.struct(s["term"].alias("term"), (F.coalesce(F.get(first, i + 1)["at"], F.size(held)) - s["at"]).cast("long").alias("tf"))))

    return let(F.sort_array(tokens), counted)


def build(passages: DataFrame, *, text: Column | None = None, analyse=tokenise, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, probabilistic: bool = True) -> Bm25Index:
    """Index ``passages`` (passage_id, title, text).

    Passages without tokens count for the number and mean length of documents.
    ``probabilistic``: idf = ln(N - df + .5) - ln(df + .5), negative ones
    replaced by ``epsilon`` times the mean over all terms; else the
    non-negative ln(1 + (N - df + .5) / (df + .5)).
    """
    text = indexed_text(F.col("title"), F.col("text")) if text is None else text
    tokens = passages.select("passage_id", analyse(text).alias("tokens"))
    docs = tokens.select("passage_id", F.size("tokens").alias("dl"))
    postings = tokens.select("passage_id", F.size("tokens").alias("dl"), F.inline(term_counts(F.col("tokens")))).select("term", "passage_id", "tf", "dl")
    return of_postings(postings, docs, k1=k1, b=b, epsilon=epsilon, probabilistic=probabilistic)


def build_saved(passages: DataFrame, folder: str, *, text: Column | None = None, analyse=tokenise, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, probabilistic: bool = True) -> Bm25Index:
    """``build`` with texts read and split once: terms and totals are counted on the postings that are written to ``folder``."""
    spark = passages.sparkSession
    text = indexed_text(F.col("title"), F.col("text")) if text is None else text
    tokens = passages.select("passage_id", analyse(text).alias("tokens"))
    tokens.select("passage_id", F.size("tokens").alias("dl"), term_counts(F.col("tokens")).alias("terms")).write.mode("overwrite").parquet(f"{folder}/passages")
    written = spark.read.parquet(f"{folder}/passages")
    postings = written.select("passage_id", "dl", F.inline("terms")).select("term", "passage_id", "tf", "dl")
    made = of_postings(postings, written.select("passage_id", "dl"), k1=k1, b=b, epsilon=epsilon, probabilistic=probabilistic)
    for name in ("terms", "stats"):
        getattr(made, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    return Bm25Index(made.postings, made.docs, spark.read.parquet(f"{folder}/terms"), spark.read.parquet(f"{folder}/stats"), k1, b)


def of_postings(postings: DataFrame, docs: DataFrame, *, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, probabilistic: bool = True) -> Bm25Index:
    """The index of given postings (term, passage_id, tf, dl) and docs (passage_id, dl); see ``build``."""
    size = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, d = F.col("n_docs"), F.col("df")
    counted = df.crossJoin(F.broadcast(size))  # one row
    if probabilistic:
        raw = counted.select("term", "df", (F.log(n - d + 0.5) - F.log(d + 0.5)).alias("raw"))
        mean = raw.agg(F.avg("raw").alias("average_idf"))
        terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("average_idf")).otherwise(F.col("raw")).alias("idf"))
    else:
        mean = size.select(F.lit(None).cast("double").alias("average_idf"))
        terms = counted.select("term", "df", F.log(1 + (n - d + 0.5) / (d + 0.5)).alias("idf"))
    return Bm25Index(postings, docs, terms, size.crossJoin(F.broadcast(mean)), k1, b)


def scores(index: Bm25Index, queries: DataFrame, analyse=tokenise) -> DataFrame:
    """query_id, passage_id, score of passages that share a term with a query; repeated query terms add up."""
    wanted = queries.select("query_id", F.explode(analyse(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighed = wanted.join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    length = 1 - index.b + index.b * F.col("dl") / F.col("avgdl")
    part = F.col("weight") * F.col("tf") * (index.k1 + 1) / (F.col("tf") + index.k1 * length)
    met = index.postings.join(weighed, "term").crossJoin(F.broadcast(index.stats.select("avgdl")))  # one row
    return met.groupBy("query_id", "passage_id").agg(F.sum(part).alias("score"))


def restricted(index: Bm25Index | BlockIndex, allowed: DataFrame) -> Bm25Index | BlockIndex:
    """The index with the postings of ``allowed`` passages alone; terms and totals stay those of the whole."""
    if isinstance(index, BlockIndex):
        return index.restricted(allowed)
    ids = allowed.select("passage_id").distinct()
    return Bm25Index(index.postings.join(ids, "passage_id", "left_semi"), index.docs.join(ids, "passage_id", "left_semi"), index.terms, index.stats, index.k1, index.b)


def search(index: Bm25Index | BlockIndex, queries: DataFrame, k: int = 10, *, analyse=tokenise, pad_zero: bool = False) -> DataFrame:
    """The best ``k`` passages of each query: query_id, passage_id, score, rank.

    ``pad_zero`` fills up with passages of score zero, in the order of their
    ids, as a full ranking would.
    """
    if isinstance(index, BlockIndex):
        return blocks.search(index, queries, k, analyse=analyse, pad_zero=pad_zero)
    found = scores(index, queries, analyse)
    if pad_zero:
        # Only queries with fewer than k passages at zero or above are filled, from the first k + (rows found) ids of the corpus at most.
        own = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score") >= 0).alias("high"))
        short = queries.select("query_id").distinct().join(own.where(F.col("high") >= k), "query_id", "left_anti")
        most = own.where(F.col("high") < k).agg(F.max("rows")).first()[0] or 0
        fill = index.docs.select("passage_id").orderBy("passage_id").limit(k + most)
        extra = short.crossJoin(fill).join(found.select("query_id", "passage_id"), ["query_id", "passage_id"], "left_anti").withColumn("score", F.lit(0.0))
        found = found.unionByName(extra)
    return ranked(found, k)


def search_fields(passages: DataFrame, queries: DataFrame, k: int = 10, *, boosts: dict[str, float] | None = None, analyse=tokenise, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Best field wins: the largest boosted score over the fields; only passages that match."""
    boosts = boosts or {"text": 1.0, "title": 0.5}
    legs = None
    for field, boost in boosts.items():
        index = build(passages, text=F.col(field), analyse=analyse, k1=k1, b=b, probabilistic=False)
        leg = scores(index, queries, analyse).select("query_id", "passage_id", (boost * F.col("score")).alias("score"))
        legs = leg if legs is None else legs.unionByName(leg)
    return ranked(legs.groupBy("query_id", "passage_id").agg(F.max("score").alias("score")), k)
