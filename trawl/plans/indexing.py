"""Building and keeping lexical and dense indexes side by side."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import unit
from ..functions.text import indexed_text, tokenise
from ..operators import dense, lexical
from ..operators.ranking import judged, judged_queries, not_indexed
from ..sources.corpus import passages as load_passages
from ..sources.tables import KeyedTable

POSTINGS = "passage_id string, dl int, terms array<struct<term:string,tf:long>>"
VECTORS = "passage_id string, embedding array<double>"
MANIFEST = "passage_id string"


class CorpusIndex:
    """A folder with postings, unit vectors and a manifest of what has been indexed, each a keyed table: the same passages again change nothing."""

    def __init__(self, spark: SparkSession, folder: str, *, k1: float = 1.5, b: float = 0.75):
        self.spark, self.folder, self.k1, self.b = spark, folder, k1, b
        self.postings = KeyedTable(spark, f"{folder}/postings", POSTINGS)
        self.vectors = KeyedTable(spark, f"{folder}/vectors", VECTORS)
        self.manifest = KeyedTable(spark, f"{folder}/manifest", MANIFEST)
        for table in (self.postings, self.vectors, self.manifest):
            table.create()

    def index_lexical(self, passages: DataFrame, analyse=tokenise) -> None:
        """Upsert the postings of ``passages`` (passage_id, title, text)."""
        tokens = passages.select("passage_id", analyse(indexed_text(F.col("title"), F.col("text"))).alias("tokens"))
        self.postings.upsert(tokens.select("passage_id", F.size("tokens").alias("dl"), lexical.term_counts(F.col("tokens")).alias("terms")))

    def index_dense(self, embeddings: DataFrame) -> None:
        """Upsert unit vectors of ``embeddings`` (passage_id, embedding)."""
        self.vectors.upsert(embeddings.select("passage_id", unit(F.col("embedding").cast("array<double>")).alias("embedding")))

    def index(self, passages: DataFrame, encode: Callable[[DataFrame], DataFrame] | None = None, *, resume: bool = True) -> dict[str, int]:
        """Index passages that the manifest lacks (all with ``resume`` off) both ways; the manifest comes last, so a failed run is repeated."""
        new = not_indexed(passages, self.manifest.read()) if resume else passages
        new = new.persist()
        try:
            fresh, total = new.count(), passages.count()
            if fresh:
                self.index_lexical(new)
                if encode:
                    self.index_dense(encode(new))
                self.manifest.upsert(new.select("passage_id"))
        finally:
            new.unpersist()
        return {"indexed": fresh, "skipped": total - fresh}

    def bm25(self) -> lexical.Bm25Index:
        """The lexical index of all that has been upserted."""
        rows = self.postings.read()
        postings = rows.select("passage_id", "dl", F.inline("terms")).select("term", "passage_id", "tf", "dl")
        return lexical.of_postings(postings, rows.select("passage_id", "dl"), k1=self.k1, b=self.b)

    def healthy(self) -> dict[str, bool]:
        """Whether each part exists and has rows."""
        return {name: not table.read().isEmpty() for name, table in (("postings", self.postings), ("vectors", self.vectors), ("manifest", self.manifest))}


def save_flat(embeddings: DataFrame, folder: str) -> None:
    """Unit vectors with a running number for each id, for readers that want positions."""
    numbered = embeddings.select("passage_id", unit(F.col("embedding").cast("array<double>")).alias("embedding"))
    numbered.sort("passage_id").withColumn("number", F.monotonically_increasing_id()).write.mode("overwrite").parquet(folder)


def ingest_sample(raw: DataFrame, folder: str, *, encode: Callable[[DataFrame], DataFrame], mode: str = "dev", qrels: DataFrame | None = None, limit: int | None = None, cells: int | None = None) -> dict:
    """Load a sample, index it both ways and write its vectors and a summary; returns the summary."""
    spark, began = raw.sparkSession, time.time()
    sample = load_passages(raw, mode, qrels=qrels, limit=limit)
    index = CorpusIndex(spark, folder)
    counts = index.index(sample, encode)
    save_flat(index.vectors.read(), f"{folder}/flat")
    if cells:
        dense.build_cells(index.vectors.read(), cells).save(f"{folder}/cells")
    summary = {"run": uuid.uuid4().hex, "mode": mode, **counts, "vectors": index.vectors.count(), "seconds": round(time.time() - began, 3)}
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
    return summary


def dev_set(queries: DataFrame, qrels: DataFrame, passages: DataFrame, first: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, judgments and passages for evaluation while training: the first judged queries and what their judgments name."""
    chosen = judged_queries(queries, qrels.where("grade > 0"), first)
    own = qrels.where("grade > 0").join(chosen.select("query_id"), "query_id", "left_semi")
    return chosen, own, judged(passages, own)


def pair_set(triplets: DataFrame) -> DataFrame:
    """query, passage and label of triplets (query, positive, negative): one good and one bad pair of each."""
    pairs = F.array(F.struct(F.col("positive").alias("passage"), F.lit(1).alias("label")), F.struct(F.col("negative").alias("passage"), F.lit(0).alias("label")))
    return triplets.select("query", F.inline(pairs))
