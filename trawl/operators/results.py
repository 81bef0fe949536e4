"""Result rows as other programs want them: checked, rounded, flat, as JSON and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The figures of a flat summary, and the columns of a run's means that they come from.
HEADLINES = {"ndcg@10": "ndcg_10", "mrr@10": "mrr_10", "recall@100": "recall_100", "precision@10": "precision_10", "map": "map"}
#: Longest query, in characters.
LONGEST_QUERY = 1000
#: What a result's JSON holds.
RESULT = "passage_id string, text string, score double, rank int, title string, metadata map<string,string>"


def rounded(df: DataFrame, columns: list[str], digits: int = 4, *, half_even: bool = True) -> DataFrame:
    """``df`` with ``columns`` rounded; halves go to the even digit, or up."""
    rounding = F.bround if half_even else F.round
    return df.withColumns({c: rounding(F.col(c).cast("double"), digits) for c in columns})


def summary(means: DataFrame) -> DataFrame:
    """A map of the headline figures of each row of means."""
    pairs = [x for name, column in HEADLINES.items() for x in (F.lit(name), F.col(column).cast("double"))]
    return means.withColumn("summary", F.create_map(*pairs))


def to_json(results: DataFrame) -> DataFrame:
    """``results`` with ``json``: the six fields of a result as one object."""
    fields = {f.split()[0]: f.split()[1] for f in RESULT.split(", ")}
    return results.withColumn("json", F.to_json(F.struct(*[F.col(c) if c in results.columns else F.lit(None).cast(t).alias(c) for c, t in fields.items()]), {"ignoreNullFields": "false"}))


def from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """The six fields of each object; missing metadata is an empty map, a missing title an empty text."""
    out = rows.select(F.from_json(column, RESULT).alias("r")).select("r.*")
    return out.withColumns({"title": F.coalesce("title", F.lit("")), "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>"))})


def candidates(rows: DataFrame) -> DataFrame:
    """A caller's own candidates (query_id, passage_id, text and maybe title, score, rank, metadata) with defaults for what is missing; a rank of zero passes."""
    defaults = {"title": F.lit(""), "score": F.lit(0.0), "rank": F.lit(0), "metadata": F.create_map().cast("map<string,string>")}
    return rows.withColumns({c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()})


def diagnosed(by_query: DataFrame, *, dense: str | None = None, lexical: str | None = None, rerank: str | None = None, base: str | None = None, low: str | None = None, dense_gain: float = 0.05, rerank_gain: float = 0.02, low_score: float = 0.3) -> DataFrame:
    """Queries for which all the masks asked for hold: dense beats lexical, reranking beats its base, a score is low."""
    masks: list[Column] = []
    if dense and lexical:
        masks.append(F.col(dense) - F.col(lexical) > dense_gain)
    if rerank and base:
        masks.append(F.col(rerank) - F.col(base) > rerank_gain)
    if low:
        masks.append(F.col(low) < low_score)
    for mask in masks:
        by_query = by_query.where(mask)
    return by_query


def check_weights(lexical: float, dense: float) -> None:
    """Weights of a hybrid must sum to one, at six decimals."""
    if round(lexical + dense, 6) != 1:
        raise ValueError(f"weights sum to {lexical + dense}, not 1")


def check_query(text: str) -> str:
    """A single query without outer white space; raises if it is blank or, as given, too long."""
    if len(text) > LONGEST_QUERY:
        raise ValueError(f"a query has at most {LONGEST_QUERY} characters")
    if not text.strip():
        raise ValueError("a query is more than white space")
    return text.strip()


def check_rerank(n_passages: int, top_n: int) -> None:
    if not 1 <= top_n <= n_passages:
        raise ValueError("top_n lies between 1 and the number of passages")
