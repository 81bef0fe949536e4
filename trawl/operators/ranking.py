"""Ranking, limits, deduplication and the other relational steps that searches share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decimals at which scores are compared, so that engines which add in another order rank alike.
COMPARED = 9
#: Marks that ids are hashed to before the texts of a run are looked up.
MARKS = 1 << 20


def ranked(run: DataFrame, k: int | None = None, *, by: str = "query_id", score: str = "score", tie: str = "passage_id", ascending: bool = False) -> DataFrame:
    """``run`` with rank from 1 within ``by``: best score first, then ``tie``; only ``k`` rows each where given."""
    value = F.round(F.col(score), COMPARED)
    order = value.asc() if ascending else value.desc()
    out = run.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, F.col(tie).asc())))
    return out.where(F.col("rank") <= k) if k is not None else out


def rank_or_position(rank: Column, position: Column) -> Column:
    """A rank below 1 counts as unknown; the place in the list stands in."""
    return F.when(rank >= 1, rank).otherwise(position)


def non_blank(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """Queries with more than white space."""
    return queries.where(F.length(F.trim(F.regexp_replace(F.col(text), r"(?U)\s", " "))) > 0)


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("nth row", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("nth row") == 1).drop("nth row")


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in the given order."""
    return df.withColumn("nth row", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where(F.col("nth row") == 1).drop("nth row")


def not_indexed(df: DataFrame, index: DataFrame, key: str = "passage_id") -> DataFrame:
    """Rows whose key the index lacks."""
    return df.join(index.select(key), key, "left_anti")


def judged(passages: DataFrame, qrels: DataFrame) -> DataFrame:
    """Passages that some judgment names."""
    return passages.join(qrels.select("passage_id"), "passage_id", "left_semi")


def judged_queries(queries: DataFrame, qrels: DataFrame, first: int | None = None) -> DataFrame:
    """Queries with judgments; the ``first`` by id as text where given."""
    out = queries.join(qrels.select("query_id"), "query_id", "left_semi")
    return out.orderBy("query_id").limit(first) if first is not None else out


def with_payload(run: DataFrame, passages: DataFrame) -> DataFrame:
    """Texts and titles joined after the ranks are known; missing ones are empty.

    Of the passages only those move whose id has the mark of an id of the run;
    there are MARKS marks at most, so they are sent to where the texts are.
    """
    mark = F.pmod(F.xxhash64(F.col("passage_id").cast("string")), F.lit(MARKS)).alias("mark of the id")
    wanted = passages.select("passage_id", "text", "title", mark).join(F.broadcast(run.select(mark).distinct()), "mark of the id", "left_semi")
    out = run.join(wanted.drop("mark of the id"), "passage_id", "left")
    return out.withColumns({"text": F.coalesce("text", F.lit("")), "title": F.coalesce("title", F.lit(""))})


def metadata(df: DataFrame, core: tuple[str, ...] = ("passage_id", "text", "title")) -> DataFrame:
    """Core columns and a map of all others as text."""
    rest = [c for c in df.columns if c not in core]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    held = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return df.select(*[c for c in core if c in df.columns], held.alias("metadata"))


def filtered(passages: DataFrame, *, source: str | None = None, language: str | None = None, date_from: str | None = None, date_to: str | None = None, tags: list[str] | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """Passages before retrieval: by source, language, ISO dates, all of some tags, other metadata."""
    for name, value in (("source", source), ("lang", language)):
        if value is not None:
            passages = passages.where(F.col(name) == value)
    if date_from is not None:
        passages = passages.where(F.col("date") >= date_from)
    if date_to is not None:
        passages = passages.where(F.col("date") <= date_to)
    if tags:
        passages = passages.where(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    for key, value in (extra or {}).items():
        passages = passages.where(F.col("metadata")[key] == value)
    return passages
