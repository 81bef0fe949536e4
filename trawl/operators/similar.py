"""Pairs of overlapping texts, found through keys that such pairs must share, then verified.

A text that holds another one holds the other's inner words whole, as they stand
between white space in both; so each sought text is looked up by the rarest of
its inner words. Texts of less than three words have no inner ones and are
looked up by their rarest piece of GRAM characters. Token sets of a Jaccard
similarity of t or more share a token among the first size - ceil(t size) + 1 of
each, in any common order; the rarest come first. Every step is an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, strip, tokenise

#: Characters of the pieces by which short texts are looked up.
GRAM = 4
_SPACE = r"\s+"


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(F.split(text, _SPACE))


def _pieces(text: Column, length: Column | int) -> Column:
    """Distinct pieces of ``length`` characters; none of a shorter text."""
    size = length if isinstance(length, Column) else F.lit(length)
    starts = F.sequence(F.lit(1), F.char_length(text) - size + 1)
    held = F.struct(F.split(text, "").alias("characters"), starts.alias("starts"), size.alias("size"))
    cut = lambda h: F.transform(h["starts"], lambda at: F.array_join(F.slice(h["characters"], at, h["size"]), ""))
    made = F.array_distinct(F.get(F.transform(F.array(held), cut), 0))
    return F.when(F.char_length(text) >= size, made).otherwise(F.array().cast("array<string>"))


def _anchored(asks: DataFrame, offers: DataFrame, by: Sequence[str]) -> DataFrame:
    """needle_id and hay_id of the ``offers`` (by, hay_id, key) that have the rarest key of a needle among its ``asks`` (by, needle_id, key)."""
    counts = offers.join(asks.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    rarest = asks.join(counts, "key", "left").groupBy(*by, "needle_id").agg(F.min_by("key", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("key"))
    return rarest.join(offers, [*by, "key"]).select(*by, "needle_id", "hay_id")


def contained(needles: DataFrame, haystacks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """needle_id and hay_id of all pairs, within equal ``by``, in which a haystack's text holds a needle's.

    ``needles``: needle_id, text; ``haystacks``: hay_id, text; both with the
    columns ``by``. Empty and null texts hold nothing and are held by nothing.
    """
    needles = needles.select(*by, "needle_id", F.col("text").alias("needle")).where(F.char_length("needle") > 0)
    haystacks = haystacks.select(*by, "hay_id", F.col("text").alias("hay"))
    parts = needles.withColumn("parts", F.split("needle", _SPACE))
    inner = F.array_distinct(F.slice("parts", F.lit(2), F.size("parts") - 2))
    asks = parts.where(F.size("parts") > 2).select(*by, "needle_id", F.explode(inner).alias("key"))
    found = _anchored(asks, haystacks.select(*by, "hay_id", F.explode(_distinct_words(F.col("hay"))).alias("key")), by)
    short = parts.where(F.size("parts") < 3).withColumn("length", F.least(F.char_length("needle"), F.lit(GRAM)))
    for length in [r[0] for r in short.select("length").distinct().collect()]:  # GRAM at most
        asks = short.where(F.col("length") == length).select(*by, "needle_id", F.explode(_pieces(F.col("needle"), length)).alias("key"))
        found = found.unionByName(_anchored(asks, haystacks.select(*by, "hay_id", F.explode(_pieces(F.col("hay"), length)).alias("key")), by))
    return found.distinct().join(needles, [*by, "needle_id"]).join(haystacks, [*by, "hay_id"]).where(F.contains("hay", "needle")).select(*by, "needle_id", "hay_id").distinct()


def alike(left: DataFrame, right: DataFrame, threshold: float = 0.9, by: Sequence[str] = ()) -> DataFrame:
    """left_id and right_id of all pairs, within equal ``by``, whose token sets have a Jaccard similarity of ``threshold`` or more.

    ``left``: left_id, text; ``right``: right_id, text. Texts without tokens are like none.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is 1 at most")
    sides = {name: df.select(*by, f"{name}_id", F.array_distinct(tokenise(F.col("text"))).alias(f"{name}_tokens")) for name, df in (("left", left), ("right", right))}
    each = {name: df.select(*by, f"{name}_id", F.size(f"{name}_tokens").alias(f"{name}_size"), F.explode(f"{name}_tokens").alias("token")) for name, df in sides.items()}
    counts = each["left"].select("token").unionByName(each["right"].select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def prefix(name: str) -> DataFrame:
        size = F.col(f"{name}_size")
        order = Window.partitionBy(*by, f"{name}_id").orderBy("df", "token")
        first = each[name].join(counts, "token").withColumn("nth", F.row_number().over(order))
        return first.where(F.col("nth") <= size - F.ceil(threshold * size - 1e-9) + 1).select(*by, "token", f"{name}_id", f"{name}_size")

    a, b = F.col("left_size"), F.col("right_size")
    met = prefix("left").join(prefix("right"), [*by, "token"]).where(F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9)
    pairs = met.select(*by, "left_id", "right_id").distinct()
    whole = pairs.join(sides["left"], [*by, "left_id"]).join(sides["right"], [*by, "right_id"])
    return whole.where(jaccard(F.col("left_tokens"), F.col("right_tokens")) >= threshold).select(*by, "left_id", "right_id").distinct()


def overlapping(left: DataFrame, right: DataFrame, threshold: float = 0.9, by: Sequence[str] = ()) -> DataFrame:
    """left_id and right_id of all pairs, within equal ``by``, for which ``functions.text.overlaps`` holds: equal but for case and outer space, one within the other, or alike."""
    plain = F.lower(strip(F.col("text")))
    x, y = left.withColumn("text", plain), right.withColumn("text", plain)
    equal = x.select(*by, "left_id", "text").join(y.select(*by, "right_id", "text"), [*by, "text"]).select(*by, "left_id", "right_id")

    def within(small: DataFrame, a: str, large: DataFrame, b: str) -> DataFrame:
        found = contained(small.withColumnRenamed(a, "needle_id"), large.withColumnRenamed(b, "hay_id"), by)
        return found.withColumnsRenamed({"needle_id": a, "hay_id": b})

    every = equal.unionByName(within(x, "left_id", y, "right_id")).unionByName(within(y, "right_id", x, "left_id")).unionByName(alike(left, right, threshold, by))
    return every.distinct()
