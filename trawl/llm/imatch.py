"""I-Match fingerprints over randomised subsets of a lexicon, in DataFrame functions alone.

Terms are lower-cased runs of letters, marks and digits. The lexicon holds those
whose share of the documents lies in a band: common terms say little of a text,
rare ones are often slips. Terms in the band's sparse end occur in at least a
thousandth of the documents, so the lexicon has at most a thousand times as many
terms as a document has distinct ones on average, whatever the number of
documents, and tasks can hold it.

A text's distinct terms of the lexicon are sorted and hashed, whole and within
randomised subsets of the lexicon: a term's hash draws one of SUBSETS subsets and
the levels, each half as dense as the one before, that it belongs to. A
fingerprint has the subsets of two levels, the first that leaves at most a term
a subset. So equal texts have equal fingerprints, and of two texts that share a
part of their terms, about that part of the subsets hash alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, picked

#: Shares of the documents between which a term's lie.
RAREST, COMMONEST = 1 / 1000, 1 / 10
#: Subsets in each level, as bits of a term's hash.
SUBSET_BITS = 6
#: Lists among which the lexicon is dealt by hash.
SLOTS = 1 << 14
#: Ranges of ids for each shuffle partition.
RANGES = 4

#: What separates terms.
BETWEEN = r"[^\p{L}\p{M}\p{N}]+"
_LEAST = -(1 << 63)


def terms(text: Column) -> Column:
    """XXH64 (seed 42) of each distinct term of a text, as signed longs; none for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """term of every term of ``docs`` (doc_id, text) whose share of the rows is at least ``rarest`` and at most ``commonest``."""
    texts = picked(docs, text="string")
    rows = texts.count()
    counted = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.where(F.col("df").between(math.ceil(rarest * rows), math.floor(commonest * rows))).select("term")


def slotted(words: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row with a lexicon (term), dealt by hash to an array of ``slots`` arrays."""
    dealt = words.groupBy(F.pmod("term", F.lit(slots)).alias("slot")).agg(F.collect_list("term").alias("terms"))
    every = dealt.sparkSession.range(slots).join(dealt, F.col("id") == F.col("slot"), "left").select("id", F.coalesce("terms", F.array().cast("array<long>")).alias("terms"))
    return every.agg(F.sort_array(F.collect_list(F.struct("id", "terms"))).alias("all")).select(F.col("all.terms").alias("slots"))


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.hex(number), digits, "0")


def _tokens(chosen: Column, level: Column) -> Column:
    """Level, subset and signature of each subset of a level that has any of the ``chosen``, sorted terms."""
    subset = lambda x: F.shiftrightunsigned(x, 64 - SUBSET_BITS)

    def listed(held: Column) -> Column:
        piece = lambda x, i: F.concat(F.when((i > 0) & (subset(x) == subset(F.get(held, i - 1))), ",").otherwise(F.concat(F.lit(";"), _hex(subset(x), 2), F.lit(":"))), F.hex(x))
        return F.filter(F.split(F.array_join(F.transform(held, piece), ""), ";"), lambda group: group != "")

    held = F.filter(chosen, lambda x: x.bitwiseAND(F.pow(F.lit(2.0), level).cast("long") - 1) == 0)
    return F.transform(let(held, listed), lambda group: F.concat(_hex(level, 2), F.left(group, F.lit(2)), F.right(_hex(F.xxhash64(group), 16), F.lit(4))))


def fingerprint(text: Column, slots: Column) -> Column:
    """Fingerprint of a text: the signature of all its terms in the lexicon, and tokens of the subsets of two levels.

    ``slots``: a lexicon as ``slotted`` deals it. A text without terms in the
    lexicon has those of all its terms.
    """

    def made(sorted_terms: Column) -> Column:
        over = F.shiftright(F.size(sorted_terms) - 1, SUBSET_BITS)
        first = F.when(F.size(sorted_terms) <= 1 << SUBSET_BITS, F.lit(0)).otherwise(F.length(F.bin(over)))
        tokens = let(first, lambda level: F.concat(_tokens(sorted_terms, level), _tokens(sorted_terms, level + 1)))
        return F.concat_ws(" ", _hex(F.xxhash64(sorted_terms), 16), tokens)

    def choose(held: Column) -> Column:
        all_terms, lists = held["terms"], held["slots"]
        known = F.filter(all_terms, lambda t: F.array_contains(F.get(lists, F.pmod(t, F.size(lists)).cast("int")), t))
        return let(known, lambda k: let(F.sort_array(F.when(F.size(k) > 0, k).otherwise(all_terms)), made))

    return let(F.struct(terms(text).alias("terms"), slots.alias("slots")), choose)


def with_fingerprint(df: DataFrame, name: str, text: Column, slots: DataFrame) -> DataFrame:
    """``df`` with the ``fingerprint`` of ``text`` as column ``name``.

    The lexicon is a scalar subquery, which can't stand within a lambda; as a
    column that is named once, the optimiser puts it in the place of its name,
    so a task holds one lexicon and no row does.
    """
    return df.withColumn("slots of the lexicon", slots.scalar()).withColumn(name, fingerprint(text, F.col("slots of the lexicon"))).drop("slots of the lexicon")


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets that hash alike among those that either fingerprint has terms of, in the levels of both; 1 if they are equal."""

    def of(both: Column) -> Column:
        left, right = F.slice(both["a"], 2, 1 << 20), F.slice(both["b"], 2, 1 << 20)
        levels = lambda tokens: F.array_distinct(F.transform(tokens, lambda t: F.left(t, F.lit(2))))
        shared = F.array_intersect(levels(left), levels(right))
        places = lambda tokens, held: F.transform(F.filter(tokens, lambda t: F.array_contains(held, F.left(t, F.lit(2)))), lambda t: F.left(t, F.lit(4)))
        either = let(shared, lambda held: F.size(F.array_union(places(left, held), places(right, held))))
        return F.when(either > 0, F.size(F.array_intersect(left, right)) / either).otherwise(0.0)

    return F.when(a == b, 1.0).otherwise(let(F.struct(F.split(a, " ").alias("a"), F.split(b, " ").alias("b")), of))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in ranges of ids, a ``range`` each, which also have the first row of the next range as a ``guest``.

    The last range has the table's first row. Rows are dealt once; what the
    driver holds is one id for each range.
    """
    spark = docs.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce("doc_id", F.lit(_LEAST))  # nulls come first
    ids = docs.select(place.alias("place"))
    cuts = ids.agg(F.percentile_approx("place", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("cuts")).first()["cuts"] if ranges > 1 else []
    cuts = sorted({int(c) for c in cuts or []})
    width = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[k : k + width] for k in range(0, len(cuts), width)] or [[]]
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values]).cast("array<long>")
    tops, lists = longs([block[0] for block in blocks if block]), F.array(*[longs(block) for block in blocks])

    def number(at: Column) -> Column:
        block = F.greatest(F.size(F.filter(tops, lambda c: c <= at)) - 1, F.lit(0))
        return let(block, lambda b: b * width + F.size(F.filter(F.get(lists, b), lambda c: c <= at)))

    firsts = {r["range"]: r["first"] for r in ids.groupBy(number(F.col("place")).alias("range")).agg(F.min("place").alias("first")).collect()}
    known = sorted(firsts)
    before = {r: known[k - 1] for k, r in enumerate(known)}
    placed = docs.withColumn("place", place).withColumn("own", number(F.col("place")))
    top = known[-1] + 1 if known else 0
    first = F.get(longs([firsts.get(r) for r in range(top)]), F.col("own"))
    earlier = F.get(longs([before.get(r) for r in range(top)]), F.col("own")).cast("int")
    both = F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("guest")), F.struct(earlier.alias("range"), F.lit(True).alias("guest")))
    alone = F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("guest")))
    return placed.select("doc_id", "text", "place", F.inline(F.when(F.col("place") == first, both).otherwise(alone)))


def edited_likeness(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text, and their likenesses.

    The edited text has, for the last half of its code points, as many first
    ones of the next document, in the order of ids; after the last comes the
    first. doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (to the next document). Null texts are empty,
    null ids come first, rows of one id are ordered by text, repeated rows stay;
    very long texts are read whole, other columns are ignored, an empty table
    gives no rows. A sole row is its own next.
    """
    own = picked(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    slots = cut(slotted(lexicon(own, rarest, commonest)))
    dealt = with_fingerprint(with_next(own).repartition("range"), "fingerprint", F.col("text"), slots)
    order = Window.partitionBy("range").orderBy("guest", "place", "doc_id", "text")
    met = dealt.withColumn("next", F.lead("text").over(order)).withColumn("next_print", F.lead("fingerprint").over(order)).where(~F.col("guest"))
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.left("text", size - half), F.left("next", half))
    made = met.select("doc_id", size.cast("long").alias("n_chars"), "fingerprint", "next_print", edited.alias("edited"))
    made = made.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))  # before: the text's other use would keep the lexicon a column
    made = with_fingerprint(made, "edited_fingerprint", F.col("edited"), slots)
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_print").alias("near_next"))
