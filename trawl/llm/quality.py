"""Quality rules with host-level verdicts, in DataFrame functions alone.

Each document is measured within its row. Rule failures are added up by host
(the ``source`` column); a host's failure rate of each rule is shrunk towards
the rate of all hosts by a beta prior fitted to the hosts themselves, so a host
of a few documents is not condemned by them. A host is rejected, with all its
documents, if it is all but certain (``SURE`` standard deviations of its
posterior) that its rate of some rule exceeds both ``TIMES`` the rate of all
hosts and ``host_rate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, let, small

#: Least words of a document.
MIN_WORDS = 10
#: Most words, in percent, that lie in repeated windows.
MAX_REPEATED = 20
#: Words in a window.
WINDOW = 5
#: Symbols, in percent of the characters in words, from which a document fails the symbol rule.
MAX_SYMBOLS = 15
#: Repeated lines, in percent of the lines with a word, from which a document fails the line rule.
MAX_DUP_LINES = 50
#: Failure rate that a rejected host exceeds.
HOST_RATE = 0.25
#: Times the rate of all hosts that a rejected host's rate exceeds.
TIMES = 2.0
#: Standard deviations of the posterior by which it does (one sided: 0.999).
SURE = 3.09
#: Documents that a prior counts for at most.
MOST_STRENGTH = 100.0

#: Rules, in the order of the host table's columns.
RULES = ("short", "repeats", "symbols", "lines")


def _repeat_words(words: Column) -> Column:
    """Words that lie in windows found twice or more in the text.

    Windows are compared by 64-bit hashes. Those that occur twice or more are
    found by sorting; the words they cover are counted from the sorted
    positions, so the work grows as n log n with the text.
    """

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(WINDOW)]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(at, k - 1))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def positions(ordered: Column) -> Column:
        same = F.filter(ordered, lambda e, k: (F.get(ordered, k - 1)["h"] == e["h"]) | (F.get(ordered, k + 1)["h"] == e["h"]))
        return F.sort_array(F.transform(same, lambda e: e["i"]))

    def counted(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(ordered, positions), covered))

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(let(hashes(words), counted)).cast("long")


def measure(docs: DataFrame, name: str = "m") -> DataFrame:
    """``docs`` (text) with a column ``name`` of measures: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))

    def of_lines(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"))

    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
    return docs.withColumn(name, F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), symbols.alias("n_symbols")))


def _flat() -> list[Column]:
    m = F.col("m")
    return [m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["l"]["n_lines"].alias("n_lines"), m["l"]["n_dup_lines"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words")]


def failures() -> dict[str, Column]:
    """Each rule's failure as a condition on the measures."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"),
        "symbols": (F.col("n_symbols") > 0) & (100 * F.col("n_symbols") >= MAX_SYMBOLS * F.col("word_chars")),
        "lines": (F.col("n_dup_lines") > 0) & (100 * F.col("n_dup_lines") >= MAX_DUP_LINES * F.col("n_lines")),
    }


def base_failed() -> Column:
    rules = failures()
    return rules["short"] | rules["repeats"]


def host_verdicts(measured: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """source, n_docs, each rule's shrunk failure rate and least sure rate, and host_rejected of every host.

    The prior of a rule is a beta distribution with the mean and the spread of
    the hosts' rates (by moments, what sampling alone would spread taken off).
    A host's posterior is the beta distribution with its own failures added;
    the least sure rate lies SURE of its standard deviations below its mean.
    """
    rules = failures()
    hosts = measured.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(rules[r].cast("long")).alias(f"f_{r}") for r in RULES])
    hosts = cut(hosts)
    totals = [F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("docs")]
    for r in RULES:
        rate = F.col(f"f_{r}") / F.col("n_docs")
        totals += [F.sum(f"f_{r}").alias(f"sum_{r}"), F.var_pop(rate).alias(f"var_{r}")]
    totals.append(F.avg(1 / F.col("n_docs")).alias("inverse"))
    prior = hosts.agg(*totals).first()
    shrunk, sure, bad = [], [], F.lit(False)
    for r in RULES:
        docs = prior["docs"] or 0
        mean = (prior[f"sum_{r}"] or 0) / docs if docs else 0.0
        spread = mean * (1 - mean)
        # Spread between hosts beyond that of sampling; strength is the documents the prior counts for.
        between = max((prior[f"var_{r}"] or 0.0) - spread * (prior["inverse"] or 0.0), 0.0)
        strength = min(max(spread / between - 1, 1.0), MOST_STRENGTH) if between > 0 else MOST_STRENGTH
        rate = (F.col(f"f_{r}") + mean * strength) / (F.col("n_docs") + strength)
        least = rate - SURE * F.sqrt(rate * (1 - rate) / (F.col("n_docs") + strength + 1))
        shrunk.append(rate.alias(f"rate_{r}"))
        sure.append(least.alias(f"sure_{r}"))
        bad = bad | (F.col(f"sure_{r}") >= max(host_rate, min(TIMES * mean, (1 + mean) / 2)))
    return hosts.select("source", "n_docs", *shrunk, *sure).withColumn("host_rejected", bad)


def judge(docs: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """Measures and verdict of every row of ``docs`` (doc_id, text, source).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and then the host's verdict. Null and
    empty texts have no words and fail. Rows without a source form one host;
    repeated rows are judged, and count, as often as they occur. Very long
    texts are measured whole. Other columns are ignored; an empty table gives
    no rows.
    """
    measured = cut(measure(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")).select("doc_id", "source", *_flat()))
    hosts = small(cut(host_verdicts(measured, host_rate).select(F.col("source").alias("host"), "host_rejected")))
    joined = measured.join(hosts, F.col("source").eqNullSafe(F.col("host"))).withColumn("base_failed", base_failed())
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host_rejected")


def keep_good(docs: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Documents are measured twice, once for their hosts and once for themselves:
    that is less than shuffling their texts.
    """
    counted = measure(docs.select(F.col("source").cast("string").alias("source"), "text")).select("source", *_flat())
    bad = small(cut(host_verdicts(counted, host_rate).where("host_rejected").select(F.col("source").alias("host"))))
    name = "m"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    measured = measure(docs, name)
    words, repeats = F.col(name)["w"]["n_words"], F.col(name)["w"]["n_repeat_words"]
    good = measured.where((words >= MIN_WORDS) & (100 * repeats <= MAX_REPEATED * words)).drop(name)
    return good.join(bad, good["source"].cast("string").eqNullSafe(bad["host"]), "left_anti").select(*docs.columns)
