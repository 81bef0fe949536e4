"""Text functions as column expressions; a pandas UDF only where Spark has no counterpart."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's ``str.split`` sees it.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
#: Words and single marks.
TOKENS = r"(?U)\w+|[^\w\s]"

# Typographic characters and their plain counterparts, and the patterns of tags, urls, controls and sentence breaks.
TYPOGRAPHY = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}
TAGS = r"<[^>]+>"
URLS = r"(?iU)(?:https?://|www\.|ftp://)[^\s\x1c-\x1f]+"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
SENTENCE_BREAK = r'(?U)(?<=[.!?])[\s\x1c-\x1f]+(?=[A-Z"])'


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once; within a lambda an outer expression is computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """``text`` without white space at its ends, as Python's ``str.strip`` does."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def tokenise(text: Column) -> Column:
    """Lower-cased words between white space; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITESPACE), lambda w: w != "")


def words(text: Column) -> Column:
    """Words between white space as they stand."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITESPACE), lambda w: w != "")


def indexed_text(title: Column, text: Column) -> Column:
    """Title and text, or the text alone where the title is empty."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat_ws(" ", title, text)).otherwise(F.coalesce(text, F.lit("")))


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def compose(text: Column) -> Column:
    """Unicode normal form C; ASCII texts never leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), _compose(text)).otherwise(text)


def strip_tags(text: Column) -> Column:
    """Tags become spaces; what scripts hold, and entities, stay."""
    return F.regexp_replace(text, TAGS, " ")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URLS, " ")


def strip_controls(text: Column) -> Column:
    """Drop control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(text, CONTROLS, "")


def plain_typography(text: Column) -> Column:
    """Curly quotes, dashes and ellipses as ASCII."""
    for char, plain in TYPOGRAPHY.items():
        text = F.replace(text, F.lit(char), F.lit(plain))
    return text


def squeeze(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def clean(text: Column, *, remove_html=True, remove_urls=False, normalise_unicode=True, normalise_whitespace=True, strip_control=True, lowercase=False, nfc=True) -> Column:
    """The cleaning steps in their fixed order; a null text becomes empty. ``nfc`` off keeps it all in the JVM."""
    text = F.coalesce(text, F.lit(""))
    if remove_html:
        text = strip_tags(text)
    if remove_urls:
        text = strip_urls(text)
    if normalise_unicode:
        text = plain_typography(compose(text) if nfc else text)
    if strip_control:
        text = strip_controls(text)
    if normalise_whitespace:
        text = squeeze(text)
    return F.lower(text) if lowercase else text


def truncate(text: Column, max_length: int, *, marker: str = "…", unit: str = "chars") -> Column:
    """At most ``max_length`` chars, words or tokens, the marker counted; shorter texts are untouched."""
    if max_length <= 0 or max_length < len(marker):
        raise ValueError("max_length must be positive and at least as long as the marker")
    if unit == "chars":
        return F.when(F.char_length(text) > max_length, F.concat(F.substring(text, 1, max_length - len(marker)), F.lit(marker))).otherwise(text)
    if unit == "words":
        found = words(text)
        return F.when(F.size(found) > max_length, F.concat_ws(" ", F.slice(found, 1, max_length - 1), F.lit(marker))).otherwise(text)
    if unit == "tokens":
        found = F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))
        mark = F.lit(marker)
        joined = F.aggregate(F.slice(found, 1, max_length - 1), F.lit(""), lambda out, token: F.when(out == "", token).when(token.rlike(r"(?U)^\w"), F.concat(out, F.lit(" "), token)).otherwise(F.concat(out, token)))
        return F.when(F.size(found) > max_length, F.concat(joined, mark)).otherwise(text)
    raise ValueError(f"unknown unit {unit!r}")


def windows(items: Column, size: int, overlap: int = 0, *, drop_contained_tail: bool = False) -> Column:
    """Arrays of ``size`` items every ``size - overlap``; the last may be short.

    ``drop_contained_tail`` leaves out a last window that the one before it covers.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap less than size")
    step = size - overlap

    def cut(held: Column) -> Column:
        count = F.size(held)
        last = count - 1 if not drop_contained_tail else F.greatest(count - overlap - 1, F.lit(0))
        starts = F.when(count > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(held, i + 1, size))

    return let(items, cut)


def chunk(text: Column, size: int, overlap: int = 0, *, unit: str = "words", min_size: int = 1, drop_contained_tail: bool = False) -> Column:
    """Array of chunks of words, chars or sentences; those of fewer than ``min_size`` items are left out."""
    text = F.coalesce(text, F.lit(""))
    if unit == "words":
        items, glue = words(text), " "
    elif unit == "chars":
        items, glue = F.filter(F.split(text, ""), lambda c: c != ""), ""
    elif unit == "sentences":
        items, glue = sentences(text), " "
    else:
        raise ValueError(f"unknown unit {unit!r}")
    found = windows(items, size, overlap, drop_contained_tail=drop_contained_tail)
    return F.transform(F.filter(found, lambda w: F.size(w) >= min_size), lambda w: F.array_join(w, glue))


def sentences(text: Column) -> Column:
    """Pieces between a sentence's end and a capital or a quote."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK), strip), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def char_count(text: Column, *, spaces: bool = True) -> Column:
    return F.char_length(text if spaces else F.replace(text, F.lit(" "), F.lit("")))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; zero for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlaps(a: Column, b: Column, threshold: float = 0.9) -> Column:
    """Equal but for case and outer space, one within the other, or of token sets alike."""
    x, y = F.lower(strip(a)), F.lower(strip(b))
    within = (F.char_length(x) > 0) & (F.char_length(y) > 0) & (F.contains(x, y) | F.contains(y, x))
    return (x == y) | within | (jaccard(tokenise(a), tokenise(b)) >= threshold)


def redact_url(url: Column) -> Column:
    """A connection url without its password."""
    return F.regexp_replace(url, r"(://[^:/@\s]*):[^@/\s]*@", "$1:***@")


def preview(text: Column, n: int = 60) -> Column:
    return F.substring(text, 1, n)
