"""English analysis: standard words, possessives, case, stop words and Porter's stemmer; and name-based ids."""

from __future__ import annotations

import uuid
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The usual English stop words of search engines.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()

# Suffix rules of Porter's algorithm (1980), steps 2 to 4.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                stem = word[: -len(end)]
                if "v" in _shape(stem):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short_end(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        end = max((e for e in rules if word.endswith(e)), key=len, default=None)
        if end and _measure(word[: -len(end)]):
            word = word[: -len(end)] + rules[end]
    end = max((e for e in STEP_4 if word.endswith(e)), key=len, default=None)
    if end:
        stem = word[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(ArrayType(StringType()))
def _stem(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [porter(w) for w in ws])


def english(text: Column, *, possessives: bool = True, stem: bool = True) -> Column:
    """Terms of an English text; ``stem`` off keeps it in the JVM."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*"), F.lit(0))
    if possessives:
        found = F.transform(found, lambda w: F.regexp_replace(w, "['’]s$", ""))
    found = F.filter(found, lambda w: ~w.isin(STOP_WORDS) & (w != ""))
    return _stem(found) if stem else found


@F.pandas_udf(StringType())
def uuid5(names: pd.Series) -> pd.Series:
    """Name-based id of a passage in the url namespace."""
    return names.map(lambda n: None if n is None else str(uuid.uuid5(uuid.NAMESPACE_URL, n)))
