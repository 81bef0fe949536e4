import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from trawl.functions import analysis, scores, text


def each(spark, rows, *columns):
    """Evaluate column expressions of ``t`` over texts."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def one(spark, value, column):
    return each(spark, [value], column)[0][0]


@pytest.fixture(autouse=True)
def column(spark):
    """The column of texts; columns need a running session."""
    global T
    T = F.col("t")


def test_tokens_split_on_all_white_space(spark):
    odd = "A b\tC d e　f g\x0bh\x1ci\x85j​k﻿l᠎m"
    assert one(spark, odd, text.tokenise(T)) == odd.lower().split()
    assert each(spark, [None, "", "  "], text.tokenise(T)) == [([],)] * 3


def test_cleaning(spark):
    assert one(spark, "<p>Hello <b>World</b></p>", text.clean(T)) == "Hello World"
    assert one(spark, "see https://x.org/a?b www.y.com FTP://z now", text.clean(T, remove_urls=True)) == "see now"
    assert one(spark, "“a” ‘b’ – — …", text.clean(T)) == "\"a\" 'b' - - ..."
    assert one(spark, "é A\x00B\x7fC\x9fD", text.clean(T)) == "é ABCD"
    assert one(spark, "  MiXed \n\n Case ", text.clean(T, lowercase=True)) == "mixed case"
    assert one(spark, None, text.clean(T)) == ""
    assert one(spark, "<script>var a</script>&amp;", text.clean(T)) == "var a &amp;"


def test_truncation(spark):
    assert one(spark, "abcdefghij", text.truncate(T, 5)) == "abcd…"
    assert one(spark, "abc", text.truncate(T, 5)) == "abc"
    assert one(spark, "a b c d e", text.truncate(T, 3, unit="words")) == "a b …"
    assert one(spark, "a  b", text.truncate(T, 3, unit="words")) == "a  b"
    assert one(spark, "Hi, you there!", text.truncate(T, 4, unit="tokens")) == "Hi, you…"
    for bad in (dict(max_length=0), dict(max_length=1, marker="...")):
        with pytest.raises(ValueError):
            text.truncate(T, **bad)
    with pytest.raises(ValueError):
        text.truncate(T, 5, unit="lines")


def test_chunks(spark):
    assert one(spark, "a b c d e", text.chunk(T, 2)) == ["a b", "c d", "e"]
    assert one(spark, "a b c d e", text.chunk(T, 3, 1)) == ["a b c", "c d e", "e"]
    assert one(spark, "a b c d e", text.chunk(T, 3, 1, drop_contained_tail=True)) == ["a b c", "c d e"]
    assert one(spark, "a b c", text.chunk(T, 2, min_size=2)) == ["a b"]
    assert one(spark, "abcde", text.chunk(T, 2, unit="chars")) == ["ab", "cd", "e"]
    assert one(spark, 'One. "Two" three! Four? five', text.chunk(T, 1, unit="sentences")) == ["One.", '"Two" three!', "Four? five"]
    assert each(spark, ["", None], text.chunk(T, 2)) == [([],), ([],)]
    with pytest.raises(ValueError):
        text.chunk(T, 2, 2)


def test_random_chunks_agree_with_slicing(spark):
    rng = random.Random(1)
    for _ in range(4):
        size = rng.randint(1, 6)
        overlap = rng.randint(0, size - 1)
        rows = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 20))) for _ in range(10)]
        expected = [[" ".join(w[i : i + size]) for i in range(0, len(w), size - overlap)] for w in map(str.split, rows)]
        assert [r[0] for r in each(spark, rows, text.chunk(T, size, overlap))] == expected


def test_counts_and_overlap(spark):
    assert each(spark, ["a bc  d"], text.word_count(T), text.char_count(T), text.char_count(T, spaces=False)) == [(3, 7, 4)]
    pairs = [("Same", " same ", True), ("the cat sat", "cat", True), ("", "x", False), ("a b c d e f g h i j", "a b c d e f g h i k", False), ("x y", "y x", True)]
    df = spark.createDataFrame(pairs, "a string, b string, e boolean")
    assert all(r.o == r.e for r in df.select(text.overlaps(F.col("a"), F.col("b")).alias("o"), "e").collect())


def test_analysis(spark):
    assert one(spark, "The cats' owner's running quickly", analysis.english(T)) == ["cat", "owner", "run", "quickli"]
    assert one(spark, "The cats of it", analysis.english(T, stem=False)) == ["cats"]
    # Pairs given in Porter's paper.
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}
    assert {w: analysis.porter(w) for w in known} == known
    assert one(spark, "p1", analysis.uuid5("t")) == str(uuid.uuid5(uuid.NAMESPACE_URL, "p1"))


def test_small_functions(spark):
    assert one(spark, "postgres://me:secret@host/db", text.redact_url(T)) == "postgres://me:***@host/db"
    assert one(spark, "x", F.array(*[scores.backoff(F.lit(n)) for n in (1, 2, 4, 20)])) == [0.1, 0.2, 0.8, 30.0]
    got = one(spark, "x", F.array(scores.relevance(F.array(F.lit(0.0))), scores.relevance(F.array(F.lit(1.0), F.lit(1.0))), scores.relevance(F.array(F.lit(0.0), F.lit(-1.0), F.lit(0.0)))))
    assert got == [0.5, 0.5, 0.5]
    assert one(spark, "x", F.array(scores.normalise(F.lit(3.0), F.lit(3.0), F.lit(3.0)), scores.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0)))) == [0.0, 1.0]
    assert one(spark, "x", F.array(scores.finite(F.lit(float("nan"))), scores.finite(F.lit(float("inf"))), scores.finite(F.lit(1.0)))) == [False, False, True]
    assert re.fullmatch("[0-9a-f]{64}", one(spark, "q", scores.cache_key(T, F.lit("m"))))
