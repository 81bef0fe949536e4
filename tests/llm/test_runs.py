import hashlib
import random
import zlib

import numpy as np
import pytest

from trawl.llm import runs as R
from trawl.llm.queries import QUERIES


def brute(words, shortest=12):
    """Every run, from its definition: for each period, the maximal stretches; the smallest period of each."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        start = None
        for i in range(n - q + 1):
            same = i < n - q and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                length = i - start + q
                if length >= max(shortest, 2 * q):
                    found.setdefault((start, length), q)
                start = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def tailed(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    words = words if doc_id is None else tailed(words, doc_id)
    found = brute(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    start, length, period = best[0] if best else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), start, length, period, best and 1000 * length // period or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


@pytest.mark.parametrize("shortest", [2, 3, 7, 12])
def test_all_short_words(shortest):
    """Random words of few letters, which have runs in runs, runs that touch and runs at both ends."""
    draw = random.Random(shortest)
    for _ in range(1500):
        words = [draw.randrange(draw.choice((1, 2, 3, 5))) for _ in range(draw.randrange(60))]
        assert R.runs_of(np.array(words, np.int64), shortest) == brute(words, shortest), words


@pytest.mark.parametrize("words", [fibonacci(400), thue_morse(600), [0] * 300, [0] * 150 + [1] + [0] * 150, ([0] * 7 + [1]) * 40, (fibonacci(90) + [9]) * 4, list(range(100)) * 3], ids=range(7))
def test_hard_words(words):
    assert R.runs_of(np.array(words, np.int64)) == brute(words)


def test_verified_word_by_word(monkeypatch):
    """With a hash that calls all alike, results are the same."""
    monkeypatch.setattr(R.Periods, "_alike", lambda self, i, j, length: True)
    draw = random.Random(1)
    for _ in range(300):
        words = [draw.randrange(3) for _ in range(50)]
        assert R.runs_of(np.array(words, np.int64), 4) == brute(words, 4)


def test_very_long_texts():
    """A million words of one period, of Fibonacci words and of different words take seconds."""
    one = R.runs_of(np.arange(1_000_000) % 7)
    assert one == [(0, 1_000_000, 7)]
    assert R.runs_of(np.arange(1_000_000)) == []
    ids = np.array(fibonacci(60_000), np.int64)
    assert all((ids[s : s + n - q] == ids[s + q : s + n]).all() and n >= max(12, 2 * q) for s, n, q in R.runs_of(ids))


ROWS = [(i, " ".join(random.Random(i).choice(["a", "b", "cc", "é", "x.", "\n"]) for _ in range(random.Random(-i).randrange(90)))) for i in range(300)]
ODD = [(None, None), (None, "a " * 30), (1, ""), (2, " \t\n\x0b\x0c\r"), (3, None), (4, "  " * 20), (5, "b a" * 40), (5, "b a" * 40), (28, "z " * 12), (7, "z " * 11), (10, "x y " * 13)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t, 1, "TEXT") for i, t in ROWS + ODD]
    spark.createDataFrame(rows, "doc_id long, text string, start int, n_runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(i, t) for i, t in ROWS + ODD), key=str)


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r) for r in QUERIES["op13_runs"](spark, sf).collect()}
    short = [d for d in docs if len((d[1] or "").split()) < 700]
    assert len(got) == len(docs) and len(short) > 100
    assert [got[d[0]] for d in short] == [expected(*d) for d in short]


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "no no no no no no no no no no no no yes", "x"), (2, None, "x"), (3, "a b  c", "x")], "doc_id long, TEXT string, text2 string").withColumnRenamed("text2", "doc_ID2")
    assert [tuple(r) for r in R.find_runs(docs).collect()] == [(1, 0, 12, 1)]
    assert {r.doc_id: r.text for r in R.collapse(docs).collect()} == {1: "no yes", 2: "", 3: "a b c"}


def test_columns_that_differ_in_case(spark):
    clash = spark.createDataFrame([(1, "q " * 12, "different")], "doc_id long, text string, third string").toDF("doc_id", "text", "TEXT")
    assert [tuple(r) for r in R.find_runs(clash).collect()] == [(1, 0, 12, 1)]


def test_empty_table(spark):
    assert R.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
