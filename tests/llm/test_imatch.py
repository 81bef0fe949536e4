import hashlib
import math
import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from trawl.llm import imatch as I
from trawl.llm.queries import QUERIES


def terms(text):
    return {xxh64_intdigest(w.encode(), 42) for w in regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())}


def lexicon(texts, rarest=I.RAREST, commonest=I.COMMONEST):
    df = Counter(t for text in texts for t in terms(text))
    return {t for t, n in df.items() if rarest * len(texts) <= n <= commonest * len(texts)}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text, lex):
    """Signature of all terms, then (level, subset, signature) by the definition."""
    own = sorted(terms(text) & lex or terms(text), key=signed)
    whole = 42
    for x in own:
        whole = xxh64_intdigest(x.to_bytes(8, "little"), whole)
    level = 0
    while len(own) > 64 << level:
        level += 1
    found = [f"{whole:016X}"]
    for at in (level, level + 1):
        groups = {}
        for x in own:
            if x % (1 << at) == 0:
                groups.setdefault(x >> 58, []).append(x)
        for subset, held in groups.items():
            name = f"{subset:02X}:" + ",".join(f"{x:X}" for x in held)
            found.append(f"{at:02X}{subset:02X}{xxh64_intdigest(name.encode(), 42) & 0xFFFF:04X}")
    return " ".join(found)


def likeness(a, b):
    if a == b:
        return 1.0
    a, b = a.split()[1:], b.split()[1:]
    levels = {t[:2] for t in a} & {t[:2] for t in b}
    either = {t[:4] for t in a + b if t[:2] in levels}
    return len(set(a) & set(b)) / len(either) if either else 0.0


def brute(rows):
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    lex = lexicon([t for _, t in rows])
    prints = [fingerprint(t, lex) for _, t in rows]
    out = []
    for k, (i, text) in enumerate(rows):
        after = (k + 1) % len(rows)
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[after][1][:half]
        other = fingerprint(edited, lex)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[k], other, likeness(prints[k], other), likeness(prints[k], prints[after])))
    return out


ODD = [(None, None), (None, "only here"), (-(1 << 63), "lowest é id"), (7, ""), (7, ""), (8, "!?. \n"), (9, "\U0001f600 áb Straße ÀÉ"), (10, "x"), (11, "x y z " * 400), (3, "one two three four five six"), (3, "one two three four five six"), (12, "a\tb c d")]
WORDS = [f"w{i}" for i in range(3000)]


def wordy(k):
    draw = random.Random(k)
    return " ".join(WORDS[int(draw.random() ** 3 * 3000)] for _ in range(draw.choice((3, 30, 300, 2000))))


ROWS = ODD + [(20 + 3 * k, wordy(k)) for k in range(150)] + [(600 + k, wordy(5) + " more") for k in range(30)]


def same(got, expected):
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_query_equals_brute_force(spark, tmp_path, partitions):
    rows = [(i, t, 1, "x") for i, t in ROWS]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, place int, range string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        same(QUERIES["op11_imatch"](spark, str(tmp_path)), brute(ROWS))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_imatch"](spark, sf)
    same(got, brute(rows))
    found = got.toPandas()
    assert (found.near_edited > found.near_next).mean() > 0.95


@pytest.mark.parametrize("rows", [[], [(1, "alone and short")], [(1, "a b c"), (1, "a b c")], [(None, None)]], ids=range(4))
def test_small_tables(spark, rows):
    same(I.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")), brute(rows) if rows else [])


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for rarest, commonest in ((0.01, 0.1), (0.0, 1.0), (0.2, 0.3)):
        got = {r.term % (1 << 64) for r in I.lexicon(docs, rarest, commonest).collect()}
        assert got == lexicon([t for _, t in ROWS], rarest, commonest)
        assert len(got) * rarest <= sum(len(terms(t)) for _, t in ROWS) / len(ROWS) + 1


def test_edits_lower_likeness(spark):
    """Likeness follows the share of terms that two texts have in common."""
    draw = random.Random(3)
    base = [draw.sample(WORDS, 400) for _ in range(60)]
    rows = [(k, " ".join(b), " ".join(b[: int(400 * share)] + draw.sample(WORDS, 400 - int(400 * share)))) for share in (1.0, 0.9, 0.5, 0.0) for k, b in enumerate(base)]
    docs = spark.createDataFrame([(s, *r) for s, r in zip([x for x in (1.0, 0.9, 0.5, 0.0) for _ in base], rows)], "share double, doc_id long, text string, other string")
    slots = I.cut(I.slotted(I.lexicon(docs, 0.0, 1.0)))
    made = I.with_fingerprint(I.with_fingerprint(docs, "a", F.col("text"), slots), "b", F.col("other"), slots)
    mean = dict(map(tuple, made.groupBy("share").agg(F.avg(I.likeness(F.col("a"), F.col("b")))).collect()))
    assert mean[1.0] == 1.0 and 0.6 < mean[0.9] < 0.95 and 0.15 < mean[0.5] < 0.45 and mean[0.0] < 0.15


def test_native_plan_holds_one_lexicon(spark, sf):
    plan = I.edited_likeness(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
    # No row carries the lexicon: it is named only where a subquery stands within an expression.
    assert "AS slots of the lexicon" not in plan


def test_ranges_hold_every_row_once(spark):
    rows = [(k * k - 50, str(k)) for k in range(300)]
    met = I.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in met if not r.guest) == sorted(rows)
    assert len({r.range for r in met}) > 4
    assert sum(r.guest for r in met) == len({r.range for r in met})
