import random

import pytest
from pyspark.sql import functions as F

from trawl.functions.text import overlaps
from trawl.operators import mining, similar


def texts(n, seed):
    draw = random.Random(seed)
    words = ["ab", "abc", "b", "ca", "é", "Xy", "\U0001f600", "long", "longer", "word"]
    made = [draw.choice(["", " ", "\t"]) + draw.choice([" ", "  ", "\n"]).join(draw.choice(words) for _ in range(draw.choice((0, 1, 2, 3, 5, 9, 14)))) + draw.choice(["", " "]) for _ in range(n)]
    return made + [made[0], "", " ", None, "A", "bc a", "c"]


def frame(spark, rows, name):
    return spark.createDataFrame([(k % 3, k, t) for k, t in enumerate(rows)], f"g int, {name} int, text string")


def pairs(df, *names):
    rows = [tuple(r) for r in df.select(*names).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def held(plan):
    return not any(word in plan._jdf.queryExecution().executedPlan().toString() for word in ("NestedLoop", "Cartesian", "Python"))


@pytest.mark.parametrize("by", [[], ["g"]], ids=["all", "by"])
def test_contained(spark, by):
    needles, hay = texts(80, 1), texts(60, 2)
    got = similar.contained(frame(spark, needles, "needle_id"), frame(spark, hay, "hay_id"), by)
    expected = {(i, j) for i, a in enumerate(needles) for j, b in enumerate(hay) if a and b is not None and a in b and (not by or i % 3 == j % 3)}
    assert pairs(got, "needle_id", "hay_id") == expected and len(expected) > 50 and held(got)


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_alike(spark, threshold):
    left, right = texts(90, 3), texts(90, 4)
    got = similar.alike(frame(spark, left, "left_id"), frame(spark, right, "right_id"), threshold)
    sets = lambda rows: [set((t or "").lower().split()) for t in rows]
    expected = {(i, j) for i, a in enumerate(sets(left)) for j, b in enumerate(sets(right)) if a and b and len(a & b) / len(a | b) >= threshold}
    assert pairs(got, "left_id", "right_id") == expected and len(expected) > 10 and held(got)
    with pytest.raises(ValueError):
        similar.alike(frame(spark, left, "left_id"), frame(spark, right, "right_id"), 0.0)


@pytest.mark.parametrize("by", [[], ["g"]], ids=["all", "by"])
def test_overlapping_equals_the_function(spark, by):
    left, right = frame(spark, texts(70, 5), "left_id"), frame(spark, texts(70, 6), "right_id")
    got = similar.overlapping(left, right, 0.6, by)
    met = left.alias("l").join(right.alias("r"), F.expr("l.g = r.g") if by else F.lit(True)).where(overlaps(F.col("l.text"), F.col("r.text"), 0.6))
    assert pairs(got, "left_id", "right_id") == pairs(met, "left_id", "right_id") and held(got)


def test_hard_negatives_leave_overlaps_out(spark):
    draw = random.Random(8)
    held_texts = texts(120, 7)
    candidates = [(f"q{k % 9}", f"p{k}", t) for k, t in enumerate(held_texts)]
    positives = [(f"q{k}", f"p{draw.randrange(120)}", held_texts[draw.randrange(120)]) for k in list(range(9)) * 2]
    c, p = (spark.createDataFrame(rows, "query_id string, passage_id string, text string") for rows in (candidates, positives))
    same = (F.col("c.passage_id") == F.col("p.passage_id")) | overlaps(F.col("c.text"), F.col("p.text"), 0.9)
    bad = {(r[0], r[1]) for r in c.alias("c").join(p.alias("p"), "query_id").where(same).select("query_id", "c.passage_id").collect()}
    good = {}
    for q, i, _ in candidates:
        if (q, i) not in bad:
            good.setdefault(q, set()).add(i)
    got = mining.hard_negatives(c, p)
    assert held(got)
    found = {r.query_id: (r.negative_id, r.n_candidates) for r in got.collect()}
    assert {q: n for q, (_, n) in found.items()} == {q: len(ids) for q, ids in good.items()}
    assert all(i in good[q] for q, (i, _) in found.items())
