import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.operators import metrics, significance

RUN = "query_id string, passage_id string, rank int"
QRELS = "query_id string, passage_id string, grade int"


def brute(grades, all_grades, k):
    dcg = lambda g: sum(x / math.log2(i + 2) for i, x in enumerate(g))
    gain = lambda g: [2**x - 1 for x in g]
    div = lambda a, b: a / b if b else 0.0
    hits = [i for i, g in enumerate(grades) if g > 0]
    ap = sum((j + 1) / (i + 1) for j, i in enumerate(hits))
    n = sum(g > 0 for g in all_grades)
    top = grades[:k]
    return {
        "n_relevant": n, "rr": 1 / (hits[0] + 1) if hits else 0.0, "ap_retrieved": div(ap, len(hits)), "ap_total": div(ap, n), f"dcg_{k}": dcg(top),
        f"ndcg_{k}": min(1, div(dcg(top), dcg(sorted(grades, reverse=True)[:k]))), f"ndcg_exp_{k}": div(dcg(gain(top)), dcg(gain(sorted(top, reverse=True)))),
        f"ndcg_qrels_{k}": min(1, div(dcg(top), dcg(sorted(all_grades, reverse=True)[:k]))), f"mrr_{k}": 1 / (hits[0] + 1) if hits and hits[0] < k else 0.0,
        f"recall_{k}": div(sum(g > 0 for g in top), n), f"precision_{k}": sum(g > 0 for g in top) / k, f"precision_len_{k}": div(sum(g > 0 for g in top), min(k, len(grades))),
    }


def test_random_lists_agree_with_plain_python(spark):
    rng = random.Random(7)
    run, qrels, expected = [], [], {}
    for q in range(40):
        retrieved = [f"d{i}" for i in range(rng.randint(0, 12))]
        grade = {f"d{i}": rng.choice([0, 0, 1, 2, 3]) for i in range(15) if rng.random() < 0.7}
        grade["d14"] = 0
        run += [(f"q{q}", d, i + 1) for i, d in enumerate(retrieved)]
        qrels += [(f"q{q}", d, g) for d, g in grade.items()]
        expected[f"q{q}"] = {k: v for cut in (1, 3, 10) for k, v in brute([grade.get(d, 0) for d in retrieved], list(grade.values()), cut).items()}
    got = metrics.per_query(spark.createDataFrame(run, RUN), spark.createDataFrame(qrels, QRELS), (1, 3, 10)).collect()
    assert len(got) == 40
    for r in got:
        for name, value in expected[r.query_id].items():
            assert r[name] == pytest.approx(value, abs=1e-9), (r.query_id, name)
            assert name.startswith(("dcg", "n_")) or 0 <= r[name] <= 1 + 1e-9


def test_aggregate_counts_missing_queries(spark):
    qrels = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 0), ("q2", "c", 1), ("q2", "d", 1), ("q2", "e", 0)], QRELS)
    run = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3), ("q2", "d", 1), ("q2", "c", 2), ("q2", "e", 3)], RUN)
    assert metrics.aggregate(metrics.per_query(run, qrels)).first()["map"] == 1.0
    half = metrics.aggregate(metrics.per_query(run.where("query_id = 'q1'"), qrels)).first()
    assert half["n_queries"] == 2 and half["map"] == 0.5 and half["mrr_10"] == 0.5
    assert metrics.aggregate(metrics.per_query(run, qrels.limit(0))).collect() == []


def test_percentile_histogram_violations(spark):
    df = spark.createDataFrame([(float(v), "g") for v in range(1, 21)] + [(None, "g")], "v double, g string")
    assert metrics.index_percentile(df, "v", 0.95).first()["v"] == 20.0
    assert metrics.index_percentile(df, "v", 0.5, "g").first()["v"] == 11.0
    bins = spark.createDataFrame([(0.0,), (0.05,), (1.0,), (0.999,)], "x double")
    assert {r.bin: r.n for r in metrics.histogram(bins, "x").collect()} == {0: 1, 1: 1, 19: 2}
    assert metrics.violations(spark.createDataFrame([(0.5,), (1.5,), (None,)], "x double"), ["x"]).count() == 2


def test_bootstrap():
    same = significance.bootstrap([0.1 * i for i in range(10)], [0.1 * i for i in range(10)])
    assert same["p_value"] > 0.5 and same["effect_size"] == 0.0
    assert significance.bootstrap([0.0] * 20, [1.0] * 20)["p_value"] < 0.05
    rng = np.random.default_rng(0)
    a, b = rng.random(30), rng.random(30) + 0.1
    found = significance.bootstrap(a, b)
    assert found["ci_lower"] <= found["delta"] <= found["ci_upper"]
    means = (b - a)[np.random.default_rng(42).integers(0, 30, size=(10_000, 30))].mean(1)
    assert found["p_value"] == (means <= 0).mean()
    assert significance.bootstrap(a, b, two_sided=True)["p_value"] == min(1, 2 * found["p_value"])
    for bad in (([], []), ([1.0], [1.0, 2.0])):
        with pytest.raises(ValueError):
            significance.bootstrap(*bad)


def test_comparisons(spark):
    a = spark.createDataFrame([("q1", 0.1), ("q2", 0.2), ("only_a", 0.5)], "query_id string, value double")
    b = spark.createDataFrame([("q1", 0.3), ("q2", 0.3), ("only_b", 0.5)], "query_id string, value double")
    assert significance.compare(a, b, resamples=200).first()["n_queries"] == 2
    assert {tuple(r) for r in significance.exclusive(a, b).collect()} == {("only_a", "a"), ("only_b", "b")}
    with pytest.raises(ValueError):
        significance.compare(a, b.where("query_id = 'only_b'"))
    rows = [(s, o, f"q{q}", v + q / 100) for o, (s, v) in enumerate([("x", 0.1), ("y", 0.5), ("z", 0.2)]) for q in range(8)]
    got = significance.compare_all(spark.createDataFrame(rows, "system string, ord int, query_id string, value double"), resamples=200).collect()
    assert [(r.system_a, r.system_b) for r in got] == [("x", "y"), ("y", "z"), ("x", "z")]
    tally = significance.win_loss_tie(spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (1.0, 1.0)], "a double, b double")).first()
    assert tuple(tally) == (1, 1, 1)


def test_paired_t(spark):
    # Known values of Student's t: two-sided 5 % points.
    for df, point in ((1, 12.7062), (5, 2.5706), (30, 2.0423)):
        assert significance.t_quantile(0.975, df) == pytest.approx(point, abs=1e-3)
        assert significance.t_tail(point, df) == pytest.approx(0.05, abs=1e-4)
    pairs = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (0.0, 3.0)], "a double, b double")
    found = significance.paired_t(pairs)
    assert found["t"] == pytest.approx(3.4641, abs=1e-4) and found["p_value"] == pytest.approx(0.0742, abs=1e-3)
    assert not significance.paired_t(pairs.withColumn("b", F.col("a")))["is_significant"]


def test_classes_equal_judged_pairs(spark):
    """Grades by class give what all pairs of a class give: own rows, lone and unknown classes, null ones and grades of zero included."""
    import random

    draw = random.Random(9)
    members = [(f"v{k}", draw.choice([0, 1, 2, None]), draw.choice([0, 1, 1, 2, 3])) for k in range(90)] + [("lone", 7, 2), ("zero", 8, 0), ("nought", 8, 0)]
    asked = [(name, label) for name, label, _ in members if draw.random() < 0.4 or label in (7, 8)] + [("other", 1), ("unknown", 99)]
    run = [(q, p, k + 1) for q, _ in asked for k, p in enumerate(draw.sample([m[0] for m in members], draw.randrange(12)))]
    m = spark.createDataFrame(members, "passage_id string, class int, grade int")
    a = spark.createDataFrame(asked, "query_id string, class int")
    r = spark.createDataFrame(run, "query_id string, passage_id string, rank int")
    qrels = a.join(m, "class").where("query_id <> passage_id").select("query_id", "passage_id", "grade")
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in df.collect())
    cuts = (1, 3, 10)
    expected = rows(metrics.per_query(r, qrels, cuts))
    assert rows(metrics.per_query_of_classes(r, a, m, cuts)) == expected and len(expected) > 20
    plan = metrics.per_query_of_classes(r, a, m, cuts)._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT (query_id" not in plan
