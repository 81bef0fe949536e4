import numpy as np

from trawl.operators import dense
from trawl.operators.leaders import Leaders


def test_best_rows_with_ties_by_name():
    """Many ties at the last place, added in parts of all sizes."""
    rng = np.random.default_rng(4)
    for k in (1, 3, 10):
        values, names = rng.integers(0, 6, (7, 900)) / 3, np.array([f"p{x}" for x in rng.permutation(900)], object)
        held, at = Leaders(7, k), 0
        held.most = 50
        for size in (1, 400, 30, 469):
            q, p = np.divmod(np.arange(7 * size), size)
            held.add(q, values[q, at + p], names[at + p])
            at += size
        got = {(q, n) for b in held.batches(np.array([str(i) for i in range(7)], object), 1) for q, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        assert got == {(str(i), n) for i in range(7) for _, n in sorted(zip(np.round(values[i], 9), names))[:k]}
        assert held.waiting == 0 and len(held.rows[0][0]) == 7 * k


def test_a_task_returns_k_rows_a_query(spark):
    """However many batches it reads; the products held at once are bounded."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(6000, 8)).round(1)
    corpus = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(vectors)], "passage_id string, embedding array<double>").coalesce(1)
    asked = corpus.where("cast(passage_id as int) < 30").withColumnRenamed("passage_id", "query_id")
    run = dense.search(asked, corpus, 5, exclude_self=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        ids, matrix = next(dense._asked(asked, "dot", 5))
        found = dense._Search(ids, matrix, 5, "dot", True)
        for at in range(0, 6000, 500):
            found.add(np.array([str(i) for i in range(at, at + 500)], object), vectors[at : at + 500])
        assert sum(len(b) for b in found.batches()) == 30 * 5
        got = {(r.query_id, r.passage_id, r["rank"]) for r in run.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    scores = np.round(vectors[:30] @ vectors.T, 9)
    scores[np.arange(30), np.arange(30)] = -np.inf
    assert got == {(str(q), name, n + 1) for q in range(30) for n, (_, name) in enumerate(sorted((-s, str(p)) for p, s in enumerate(scores[q]))[:5])}


def test_queries_are_searched_in_groups_of_bounded_results(spark, monkeypatch):
    monkeypatch.setattr(dense, "KEPT", 100)
    asked = spark.createDataFrame([(str(i), [float(i % 7), 1.0]) for i in range(60)], "query_id string, embedding array<double>")
    groups = list(dense._asked(asked, "dot", 10))
    assert len(groups) > 3 and sorted(i for ids, _ in groups for i in ids) == sorted(map(str, range(60)))
    corpus = asked.withColumnRenamed("query_id", "passage_id")
    assert dense.search(asked, corpus).count() == 600
