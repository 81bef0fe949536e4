import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.functions.text import tokenise
from trawl.operators import dense, fusion, lexical, mining, ranking
from trawl.operators import rerank as reranking
from trawl.plans import evaluation
from trawl.plans.search import Searcher, rerank_only

PASSAGES = [("1", "the quick brown fox jumps", ""), ("2", "a lazy dog sleeps all day", "dogs"), ("3", "machine learning ranks documents", ""), ("4", "learning to rank with deep learning", "ranking"), ("5", "", "")]


def passages(spark, rows=PASSAGES):
    return spark.createDataFrame(rows, "passage_id string, text string, title string")


def queries(spark, *rows):
    return spark.createDataFrame(rows, "query_id string, query_text string")


def brute_bm25(rows, query, k1=1.5, b=0.75, epsilon=0.25):
    docs = {i: ((title + " " if title else "") + text).lower().split() for i, text, title in rows}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else epsilon * mean for t, v in raw.items()}
    return {i: sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avgdl)) for t in query.lower().split()) for i, d in docs.items()}


def test_bm25_scores(spark):
    index = lexical.build(passages(spark))
    for query in ("learning rank", "learning learning documents", "the dogs", "unknown words"):
        expected = {i: s for i, s in brute_bm25(PASSAGES, query).items() if s}
        got = {r.passage_id: r.score for r in lexical.scores(index, queries(spark, ("q", query))).collect()}
        assert got == pytest.approx(expected)


def test_bm25_lists(spark, tmp_path):
    index = lexical.build(passages(spark))
    run = lexical.search(index, queries(spark, ("q", "deep learning"), ("none", "zzz")), 3).collect()
    assert [r.passage_id for r in sorted(run, key=lambda r: r.rank)] == ["4", "3"]
    padded = lexical.search(index, queries(spark, ("q", "deep learning"), ("none", "zzz")), 10, pad_zero=True).collect()
    assert Counter(r.query_id for r in padded) == {"q": 5, "none": 5}
    assert sorted(r["rank"] for r in padded if r.query_id == "none") == [1, 2, 3, 4, 5]
    assert all(r.score == 0 for r in padded if r.query_id == "none")
    index.save(str(tmp_path / "index"))
    again = lexical.Bm25Index.load(spark, str(tmp_path / "index"))
    assert again.size() == 5 and lexical.search(again, queries(spark, ("q", "deep learning")), 3).count() == 2
    fields = lexical.search_fields(passages(spark), queries(spark, ("q", "ranking")), 3).collect()
    assert [r.passage_id for r in fields] == ["4"]
    assert ranking.non_blank(queries(spark, ("a", " \t　"), ("b", "x"), ("c", ""))).count() == 1


def vectors(n, d=8, seed=0):
    found = np.random.default_rng(seed).normal(size=(n, d))
    return found / np.linalg.norm(found, axis=1, keepdims=True) * np.random.default_rng(seed + 1).uniform(0.5, 2, size=(n, 1))


@pytest.mark.parametrize("metric", ["dot", "cosine", "euclid"])
def test_exact_search(spark, metric):
    x = vectors(300).astype(np.float32)
    x[7] = x[3]  # a tie
    corpus = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "passage_id string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x[:20])], "query_id string, embedding array<float>")
    y = x.astype(float)
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    s = y[:20] @ y.T if metric == "dot" else u[:20] @ u.T if metric == "cosine" else -np.linalg.norm(y[:20, None] - y[None], axis=2)
    expected = {str(q): [str(p) for p in sorted(range(300), key=lambda p: (-round(s[q, p], 9), str(p))) if p != q][:10] for q in range(20)}
    for run in (dense.search(asked, corpus, metric=metric, exclude_self=True, block=7), dense.search_native(asked, corpus, metric=metric, exclude_self=True)):
        got = {}
        for r in sorted(run.collect(), key=lambda r: r.rank):
            got.setdefault(r.query_id, []).append(r.passage_id)
        assert got == expected


@pytest.mark.parametrize("metric", ["dot", "euclid"])
def test_ties_are_cut_by_id(metric):
    """Of thousands of equal vectors each query gets the k smallest ids, beside what is better."""
    rows = np.tile([[1.0, 0.0]], (5000, 1))
    rows[77] = [2.0, 0.0]
    names = np.array([str(k) for k in range(5000)], object)
    asked = np.array([[2.0, 0.0], [2.0, 0.1]])
    q, p, _ = dense._best(np.array(["a", "b"], object), asked, names, rows, 10, metric, False)
    for query in ("a", "b"):
        assert sorted(p[q == query]) == sorted(["77", *sorted(set(names) - {"77"})[:9]])


def test_cells_reach_recall(spark):
    """Every vector is indexed and nine in ten of the exact neighbours are found."""
    corpus = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").cast("string").alias("passage_id"), "embedding")
    asked = corpus.where("cast(passage_id as long) % 20 = 0").withColumnRenamed("passage_id", "query_id")
    index = dense.build_cells(corpus, 20)
    assert index.vectors.count() == corpus.count()
    exact = dense.search(asked, corpus, 10).select("query_id", "passage_id")
    found = index.search(asked, 10, probes=10).select("query_id", "passage_id")
    assert exact.intersect(found).count() / exact.count() >= 0.9
    assert dense.auto_search(asked, corpus, 3).count() == 3 * asked.count()


def test_cells_grow(spark):
    """Twice the vectors without a new fit, cells split past a bound, replaced and deleted vectors; recall stays over nine in ten."""
    corpus = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").cast("string").alias("passage_id"), "embedding")
    number = F.col("passage_id").cast("long")
    asked = corpus.where(number % 20 == 0).withColumnRenamed("passage_id", "query_id")
    index = dense.build_cells(corpus.where(number % 2 == 0), 20)
    stale = corpus.where(number % 10 == 0).select("passage_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    grown = index.add(stale).add(corpus.where((number % 2 == 1) | (number % 10 == 0))).rebalance(100)
    sizes = {r["cell"]: r["count"] for r in grown.vectors.groupBy("cell").count().collect()}
    assert sum(sizes.values()) == corpus.count() and max(sizes.values()) <= 100 and len(grown.centres) > 20
    exact = dense.search(asked, corpus, 10).select("query_id", "passage_id")
    found = grown.search(asked, 10).select("query_id", "passage_id")
    assert exact.intersect(found).count() / exact.count() >= 0.9
    assert {r.passage_id for r in grown.remove(stale).vectors.collect()} == {r.passage_id for r in corpus.where(number % 10 != 0).collect()}
    # Equal vectors can't be split; they stay one cell over the bound.
    same = spark.range(50).select(F.col("id").cast("string").alias("passage_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    one = dense.build_cells(same, 1)
    assert len(one.rebalance(10).centres) == len(one.centres) and one.rebalance(10).size() == 50


def run_of(spark, *lists):
    return spark.createDataFrame([("q", d, float(s), i + 1) for i, (d, s) in enumerate(lists)], "query_id string, passage_id string, score double, rank int")


def order(run):
    return [(r.passage_id, r.score) for r in sorted(run.collect(), key=lambda r: r.rank)]


def test_fusion(spark):
    a, b = run_of(spark, ("x", 9), ("y", 5), ("z", 1)), run_of(spark, ("y", 0.9), ("w", 0.1))
    assert [s for _, s in order(fusion.by_ranks(a))] == pytest.approx([1 / 61, 1 / 62, 1 / 63])
    assert dict(order(fusion.by_ranks(a, a, a)))["x"] == pytest.approx(3 / 61)
    assert order(fusion.by_ranks(a, b)) == order(fusion.by_ranks(b, a))
    assert dict(order(fusion.by_scores(a, b, alpha=0.0))) == pytest.approx({"x": 1, "y": 0.5, "z": 0, "w": 0})
    assert dict(order(fusion.by_scores(a, b, alpha=1.0))) == pytest.approx({"y": 1, "w": 0, "x": 0, "z": 0})
    assert dict(order(fusion.by_scores(a, b))) == pytest.approx({"x": 0.5, "y": 0.75, "z": 0, "w": 0})
    empty = a.limit(0)
    assert {d for d, _ in order(fusion.by_scores(empty, b))} == {"y", "w"} and {d for d, _ in order(fusion.by_scores(a, empty))} == {"x", "y", "z"}
    assert order(fusion.by_scores(run_of(spark, ("x", 3)), empty, alpha=0.0)) == [("x", 1.0)]
    assert dict(order(fusion.by_ranks(a.withColumn("rank", F.lit(0))))) == dict(order(fusion.by_ranks(a)))
    assert fusion.strategy("RRF") is fusion.by_ranks
    for bad in (lambda: fusion.by_scores(a, b, alpha=1.5), lambda: fusion.by_ranks(a, constant=0), lambda: fusion.strategy("learned")):
        with pytest.raises(ValueError):
            bad()


def test_models_are_pluggable(spark):
    class Lengths:
        dimensions = 2

        def encode(self, texts):
            return np.array([[len(t), 1] for t in texts], float)

        def score(self, queries, passages):
            return np.array([len(p) for p in passages], float)

    got = reranking.encoded(passages(spark), "text", Lengths, batch=2).collect()
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-6 for r in got)
    candidates = passages(spark).withColumns({"query_id": F.lit("q"), "query_text": F.lit("rank documents")})
    assert [r.passage_id for r in reranking.rerank(candidates, 2, make=Lengths).orderBy("rank").collect()] == ["4", "3"]
    assert reranking.rerank(candidates, 1).first()["passage_id"] == "3"
    assert reranking.rerank(candidates.limit(0), 3).count() == 0
    assert rerank_only(candidates, 2).count() == 2
    vector = passages(spark).select(reranking.hashed_words(F.col("text")).alias("v"), tokenise(F.col("text")).alias("w")).first()
    assert len(vector.v) == 64 and abs(np.linalg.norm(vector.v) - 1) < 1e-9


def searcher(spark):
    rows = [(str(i), " ".join(f"w{random.Random(i).randint(0, 30)}" for _ in range(12)), "") for i in range(60)]
    x = vectors(60)
    corpus = passages(spark, rows)
    embedded = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "passage_id string, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 1}", x[i].tolist()) for i in range(4)] + [("blank", "  ", x[5].tolist())], "query_id string, query_text string, embedding array<double>")
    return Searcher(corpus, lexical.build(corpus), embedded), asked


def test_search_modes(spark):
    engine, asked = searcher(spark)
    for mode in ("bm25", "dense", "hybrid", "rerank"):
        run = engine.search(asked, mode, 5).collect()
        by = {}
        for r in run:
            by.setdefault(r.query_id, []).append(r["rank"])
        assert "blank" not in by and set(by) == {f"q{i}" for i in range(4)}
        assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())
    assert {r.mode for r in engine.compare_modes(asked, 2).select("mode").distinct().collect()} == {"bm25", "dense", "hybrid", "rerank"}
    assert engine.warm(asked, "bm25") == {"succeeded": 4, "failed": 1}
    assert engine.search(asked, "hybrid", 3, payload=True).where("text = ''").count() == 0
    for bad in (dict(mode="learned"), dict(k=0), dict(mode="rerank", k=10, rerank_top_n=5)):
        with pytest.raises(ValueError):
            engine.search(asked, **bad)


def test_sweep_and_report(spark):
    engine, asked = searcher(spark)
    qrels = spark.createDataFrame([(f"q{i}", str(i), 1) for i in range(4)], "query_id string, passage_id string, grade int")
    found, seconds = evaluation.sweep(engine, asked, qrels, pool=20)
    assert set(seconds) == {name for name, _, _ in evaluation.SWEEP} and found.count() == 24
    assert found.where("system = 'dense' and ndcg_10 < 0.3").count() == 0
    compared = evaluation.compare(found, resamples=100)
    assert compared.count() == 15
    text = evaluation.report(found, compared)
    assert text.count("\n| ") == 4 + 6 + 15 and "hybrid+rerank" in text


def test_relational_steps(spark):
    df = spark.createDataFrame([("a", "1", "en", ["x", "y"], "2024-01-05"), ("b", "2", "de", ["x"], "2024-02-01")], "passage_id string, text string, lang string, tags array<string>, date string")
    assert [r.passage_id for r in ranking.filtered(df, language="en", tags=["x", "y"], date_from="2024-01-01", date_to="2024-01-31").collect()] == ["a"]
    assert ranking.filtered(df, tags=["x"]).count() == 2
    held = ranking.metadata(df.select("passage_id", "text", "lang").withColumn("n", F.lit(None).cast("int"))).where("passage_id = 'a'").first()
    assert held.metadata == {"lang": "en"}
    kept = ranking.with_payload(spark.createDataFrame([("q", "a", 1), ("q", "gone", 2)], "query_id string, passage_id string, rank int"), df.withColumn("title", F.lit(None).cast("string"))).collect()
    assert {(r.passage_id, r.text, r.title) for r in kept} == {("a", "1", ""), ("gone", "", "")}
    assert [r.query_id for r in ranking.judged_queries(spark.createDataFrame([("10", "x"), ("9", "y"), ("2", "z")], "query_id string, query_text string"), spark.createDataFrame([("10", "a", 1), ("2", "a", 1)], "query_id string, passage_id string, grade int"), 1).collect()] == ["10"]


def test_mining(spark):
    c = spark.createDataFrame([("q1", "p", "the positive text"), ("q1", "n", "something else"), ("q1", "dup", "The Positive text "), ("q2", "p2", "same")], "query_id string, passage_id string, text string")
    p = spark.createDataFrame([("q1", "p", "the positive text"), ("q2", "p2", "same")], "query_id string, passage_id string, text string")
    assert [tuple(r) for r in mining.hard_negatives(c, p).collect()] == [("q1", "n", 1)]
    found = mining.labelled_pairs(spark.createDataFrame([("q", "a", "b")], "query string, positive string, negative string"))
    assert {r.label: r.n for r in mining.label_counts(found).collect()} == {1: 1, 0: 4}
    nested = spark.createDataFrame([("q", ["a", "b"], [0, 1])], "query_id string, passage_text array<string>, is_selected array<int>")
    assert mining.exploded_passages(nested).where("is_selected = 1").first().passage_text == "b"
    one = mining.triplets(p, c.where("passage_id = 'n'"))
    assert [tuple(r) for r in one.collect()] == [("q1", "p", "n")]
    log = spark.createDataFrame([(1, 0.5, None), (2, None, 0.4), (3, None, None)], "step int, loss double, eval_loss double")
    assert mining.loss_curve(log).count() == 2


def test_only_texts_of_a_run_move(spark, monkeypatch):
    """Texts without a mark of the run's ids stay where they are; ids that share a mark with one change no result."""
    passages = spark.range(2000).select(F.col("id").cast("string").alias("passage_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(None).cast("string").alias("title"))
    run = spark.createDataFrame([("q", "7", 1), ("r", "7", 1), ("q", "gone", 2), ("q", "1999", 3)], "query_id string, passage_id string, rank int")
    for marks in (ranking.MARKS, 2):
        monkeypatch.setattr(ranking, "MARKS", marks)
        held = ranking.with_payload(run, passages)
        plan = held._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan and plan.index("LeftOuter") < plan.index("LeftSemi")
        assert sorted(tuple(r) for r in held.select("query_id", "passage_id", "text", "title").collect()) == [("q", "1999", "text 1999", ""), ("q", "7", "text 7", ""), ("q", "gone", "", ""), ("r", "7", "text 7", "")]


def test_rows_of_a_dense_search_do_not_grow_with_the_stretches_of_input(spark):
    """Forty partitions of rows are searched in as many tasks as run at once, with the same results."""
    draw = np.random.default_rng(3)
    held = [(f"p{k}", [float(x) for x in draw.normal(size=4)]) for k in range(800)]
    corpus = spark.createDataFrame(held, "passage_id string, embedding array<double>")
    queries = corpus.limit(30).withColumnRenamed("passage_id", "query_id")
    found = dense.search(queries, corpus.repartition(40), 5)
    most = max(8, spark.sparkContext.defaultParallelism)
    assert f"Coalesce {most}" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, found.collect())) == sorted(map(str, dense.search(queries, corpus.coalesce(1), 5).collect()))


def test_texts_of_a_pair_are_split_once(spark):
    """The overlap asks for the tokens several times."""
    pairs = spark.createDataFrame([("a b b", "B c"), ("", ""), (None, "a"), ("a  b", "b A")], "query string, passage string")
    scored = pairs.select(F.round(reranking.overlap_score(F.col("query"), F.col("passage")), 6).alias("score"))
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    assert [r.score for r in scored.collect()] == [round(1 / (1 + np.exp(1 - 8 * x)), 6) for x in (1 / 3, 0, 0, 1)]


def test_a_run_is_searched_once_for_its_texts(spark):
    """The run is kept before its ids choose the texts and the texts are joined to it."""
    engine, asked = searcher(spark)
    for found in (engine.search(asked, "hybrid", 5, payload=True), engine.search(asked, "rerank", 5)):
        tree = found._jdf.queryExecution().executedPlan().toString()
        outer = tree.split("InMemoryRelation")[0]
        assert "InMemoryTableScan" in outer and "MapInArrow" not in outer
        assert found.count() == 20
