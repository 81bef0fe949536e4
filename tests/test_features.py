"""Indexing, retrievers, caches, experiments, operations and artifacts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import dense, fusion, lexical, metrics, results
from trawl.operators import rerank as reranking
from trawl.plans import indexing
from trawl.plans.evaluation import Runner
from trawl.plans.search import DenseRetriever, HybridRetriever, LexicalRetriever, Searcher
from trawl.sources import artifacts, corpus
from trawl.sources.tables import ExperimentStore, KeyedTable
from trawl.streaming import operations, windows

ROWS = [("p1", "Search", "search engines rank documents", "en"), ("p2", "", "vectors rank passages", "en"), ("p3", "Moteurs", "les moteurs rank", "fr"), ("p4", "", "  ", "fr")]


def passages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "passage_id string, title string, text string, lang string")


def hashed(df):
    return df.withColumn("embedding", reranking.hashed_words(F.col("text"))).select("passage_id", "embedding")


def asked(spark):
    df = spark.createDataFrame([("q1", "rank documents"), ("q2", "moteurs"), ("q3", "  ")], "query_id string, query_text string")
    return df.withColumn("embedding", reranking.hashed_words(F.col("query_text")))


def pairs(run):
    return [(r.query_id, r.passage_id) for r in run.orderBy("query_id", "rank").collect()]


def test_corpus_index_is_upserted(spark, tmp_path):
    index = indexing.CorpusIndex(spark, str(tmp_path / "i"))
    assert index.healthy() == {"postings": False, "vectors": False, "manifest": False}
    assert index.index(passages(spark, ROWS[:2]), hashed) == {"indexed": 2, "skipped": 0}
    assert index.index(passages(spark), hashed) == {"indexed": 2, "skipped": 2}
    assert index.index(passages(spark), hashed) == {"indexed": 0, "skipped": 4}
    index.index_lexical(passages(spark, [("p2", "", "changed words", "en")]))
    index.index_lexical(passages(spark, ROWS[1:2]))
    assert all(index.healthy().values()) and index.vectors.count() == 4
    built = lexical.build(passages(spark))
    whole = [tuple(r) for r in lexical.search(built, asked(spark), 5).orderBy("query_id", "rank").collect()]
    assert whole == [tuple(r) for r in lexical.search(index.bm25(), asked(spark), 5).orderBy("query_id", "rank").collect()]
    saved = lexical.build_saved(passages(spark), str(tmp_path / "s"))
    assert whole == [tuple(r) for r in lexical.search(saved, asked(spark), 5).orderBy("query_id", "rank").collect()]


def test_ingest_sample(spark, tmp_path):
    made = indexing.ingest_sample(passages(spark), str(tmp_path / "s"), encode=hashed, mode="full", cells=2)
    assert (made["indexed"], made["vectors"]) == (4, 4)
    assert artifacts.read_record(spark, str(tmp_path / "s/summary"))["run"] == made["run"]
    assert spark.read.parquet(str(tmp_path / "s/flat")).select("number").distinct().count() == 4
    assert dense.CellIndex.load(spark, str(tmp_path / "s/cells"), probes=2).size() == 4


def test_cell_index_round_trip_and_probes(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"p{i}", rng.normal(size=8).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, "passage_id string, embedding array<double>").repartition(3)
    queries = vectors.where("passage_id like 'p1%'").withColumnRenamed("passage_id", "query_id")
    index = dense.build_cells(vectors, 6)
    index.save(str(tmp_path / "c"))
    loaded = dense.CellIndex.load(spark, str(tmp_path / "c"))
    assert pairs(loaded.search(queries, 5, probes=2)) == pairs(index.search(queries, 5, probes=2))
    exact = pairs(dense.search(queries, vectors.withColumn("embedding", F.col("embedding").cast("array<float>").cast("array<double>")), 5))
    assert pairs(loaded.search(queries, 5, probes=6)) == exact
    brute = {q: sorted(((-round(float(np.dot(np.float32(a), np.float32(b))), 5), p) for p, b in rows))[:5] for q, a in rows if q.startswith("p1")}
    assert {(q, p) for q, found in brute.items() for _, p in found} == set(exact)


def test_queries_in_several_groups_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(f"p{i}", rng.normal(size=4).tolist()) for i in range(60)], "passage_id string, embedding array<double>")
    queries = vectors.withColumnRenamed("passage_id", "query_id")
    whole = pairs(dense.search(queries, vectors, 3, metric="cosine", exclude_self=True))
    monkeypatch.setattr(dense, "HELD", 4 * 8 * 25)
    assert pairs(dense.search(queries, vectors, 3, metric="cosine", exclude_self=True, block=7)) == whole
    with pytest.raises(ValueError):
        dense.auto_search(queries, vectors, method="cells", metric="euclid")


def test_retrievers_and_custom_fusion(spark):
    legs = [LexicalRetriever(), DenseRetriever(encode=lambda df: df.withColumn("embedding", reranking.hashed_words(F.col("text"))))]
    hybrid = HybridRetriever(legs)
    assert not hybrid.healthy()
    with pytest.raises(ValueError):
        legs[0].search(asked(spark), 2)
    hybrid.index(passages(spark))
    assert hybrid.healthy()
    runs = [leg.search(asked(spark), 50) for leg in legs]
    assert pairs(hybrid.search(asked(spark), 2)) == pairs(fusion.by_ranks(*runs, k=2))
    first = HybridRetriever(legs, lambda found: found[0])
    both = HybridRetriever(legs, lambda found, k: found[0].where(F.col("rank") <= k))
    assert pairs(first.search(asked(spark), 1)) == pairs(both.search(asked(spark), 1)) == pairs(runs[0].where("rank = 1"))


def test_filters_choose_before_retrieval(spark):
    engine = Searcher(passages(spark), lexical.build(passages(spark)), hashed(passages(spark)))
    for mode in ("bm25", "dense", "hybrid", "rerank"):
        found = pairs(engine.search(asked(spark), mode, 2, filters={"language": "fr"}))
        assert {p for _, p in found} <= {"p3", "p4"} and ("q1", "p3") in found
    assert engine.search_one("rank", "bm25", 1).count() == 1
    for bad in (" \t", "x" * 1001):
        with pytest.raises(ValueError):
            engine.search_one(bad, "bm25")


def test_cached_results_expire(spark):
    now = [0.0]
    engine = Searcher(passages(spark), lexical.build(passages(spark)), hashed(passages(spark)), ttl=10, most=2, clock=lambda: now[0])
    queries = asked(spark)
    first = engine.cached(queries, "bm25", 1)
    assert engine.cached(queries, "bm25", 1) is first
    now[0] = 11
    assert engine.cached(queries, "bm25", 1) is not first and len(engine.results) == 1
    for k in (2, 3, 4):
        engine.cached(queries, "bm25", k)
    assert len(engine.results) == 2
    engine.forget()
    assert not engine.results and engine.healthy() == {"passages": True, "index": True, "vectors": True}


def test_experiments_are_stored_and_compared(spark, tmp_path):
    engine = Searcher(passages(spark), lexical.build(passages(spark)), hashed(passages(spark)))
    qrels = spark.createDataFrame([("q1", "p1", 1), ("q2", "p3", 1)], "query_id string, passage_id string, grade int")
    runner = Runner(engine, ExperimentStore(spark, str(tmp_path / "e")))
    a = runner.run("lexical", "bm25", asked(spark), qrels, 10)
    b = runner.run("dense", "dense", asked(spark), qrels, 10, number="fixed")
    runner.run("dense", "dense", asked(spark), qrels, 10, number="fixed")
    assert runner.store.counts() == {"experiments": 2, "experiment_results": 2, "per_query_metrics": 4}
    row = runner.compare(a, b, resamples=200).first()
    assert row["a"]["ndcg_at_10"] == 1.0 and row["n_queries"] == 2
    with pytest.raises(ValueError):
        runner.compare(a, "none")


def test_keyed_table_folds_touched_buckets_and_keeps_old_readers(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "passage_id string, text string", buckets=4)
    table.upsert(spark.createDataFrame([(f"p{i}", "a") for i in range(40)], table.schema))
    table.compact()
    before, held = table._state()["bases"], table.read()
    table.upsert(spark.createDataFrame([("p1", "b"), ("new", "c")], table.schema))
    table.compact()
    after = table._state()["bases"]
    assert 1 <= sum(before[k] != after[k] for k in before) <= 2 and table.count() == 41
    assert held.where("text = 'b'").count() == 0 and held.count() == 40  # the old state is still there
    assert {r.passage_id: r.text for r in table.read().where("passage_id in ('p1', 'new', 'p2')").collect()} == {"p1": "b", "new": "c", "p2": "a"}
    table.upsert(spark.createDataFrame([], table.schema))
    assert table.count() == 41
    # A write that is lost before its state leaves the table as it was.
    commit = KeyedTable._commit
    try:
        KeyedTable._commit = lambda *_: (_ for _ in ()).throw(OSError("lost"))
        with pytest.raises(OSError):
            table.upsert(spark.createDataFrame([("p3", "z")], table.schema))
    finally:
        KeyedTable._commit = commit
    assert table.read().where("text = 'z'").isEmpty() and table.count() == 41


def test_alerts_break_at_missing_windows(spark, monkeypatch):
    def starts(minutes):
        return sorted((str(r.alert_start)[11:16], str(r.alert_end)[11:16], r.n_windows) for r in windows.alerts(spark.createDataFrame([(m,) for m in minutes], "m int").select((F.timestamp_seconds(F.col("m") * 60 + 86_400)).alias("window_start"), F.lit(9.0).alias("p")), "p > 5", 2).collect())

    found = [("00:00", "00:10", 3), ("03:00", "03:05", 2)]
    assert starts([0, 5, 10, 180, 185, 300]) == found
    monkeypatch.setattr(windows, "STRETCH", 2)
    assert starts([0, 5, 10, 180, 185, 300]) == found
    monkeypatch.setattr(windows, "STRETCH", 1)
    assert starts([0, 5, 10, 180, 185, 300]) == found


def test_index_percentile_in_narrowed_ranges(spark, monkeypatch):
    monkeypatch.setattr(metrics, "SORTED", 50)
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=5000).tolist(), [1.0] * 4000 + [2.0] * 1000, [float(i % 7) for i in range(3000)]):
        df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)] + [(None, 0)], "v double, g int")
        for share in (0.0, 0.5, 0.95, 1.0):
            ordered = sorted(values)
            assert metrics.index_percentile(df, "v", share).first()["v"] == ordered[min(int(share * len(ordered)), len(ordered) - 1)]
        for r in metrics.index_percentile(df, "v", 0.9, "g").collect():
            own = sorted(v for i, v in enumerate(values) if i % 3 == r["g"])
            assert r["v"] == own[min(int(0.9 * len(own)), len(own) - 1)]


def test_white_space_as_python_sees_it(spark):
    texts = [" Hello.\n", "One here. Two there.\x1f Three", "see http://a.b/c next www.x.y\x1cz", "    ", "a.\x85B"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.strip(F.col("t"))).collect()] == [t.strip() for t in texts]
    assert [r[0] for r in df.select(T.sentences(F.col("t"))).collect()] == [["Hello."], ["One here.", "Two there.", "Three"], [texts[2]], [], ["a.", "B"]]
    assert df.select(T.strip_urls(F.col("t"))).collect()[2][0] == "see   next  \x1cz"
    assert [r[0] for r in df.select(T.overlaps(F.col("t"), F.lit("zzz hello."))).collect()] == [True, False, False, False, False]


def test_passages_keep_the_first_read(spark):
    raw = spark.createDataFrame([("a", "zz", 2), ("a", "aa", 1), ("b", "x", 3)], "passage_id string, text string, at int").coalesce(1)
    assert {r.passage_id: r.text for r in corpus.passages(raw, "full").collect()} == {"a": "zz", "b": "x"}
    assert {r.passage_id: r.text for r in corpus.passages(raw, "full", order="at").collect()} == {"a": "aa", "b": "x"}


def test_checks(spark):
    results.check_weights(0.3, 0.7)
    for call in (lambda: results.check_weights(0.3, 0.6), lambda: results.check_rerank(3, 4), lambda: results.check_query("")):
        with pytest.raises(ValueError):
            call()
    df = spark.createDataFrame([(0.5, 1.0, 2.0, 3.0), (0.5, 3.0, 2.0, 3.0)], "m double, p50 double, p95 double, p99 double")
    assert metrics.violations(df, ["m"], (("p50", "p95", "p99"),)).count() == 1
    row = results.candidates(spark.createDataFrame([("q", "p", "t")], "query_id string, passage_id string, text string")).first()
    assert (row.rank, row.score, row.title, row.metadata) == (0, 0.0, "", {})
    with pytest.raises(ValueError):
        reranking.encoded_list(spark, [], None)
    assert indexing.pair_set(spark.createDataFrame([("q", "p", "n")], "query string, positive string, negative string")).collect() == [("q", "p", 1), ("q", "n", 0)]


def test_operations(spark, tmp_path):
    pauses, calls = [], []

    def fails(times):
        calls.append(1)
        if len(calls) <= times:
            raise OSError
        return "done"

    assert operations.retried(lambda: fails(3), sleep=pauses.append) == "done" and pauses == [0.1, 0.2, 0.4]
    calls.clear()
    with pytest.raises(OSError):
        operations.retried(lambda: fails(9), sleep=pauses.append)
    assert len(calls) == 5
    progress = {"sources": [{"endOffset": '{"t": {"0": 5, "1": 7}}', "latestOffset": '{"t": {"0": 2005, "1": 7}}'}, {"endOffset": 3, "latestOffset": None}]}
    assert operations.lag(progress) == 2000 and operations.lag_level(2000) == "warning" and operations.lag_level(10_001) == "critical"
    samples = spark.createDataFrame([(g, t, n) for g, ns in {"a": [0, 2000, 2000, 3000], "b": [20_000] * 4, "c": [2000, 2000, 0, 2000]}.items() for t, n in enumerate(ns)], "consumer_group string, ts int, lag long")
    assert sorted(tuple(r) for r in operations.lag_alerts(samples, hold=3).collect()) == [("a", "warning", 1), ("b", "critical", 1)]
    errors = []
    assert not operations.send(spark.createDataFrame([("k", "v")], "key string, value string"), "h:1", "t", on_error=errors.append) and errors
    assert operations.send(operations.job_rows(spark.createDataFrame([("j1",)], "job_id string")), "", "", format="json", path=str(tmp_path / "out"))
    assert json.loads(spark.read.json(str(tmp_path / "out")).first()["value"])["_type"] == "indexing_job"
    taken = {}
    with operations.timed(taken, "x"):
        pass
    assert taken["x"] >= 0 and operations.throughput(10, 2.0, 20) == {"per_second": 5.0, "seconds_left": 2.0}
    assert len(operations.run_id()) == 15 and operations.utc_now().endswith("+00:00")


def test_artifacts(spark, tmp_path):
    state = {"log_history": [{"step": 1, "loss": 0.5}, {"step": 2, "eval_loss": 0.4}]}
    for name in ("checkpoint-1", "checkpoint-2"):
        (tmp_path / "run" / name).mkdir(parents=True)
        (tmp_path / "run" / name / "trainer_state.json").write_text(json.dumps(state, indent=1))
    found = artifacts.checkpoints(spark, str(tmp_path / "run"))
    assert [f.rsplit("/", 1)[1] for f in found] == ["checkpoint-1", "checkpoint-2"]
    log = artifacts.training_log(spark, str(tmp_path / "run"))
    assert log.count() == 4 and log.where("checkpoint = 'checkpoint-1' and loss = 0.5").count() == 1
    artifacts.save_model(spark, str(tmp_path / "m"), b"\x00weights", {"d": 3})
    assert artifacts.load_model(spark, str(tmp_path / "m")) == (b"\x00weights", {"d": 3})
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, str(tmp_path / "none"))
    assert artifacts.read_record(spark, str(tmp_path / "none")) is None and artifacts.checkpoints(spark, str(tmp_path / "none")) == []
