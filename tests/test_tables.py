import json

import pytest
from pyspark.sql import functions as F

from trawl.sources import corpus
from trawl.sources.tables import SEED_EXPERIMENTS, ExperimentStore, KeyedTable
from trawl.streaming import ingest, windows

ROW = "passage_id string, text string, title string, version long"


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, order="version")
    assert table.count() == 0 and table.create() and not table.create()
    rows = spark.createDataFrame([("a", "one", "", 1), ("b", "two", "", 1), ("a", "newer", "", 2)], ROW)
    for _ in range(2):
        table.upsert(rows)
        assert {(r.passage_id, r.text) for r in table.read().collect()} == {("a", "newer"), ("b", "two")}
    table.upsert(spark.createDataFrame([("a", "old", "", 0)], ROW))
    assert table.read().where("passage_id = 'a'").first().text == "newer"
    assert table.insert_absent(spark.createDataFrame([("a", "x", "", 9), ("c", "y", "", 1)], ROW)) == 1
    assert table.create(replace=True) and table.count() == 0
    assert table.drop() and not table.drop()


def size_of(folder, prefix=""):
    return sum(f.stat().st_size for d in folder.glob(f"{prefix}*") for f in ([d] if d.is_file() else d.rglob("*.parquet")))


def test_a_write_costs_what_it_changes(spark, tmp_path):
    """Bytes of a batch grow with the batch, not with the table; unread buckets stay when deltas are folded in."""
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, order="version")
    many = spark.range(20_000).select(F.col("id").cast("string").alias("passage_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit("").alias("title"), F.lit(1).cast("long").alias("version"))
    table.upsert(many)
    assert table.compact() == 16
    base = size_of(tmp_path / "t", "v-")
    took = []
    for rows in (10, 100, 1000):
        before = size_of(tmp_path / "t", "d-")
        table.upsert(many.where(F.col("passage_id").cast("int") < rows).withColumns({"text": F.concat("text", F.lit("!")), "version": F.lit(2).cast("long")}))
        took.append(size_of(tmp_path / "t", "d-") - before)
    assert took[0] < took[1] < took[2] < base / 10
    assert table.count() == 20_000 and table.read().where("text like '%!'").count() == 1000
    one = spark.createDataFrame([("7", "seven", "", 3)], ROW)
    table.compact()
    table.upsert(one)
    assert table.compact() == 1 and table.count() == 20_000 and table.read().where("passage_id = '7'").first().text == "seven"


def test_deletes_and_late_rows(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, order="version")
    table.upsert(spark.createDataFrame([("a", "1", "", 5), ("b", "1", "", 5), ("c", "1", "", None), (None, "null", "", 1)], ROW))
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "passage_id string")
    state = lambda: {(r.passage_id, r.text) for r in table.read().collect()}
    for fold in (False, True):
        if fold:
            table.compact()
        table.delete(keys("a", "unknown"))
        assert state() == {("b", "1"), ("c", "1"), (None, "null")}
        table.upsert(spark.createDataFrame([("a", "late", "", 4), ("b", "late", "", 4), ("c", "null order", "", None), (None, "null", "", 1)], ROW))
        assert state() == {("b", "1"), ("c", "null order"), (None, "null")}
        table.upsert(spark.createDataFrame([("a", "again", "", 5)], ROW))
        assert state() == {("a", "again"), ("b", "1"), ("c", "null order"), (None, "null")}
        table.upsert(spark.createDataFrame([("c", "1", "", None)], ROW))
    plain = KeyedTable(spark, str(tmp_path / "p"), "passage_id string, text string")
    plain.upsert(spark.createDataFrame([("a", "1"), ("b", "1")], "passage_id string, text string"))
    plain.compact()
    plain.delete(keys("a"))
    plain.upsert(spark.createDataFrame([("b", "2"), ("c", "1")], "passage_id string, text string"))
    assert {tuple(r) for r in plain.read().collect()} == {("b", "2"), ("c", "1")}


def test_readers_and_writers_at_once(spark, tmp_path):
    """A reader's frame outlives later writes and a compaction; of two writers that saw one state neither is lost."""
    table, other = (KeyedTable(spark, str(tmp_path / "t"), ROW, order="version") for _ in range(2))
    table.upsert(spark.createDataFrame([("a", "old", "", 1)], ROW))
    before = table.read()
    seen = table._numbers()
    plain = table._numbers
    calls = iter([seen, seen])  # the next write believes that nothing has come since
    other.upsert(spark.createDataFrame([("b", "other", "", 1)], ROW))
    table._numbers = lambda: next(calls, None) or plain()
    table.upsert(spark.createDataFrame([("c", "mine", "", 1)], ROW))
    assert {r.passage_id for r in table.read().collect()} == {"a", "b", "c"}
    table.upsert(spark.createDataFrame([("a", "new", "", 2)], ROW))
    table.compact()
    assert [r.text for r in before.collect()] == ["old"]
    # What came after a compaction read the state stays a delta.
    state = table._state()
    table.upsert(spark.createDataFrame([("d", "late", "", 1)], ROW))
    reads = iter([table._numbers()[:-1]])
    table._numbers = lambda: next(reads, None) or plain()
    table.upsert(spark.createDataFrame([("e", "later", "", 1)], ROW))
    assert table.count() == 5 and state["bases"] == table._state()["bases"]


def test_batches_and_folding(spark, tmp_path, monkeypatch):
    from trawl.sources import tables

    monkeypatch.setattr(tables, "MOST_DELTAS", 3)
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, order="version")
    for number in (0, 1, 1, 2, 0, 3, 4, 5):
        table.upsert(spark.createDataFrame([(str(number), "x", "", number), ("all", str(number), "", number)], ROW), batch=("s", number))
        assert len(table._state()["deltas"]) <= 3
    assert table.count() == 7 and table.read().where("passage_id = 'all'").first().text == "5"
    assert len(table._numbers()) <= tables.KEPT_STATES + 4
    table.upsert(spark.createDataFrame([], ROW))
    assert table.count() == 7


def test_experiments(spark, tmp_path):
    store = ExperimentStore(spark, str(tmp_path / "store"))
    assert store.seed() == len(SEED_EXPERIMENTS) and store.seed() == 0
    by_query = spark.createDataFrame([("q1", 0.5, 1.0, 0.5, 0.1)], "query_id string, ndcg double, rr double, ap double, precision double")
    ids = [store.add(f"run {k}", "bm25", {"k": k}, {"ndcg_at_10": 0.1 * k, "num_queries": 1}, by_query) for k in (1, 2)]
    assert store.counts() == {"experiments": 7, "experiment_results": 2, "per_query_metrics": 2}
    assert store.compared(*ids).first().b.ndcg_at_10 == pytest.approx(0.2)
    assert store.compared(ids[0], "missing") is None
    assert store.joined().count() == 7
    store.artifact(ids[0], str(tmp_path / "artifact"))
    assert spark.read.json(str(tmp_path / "artifact")).first().name == "run 1"


def test_corpus_readers(spark, tmp_path):
    folder = tmp_path / "lines.jsonl"
    folder.write_text('{"query_id": "1", "query_text": "a"}\n\n{"query_id": "2", "query_text": ""}\n')
    raw = corpus.jsonl(spark, str(folder), "query_id string, query_text string")
    assert [r.query_id for r in corpus.queries(raw).collect()] == ["1"]
    pairs = spark.createDataFrame([("q", "d", 0, 1), ("q", "d", 2, 5), ("q", "e", 1, 2)], "query_id string, passage_id string, grade int, position int")
    assert {(r.passage_id, r.grade) for r in corpus.qrels(pairs).collect()} == {("d", 2), ("e", 1)}
    docs = spark.createDataFrame([("e", "b"), ("e", "a"), ("f", "c")], "passage_id string, text string")
    assert corpus.passages(docs, "full").count() == 2 and corpus.passages(docs, "dev", qrels=pairs).count() == 2
    assert corpus.passages(docs, "small", limit=1).count() == 1
    for bad in (dict(mode="dev"), dict(mode="x")):
        with pytest.raises(ValueError):
            corpus.passages(docs, **bad)
    calls = []

    def compute():
        calls.append(1)
        return docs

    for _ in range(2):
        assert corpus.read_through(spark, str(tmp_path / "cache"), compute).count() == 3
    assert len(calls) == 1
    encode = lambda df: df.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    path = str(tmp_path / "embeddings")
    assert corpus.store_embeddings(docs.where("passage_id = 'f'"), encode, path) == 1
    assert corpus.store_embeddings(docs.dropDuplicates(["passage_id"]), encode, path) == 1
    assert corpus.load_embeddings(spark, path).count() == 2
    with pytest.raises(ValueError):
        corpus.load_embeddings(spark, str(tmp_path / "cache"))


def test_stream_ingest_is_idempotent(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    lines = [{"_type": "passage", "id": "a", "text": "first", "version": 1}, {"id": "a", "text": "second", "version": 2}, {"_type": "indexing_job", "job_id": "j"}, {"_type": "odd", "id": "x"}, {"id": "", "text": "no id"}, {"id": "b", "text": "kept"}]
    (inbox / "m.txt").write_text("\n".join(map(json.dumps, lines)) + '\n{"id": \n')
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, order="version")
    table.create()
    jobs = []
    for run in ("one", "two"):
        ingest.ingest(ingest.file_messages(spark, str(inbox)), table, str(tmp_path / "letters"), str(tmp_path / run), on_job=lambda df: jobs.append(df.count()))
        assert {(r.passage_id, r.text) for r in table.read().collect()} == {("a", "second"), ("b", "kept")}
        assert spark.read.json(str(tmp_path / "letters")).count() == 2
    assert jobs == [1, 1]
    (inbox / "n.txt").write_text(json.dumps({"id": "b", "text": "late", "version": 9}) + "\n")
    ingest.ingest(ingest.file_messages(spark, str(inbox)), table, str(tmp_path / "letters"), str(tmp_path / "two"))
    assert table.read().where("passage_id = 'b'").first().text == "late"


def test_windows(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", 1 + i % 2, "error" if 10 <= i < 20 else "view", float(i)) for i in range(30)]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id int, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    assert windows.alerts(windows.error_share(events), "error_percent > 50", 2).first().n_windows == 2
    assert windows.alerts(windows.error_share(events), "error_percent > 50", 3).count() == 0
    assert windows.rates(events, "5 minutes", "1 minute").count() > windows.rates(events).count()
    assert windows.sessions(events, "3 minutes").count() == 2
    assert windows.bucket_quantile(events.withColumn("event_type", F.lit("all")), 0.5, bounds=(10.0, 20.0)).first()[1] == pytest.approx(14.0)
    states = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False), ("c", False)], "service string, healthy boolean")
    assert {r.service: r.status for r in windows.health(states).collect()} == {"a": "healthy", "b": "degraded", "c": "unhealthy"}
    events.unionByName(events).write.parquet(str(tmp_path / "events"))
    stream = windows.stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    query = windows.rates(stream).writeStream.outputMode("append").format("memory").queryName("rates").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("rates").groupBy().sum("n").first()[0]
    assert got and got <= 30  # repeated events count once; the last windows stay open
