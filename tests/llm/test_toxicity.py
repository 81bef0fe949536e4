import zlib

import numpy as np
from pyspark.sql import functions as F

from trawl.llm import toxicity as T


def fitted(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return docs, labels, T.train(T.labelled_sample(docs, labels))


def test_held_out_accuracy(spark):
    """Labels of the held-out quarter, never seen in training, are mostly found."""
    docs, labels, model = fitted(spark, "/root/testdata/sf0.1")
    rows = T.score(docs, model).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    toxic, said = sum(r.toxic for r in rows), sum(r.predicted for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert hit / toxic > 0.85 and hit / said > 0.85


def test_edge_cases(spark, sf):
    docs, labels, model = fitted(spark, sf)
    long = "word other " * 60_000 + "idiot"
    rows = [(1, None), (2, ""), (3, " \t"), (4, long), (5, "x" * 500_000), (6, "é idiot"), (6, "é idiot"), (None, "idiot")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(1))
    got = T.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[3].score
    assert [by[i].held_out for i in (1, 2, 3, 4, 5, 6)] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 2, 3, 4, 5, 6)] and by[None].held_out is False
    kept = T.keep_clean(df, model)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)
    assert T.score(df.limit(0), model).collect() == []


def test_held_out_labels_are_not_learnt(spark, sf):
    """Turning the held-out labels around changes no score."""
    docs, labels, model = fitted(spark, sf)
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = T.train(T.labelled_sample(docs, turned))
    assert again.chosen == model.chosen and np.array_equal(again.weights, model.weights) and again.intercept == model.intercept


def test_one_sided_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (3, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    model = T.train(T.labelled_sample(docs, labels))
    assert {r.predicted for r in T.score(docs, model).collect()} == {0}
    assert T.train(T.labelled_sample(docs, labels.limit(0))).score([]) < 0.01


def test_sample_bound(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    n = T.labelled_sample(docs, labels, 500).count()
    assert 350 < n < 650


def test_gradient():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(200)]
    labels = np.array([float(3 in r) for r in rows])
    weights, intercept = T.fit_weights(rows, labels, np.ones(30), 0.1)
    predicted = np.array([weights[r].sum() + intercept > 0 for r in rows])
    assert (predicted == (labels > 0)).mean() > 0.98


def test_rare_words_without_clean_uses_are_learnt(spark):
    """Six toxic rows of 60 share a word that no other row has."""
    rows = [(i, f"plain words number {'abcdefghij'[i % 10]} {'vile' if i < 6 else 'fine'}") for i in range(60)]
    labelled = spark.createDataFrame([(t, int(i < 6)) for i, t in rows], "text string, toxic int")
    model = T.train(labelled)
    assert T.word_buckets("vile") & set(model.chosen)
    found = {r.doc_id: r.predicted for r in T.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert found == {i: int(i < 6) for i, _ in rows}


def brute_grams(text):
    line = f" {' '.join(text.lower().split())} "
    return {line[i : i + n] for n in T.GRAMS for i in range(len(line) - n + 1)} if text.split() else set()


def test_all_characters_count(monkeypatch):
    """Each n-gram, whatever its characters, has one bucket; stretches of a long text change nothing."""
    texts = ["", " \n", "a", "ab", "Tr4$h  y0u\n*idiot* 😀 É", "i d i o t", "x" * 30, "w1 w2 " * 40]
    number = {}
    for text in texts:
        grams, found = brute_grams(text), T.buckets_of(text).tolist()
        assert len(found) == len(set(found)) == len(grams)
        for g in grams:
            number.setdefault(g, set(found))
            number[g] &= set(found)
    assert all(number.values())
    whole = [sorted(T.buckets_of(t).tolist()) for t in texts]
    monkeypatch.setattr(T, "STRETCH", 7)
    assert [sorted(T.buckets_of(t).tolist()) for t in texts] == whole


def test_spellings_with_digits_and_symbols_are_learnt(spark):
    rows = [(i, f"plain words number {'abcdefghij'[i % 10]} {['tr4$h', '1d10t'][i % 2] if i < 12 else 'fine'}") for i in range(80)]
    model = T.train(spark.createDataFrame([(t, int(i < 12)) for i, t in rows], "text string, toxic int"))
    found = {r.doc_id: r.predicted for r in T.score(spark.createDataFrame([(1, "a tr4$h here"), (2, "a fine day"), (3, "1d10t")], "doc_id long, text string"), model).collect()}
    assert found == {1: 1, 2: 0, 3: 1}
