import re
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trawl.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "op string, source string, lang string, version string, tokens long, old_tokens long"


def totals(rollup):
    return sorted((tuple(r) for r in rollup.totals().collect()), key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.unionByName(spark.createDataFrame([(1, None, None, None), (2, " \n", "en", "s"), (3, "x y", None, "s"), (3, "x y", None, "s")], docs.schema)).withColumn("tokens", F.lit("clash"))
    library, count, size = Tokenizer.from_file(PATH), Counter(), Counter()
    for r in docs.collect():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        for version, n in (("words", words), ("bpe", len(library.encode(r.text or "").ids))):
            count[r.source, r.lang, version] += 1
            size[r.source, r.lang, version] += n
    got = sorted((tuple(r) for r in T.corpus_totals(docs, PATH, "bpe").collect()), key=str)
    assert got == sorted(((*k, count[k], size[k]) for k in count), key=str)
    assert T.corpus_totals(docs.limit(0), PATH, "bpe").collect() == []


def test_batches_are_signed_and_idempotent(spark):
    rollup = T.Rollup(spark)
    assert totals(rollup) == []
    first = spark.createDataFrame([("insert", "a", "en", "v1", 5, None), ("insert", "a", "en", "v1", 7, None), ("insert", None, None, "v1", 1, 99), ("other", "a", "en", "v1", 50, None)], SCHEMA)
    second = spark.createDataFrame([("delete", "a", "en", "v1", 5, None), ("revise", "a", "en", "v1", 9, 7), ("delete", None, None, "v1", 1, None), ("insert", "b", "en", "v2", None, None)], SCHEMA)
    assert rollup.commit("two", second) and rollup.commit("one", first)
    assert totals(rollup) == [("a", "en", "v1", 1, 9), ("b", "en", "v2", 1, 0)]
    assert not rollup.commit("one", first) and not rollup.commit("two", second)
    assert totals(T.Rollup(spark, rollup.folder)) == [("a", "en", "v1", 1, 9), ("b", "en", "v2", 1, 0)]


def test_an_attempt_without_a_marker_does_not_count(spark):
    rollup = T.Rollup(spark)
    changes = spark.createDataFrame([("insert", "a", "en", "v", 3, None)], SCHEMA)
    T.deltas(changes).write.parquet(f"{rollup.folder}/deltas/lost-attempt")
    assert totals(rollup) == []
    assert rollup.commit("b", changes) and totals(rollup) == [("a", "en", "v", 1, 3)]


def test_rows_without_words_count(spark):
    rows = [(1, None, "en", "blank"), (2, "", "en", "blank"), (3, " \n\t ", "en", "blank"), (3, " \n\t ", "en", "blank"), (4, " ", None, None), (5, "x y", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    library, count, size = Tokenizer.from_file(PATH), Counter(), Counter()
    for _, text, lang, source in rows:
        for version, n in (("words", len((text or "").split())), ("bpe", len(library.encode(text or "").ids))):
            count[source, lang, version] += 1
            size[source, lang, version] += n
    assert size["blank", "en", "bpe"] > 0
    got = sorted((tuple(r) for r in T.corpus_totals(docs, PATH, "bpe").collect()), key=str)
    assert got == sorted(((*k, count[k], size[k]) for k in count), key=str)


def test_a_driver_lost_before_the_rename_leaves_nothing(spark, monkeypatch):
    rollup = T.Rollup(spark)
    changes = spark.createDataFrame([("insert", "a", "en", "v", 3, None)], SCHEMA)

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(T.Rollup, "_commit", lost)
        try:
            rollup.commit("b", changes)
        except KeyboardInterrupt:
            pass
    again = T.Rollup(spark, rollup.folder)
    assert totals(again) == [] and again.committed() == set()
    assert again.commit("b", changes) and totals(again) == [("a", "en", "v", 1, 3)]


def test_of_two_attempts_one_counts(spark, monkeypatch):
    rollup, other = T.Rollup(spark), None
    changes = spark.createDataFrame([("insert", "a", "en", "v", 3, None)], SCHEMA)
    other = T.Rollup(spark, rollup.folder)
    with monkeypatch.context() as m:
        m.setattr(T.Rollup, "committed", lambda self: set())  # as if both had looked before either had renamed
        assert rollup.commit("b", changes) and not other.commit("b", changes)
    assert totals(rollup) == [("a", "en", "v", 1, 3)]


def test_compaction_keeps_totals_and_names(spark):
    rollup = T.Rollup(spark, compact_at=3)
    one = spark.createDataFrame([("insert", "a", "en", "v", 3, None), ("insert", None, None, "v", 1, None)], SCHEMA)
    names = ["b 1", "b/2", "_b3", "é=4", "5"]
    for k, name in enumerate(names):
        held = rollup.totals()
        assert rollup.commit(name, one) and not rollup.commit(name, one)
        assert totals(rollup) == [("a", "en", "v", k + 1, 3 * (k + 1)), (None, None, "v", k + 1, k + 1)]
        assert sorted(r.docs for r in held.collect()) == [k] * 2 * (k > 0)  # readers of the old state still can
    while rollup.compact():
        pass
    assert rollup.committed() == set(names) and not rollup.commit("b/2", one)
    assert totals(T.Rollup(spark, rollup.folder)) == [("a", "en", "v", 5, 15), (None, None, "v", 5, 5)]
    rollup.compact()
    assert rollup._listed("deltas") == [] and len(rollup._listed("bases")) == 1
