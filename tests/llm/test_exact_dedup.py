import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trawl.llm import exact_dedup as E


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append(i)
    out = []
    for plain, members in groups.items():
        best = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0, i))
        for i in members:
            out.append((rows[i][0], rows[best][0], len(members), i == best, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("digest", F.lit("clash")).withColumn("n", F.lit(7))
    return sorted((tuple(r) for r in E.deduplicate(df, **kw).collect()), key=str)


ROWS = [(4, "a b"), (2, "ab"), (9, " a b"), (3, "a b "), (1, None), (6, ""), (5, " \n"), (7, "x"), (7, "x"), (7, "y"), (None, "z"), (None, "z"), (12, "z"), (None, "only"), (None, "only"), (8, "É " * 70_000), (10, "É" * 70_000), (11, "a b"), (13, "c" * 1000)]


@pytest.mark.parametrize("kw", [{}, {"digits": 1}, {"digits": 0}, {"memtable": 2}])
def test_edge_cases(spark, kw):
    """Shortened digests make different texts share one: byte verification parts them."""
    assert run(spark, ROWS, **kw) == brute(ROWS)


def test_empty(spark):
    assert run(spark, []) == []


def test_hot_group_and_table(spark, sf):
    rows = [(i, "the same  text" if i % 3 == 0 else f"text {i % 40} of many") for i in range(3000)]
    assert run(spark, rows) == brute(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in E.deduplicate(docs).collect()), key=str) == brute(rows)


def test_lookup(spark):
    index = E.DigestIndex(spark, memtable=3)
    rows = E.digests(spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], "doc_id long, text string"))
    index.flush(rows.where("doc_id < 20"))
    index.flush(rows.where("doc_id >= 20"))
    key = hashlib.sha256(b"t3").hexdigest()
    assert [tuple(r)[:3] for r in index.lookup(key).collect()] == [(key, 7, 3)]
    assert index.lookup("0" * 64).collect() == []


def test_whole_table_equals_sql(spark, sf):
    import duckdb

    from trawl.llm.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op9_exact_dedup"](spark, sf).collect())
    assert got == sorted(db.execute(ORACLE_SQL["op9_exact_dedup"]).fetchall()) and not all(r[3] for r in got)


def test_runs_filters_and_compaction(spark, monkeypatch):
    """A batch's hits come from the blocks whose filter lets them pass; compaction leaves one run with the smallest identifiers."""
    monkeypatch.setattr(E, "BLOCK", 4)
    index = E.DigestIndex(spark, memtable=5, shards=3)
    texts = [[f"t{i}" for i in range(40)], ["t3", "t3", "new", "n2", "n2"], ["t39", "other", "new"]]
    met = []
    for k, batch in enumerate(texts):
        met.append({r.digest for r in index.flush(E.digests(spark.createDataFrame([(100 - 10 * k - i % 10, t) for i, t in enumerate(batch)], "doc_id long, text string"))).collect()})
    name = {t: hashlib.sha256(t.encode()).hexdigest() for b in texts for t in b}
    assert met == [set(), {name["t3"], name["n2"]}, {name["t39"], name["new"]}]
    before = sorted(tuple(r) for r in index.lookup(spark.createDataFrame([(d,) for d in [*name.values(), "0" * 64]], "digest string")).collect())
    index.compact()
    runs = index._read(index.runs).collect()
    assert len(index.runs) == 1 and max(len(r.entries) for r in runs) <= 4
    for r in runs:
        keys = [e.digest for e in r.entries]
        assert keys == sorted(set(keys)) and E.may_hold(E.np.frombuffer(r.filter, "u1"), keys).all()
    other = [hashlib.sha256(b"none%d" % i).hexdigest() for i in range(2000)]
    assert max(E.may_hold(E.np.frombuffer(r.filter, "u1"), other).mean() for r in runs) < 0.1
    after = sorted(tuple(r) for r in index.lookup(spark.createDataFrame([(d,) for d in name.values()], "digest string")).collect())
    assert before == after and {r[0]: (r[1], r[2]) for r in after}[name["t3"]] == (3, 89)
    index.drop()


def test_copies_without_ids_in_many_partitions(spark):
    rows = [(None, "one text") for _ in range(600)] + [(i, f"t{i}") for i in range(60)] + [(7, "x")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted((tuple(r) for r in E.deduplicate(df).collect()), key=str) == brute(rows)


def test_verification_is_not_a_broadcast_of_rows(spark, sf):
    """What is broadcast is bounded: a thousand hot digests, never the hits."""
    plan = E.deduplicate(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
