import random

from pyspark.sql import functions as F

import corpus_pipeline
from test_near_copies import brute_components
from trawl.llm import exact_dedup, packing, quality, simhash, toxicity


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("whole", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("stays", F.lit(2))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute_exact(rows):
    best = {}
    for i, r in enumerate(rows):
        key = "".join((r[1] or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}))
        rank = (-len(r[1] or ""), r[0] is None, r[0] or 0, i)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    return sorted((b[1] for b in best.values()), key=str)


def test_exact_stage(spark):
    texts = ["a b", "ab", " a b", None, "", "x", "x", "y", "z", "z", "z"]
    ids = [4, 2, 9, 1, 6, 7, 7, 7, None, None, 12]
    rows = [(i, t, "en", "s", 1) for i, t in zip(ids, texts)]
    got = [r[:5] for r in rows_of(exact_dedup.keep_first(frame(spark, rows)))]
    assert got == brute_exact(rows)
    assert rows_of(exact_dedup.keep_first(frame(spark, []))) == []


def test_near_stage(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(15):
        base = [rng.choice(vocabulary) for _ in range(2000)]
        for k in range(rng.randint(1, 4)):
            copy = list(base)
            copy[rng.randrange(2000)] = f"v{k}"
            rows.append((100 * g + k, " ".join(copy), "en", "s", 1))
    rows += [(3, rows[0][1], "en", "s", 1), (3, "other words entirely", "de", "s", 2), (rows[0][0], rows[0][1], "en", "s", 1), (None, None, "en", "s", 0), (None, "", "en", "s", 0), (9000, "alone", None, None, None)]
    df = frame(spark, rows)
    found = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    kept = rows_of(simhash.keep_one(df))
    components = {c for _, _, c in found if c is not None}
    null_groups = {f for _, f, c in found if c is None}
    assert len(kept) == len(components) + len(null_groups)
    print_of = {}
    for r in rows:
        print_of[r[0], r[1]] = f"{simhash.fingerprint_all([r[1].encode() if r[1] is not None else None])[0]:016x}"
    component = {(d, f): c for d, f, c in found}
    seen = [component[r[0], print_of[r[0], r[1]]] for r in kept]
    assert sorted(map(str, seen)) == sorted(map(str, [*components, *[None] * len(null_groups)]))
    assert all(r[0] == c for r, c in zip(kept, seen))
    assert simhash.keep_one(df).columns == df.columns
    assert rows_of(simhash.keep_one(frame(spark, []))) == []


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "exact_dedup", "simhash_near_dedup", "packing"]
    columns, counts = docs.columns, [docs.count()]
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, sf).collect(), before.schema)
        assert docs.columns == columns
        assert all(rows[r.doc_id] == r for r in docs.collect())
        counts.append(docs.count())
        ids = {r.doc_id for r in docs.collect()}
        if name == "quality_rules":
            assert ids == {r.doc_id for r in quality.judge(before).where("kept").collect()}
        elif name == "toxicity":
            model = toxicity.train(toxicity.labelled_sample(before, spark.read.parquet(f"{sf}/labels.parquet")))
            assert ids == {r.doc_id for r in toxicity.score(before, model).where("predicted = 0").collect()}
        elif name == "exact_dedup":
            assert ids == {r.doc_id for r in exact_dedup.deduplicate(before).where("kept").collect()}
        else:
            near = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert ids == {component for _, component in near}
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 3
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    per_row = {}
    for r in packed:
        per_row.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in per_row.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_stages_bound_arrow_batches(spark):
    import pyarrow as pa

    from trawl.llm.common import ARROW_ROWS

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = frame(spark, [(i, f"word{i} and more", "en", "s", 1) for i in range(20)])
    many = spark.range(0, 5_000, 1, 1)

    def most():
        return many.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").groupBy().max("n").first()[0]

    try:
        for stage, asked, seen in (("exact_dedup", "10000", ARROW_ROWS), ("simhash_near_dedup", "0", ARROW_ROWS), ("packing", "300", 300)):
            spark.conf.set(name, asked)
            dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
            assert most() == seen
    finally:
        spark.conf.unset(name)
