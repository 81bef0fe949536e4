import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import hard_negatives as H
from trawl.llm.oracles import ORACLE_SQL
from trawl.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, chunk string, kind int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=50, shift=True):
    """By the definition, pair by pair."""
    known = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if shift and vec_id is not None and vec_id % 7 == 0 else label
        known.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    anchors = {}
    for vec_id, label, numbers in sorted((r for r in known if r[0] is not None and r[0] % every == 0), key=lambda r: (r[0], r[1], len(r[2]), r[2])):
        anchors.setdefault(vec_id, (label, numbers))
    out = []
    for anchor, (label, numbers) in anchors.items():
        scored = [(-sum(a * b for a, b in zip(numbers, n)), v is None, v or 0, v, lab) for v, lab, n in known if len(n) == len(numbers)]
        scored.sort(key=lambda s: s[:3])
        for positive in [s for s in scored if s[4] == label and s[3] != anchor][:5]:
            p = -positive[0]
            fit = [s for s in scored if s[4] != label and 50 * p <= 100 * -s[0] <= 95 * p]
            out += [(anchor, positive[3], rank, s[3], p, -s[0]) for rank, s in enumerate(fit[:3], 1)]
    return out


def check(df, rows, **how):
    assert df.columns == COLUMNS
    got, expected = sorted(map(tuple, df.collect()), key=str), sorted(brute(rows, **how), key=str)
    assert got == expected
    return got


def vectors(n, width, seed, spread=1.0, labels=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, width))
    out = []
    for k in range(n):
        label = int(draw.integers(labels))
        v = centres[label] * draw.uniform(0, 1) + draw.normal(size=width) * spread
        out.append((k, (v / max(1e-9, np.linalg.norm(v))).astype(np.float32).tolist(), label))
    return out


def written(spark, rows, path):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("sizes", [(65_536, 2_048, 512, 8_192), (100, 20, 3, 16)], ids=["whole", "chunks"])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, sizes):
    """Groups of equal vectors, repeated rows, odd components and several widths, in one chunk and in many."""
    for name, size in zip(("CHUNK", "LEAST", "TILE", "BLOCK"), sizes):
        monkeypatch.setattr(H, name, size)
    rows = vectors(700, 64, 1) + [(1000 + k, vectors(1, 64, 9)[0][1], k % 3) for k in range(120)]
    rows += [(2000 + k, v, lab) for k, v, lab in vectors(150, 70, 2)] + [(3000 + 50 * k, [], k % 2) for k in range(5)]
    rows += [(50, rows[50][1], 1), (50, rows[51][1], 0), (51, rows[51][1], rows[51][2]), (None, rows[3][1], 1), (None, rows[3][1], None)]
    rows += [(4000, None, 1), (4050, [None] + [0.1] * 63, 1), (4100, [math.nan] + [0.1] * 63, 1), (4150, [math.inf] + [0.1] * 63, 2), (4200, [0.0] * 64, 1), (4250, [-1.0] * 64, 2), (4300, [0.5, -0.5], 3)]
    random.Random(4).shuffle(rows)
    folder = written(spark, rows, tmp_path)
    got = check(QUERIES["op12_hard_negatives"](spark, folder), rows)
    assert len({r[0] for r in got}) > 15
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    assert sorted(db.execute(ORACLE_SQL["op12_hard_negatives"]).fetchall(), key=str) == got


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert check(QUERIES["op12_hard_negatives"](spark, sf), rows)


@pytest.mark.parametrize("scale", [0.01, 1.0, 300.0, 70_000.0])
def test_any_magnitude(spark, scale):
    """Tiny numbers of one plane, numbers whose products outgrow single precision, and those at the bound."""
    rows = [(k, [min(65_536.0, max(-65_536.0, x * scale)) for x in v], lab) for k, v, lab in vectors(150, 5, 7)]
    check(H.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 10 == 0), rows, every=10, shift=False)


def test_components_beyond_the_bound(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, 0.0], 1), (2, [65_536.0, -3e38], 2), (3, [65_536.0 * 0.8, 0.0], 2)]
    held = [(i, [min(65_536.0, max(-65_536.0, x)) for x in v], lab) for i, v, lab in rows]
    check(H.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") == 0), held, every=10, shift=False)


def test_few_pairs_reach_the_last_plane(monkeypatch):
    """Rows that can't qualify are dropped before their last planes are read."""
    rows = vectors(5_000, 64, 3, labels=2)
    numbers = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    import pyarrow as pa

    labels = np.array([r[2] for r in rows])
    block = H.Block(pa.array(range(5_000)), labels, numbers, True)
    tile = H.Tile(np.arange(0, 5_000, 50), labels[::50], numbers[::50])
    read = []
    plain = H.Tile.plane_products
    monkeypatch.setattr(H.Tile, "plane_products", lambda self, block, plane, a, r: read.append((plane, len(a))) or plain(self, block, plane, a, r))
    H.find_positives(tile, block, 5)
    last = sum(n for plane, n in read if plane == 0)
    assert sum(n for plane, n in read if plane == 2) >= last and last < 0.02 * 100 * 2_500


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 0.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(None, None, None)]], ids=range(4))
def test_small_tables(spark, rows):
    check(H.mine(H.shifted_labels(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), F.col("vec_id") % 50 == 0), rows)


def test_planes_make_up_the_numbers():
    numbers = np.array([[-256, 256, 0, -1, 255], [7, -8, 3, 100, -100]])
    planes = H.planes_of(numbers)
    bits = H.bit_planes(numbers, planes)
    again = sum((-1 if p == planes - 1 else 1) * (((bits[p] >> np.arange(5, dtype=np.uint64)) & np.uint64(1)).astype(int) << p) for p in range(planes))
    assert (again == numbers).all() and planes == 10
