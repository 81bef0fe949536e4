import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trawl.llm import binary_output, packing
from trawl.llm.subwords import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n  a  b \n", "<|endoftext|>x <|endoftext|>", "É\x1c\x85　ẞ", "a" * 40_000, " " * 5000 + "b", "word " * 30_000, "I'll can't 1234 ½ ² ͸"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_library_s(library):
    bpe = ByteBpe(PATH)
    points = [f"a{chr(k)}1{chr(k)} {chr(k)}" for k in range(0, 0x30000) if not 0xD800 <= k < 0xE000]
    for texts in (ODD, points):
        for text, ids in zip(texts, library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
            assert np.frombuffer(bpe.encode(text), "<u4").tolist() == ids.ids


def frame(spark, sf, odd=True):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)] + [(10**6 + 3, ODD[3]), (None, "no id")], "doc_id long, text string")
    return docs.unionByName(extra).withColumn("length", F.lit("clash")).withColumn("start", F.lit(0))


def test_every_id_lies_in_one_piece(spark, sf, library):
    docs = frame(spark, sf)
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append([*library_ids(library, r.text), 1])
    rows = packing.pack(docs, PATH).collect()
    by_doc, by_row = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_row.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc_id, pieces in by_doc.items():
        expected = ids[doc_id]
        total = len(expected[0])
        if len(expected) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == total
                assert p.ids_crc32 == zlib.crc32(np.array(expected[0][at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == total
        else:  # repeated rows: every piece twice over in sum
            assert sum(p.length for p in pieces) == sum(map(len, expected))
    padding = 0
    for pieces in by_row.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.05 * sum(r.length for r in rows)
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_windows_are_near_equal_and_rise():
    rng = random.Random(1)
    sizes = [rng.randint(1, 500) for _ in range(400)]
    windows = packing.difference(sizes, 48)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(400)) and max(sums) - min(sums) < 40
    groups = packing.divide([1500] * 5, 2048)
    assert len(groups) == 5  # ceil(7500 / 2048) = 4 can't hold them
    assert packing.divide([], 2048) == [] and packing.difference([], 3) == [[], [], []]
    assert packing.difference([3, 3, 3], 1) in ([[0, 1, 2]], [[2, 1, 0]], [[0, 2, 1]], [[1, 0, 2]], [[1, 2, 0]], [[2, 0, 1]])


def brute_best_fit(sizes, capacity):
    rows, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in range(len(rows)) if room[r] >= sizes[i]]
        if fits:
            at = min(fits, key=lambda r: room[r])
        else:
            at = len(rows)
            rows.append(0)
            room.append(capacity)
        room[at] -= sizes[i]
    return sorted(room)


@pytest.mark.parametrize("capacity", [7, 64, 100, 2048])
def test_segment_tree_finds_the_best_fit(capacity):
    rng = random.Random(capacity)
    for _ in range(30):
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        rows = binary_output.best_fit(sizes, capacity)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(capacity - sum(sizes[i] for i in r) for r in rows) == brute_best_fit(sizes, capacity)


def test_packed_rows_round_trip(spark, sf, library, tmp_path):
    docs = frame(spark, sf)
    folder = str(tmp_path / "rows")
    binary_output.write_rows(binary_output.pack_rows(docs, PATH, block=50_000), folder)
    rows = spark.read.parquet(folder).collect()
    parts = {}
    for r in rows:
        ids = np.frombuffer(bytes(r.input_ids), "<u2")
        assert len(ids) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for doc_id, start, piece, positions in binary_output.segments(r):
            assert positions.tolist() == list(range(len(piece)))
            parts.setdefault(doc_id, []).append((start, piece.tolist()))
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in docs.where("doc_id is not null and doc_id <> 1000003").collect():
        assert sum((p for _, p in sorted(parts.pop(r.doc_id))), []) == [*library_ids(library, r.text), 1]
    assert set(parts) == {None, 10**6 + 3}
    assert sum(r.n_tokens for r in rows) > 0.9 * 2048 * len(rows)
    assert binary_output.pack_rows(docs.limit(0), PATH).collect() == []


def test_only_what_must_be_cut_is_cut(spark):
    """Pieces of a document: whole windows and one rest; ``piece`` cuts rests for less padding."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(1, 5000) if i % 9 == 0 else rng.randint(1, 900)))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    padded = {}
    for piece in (None, 256):
        found = packing.pack(docs, PATH, piece=piece).collect()
        per_row, per_doc = {}, {}
        for r in found:
            per_row[r.sequence_id] = per_row.get(r.sequence_id, 0) + r.length
            per_doc.setdefault(r.doc_id, []).append(r)
        assert max(per_row.values()) <= packing.CAPACITY
        if piece is None:
            more = sum(len(p) - -(-p[0].doc_tokens // packing.CAPACITY) for p in per_doc.values())
            assert more < packing.WINDOWS * 4 and sum(len(p) for p in per_doc.values()) < 1.5 * len(rows)
        padded[piece] = len(per_row) * packing.CAPACITY / sum(per_row.values()) - 1
    assert padded[256] < padded[None] < 0.05
