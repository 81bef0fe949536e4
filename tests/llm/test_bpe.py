import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trawl.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["I'll <|endoftext|>s ABC's don't 123 İstanbul ǅ ÄÖ Σίσυφος ΑΣ éx", "a" * 5000, "ab" * 3000 + " x", "<|endoftext|><|startoftext|>", "<|ENDOFTEXT|>", "é<|endoftext|>́ x\x1cy\x85z　w\n\n", "漢字かな交じり 한국어 العربية 😀👍🏽 ՘b", "", "\t \n", "lo" * 7 + "l" * 9]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return bpe.WordBpe(PATH)


def check(coder, library, texts):
    for text, (ids, decoded), expected in zip(texts, coder.encode_all(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == expected.ids, text[:80]
        assert decoded == coder.decode(ids) == library.decode(expected.ids, skip_special_tokens=False)


def test_odd_texts_and_code_points(coder, library):
    check(coder, library, ODD)
    check(coder, library, [f"a{chr(k)}1{chr(k)} {chr(k)}B" for k in range(0x20000) if not 0xD800 <= k < 0xE000])


def test_random_texts(coder, library):
    rng = random.Random(4)
    check(coder, library, ["".join(rng.choice("aabcde  'slte.,1é\n") for _ in range(rng.randint(0, 300))) for _ in range(600)])


def test_memory_bound(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "STRETCH", 50)
    check(bpe.WordBpe(PATH), library, ODD * 2 + ["the cat sat on the mat"] * 5)


def test_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(ODD)] + [(None, None), (7, "again"), (7, "again")], "doc_id long, text string"))
    docs = docs.withColumn("n_tokens", F.lit("clash"))
    expected = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((tuple(r) for r in bpe.encode_decode(docs, PATH).collect()), key=str) == sorted(expected, key=str)
    assert bpe.encode_decode(docs.limit(0), PATH).collect() == []
