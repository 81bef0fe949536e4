import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trawl.llm import binary_output, packing, subwords, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("space", [" ", "\n", "\u00a0", " \n"])
@pytest.mark.parametrize("length", [subwords.LONG_SPACE - 1, subwords.LONG_SPACE, 1_000_001, 2_000_000, 5_000_000])
def test_long_white_space(library, space, length):
    """Runs with and without something before and after them, special tokens among it."""
    run = space * (length // len(space))
    bpe = subwords.ByteBpe(PATH)
    cases = [("", ""), ("a", "b c"), ("<|endoftext|>", "<|endoftext|>x"), (".", "'s ½")] if length < 5_000_000 else [("a", "b")]
    for before, after in cases:
        text = before + run + after
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, (before, after)


def test_several_runs(library):
    run = " " * subwords.LONG_SPACE
    text = f"x{run}y{run}\n z{run}<|endoftext|>{run}"
    assert np.frombuffer(subwords.ByteBpe(PATH).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("length", [1_000, subwords.LONG_SPACE - 1, subwords.LONG_SPACE])
def test_many_runs_take_no_time(library, length):
    """Ten million characters of runs just below the bound, or of any length, are read in one pass."""
    bpe = subwords.ByteBpe(PATH)
    text = ("x" + " " * length) * (1_000_000 // length)
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    began = time.perf_counter()
    bpe.encode(text * 10)
    assert time.perf_counter() - began < 10


def test_operators_read_long_white_space_whole(spark, library):
    rows = [(k, "a" + space * 1_000_000 + "b", "en", "s") for k, space in enumerate((" ", "\n", "\u00a0"))]
    sizes = {k: len(library.encode(t, add_special_tokens=False).ids) for k, t, _, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.tokens for r in token_counts.count_tokens(docs, PATH).collect()} == sizes
    pieces = packing.pack(docs, PATH).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in pieces} == {k: n + 1 for k, n in sizes.items()}
    assert sum(r.n_tokens for r in binary_output.pack_rows(docs, PATH).collect()) == sum(sizes.values()) + 3
