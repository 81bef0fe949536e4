"""One registered query per corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_output import pack_rows
from .bpe import encode_decode
from .chat import format_turns
from .common import table
from .exact_dedup import deduplicate
from .hard_negatives import mine, shifted_labels
from .imatch import edited_likeness
from .oracles import ORACLE_SQL
from .packing import pack
from .quality import judge
from .runs import digest
from .simhash import near_duplicates
from .token_counts import corpus_totals
from .toxicity import labelled_sample, score, train
from .url_graph import judge as judge_urls


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal windows of at most 2048 ids over all documents."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents, as digests."""
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal texts stays, for all documents."""
    return deduplicate(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    return judge(table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled three quarters."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(labelled_sample(docs, table(spark, sf_dir, "labels"))))


def op8_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by source, language and tokenizer version."""
    return corpus_totals(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_50k")


def op4_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrices of all documents."""
    return pack_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked, ordered, validated and serialised turns of all conversations."""
    return format_turns(table(spark, sf_dir, "conversations"))


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_likeness(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector among all."""
    return mine(shifted_labels(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents."""
    return digest(table(spark, sf_dir, "documents"))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_simhash": op3_simhash,
    "op4_binary_output": op4_binary_output,
    "op5_packing": op5_packing,
    "op6_bpe": op6_bpe,
    "op7_chat": op7_chat,
    "op8_url_graph": op8_url_graph,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality": op10_quality,
    "op11_imatch": op11_imatch,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_runs": op13_runs,
}
