"""Token counts as delta-maintained rollups.

Changes to a corpus arrive as batches of signed rows: an insert adds a
document's tokens, a delete takes them away, a revision adds the difference of
a new count to an old one. Each batch is added up by source, language and
tokenizer version before it is shuffled or stored, and totals are sums over the
committed batches, so they follow any order of batches.

A batch is written aside and committed by one rename of its folder, which fails
where the batch is there already: a driver lost before it leaves nothing that
counts, one lost after it a whole batch. Compaction adds batches up in a base
that also names them, committed by a rename likewise; what a base replaces is
deleted at the next compaction, so readers of the old one can finish.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, shared_folder, slices
from .subwords import byte_bpe

#: What totals are kept by.
KEYS = ("source", "lang", "version")
_TOTALS = "source string, lang string, version string, docs long, tokens long"
#: Batches after which a commit compacts.
COMPACT_AT = 64


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, words and tokens (ids of a byte-level BPE file) of every row of ``docs``.

    Null and empty texts have neither; very long ones are counted whole.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer).encode
        for batch in slices(batches):
            *columns, texts = batch.columns
            tokens = [len(encode(t)) // 4 for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens, pa.int64())], names=["doc_id", "source", "lang", "words", "tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), words.alias("words"), text.alias("text"))
    return columns.mapInArrow(counted, "doc_id long, source string, lang string, words long, tokens long")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed totals of ``changes`` (op, source, lang, version, tokens, old_tokens), one row per key.

    op is insert, delete or revise; old_tokens counts for revise alone. Other
    ops and null counts change nothing. Keys may be null.
    """
    op = F.col("op")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0).cast("long")
    new, old = F.coalesce("tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
    tokens = F.when(op == "insert", new).when(op == "delete", -new).when(op == "revise", new - old).otherwise(F.lit(0).cast("long"))
    return changes.groupBy(*KEYS).agg(F.sum(docs).alias("docs"), F.sum(tokens).alias("tokens"))


class Rollup:
    """Totals in a folder that driver and executors share.

    ``deltas/batch=NAME`` holds a committed batch, ``bases/N`` the Nth base:
    its ``totals`` and the names of the ``batches`` in them.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, compact_at: int = COMPACT_AT):
        self.spark, self.compact_at = spark, compact_at
        self.folder = folder or f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        conf = spark._jsc.hadoopConfiguration()
        root = hadoop.Path(self.folder)
        self._files = root.getFileSystem(conf)
        self._renames = hadoop.FileContext.getFileContext(root.makeQualified(self._files.getUri(), self._files.getWorkingDirectory()).toUri(), conf)
        self._no_options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _listed(self, name: str) -> list[str]:
        at = self._path(f"{self.folder}/{name}")
        return [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []

    def _commit(self, attempt: str, final: str) -> bool:
        """Rename a folder that is written whole; False if ``final`` is there already."""
        target = self._path(f"{self.folder}/{final}")
        self._files.mkdirs(target.getParent())
        try:
            self._renames.rename(self._path(f"{self.folder}/{attempt}"), target, self._no_options)
        except Exception:
            if not self._files.exists(target):
                raise
            self._files.delete(self._path(f"{self.folder}/{attempt}"), True)
            return False
        return True

    def _base(self) -> tuple[int, set[str]]:
        """The newest base's number (0: none) and the batches in it."""
        number = max(map(int, self._listed("bases")), default=0)
        if not number:
            return 0, set()
        return number, {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/bases/{number}/batches").toLocalIterator()}

    def _deltas(self) -> set[str]:
        return {unquote(d.removeprefix("batch=")) for d in self._listed("deltas") if d.startswith("batch=")}

    def committed(self) -> set[str]:
        """Names of the committed batches."""
        return self._base()[1] | self._deltas()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False if it is committed already."""
        if not batch:
            raise ValueError("a batch is named by a non-empty string")
        if batch in self.committed():
            return False
        attempt = f"attempts/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.folder}/{attempt}")
        done = self._commit(attempt, f"deltas/batch={quote(batch, safe='')}")
        if len(self._listed("deltas")) >= self.compact_at:
            self.compact()
        return done

    def _rows(self) -> tuple[int, set[str], DataFrame]:
        """The newest base's number, its batches, and the rows that make the totals now."""
        number, inside = self._base()
        parts = [f"{self.folder}/deltas/batch={quote(b, safe='')}" for b in sorted(self._deltas() - inside)]
        if number:
            parts.append(f"{self.folder}/bases/{number}/totals")
        rows = self.spark.read.schema(_TOTALS).parquet(*parts) if parts else self.spark.createDataFrame([], _TOTALS)
        return number, inside, rows

    def totals(self) -> DataFrame:
        """source, lang, version, docs and tokens; keys whose documents and tokens are all gone are left out."""
        return _added_up(self._rows()[2])

    def compact(self) -> bool:
        """Add all batches up in a new base; False if another compaction was first.

        Deletes what the newest base had replaced already.
        """
        number, inside, _ = self._rows()
        here = self._deltas()
        for old in here & inside:
            self._files.delete(self._path(f"{self.folder}/deltas/batch={quote(old, safe='')}"), True)
        for old in map(int, self._listed("bases")):
            if old < number:
                self._files.delete(self._path(f"{self.folder}/bases/{old}"), True)
        fresh = sorted(here - inside)
        if not fresh:
            return False
        parts = [f"{self.folder}/deltas/batch={quote(b, safe='')}" for b in fresh] + ([f"{self.folder}/bases/{number}/totals"] if number else [])
        attempt = f"attempts/{uuid.uuid4().hex}"
        _added_up(self.spark.read.schema(_TOTALS).parquet(*parts)).write.parquet(f"{self.folder}/{attempt}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(inside | set(fresh))], "batch string").coalesce(1).write.parquet(f"{self.folder}/{attempt}/batches")
        return self._commit(attempt, f"bases/{number + 1}")

    def drop(self) -> None:
        """Delete the rollup's folder."""
        self._files.delete(self._path(self.folder), True)


def _added_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def corpus_totals(docs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """Totals of ``docs`` (doc_id, source, lang, text), maintained through five batches.

    All rows are inserted with their number of words as an estimate, under
    ``version`` and under ``words``; the estimates of ``version`` are revised to
    the tokenizer's counts; rows without words are deleted and inserted again;
    the revision is sent again, which changes nothing; and the batches are
    compacted. So totals cover all rows, null, empty and white-space-only ones
    among them. Repeated rows count as often as they occur; null sources and languages are keys of their own; other columns are
    ignored; an empty table gives no rows.
    """
    counts = cut(count_tokens(docs, tokenizer))
    rollup = Rollup(docs.sparkSession)
    none = F.lit(None).cast("long")

    def changes(rows: DataFrame, op: str, name: str, tokens, old=none) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(name).alias("version"), tokens.alias("tokens"), old.alias("old_tokens"))

    empty = counts.where("words = 0")
    revision = changes(counts, "revise", version, F.col("tokens"), F.col("words"))
    rollup.commit("insert", changes(counts, "insert", version, F.col("words")).unionByName(changes(counts, "insert", "words", F.col("words"))))
    rollup.commit("revise", revision)
    for op, batch in (("delete", "delete"), ("insert", "insert again")):
        rollup.commit(batch, changes(empty, op, version, F.col("tokens")).unionByName(changes(empty, op, "words", F.col("words"))))
    rollup.commit("revise", revision)
    rollup.compact()
    totals = cut(rollup.totals())
    rollup.drop()
    return totals
