"""Exact duplicates by a log-structured merge index of digests.

Digests arrive in batches. Each task gathers a batch's digests in a memtable
and puts it out sorted when it is full and at its end; a flush merges these
into a run: blocks of sorted entries, dealt to shards by digest, each with a
Bloom filter. A batch is looked up in the runs before it: the filters are read
first, and only blocks whose filter lets a digest pass are searched. Compaction
merges all runs into one and keeps, for each digest, the number of its rows and
the identifier of the row that stays. However many copies a task has seen, they
are one entry.

Digests that occur twice are hits. Rows that may be hits (a Bloom filter of
bounded size tells) are verified byte by byte: their whole normalised texts are
grouped by digest and text, so texts that differ in spite of their digest form
classes of their own. Rows that can't be hits are neither fetched nor shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from xxhash import xxh64_intdigest

from .common import cut, drop_folder, meet, shared_folder, slices

#: Digests in a memtable.
MEMTABLE = 100_000
#: Entries in a block, and rows of the table for each shard.
BLOCK = 4096
#: Batches in which a table is added to its index.
BATCHES = 3
#: Runs from which a flush compacts.
RUNS = 4
#: Hex digits of SHA-256 that make a digest.
DIGITS = 64
#: Hash functions of a filter, and its bits for each key.
HASHES, BITS_A_KEY = 4, 12
#: Bits of the largest filter of hits (16 MB); beyond its load more rows are verified than need be, none fewer.
MOST_BITS = 1 << 27

_DELETED = b" \t\n\x0b\x0c\r"
_ENTRY = "digest string, n long, points long, doc_id long"
_RUN = f"shard long, block long, filter binary, entries array<struct<{_ENTRY.replace(' ', ':').replace(',:', ',')}>>"
_ENTRY_TYPE = pa.struct([("digest", pa.string()), ("n", pa.int64()), ("points", pa.int64()), ("doc_id", pa.int64())])


def _positions(digests: list[str], bits: int) -> np.ndarray:
    """The bits of each digest in a filter, one row a hash function: two halves of its XXH64, as Spark's xxhash64 computes it."""
    hashed = np.fromiter((xxh64_intdigest(d, 42) for d in digests), np.uint64, len(digests))
    low, high = (hashed & np.uint64(0xFFFFFFFF)).astype(np.int64), (hashed >> np.uint64(32)).astype(np.int64) | 1
    return (low + np.arange(HASHES)[:, None] * high) & (bits - 1)


def _room(keys: int) -> int:
    """Bits of a filter of ``keys`` keys: a power of two."""
    return max(64, 1 << (keys * BITS_A_KEY - 1).bit_length())


def filter_of(digests: list[str]) -> bytes:
    """A Bloom filter of a block."""
    bits = _room(len(digests))
    room = np.zeros(bits, bool)
    room[_positions(digests, bits).ravel()] = True
    return np.packbits(room, bitorder="little").tobytes()


def may_hold(bloom: np.ndarray, digests: list[str]) -> np.ndarray:
    """Whether a filter (its bytes) lets each digest pass."""
    at = _positions(digests, 8 * len(bloom))
    return ((bloom[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


def _rank(points: int, doc_id: int | None) -> tuple:
    """Most code points first, then the smallest id; a row without an id comes last."""
    return -points, doc_id is None, doc_id or 0


def digests(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """doc_id, digest (hex, of the text without white space), points (code points of the whole text), sha and batch of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() % BATCHES
        for batch in slices(batches):
            texts = batch.column(1)
            keys = [hashlib.sha256((t or b"").translate(None, _DELETED)).hexdigest() for t in texts.cast(pa.binary()).to_pylist()]
            points = pc.fill_null(pc.utf8_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), points, pa.array([number] * len(keys), pa.int32())], names=["doc_id", "sha", "points", "batch"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(made, "doc_id long, sha string, points long, batch int")
    return rows.withColumn("digest", F.substring("sha", 1, digits))


class DigestIndex:
    """Runs of digests in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, memtable: int = MEMTABLE, shards: int = 1):
        self.spark, self.memtable, self.shards = spark, memtable, max(1, shards)
        self.folder = folder or f"{shared_folder(spark)}/digests-{uuid.uuid4().hex}"
        self.runs: list[int] = []
        self._made = 0

    def _shard(self):
        return F.pmod(F.xxhash64("digest"), F.lit(self.shards)).alias("shard")

    def _read(self, runs: list[int]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], _RUN)
        return self.spark.read.schema(_RUN).parquet(*[f"{self.folder}/run-{k}" for k in runs])

    def _write(self, entries: DataFrame) -> int:
        """Merge ``entries`` into a run; a lost task's blocks leave no trace."""

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, number, held = None, 0, []
            made: list[tuple] = []

            def close() -> None:
                nonlocal number, held
                if held:
                    made.append((shard, number, filter_of([e["digest"] for e in held]), held))
                number, held = number + 1, []

            def put_out() -> pa.RecordBatch:
                rows = [*zip(*made)] or [[], [], [], []]
                made.clear()
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(_ENTRY_TYPE))
                return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(rows, kinds)], names=["shard", "block", "filter", "entries"])

            for batch in slices(batches):
                for at, digest, n, points, doc_id in zip(*(c.to_pylist() for c in batch.columns)):
                    if at != shard:
                        close()
                        shard, number = at, 0
                    if held and held[-1]["digest"] == digest:
                        last = held[-1]
                        last["n"] += n
                        if _rank(points, doc_id) < _rank(last["points"], last["doc_id"]):
                            last["points"], last["doc_id"] = points, doc_id
                        continue
                    if len(held) >= BLOCK:
                        close()
                    held.append({"digest": digest, "n": n, "points": points, "doc_id": doc_id})
                if made:
                    yield put_out()
            close()
            yield put_out()

        dealt = entries.select(self._shard(), "digest", "n", "points", "doc_id").repartition("shard").sortWithinPartitions("shard", "digest")
        number, self._made = self._made, self._made + 1
        dealt.mapInArrow(blocks, _RUN).write.mode("overwrite").parquet(f"{self.folder}/run-{number}")
        return number

    def flush(self, rows: DataFrame) -> DataFrame:
        """Add a batch of rows (digest, points, doc_id) as a run; returns the digests in it that have occurred before, in or outside the batch."""
        limit = self.memtable

        def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table: dict[str, list] = {}

            def sorted_run() -> pa.RecordBatch:
                keys = sorted(table)
                entries = [table[k] for k in keys]
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([e[i] for e in entries], pa.int64()) for i in range(3)]], names=["digest", "n", "points", "doc_id"])

            for batch in slices(batches):
                for digest, points, doc_id in zip(*(c.to_pylist() for c in batch.columns)):
                    entry = table.get(digest)
                    if entry is None:
                        if len(table) >= limit:
                            yield sorted_run()
                            table = {}
                        table[digest] = [1, points, doc_id]
                    else:
                        entry[0] += 1
                        if _rank(points, doc_id) < _rank(entry[1], entry[2]):
                            entry[1:] = points, doc_id
            if table:
                yield sorted_run()

        number = self._write(rows.select("digest", "points", "doc_id").mapInArrow(memtables, _ENTRY))
        fresh = self._read([number]).select(F.explode("entries").alias("e")).select("e.*")
        hits = cut(fresh.where("n > 1").select("digest").unionByName(self._found(fresh.where("n = 1").select("digest"), self.runs).select("digest")))
        self.runs.append(number)
        if len(self.runs) >= RUNS:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            number = self._write(self._read(self.runs).select(F.explode("entries").alias("e")).select("e.*"))
            for old in self.runs:
                drop_folder(self.spark, f"{self.folder}/run-{old}")
            self.runs = [number]

    def _found(self, asked: DataFrame, runs: list[int]) -> DataFrame:
        """Entries (digest, n, points, doc_id) of ``runs`` for distinct digests ``asked``: the filters say which blocks are searched."""
        if not runs:
            return self.spark.createDataFrame([], _ENTRY)

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = []
                for shard, block, run, bloom, keys in zip(*(c.to_pylist() for c in batch.columns)):
                    passed = [k for k, ok in zip(keys, may_hold(np.frombuffer(bloom, np.uint8), keys)) if ok]
                    if passed:
                        rows.append((shard, block, run, sorted(passed)))
                columns = [*zip(*rows)] or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())))], names=["shard", "block", "run", "keys"])

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    keys, entries = batch.column(0)[k].as_py(), batch.column(1)[k].values
                    names, hit = entries.field("digest").to_pylist(), []
                    for key in keys:
                        at = bisect_left(names, key)
                        if at < len(names) and names[at] == key:
                            hit.append(at)
                    yield pa.RecordBatch.from_struct_array(entries.take(pa.array(hit, pa.int64())))

        run = F.input_file_name().alias("run")
        asked = asked.select(self._shard(), "digest").groupBy("shard").agg(F.collect_list("digest").alias("keys"))
        named = self._read(runs).select("shard", "block", F.regexp_extract(run, r"run-(\d+)/[^/]*$", 1).alias("run"), "filter", "entries")
        passed = named.select("shard", "block", "run", "filter").join(asked, "shard").mapInArrow(passing, "shard long, block long, run string, keys array<string>")
        blocks = named.select("shard", "block", "run", "entries").join(passed, ["shard", "block", "run"])
        return blocks.select("keys", "entries").mapInArrow(searched, _ENTRY)

    def lookup(self, asked: DataFrame | str) -> DataFrame:
        """digest, n, doc_id and points of those ``asked`` (a column digest, or one digest) that the index holds."""
        if isinstance(asked, str):
            asked = self.spark.createDataFrame([(asked,)], "digest string")
        best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("lacks"), "doc_id"))
        merged = self._found(asked.select("digest").distinct(), self.runs).groupBy("digest").agg(F.sum("n").alias("n"), best.alias("best"))
        return merged.select("digest", "n", F.col("best.doc_id").alias("doc_id"), (-F.col("best.points")).alias("points"))

    def drop(self) -> None:
        """Delete the index's folder."""
        drop_folder(self.spark, self.folder)


def find_hits(rows: DataFrame, memtable: int = MEMTABLE) -> tuple[int, DataFrame]:
    """The number of ``rows`` (a written table of ``digests``), and digest, n, doc_id and points of digests of two rows or more."""
    total = rows.count()
    index = DigestIndex(rows.sparkSession, memtable=memtable, shards=-(-total // BLOCK))
    met = [index.flush(rows.where(F.col("batch") == k)) for k in range(BATCHES)] if total else []
    index.compact()
    asked = met[0] if met else rows.select("digest")
    for more in met[1:]:
        asked = asked.unionByName(more)
    hits = cut(index.lookup(asked))
    index.drop()
    return total, hits


def hit_filter(hits: DataFrame) -> np.ndarray:
    """A Bloom filter of the hits' digests, of MOST_BITS at most; built by the executors, one number for 64 bits comes to the driver."""
    bits = min(MOST_BITS, _room(hits.count()))
    hashed = F.xxhash64("digest")
    low, high = hashed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hashed, 32).bitwiseOR(F.lit(1))
    at = F.explode(F.array(*[(low + k * high).bitwiseAND(F.lit(bits - 1)) for k in range(HASHES)])).alias("at")
    words = hits.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("ones")).toArrow()
    room = np.zeros(bits // 64, np.int64)
    room[words.column("word").to_numpy()] = words.column("ones").to_numpy()
    return room.view(np.uint8)


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """``hit_filter`` of a column of ids, nulls among them."""
    return hit_filter(ids.select(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("null")).alias("digest")))


def may_hold_ids(bloom: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Whether an ``id_filter`` lets each id pass."""
    return may_hold(bloom, ["null" if i is None else str(i) for i in ids.cast(pa.int64()).to_pylist()])


class Verified:
    """Rows of ``docs`` (doc_id, text), parted by the index: ``passing`` digests can't be hits; ``found`` may be, and their texts are compared.

    With ``whole`` both keep all columns of ``docs``, in a struct of that name.
    """

    def __init__(self, docs: DataFrame, digits: int = DIGITS, memtable: int = MEMTABLE, whole: bool = False):
        spark = docs.sparkSession
        self.rows = cut(digests(docs, digits))
        self.total, self.hits = find_hits(self.rows, memtable)
        self.filter = spark.sparkContext.broadcast(hit_filter(self.hits))
        shared = self.filter
        long_id, text = docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")
        kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")] if whole else []
        columns = ["uid long", "doc_id long", "points long", "sha string", "plain string"]
        schema = StructType([*StructType.fromDDL(", ".join(columns)).fields, *([StructField("whole", docs.schema)] if whole else [])])

        def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uid = TaskContext.get().partitionId() << 33
            for batch in slices(batches):
                plain = [(t or b"").translate(None, _DELETED) for t in batch.column(1).cast(pa.binary()).to_pylist()]
                keys = [hashlib.sha256(p).hexdigest() for p in plain]
                here = np.flatnonzero(may_hold(shared.value, [k[:digits] for k in keys]))
                if len(here):
                    some = batch.take(pa.array(here))
                    points = pc.fill_null(pc.utf8_length(some.column(1)), 0).cast(pa.int64())
                    made = [pa.array(range(uid, uid + len(here)), pa.int64()), some.column(0), points, pa.array([keys[i] for i in here], pa.string()), pa.array([plain[i] for i in here], pa.binary()).cast(pa.string())]
                    uid += len(here)
                    yield pa.RecordBatch.from_arrays([*made, *some.columns[2:]], names=["uid", "doc_id", "points", "sha", "plain", *["whole"] * whole])

        folder = f"{shared_folder(spark)}/candidates-{uuid.uuid4().hex}"
        docs.select(long_id, text, *kept).mapInArrow(candidates, schema).write.parquet(folder)
        self.found = spark.read.schema(schema).parquet(folder).withColumn("of", F.substring("sha", 1, digits))

    def classes(self) -> DataFrame:
        """of, plain, size and best (uid and doc_id of the row that stays) of each text of ``found``.

        Copies are added up within tasks first, so a hot text is one row a task.
        """
        best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("lacks"), "doc_id", "uid"))
        return self.found.groupBy("of", "plain").agg(F.count(F.lit(1)).alias("size"), best.alias("best"))

    def singles(self, digits: int) -> DataFrame:
        """``rows`` that can't be hits."""
        shared = self.filter

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(~may_hold(shared.value, [k[:digits] for k in batch.column(1).to_pylist()])))

        return self.rows.select("doc_id", "sha").mapInArrow(passing, "doc_id long, sha string")


def deduplicate(docs: DataFrame, digits: int = DIGITS, memtable: int = MEMTABLE) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs`` (doc_id, text).

    Texts are equal when identical without white space ([\\x20\\x09-\\x0D]);
    null counts as empty, and all empty texts are equal. Of equal texts the row
    with the most code points stays, then that with the smallest doc_id; a row
    without a doc_id stays only if no other can, and of repeated rows one
    stays. Very long texts are digested whole. Other columns are ignored; an
    empty table gives no rows.
    """
    parts = Verified(docs, digits, memtable)
    one = F.lit(1).cast("long")
    single = parts.singles(digits).select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))

    classes = cut(parts.classes().select("of", F.col("size"), F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("stays")))
    # A digest of one text, and that is every digest unless SHA-256 is cut short or broken, is joined by itself: sizes and ids are the index's.
    texts = classes.groupBy("of").agg(F.count(F.lit(1)).alias("texts"), F.min("stays").alias("stays"), F.min("size").alias("size"), F.min("keep_id").alias("own"))
    known = parts.hits.select(F.col("digest").alias("of"), "n", "doc_id")
    verified = texts.where("texts = 1").join(known, "of", "left").select("of", F.coalesce("n", "size").alias("group_size"), F.when(F.col("n").isNotNull(), F.col("doc_id")).otherwise(F.col("own")).alias("keep_id"), "stays")
    verified = cut(verified)
    rows = parts.found.select("uid", "doc_id", "sha", "of")
    joined = meet(rows, verified.withColumn("rows", F.col("group_size")), "of", "rows", parts.total)
    # Of texts that share a digest, rows are joined by the whole text.
    apart = parts.found.join(texts.where("texts > 1").select("of"), "of", "left_semi")
    classes = parts.classes().join(texts.where("texts > 1").select("of"), "of", "left_semi")
    classes = classes.select("of", "plain", F.col("size").alias("group_size"), F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("stays"))
    apart = apart.join(classes, ["of", "plain"]).select(*joined.columns)
    both = joined.unionByName(apart)
    return single.unionByName(both.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("stays")).alias("kept"), F.col("sha").alias("text_sha256")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``deduplicate`` keeps, with all their columns.

    Rows that can't be hits pass as they are read; of each text among the
    others the row that stays comes out of the comparison itself.
    """
    parts = Verified(docs, whole=True)
    shared = parts.filter
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).cast(pa.string()).cast(pa.binary()).to_pylist()
            keys = [hashlib.sha256((t or b"").translate(None, _DELETED)).hexdigest() for t in texts]
            yield batch.filter(pa.array(~may_hold(shared.value, keys)))

    best = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("lacks"), "doc_id", "uid")
    stays = parts.found.groupBy("of", "plain").agg(F.min_by("whole", best).alias("whole")).select("whole.*")
    return docs.mapInArrow(passing, docs.schema).unionByName(stays)
