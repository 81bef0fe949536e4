"""Packing documents into windows of near-equal length by multiway differencing.

Every document's ids, with a closing id, are cut into whole windows as long as
they fill one; what is left, uncut, is gathered into pools of about ``windows``
windows. Karmarkar and Karp's differencing method divides a pool: each piece
begins as a partial partition (its length in one window, nothing in the
others); the two partial partitions with the largest imbalance are merged again
and again, the fullest window of one with the emptiest of the other, until one
partition is left. If its fullest window exceeds the capacity, the number of
windows rises by one and the pool is divided anew.

So only documents longer than a window are cut, each into whole windows and a
rest, and some of a partition's last pool where that saves windows. ``piece`` cuts rests into pieces of at most so many ids where less padding
is worth more fragments.

Pools are formed within an input partition, so nothing is shuffled, memory is
bounded by one Arrow batch and one pool, and a lost task repeats alone.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices
from .subwords import byte_bpe

#: Ids in a window.
CAPACITY = 2048
#: Windows' worth of ids in a pool.
WINDOWS = 128
#: The id that closes a document.
CLOSING_ID = 1

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Divide indices of ``lengths`` into ``windows`` groups of near-equal sums.

    A partial partition lists its filled windows alone, fullest first; the
    others are empty. Ties are broken by the order of creation, so equal input
    gives equal output.
    """
    heap = [(-n if windows > 1 else 0, i, [(n, [i])]) for i, n in enumerate(lengths)]
    if not heap:
        return [[] for _ in range(windows)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # Fullest of one meets emptiest of two; filled windows meet only where there are too many for all.
        both = max(0, len(one) + len(two) - windows)
        alone = len(one) - both, len(two) - both
        merged = one[: alone[0]] + two[: alone[1]] + [(a + b, x + y) for (a, x), (b, y) in zip(one[alone[0] :], reversed(two[alone[1] :]))]
        merged.sort(key=lambda m: -m[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], made, merged))
        made += 1
    groups = [g for _, g in heap[0][2]]
    return groups + [[] for _ in range(windows - len(groups))]


def divide(lengths: list[int], capacity: int) -> list[list[int]]:
    """Groups whose sums are at most ``capacity``; the number of groups rises whenever one exceeds it."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        groups = difference(lengths, windows)
        if all(sum(lengths[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        windows += 1


class Packer:
    """Packs a stream of documents; ``rows`` gathers one tuple for each piece."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, windows: int = WINDOWS, piece: int | None = None):
        self.next, self.capacity, self.piece = first_sequence, capacity, min(piece or capacity, capacity)
        self.most = max(1, windows) * capacity
        self.pool: list[tuple] = []
        self.held = 0
        self.rows: list[tuple] = []

    def _window(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, length, crc, total in pieces:
            self.rows.append((doc_id, start, length, crc, total, self.next, offset))
            offset += length
        self.next += 1

    def add(self, doc_id, ids: bytes) -> None:
        """One document's ids, four bytes each."""
        total, start = len(ids) // 4, 0
        view = memoryview(ids)

        def cut(length: int) -> tuple:
            nonlocal start
            part = view[4 * start : 4 * (start + length)]
            made = (doc_id, start, length, zlib.crc32(part), total, bytes(part))
            start += length
            return made

        while total - start >= self.capacity:
            self._window([cut(self.capacity)[:5]])
        while start < total:
            length = min(self.piece, total - start)
            if self.held + length > self.most:
                self.flush()
            self.pool.append(cut(length))
            self.held += length

    def flush(self) -> None:
        """Divide the pool into windows."""
        for group in divide([p[2] for p in self.pool], self.capacity):
            self._window([self.pool[i][:5] for i in sorted(group)])
        self.pool, self.held = [], 0

    def finish(self) -> None:
        """Divide the partition's last pool; it may be small and leave little to balance, so it is cut where that saves windows."""
        if not self.pool:
            return
        cut = [part for p in self.pool for part in self._parts(p, max(1, self.capacity // 4))]
        if len(divide([p[2] for p in cut], self.capacity)) < len(divide([p[2] for p in self.pool], self.capacity)):
            self.pool = cut
        self.flush()

    @staticmethod
    def _parts(piece: tuple, most: int) -> Iterator[tuple]:
        doc_id, start, length, _, total, ids = piece
        for k in range(0, length, most):
            part = ids[4 * k : 4 * (k + most)]
            yield doc_id, start + k, len(part) // 4, zlib.crc32(part), total, part

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, windows: int = WINDOWS, piece: int | None = None, closing_id: int = CLOSING_ID) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, start (ids of its document before it), length,
    ids_crc32, doc_tokens (its document's ids, the closing one included),
    sequence_id and offset (ids before it in its sequence).

    Null and empty texts have the closing id alone. Repeated rows are packed
    as often as they occur. Very long texts fill windows of their own and leave
    a rest. A null doc_id stays null. An empty table gives no rows. Other
    columns are ignored. Sequence ids are unique, not gapless: the high bits
    hold the input partition.
    """
    closing = int(closing_id).to_bytes(4, "little")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer).encode
        packer = Packer(TaskContext.get().partitionId() << 33, capacity, windows, piece)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):  # one text at a time
                packer.add(doc_id, encode(text.as_py()) + closing)
            yield _to_batch(packer.take())
        packer.finish()
        yield _to_batch(packer.take())

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(packed, RESULT)
