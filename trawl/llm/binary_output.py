"""Packed token ids: best-fit decreasing with a segment tree over free room.

Documents' ids, each with a closing id, longer than a row are cut into full
rows and a rest; rests and shorter documents, longest first, go to the row
with the least room that holds them. A segment tree over the possible rooms
finds that row in steps of the logarithm of the row length, however many rows
are open. Rows come out as fixed-width little-endian id matrices with
cumulative segment lengths and position ids that begin anew in each segment.

Blocks of a partition are packed one by one, so memory is bounded and nothing
is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .subwords import byte_bpe

#: Ids in a row.
CAPACITY = 2048
#: Ids that are packed together.
BLOCK = 4_000_000
#: The ids that close a document and fill a row.
CLOSING_ID, PADDING_ID = 1, 0

RESULT = "sequence_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, n_tokens int, width int, input_ids binary, position_ids binary"


class RoomTree:
    """Open rows by the room they have left; finds the least room of at least a given size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the least room of at least ``size``."""
        at, count = size + self.leaves, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up until something lies to the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        self._add(room, -1)
        return room, row


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices of ``sizes``, each at most ``capacity`` in sum, by best fit in falling order."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            tree.put(room - sizes[i], row)
    return rows


def pack_rows(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, block: int = BLOCK, closing_id: int = CLOSING_ID, padding_id: int = PADDING_ID) -> DataFrame:
    """Packed rows of ``docs`` (doc_id, text).

    One row per sequence: sequence_id; doc_ids and starts of its segments (a
    split document's later segments start past 0); cu_seqlens from 0 on;
    n_tokens; width in bytes of an id; input_ids, ``capacity`` ids with padding
    at the end; position_ids, 16-bit up to 65,536 ids a row, zero at each
    segment's begin and in padding. Null and empty texts have the closing id
    alone; repeated rows are packed as often as they occur; very long texts are
    cut, without loss, into rows of their own and a rest; a null doc_id stays
    null. Other columns are ignored; an empty table gives no rows.
    """
    position_kind = "<u2" if capacity <= 1 << 16 else "<u4"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        kind = "<u2" if max(bpe.size, closing_id, padding_id) < 1 << 16 else "<u4"
        number = TaskContext.get().partitionId() << 33
        steps = np.arange(capacity, dtype=position_kind)
        pieces: list[tuple] = []
        held = 0

        def emit(rows: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal number
            columns: list[list] = [[] for _ in range(8)]
            for row in rows:
                sizes = [len(p[2]) for p in row]
                total = sum(sizes)
                ids = np.full(capacity, padding_id, kind)
                ids[:total] = np.concatenate([p[2] for p in row])
                positions = np.zeros(capacity, position_kind)
                positions[:total] = np.concatenate([steps[:n] for n in sizes])
                for column, value in zip(columns, (number, [p[0] for p in row], [p[1] for p in row], [0, *np.cumsum(sizes).tolist()], total, np.dtype(kind).itemsize, ids.tobytes(), positions.tobytes())):
                    column.append(value)
                number += 1
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["sequence_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", "width", "input_ids", "position_ids"])

        def rows_of(waiting: list[tuple]) -> Iterator[pa.RecordBatch]:
            found = best_fit([len(p[2]) for p in waiting], capacity)
            for k in range(0, len(found), 1000):
                yield emit([[waiting[i] for i in row] for row in found[k : k + 1000]])

        for batch in batches:
            full: list[list[tuple]] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(np.frombuffer(bpe.encode(text.as_py()), "<u4").astype(kind), np.array([closing_id], kind))
                whole = len(ids) // capacity * capacity
                full += [[(doc_id, k, ids[k : k + capacity])] for k in range(0, whole, capacity)]
                if whole < len(ids):
                    pieces.append((doc_id, whole, ids[whole:].copy()))
                    held += len(ids) - whole
                if len(full) >= 1000:
                    yield emit(full)
                    full = []
                if held >= block:
                    yield from rows_of(pieces)
                    pieces, held = [], 0
            if full:
                yield emit(full)
        if pieces:
            yield from rows_of(pieces)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(packed, RESULT)


def write_rows(packed: DataFrame, folder: str) -> None:
    """Write packed rows as Parquet files with the matrices as binary columns."""
    packed.write.mode("overwrite").parquet(folder)


def segments(row) -> Iterator[tuple]:
    """(doc_id, start, ids, positions) of each segment of one packed row."""
    ids = np.frombuffer(bytes(row["input_ids"]), f"<u{row['width']}")
    positions = np.frombuffer(bytes(row["position_ids"]), "<u2" if len(ids) <= 1 << 16 else "<u4")
    for k, (doc_id, start) in enumerate(zip(row["doc_ids"], row["starts"])):
        a, b = row["cu_seqlens"][k], row["cu_seqlens"][k + 1]
        yield doc_id, start, ids[a:b], positions[a:b]
