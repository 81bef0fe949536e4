"""The best rows of many queries, kept within a task while it goes through its batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .ranking import COMPARED

#: Rows of queries times k that a task holds (about); more queries are searched in several groups.
KEPT = 1_000_000
#: What unrounded values may differ by where rounded ones tie.
SLACK = 2 * 10.0**-COMPARED


class Leaders:
    """For ``n`` queries the ``k`` rows of the least value each, compared rounded; ties of the last place go to the smaller names.

    ``edge`` is what a row's value must not exceed to matter. Rows wait until
    they are as many as those kept, so memory is that of about 2 * n * k rows
    and of what is added at once.
    """

    def __init__(self, n: int, k: int):
        self.k, self.edge, self.waiting, self.most = k, np.full(n, np.inf), 0, max(n * k, 4096)
        self.rows = [(np.zeros(0, np.int32), np.zeros(0), np.zeros(0, object))]

    def add(self, queries: np.ndarray, values: np.ndarray, names: np.ndarray) -> None:
        if len(queries):
            self.rows.append((queries.astype(np.int32), values, names))
            self.waiting += len(queries)
            if self.waiting >= self.most:
                self._settle()

    def _settle(self) -> None:
        q, values, names = (np.concatenate(x) for x in zip(*self.rows))
        compared = np.round(values, COMPARED)
        order = np.lexsort((compared, q))
        q, values, names, compared = q[order], values[order], names[order], compared[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.flatnonzero(place == self.k - 1)
        self.edge[q[last]] = compared[last]
        kept, edge = place < self.k, self.edge[q]
        # Queries with more rows at their edge than there is room for: the smaller names stay.
        over = np.zeros(len(self.edge), bool)
        over[q[(place >= self.k) & (compared == edge)]] = True
        tied = np.flatnonzero(over[q] & (compared == edge))
        if len(tied):
            room = np.bincount(q[tied[kept[tied]]], minlength=len(over))
            ranks = np.unique(names[tied], return_inverse=True)[1]
            tied = tied[np.lexsort((ranks, q[tied]))]
            kept[tied] = np.arange(len(tied)) - np.searchsorted(q[tied], q[tied]) < room[q[tied]]
        self.rows, self.waiting = [(q[kept], values[kept], names[kept])], 0

    def batches(self, ids: np.ndarray, sign: int, size: int = 50_000) -> Iterator[pa.RecordBatch]:
        """query_id, passage_id and score (``sign`` times the value) of the rows kept."""
        self._settle()
        q, values, names = self.rows[0]
        for at in range(0, len(q), size):
            part = slice(at, at + size)
            columns = [pa.array(ids[q[part]].tolist(), pa.string()), pa.array(names[part].tolist(), pa.string()), pa.array(sign * values[part] + 0.0, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "passage_id", "score"])
