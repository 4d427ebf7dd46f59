"""The best rows of each query, kept while a task scores its rows block by block: pairs of query and row are never shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many queries are met in one scan of the rows.
QUERY_BLOCK = 4096
#: So many scores are held at a time.
CELLS = 2_000_000
#: A task gives up its k best rows of each query, so tasks are at most so many a core, however many rows there are.
TASKS_PER_CORE = 8


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to six places as SQL does, halves away from zero; for scores of 0 and more."""
    return np.floor(x * 1e6 + 0.5) / 1e6


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids that numpy sorts as Spark does."""
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), dtype=object)


class Best:
    """The k best rows of each of ``queries`` queries; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k, self.seen, self.new = queries, k, 0, 0
        #: Scores up to this cannot be among the best any more.
        self.limit = np.zeros(queries)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def blocks(self, rows: int) -> Iterator[slice]:
        """Slices of so many rows, short at first, when nearly all are among the best so far."""
        at = 0
        while at < rows:
            size = max(1, min(rows - at, CELLS // max(1, self.queries), max(64, self.seen)))
            yield slice(at, at + size)
            at, self.seen = at + size, self.seen + size

    def add(self, scores: np.ndarray, ids: np.ndarray, exact: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Scores of rows (one per id) by queries; 0 where they have nothing in common. ``exact`` gives the final scores of (row, query, score)."""
        row, q = np.nonzero(scores > self.limit)
        if len(row):
            self.parts.append((q.astype(np.int32), exact(row, q, scores[row, q]), ids[row]))
            self.new += len(row)
            if self.new > self.queries * self.k // 2:
                self.merge()

    def merge(self) -> None:
        if not self.parts:
            return
        q, score, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1], -score, q))
        q, score, ids = q[order], score[order], ids[order]
        start = np.searchsorted(q, np.arange(self.queries))
        place = np.arange(len(q)) - start[q]
        last = place == self.k - 1
        self.limit[q[last]] = np.maximum(0, score[last] - 1e-6)
        kept = place < self.k
        self.parts, self.new = [(q[kept], score[kept], ids[kept])], 0

    def result(self, qids: pa.Array, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(qid, id, score), with ids of the given type."""
        self.merge()
        for q, score, ids in self.parts:
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), pa.array(ids, type=kind), pa.array(score)], ["qid", "id", "score"])


def query_blocks(queries: DataFrame, n: int) -> Iterator[DataFrame]:
    """The queries (qid, ...) in parts of about ``QUERY_BLOCK`` of their ``n``."""
    blocks = max(1, -(-n // QUERY_BLOCK))
    for b in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)


def few_tasks(rows: DataFrame) -> DataFrame:
    return rows.coalesce(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
