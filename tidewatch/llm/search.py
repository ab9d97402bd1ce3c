"""Searches of a stated set of query vectors against all rows, in blocks.

The query rows are written to the shared folder once. Each task streams its part of the table in blocks of BLOCK_ROWS
rows and reads the queries beside it, QUERY_ROWS at a time; memory is a block, a batch of queries and their scores,
whatever the size of either. What the blocks of a task return is merged to the best rows for every query, MERGE_ROWS rows
at a time, and a rank over those gives the answer.
No row is copied, no key decides where a row goes, so repeated ids or vectors make no large task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.files import system
from tidewatch.storage import stage

BLOCK_ROWS = 16_384
QUERY_ROWS = 1024
MERGE_ROWS = 1 << 20


def usable(vector: str = "embedding"):
    """Whether a vector is there and all of its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def matrix(column: pa.ListArray) -> np.ndarray:
    """A row for each vector, as double; short vectors are filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == w else np.pad(x, ((0, 0), (0, w - x.shape[1]))) for x in (a, b))


def best_of(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query, ties to the smaller row id."""
    order = np.lexsort((row, -score if score.dtype.kind == "f" else ~score, query))
    query, row, score = query[order], row[order], score[order]
    first = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - first < k
    return query[keep], row[keep], score[keep]


def leading(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the k largest numbers of each line; of equal ones the first columns."""
    n, width = scores.shape
    if width <= k:
        return np.divmod(np.arange(n * width), max(width, 1))
    least = np.partition(scores, width - k, axis=1)[:, width - k]
    line, column = np.nonzero(scores > least[:, None])
    above = np.bincount(line, minlength=n)
    ties = [np.flatnonzero(scores[i] == least[i])[: k - above[i]] for i in range(n)]
    return np.concatenate([line, np.repeat(np.arange(n), [len(t) for t in ties])]), np.concatenate([column, *ties])


class BlockSearch:
    """mapInArrow function over (vec_id, embedding) rows."""

    def __init__(self, method, queries: str, k: int, score: str):
        self.method, self.queries, self.k, self.score = method, queries, k, score

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = [], 0
        for found in self.found(batches):
            best.append(found)
            rows += len(found[0])
            if rows > 2 * MERGE_ROWS:
                best = [best_of(*(np.concatenate(x) for x in zip(*best, strict=True)), self.k)]
                rows = len(best[0][0])
                if rows > MERGE_ROWS:
                    yield self.answer(best)
                    best, rows = [], 0
        if best:
            yield self.answer(best)

    def answer(self, best: list) -> pa.RecordBatch:
        merged = best_of(*(np.concatenate(x) for x in zip(*best, strict=True)), self.k)
        return pa.record_batch([pa.array(x) for x in merged], names=["query_id", "vec_id", self.score])

    def found(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                if n + part.num_rows > BLOCK_ROWS:
                    yield from self.block(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield from self.block(held)

    def block(self, held: list[pa.RecordBatch]) -> Iterator[tuple]:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = rows["vec_id"].combine_chunks().to_numpy()
        order = np.argsort(ids, kind="stable")
        search = self.method(ids[order], matrix(rows["embedding"].combine_chunks())[order], self.k)
        where, inner = system(self.queries)
        for q in pads.dataset(inner, filesystem=where, format="parquet").to_batches(batch_size=QUERY_ROWS):
            if q.num_rows:
                yield best_of(*search(q.column("vec_id").to_numpy(), matrix(q.column("embedding"))), self.k)


def search_blocks(vectors: DataFrame, every: int, k: int, method, kind: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by `every`.

    Rows without a vec_id take no part; rows that share a query's vec_id are its own and no candidates for it; of
    several vectors with a query's id the least is asked. Repeated other rows are candidates each. Empty tables give
    no rows.
    """
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull())
    asked = stage(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    found = rows.mapInArrow(BlockSearch(method, asked._tidewatch_path, k, "score"), f"query_id long, vec_id long, score {kind}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
