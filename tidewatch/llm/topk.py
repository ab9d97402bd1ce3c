"""Exact top-k by exhaustive term-at-a-time accumulation.

Vectors become whole numbers, floor(256 * x). A block of rows is turned into postings, for each term (component) the
rows with a weight there; a sparse query row goes through its terms one at a time and scatters its weight times the
postings into a dense array of scores. The highest scores are picked by partition selection and merged over blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidewatch.llm.search import leading, search_blocks, usable

SCALE = 256
EVERY = 50
TOP = 5
TILE = 4096
QUERIES = 128


LIMIT = (1 << 63) - 1


def whole(x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """floor(256 * x), and the rows with a weight whose sums of products could leave 64 bits (above 2^28 at 64
    components) as Python integers; these rows are zeros in the first."""
    most = float(int((2.0**62 / max(1, x.shape[1])) ** 0.5))
    scaled = np.floor(SCALE * x.astype(np.float64))
    large = np.flatnonzero((np.abs(scaled) > most).any(axis=1))
    exact = {int(i): np.array([int(w) for w in scaled[i]], object) for i in large}
    scaled[large] = 0
    return scaled.astype(np.int64), exact


def products(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Inner products in Python integers; those that leave 64 bits end at its limits. What one side lacks is 0."""
    width = min(rows.shape[1], len(row))
    return np.array([min(LIMIT, max(-LIMIT, int(x))) for x in (rows[:, :width].astype(object) * row[:width]).sum(axis=1)], np.int64)


def restored(weights: np.ndarray, large: dict[int, np.ndarray], at: int) -> np.ndarray:
    """Rows from `at` on as Python integers, with those that `large` has."""
    out = weights.astype(object)
    for i, row in large.items():
        if at <= i < at + len(out):
            out[i - at] = row
    return out


class Postings:
    """A block's rows by term."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.weights, self.large = whole(vectors)
        self.tiles = []
        for at in range(0, len(ids), TILE):
            part = self.weights[at : at + TILE]
            rows = [np.flatnonzero(part[:, t]) for t in range(part.shape[1])]
            self.tiles.append((at, len(part), [(None if len(r) == len(part) else r, np.ascontiguousarray(part[r, t])) for t, r in enumerate(rows)]))

    def accumulate(self, n: int, terms: list, tile_size: int, postings: list) -> np.ndarray:
        """Dense scores of n queries; terms: for each term the queries that hold it and their weights."""
        scores = np.zeros((n, tile_size), np.int64)
        for (lines, weight), (rows, posted) in zip(terms, postings, strict=False):
            if len(lines) and len(posted):
                add = weight[:, None] * posted
                if rows is not None:
                    scores[lines[:, None], rows] += add
                elif len(lines) == n:
                    scores += add
                else:
                    scores[lines] += add
        return scores

    def __call__(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = []
        asked, large = whole(queries)
        for i in range(0, len(query_ids), QUERIES):
            q, own = asked[i : i + QUERIES], query_ids[i : i + QUERIES]
            holds = [np.flatnonzero(q[:, t]) for t in range(q.shape[1])]
            terms = [(h, q[h, t]) for t, h in enumerate(holds)]
            for at, size, postings in self.tiles:
                scores = self.accumulate(len(q), terms, size, postings)
                for row in (r for r in self.large if at <= r < at + size):
                    scores[:, row - at] = products(restored(q, large, i), self.large[row])
                for line in (x for x in large if i <= x < i + len(q)):
                    scores[line - i] = products(restored(self.weights[at : at + size], self.large, at), large[line])
                ids = self.ids[at : at + size]
                low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
                for line in np.flatnonzero(high > low):
                    scores[line, low[line] : high[line]] = np.iinfo(np.int64).min
                line, column = leading(scores, self.k)
                score = scores[line, column]
                kept = score > np.iinfo(np.int64).min
                out.append((own[line[kept]], ids[column[kept]], score[kept]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def exact_top(vectors: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """The k rows with the largest whole-number inner products for each row whose vec_id is divisible by `every`, ties to
    the smaller vec_id. Vectors that are null or hold a null or a number that isn't finite take no part; components
    that a shorter vector lacks are 0. Scores are exact; those beyond 64 bits end at its limits, and tie. For rows without vec_id, repeated rows and empty tables see search_blocks."""
    return search_blocks(vectors.where(usable()), every, k, Postings, "long")


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
