"""Approximate nearest neighbours with a forest of hash prefixes.

Each tree hashes a vector to BITS signs of projections on random orthogonal directions and keeps the hashes in a sorted
array. A query descends to its longest matching prefix in every tree, then all trees ascend together, a bit at a time,
until the prefixes hold enough rows; those rows are compared exactly. Inner products become angles by one more component
that gives every row the same length. Each block of rows (see search.py) is a forest of its own, and every row is in one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.search import leading, same_width, search_blocks, usable

TREES = 96
BITS = 32
SHARE = 0.45  # of a block's rows: prefixes grow until all trees together hold as many
LEAST = 2048
EVERY = 20
TOP = 20
SEED = 11


def directions(width: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Random directions, orthogonal in groups of `width`."""
    rng = np.random.default_rng([seed, width])
    groups = -(-trees * bits // width)
    return np.concatenate([np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(groups)], axis=1)[:, : trees * bits]


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal rows give equal numbers wherever they stand."""
    return (rows * query).sum(axis=1)


class Forest:
    """The trees of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k, self.vectors, self.lean = ids, k, vectors, vectors.astype(np.float32)
        length = np.sqrt((vectors * vectors).sum(axis=1))
        self.longest = length.max()
        lifted = np.concatenate([vectors / self.longest, np.sqrt(np.maximum(0, 1 - (length / self.longest) ** 2))[:, None]], axis=1)
        self.axes = directions(lifted.shape[1])
        keys = self.hashes(lifted)
        self.order = np.argsort(keys, axis=0, kind="stable").astype(np.int32).T.copy()
        self.keys = np.take_along_axis(keys.T, self.order, axis=1)

    def hashes(self, lifted: np.ndarray) -> np.ndarray:
        """(rows, trees) of hash strings, first sign in the top bit."""
        out = []
        for i in range(0, len(lifted), 1024):
            signs = (lifted[i : i + 1024] @ self.axes > 0).reshape(-1, TREES, BITS)
            out.append(np.packbits(signs, axis=2).view(">u4")[:, :, 0].astype(np.int64))
        return np.concatenate(out)

    def ranges(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the range of the sorted array where the trees' ascent ends."""
        n, want = len(asked), max(LEAST, SHARE * len(self.ids))
        low, high = np.zeros((TREES, n), np.int64), np.full((TREES, n), len(self.ids), np.int64)
        going = np.arange(n)
        for shift in range(BITS + 1):
            prefix = asked[going] >> shift
            lo, hi = np.empty((TREES, len(going)), np.int64), np.empty((TREES, len(going)), np.int64)
            for t in range(TREES):
                lo[t] = np.searchsorted(self.keys[t], prefix[:, t] << shift, "left")
                hi[t] = np.searchsorted(self.keys[t], prefix[:, t] + 1 << shift, "left")
            done = (hi - lo).sum(axis=0) >= want
            low[:, going[done]], high[:, going[done]] = lo[:, done], hi[:, done]
            going = going[~done]
            if not len(going):
                break
        return low, high

    def __call__(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        queries, rows = same_width(queries, self.vectors)
        lean = self.lean if rows is self.vectors else rows.astype(np.float32)
        width = self.axes.shape[0] - 1
        length = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        turned = np.concatenate([(queries / length)[:, :width], np.zeros((len(queries), 1))], axis=1)
        low, high = self.ranges(self.hashes(turned))
        first, last = np.searchsorted(self.ids, query_ids, "left"), np.searchsorted(self.ids, query_ids, "right")
        out = []
        for i, own in enumerate(query_ids):
            mark = np.zeros(len(self.ids), bool)
            for t in range(TREES):
                if high[t, i] > low[t, i]:
                    mark[self.order[t, low[t, i] : high[t, i]]] = True
            mark[first[i] : last[i]] = False
            near = np.flatnonzero(mark)
            if len(near) > self.k:  # single precision leaves out what is clearly farther
                with np.errstate(over="ignore", invalid="ignore"):
                    rough = lean[near] @ queries[i].astype(np.float32)
                slack = 1e-4 * float(length[i, 0]) * float(self.longest)
                if np.isfinite(rough).all() and np.isfinite(slack):
                    near = near[rough >= np.partition(rough, len(rough) - self.k)[len(rough) - self.k] - slack]
            score = inner(rows[near], queries[i])
            pick = leading(score[None], self.k)[1]
            out.append((np.full(len(pick), own), self.ids[near[pick]], score[pick]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(vectors: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """About the k rows with the largest inner products for each row whose vec_id is divisible by `every`; scores are
    exact, ties go to the smaller vec_id. Vectors that are null, zero or hold a null or a number that isn't finite take
    no part; components that a shorter vector lacks are 0. For rows without vec_id, repeated rows and empty tables see
    search_blocks. Every row is indexed; recall is measured against brute force in the tests."""
    some = F.exists("embedding", lambda x: x != 0)
    return search_blocks(vectors.where(usable() & F.coalesce(some, F.lit(False))), every, k, Forest, "double")
