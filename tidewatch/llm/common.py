"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with this package put on the path of local Python workers."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Local workers import functions from this checkout; a cluster ships the package with --py-files instead. Batches
    that go to workers are held to BATCH_BYTES, unless the session has a lower limit: both ends hold several at a time."""
    limit = spark.conf.get(BATCH, "64m")
    if (int(limit.rstrip("b")) if limit.rstrip("b").isdigit() else BATCH_BYTES + 1) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column back to back, and each row's start (one more at the end); null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def row_groups(starts: np.ndarray, most: int):
    """Ranges of rows whose bytes come to `most` at most; a longer row is a range of its own."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each span, one span after the other."""
    lengths = lengths.astype(np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)


def give_back() -> None:
    """Returns freed memory to the system: a worker process lives on after its task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
