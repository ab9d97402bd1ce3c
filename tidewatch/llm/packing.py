"""Packing documents into sequences by power-of-two decomposition.

A document of n ids is cut into pieces of MAX_LENGTH and the binary digits of the rest, longest first. Each piece is a
sequence of its own, so no sequence crosses documents and none needs padding; sequences of one length form a bucket,
from which batches are drawn. The bucket stands in the sequence_id's top bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import give_back
from tidewatch.llm.tokens import END_ID, documents_ids, encoder, tokenizer_file

MAX_LENGTH = 4096
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
BATCH_BYTES = 1 << 22


def piece_lengths(n: int, most: int = MAX_LENGTH) -> list[int]:
    """n as whole pieces of `most` (a power of two) and falling powers of two."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class Packer:
    """mapInArrow function over (doc_id, text)."""

    def __init__(self, path: str, most: int, end_id: int):
        self.path, self.most, self.end_id = path, most, end_id

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = encoder(self.path), TaskContext.get().partitionId()
        made, rows, held = 0, [], 0
        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), documents_ids(coder, b.column("text"), self.end_id), strict=True):
                at, n = 0, len(ids)
                body = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                for size in piece_lengths(n, self.most):
                    rows.append((doc, at, size, bytes(body[4 * at : 4 * (at + size)]), n, (size.bit_length() - 1) << 58 | task << 36 | made, 0))
                    at += size
                    made += 1
                held += 4 * n
                if held >= BATCH_BYTES:
                    yield self.table(rows)
                    rows, held = [], 0
        if rows:
            yield self.table(rows)
        give_back()

    @staticmethod
    def table(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str | None = None, max_length: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Map-only: no shuffle, memory for one batch or one text. A null or empty text is the end id alone; a text of any
    length is cut into as many pieces as it takes; rows that repeat each other or share an id are packed as often as they
    occur, each with its own sequence_ids; an empty table gives no rows; columns but
    doc_id and text are not read. The path in `tokenizer` has to exist on every worker.
    """
    if max_length & (max_length - 1):
        raise ValueError("max_length has to be a power of two")
    return docs.select("doc_id", "text").mapInArrow(Packer(tokenizer or tokenizer_file(), max_length, end_id), PIECES)


def pack_report(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
