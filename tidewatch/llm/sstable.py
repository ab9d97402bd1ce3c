"""Token ids in sorted-string-table shards.

A shard holds documents by ascending key: compressed blocks in which a key keeps only what differs from the one before,
a sparse index (the last key, place and sums of each block), a Bloom filter of all ids, and a footer. A look-up asks the
filter, finds the block in the index by binary search, and reads that block alone. Shards are made from ranges of
doc_id, so read one after the other they are the whole corpus in order.

File: blocks | index | filter | footer. Entry: varint shared, varint rest, varint 2 * bytes + wide, rest of the key,
ids as little-endian 16-bit numbers (32-bit if wide). Key: 0 for null, else 1 and the id in eight bytes whose order is
that of the numbers; equal ids follow one another.
"""

from __future__ import annotations

import bisect
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import give_back
from tidewatch.llm.files import create, open_random
from tidewatch.llm.tokens import END_ID, documents_ids, encoder, tokenizer_file
from tidewatch.storage import new_path, stage

MAGIC = b"TWSST001"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES = 1 << 16
BLOOM_BITS = 10  # a key
BLOOM_HASHES = 7
MANIFEST = "shard long, path string, docs long, tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) % (1 << 64))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    """Places in the filter: one row for each key."""
    h = np.array([zlib.crc32(k) | zlib.crc32(k, 0x9E3779B9) << 32 for k in keys], np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    a, b = h >> np.uint64(33), h & np.uint64(0xFFFFFFFF) | np.uint64(1)
    return (a[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


class Writer:
    """Takes documents in ascending order of their keys."""

    def __init__(self, out):
        self.out, self.at, self.index, self.keys = out, 0, [], []
        self.block, self.size, self.before, self.docs, self.tokens = [], 0, b"", 0, 0
        self.first = (0, 0)  # docs and tokens before the block
        self.press = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if self.keys and key < self.before:
            raise ValueError("documents out of order")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.before)) and key[shared] == self.before[shared]:
                shared += 1
        wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
        body = np.ascontiguousarray(ids, "<u4" if wide else "<u2").tobytes()
        entry = varint(shared) + varint(len(key) - shared) + varint(2 * len(body) + wide) + key[shared:]
        self.block += [entry, body]
        self.size += len(entry) + len(body)
        if key != self.before or not self.keys:
            self.keys.append(key)
        self.before, self.docs, self.tokens = key, self.docs + 1, self.tokens + len(ids)
        if self.size >= BLOCK_BYTES:
            self.end_block()

    def end_block(self) -> None:
        if self.block:
            data = self.press.compress(b"".join(self.block))
            self.out.write(data)
            self.index.append((self.before.hex(), self.at, len(data), zlib.crc32(data), *self.first))
            self.at += len(data)
            self.block, self.size, self.first = [], 0, (self.docs, self.tokens)

    def close(self) -> None:
        self.end_block()
        index = zstandard.compress(json.dumps(self.index).encode())
        bits = max(64, -(-BLOOM_BITS * len(self.keys) // 8) * 8)
        bloom = np.zeros(bits // 8, np.uint8)
        if self.keys:
            places = bloom_places(self.keys, bits).ravel().astype(np.int64)
            np.bitwise_or.at(bloom, places >> 3, (1 << (places & 7)).astype(np.uint8))
        self.out.write(index + bloom.tobytes() + FOOTER.pack(self.at, len(index), len(bloom), self.docs, self.tokens, zlib.crc32(index), MAGIC))
        self.out.close()


class Shard:
    """An open shard."""

    def __init__(self, path: str):
        self.file = open_random(path)
        size = self.file.size()
        index_at, index_size, bloom_size, self.docs, self.tokens, check, magic = FOOTER.unpack(self.at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {path}")
        index = self.at(index_at, index_size)
        if zlib.crc32(index) != check:
            raise ValueError(f"damaged index: {path}")
        self.index = [(bytes.fromhex(x[0]), *x[1:]) for x in json.loads(zstandard.decompress(index))]
        self.bloom = np.frombuffer(self.at(index_at + index_size, bloom_size), np.uint8)

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def block(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        _, offset, size, check, _, _ = self.index[k]
        data = self.at(offset, size)
        if zlib.crc32(data) != check:
            raise ValueError("damaged block")
        data, at, key = zstandard.decompress(data), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key, at = key[:shared] + data[at : at + rest], at + rest
            yield id_of(key), np.frombuffer(data[at : at + size // 2], "<u4" if size & 1 else "<u2").astype(np.uint32)
            at += size // 2

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of the documents with this identifier."""
        key = key_of(doc_id)
        places = bloom_places([key], 8 * len(self.bloom))[0].astype(np.int64)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in places):
            return []
        out, k = [], bisect.bisect_left(self.index, key, key=lambda x: x[0])
        while k < len(self.index):
            found = list(self.block(k))
            out += [ids for d, ids in found if d == doc_id]
            if key_of(found[-1][0]) > key:
                break
            k += 1
        return out

    def close(self) -> None:
        self.file.close()


class ShardWriter:
    """mapInArrow function: each partition of sorted (doc_id, text) becomes a shard; returns its manifest row."""

    def __init__(self, folder: str, path: str, end_id: int):
        self.folder, self.path, self.end_id = folder, path, end_id

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, shard = encoder(self.path), None, TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows and writer is None:
                path, out = create(self.folder, f"shard-{shard:06d}")
                writer = Writer(out)
            for doc, ids in zip(b.column("doc_id").to_pylist(), documents_ids(coder, b.column("text"), self.end_id), strict=True):
                writer.add(doc, ids)
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([x]) for x in (shard, path, writer.docs, writer.tokens)], names=["shard", "path", "docs", "tokens"])
        give_back()


def write_shards(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes all documents to shards and returns the manifest (shard, path, docs, tokens), shards in order of doc_id.

    Texts are dealt by ranges of doc_id (ties by a hash of the text, so even one repeated id doesn't make one task) and
    sorted there, nulls first. Null and empty texts are the end id alone; a text of any length is encoded whole, a few
    megabytes at a time; repeated rows are each stored, and rows that share an id follow one another in the order of the
    hash; an empty table gives no shard; other columns are not read. Shards written by a task that was lost are not in the manifest.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "sstable")
    order = ["doc_id", "__tie"]
    rows = docs.select("doc_id", "text").withColumn("__tie", F.xxhash64("text"))
    ready = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stage(ready.mapInArrow(ShardWriter(folder, tokenizer or tokenizer_file(), end_id), MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for b in batches:
        for row in b.to_pylist():
            shard, start, rows, held = Shard(row["path"]), row["start"], [], 0
            for doc, ids in shard.scan():
                rows.append((doc, start, len(ids), ids.astype("<u4").tobytes()))
                start, held = start + len(ids), held + 4 * len(ids)
                if held >= 1 << 22:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            shard.close()


def read_shards(manifest: DataFrame) -> DataFrame:
    """All documents of the shards: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))
    return placed.select("path", "start").repartition(max(1, manifest.count())).mapInArrow(_read, ROWS)


def sstable_report(docs: DataFrame) -> DataFrame:
    return read_shards(write_shards(docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
