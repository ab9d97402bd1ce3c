import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import tokens
from tidewatch.llm.packing import pack, pack_report, piece_lengths
from tidewatch.llm.sstable import Shard, read_shards, sstable_report, write_shards

TEXTS = ["", None, "One, two: it's 100 % DON'T", "0 00 a0b 0", "naïve　café   𝔘nicode ０ ٣", "<|endoftext|> x<|endoftext|>y", " \n\t", "a" * 5000, "word " * 30000, "é0́ 0", "The the THE the."]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokens.tokenizer_file())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_words_encode_as_whole_texts(plain, monkeypatch):
    for piece, cache in ((tokens.PIECE_BYTES, tokens.CACHE_WORDS), (700, 3)):
        monkeypatch.setattr(tokens, "PIECE_BYTES", piece)
        monkeypatch.setattr(tokens, "CACHE_WORDS", cache)
        coder = tokens.WordEncoder(tokens.tokenizer_file())
        assert coder.by_words
        for _ in range(2):
            got = list(tokens.documents_ids(coder, pa.array(TEXTS)))
            assert [g.tolist() for g in got] == [[*plain(x), 2] for x in TEXTS]


def test_piece_lengths():
    for n in (1, 2, 3, 4095, 4096, 4097, 12345):
        p = piece_lengths(n)
        assert sum(p) == n and p == sorted(p, reverse=True) and all(x & (x - 1) == 0 and x <= 4096 for x in p)


def frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "null id", "y"), (-5, "minus", None), (2**62, "far", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string"), rows


def check(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pack(spark, plain):
    df, rows = frame(spark)
    out = pack_report(df).collect()
    assert len({r["sequence_id"] for r in out}) == len(out) and all(r["offset"] == 0 for r in out)
    want = sorted((str(d), at, n, check(ids[at : at + n]), len(ids)) for d, t, _ in rows for ids in [[*plain(t), 2]] for at, n in zip(np.cumsum([0, *piece_lengths(len(ids))]).tolist(), piece_lengths(len(ids)), strict=False))
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    assert pack(df.limit(0)).count() == 0


def test_sstable(spark, plain):
    df, rows = frame(spark)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for d, t, _ in order:
        ids = [*plain(t), 2]
        want.append((d, start, len(ids), check(ids)))
        start += len(ids)
    assert [tuple(r) for r in sstable_report(df).orderBy("start").collect()] == want
    manifest = write_shards(df)
    shards = [Shard(r["path"]) for r in manifest.collect()]
    found = lambda d: [x.tolist() for s in shards for x in s.find(d)]
    assert found(3) == [[*plain(TEXTS[3]), 2]] * 2 and found(None) == [[*plain("null id"), 2]] and found(-5) and found(2**62) and not found(99)
    assert read_shards(write_shards(df.limit(0))).count() == 0
