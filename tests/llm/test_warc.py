import base64
import hashlib
import random

from tidewatch.llm import warc
from tidewatch.llm.warc import LoserTree, archive_report, read_archives, url_key, write_archives


def test_loser_tree():
    rng = random.Random(3)
    for k in range(9):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert url_key("http://WWW.Example.com:80/A?b=2&a=1#x") == "com,example)/a?a=1&b=2"
    assert url_key(None) == ")" and url_key("http://[bad")


def test_round_trip(spark, monkeypatch):
    rng = random.Random(1)
    bodies = ["", None, "same", "same", "<p>ü</p>\r\n\r\nx", "z" * 200000]
    rows = [(i, f"http://h{rng.randrange(4)}.example/{rng.randrange(9)} x" if i % 7 else None, rng.choice(bodies), 1) for i in range(300)]
    rows += [(299, "u", "same", 1), (None, "u", "same", 1), (None, "v", "alone", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, revisit int").repartition(6)
    latest = {}
    for i, _, h, _ in rows:
        latest[h or ""] = max(latest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in rows:
        body = (h or "").encode()
        old = latest[h or ""] > (-1 if i is None else i)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if old else "response", latest[h or ""] if old else None))
    for fan in (128, 2):
        monkeypatch.setattr(warc, "FAN_IN", fan)
        monkeypatch.setattr(warc, "RANGE_ROWS", 50)
        monkeypatch.setattr(warc, "RUN_BATCH", 16)
        out = archive_report(df).collect()
        assert sorted(map(str, (tuple(r)[:5] for r in out))) == sorted(map(str, want))
        keys = [(r["urlkey"], r["stamp"], -(1 << 63) if r["page_id"] is None else r["page_id"]) for r in out]
        assert keys == sorted(keys)  # partitions are collected in their order
    assert all(x["record_type"] == "response" for x in read_archives(write_archives(df, min_payload=10**6)).collect())
    texts = {r["page_id"]: r["payload"].decode() for r in read_archives(write_archives(df)).collect() if r["payload"] is not None}
    assert all(texts[i] == (h or "") for i, _, h, _ in rows if i in texts and i not in (None, 299))
    assert archive_report(df.limit(0)).count() == 0
