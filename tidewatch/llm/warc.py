"""WARC archives with a globally ordered index.

Each task writes its captures to archives of gzip members, one a record, and a run: the archive's index entries in
order of URL key and timestamp. A k-way merge with a loser tree over the runs, a range of keys a task, gives the
capture history of every URL in one global order, and the records are read back along it.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.files import OpenFiles, create, open_random
from tidewatch.storage import new_path, stage

ARCHIVE_BYTES = 1 << 30
FAN_IN = 128
SAMPLES = 8  # keys of each run that reach the driver, to choose the ranges by
RANGE_ROWS = 20_000
RUN_BATCH = 2048
EPOCH = dt.datetime(2000, 1, 1)
ENTRY = pa.schema([("urlkey", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
RUNS = "run string, entries long, samples array<struct<urlkey:string,stamp:string,page_id:long>>"
RECORDS = "urlkey string, stamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The URL in sort-friendly form: host turned round, lower case, no scheme, www, default port or fragment."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")" + url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{place}){(parts.path or '/').lower()}" + (f"?{'&'.join(sorted(parts.query.lower().split('&')))}" if parts.query else "")


def stamp_of(page_id: int | None) -> str:
    """Pages have no capture time; one second for each id stands in for it, from the start again after 7,900 years."""
    return (EPOCH + dt.timedelta(seconds=(page_id or 0) % (7900 * 31_557_600))).strftime("%Y%m%d%H%M%S")


def record_of(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit's block ends after the HTTP header."""
    when = dt.datetime.strptime(stamp_of(page_id), "%Y%m%d%H%M%S").isoformat() + "Z"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}" if m[0] != "%" else "%", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields and payload of one record; a response is checked against its digest and length."""
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, payload = rest[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: int(x[12:-1]) if len(x) > 13 else None
    out = {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"][5:], "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To", "<urn:x-page:>")), "payload": None}
    if out["record_type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["payload_digest"]:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        out["payload"] = payload
    return out


def sort_key(entry: tuple) -> tuple:
    return entry[0], entry[1], -1 << 63 if entry[2] is None else entry[2]


class RunWriter:
    """Writes entries that come in order to a run, and draws evenly spaced keys from it."""

    def __init__(self, folder: str):
        self.path, self.out = create(folder, "run")
        self.file, self.rows, self.entries, self.firsts = pa.ipc.new_file(self.out, ENTRY), [], 0, []

    def add(self, entry: tuple) -> None:
        if not self.rows:
            self.firsts.append(entry[:3])
        self.rows.append(entry)
        if len(self.rows) == RUN_BATCH:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.file.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), ENTRY, strict=True)], schema=ENTRY))
            self.entries += len(self.rows)
            self.rows = []

    def close(self, keys: list[tuple]) -> tuple:
        self.flush()
        self.file.close()
        self.out.close()
        return self.path, self.entries, [dict(zip(("urlkey", "stamp", "page_id"), k, strict=True)) for k in keys]


def evenly(keys: list) -> list:
    n = min(SAMPLES, len(keys))
    return [keys[(2 * i + 1) * len(keys) // (2 * n)] for i in range(n)]


def run_slice(path: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """A run's entries from low (included) to high (not), found by binary search over its batches."""
    with open_random(path) as f:
        file = pa.ipc.open_file(f)
        first, last = 0, file.num_record_batches
        if low is not None:
            while last - first > 1:
                middle = (first + last) // 2
                b = file.get_batch(middle)
                first, last = (middle, last) if sort_key(tuple(c[0].as_py() for c in b.columns)) <= low else (first, middle)
        for k in range(first, file.num_record_batches):
            for entry in zip(*(c.to_pylist() for c in file.get_batch(k).columns), strict=True):
                key = sort_key(entry)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield entry


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, the winner of all stands on top."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.n = runs, key, max(1, len(runs))
        self.heads: list = [None] * self.n
        self.keys: list = [None] * self.n
        self.losers = [-1] * self.n
        for i in range(len(runs)):
            self.advance(i)
        for i in range(self.n):
            self.enter(i)

    def advance(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None) if i < len(self.runs) else None
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None or self.keys[b] is None and a < b
        return (self.keys[a], a) < (self.keys[b], b)

    def enter(self, i: int) -> None:
        """First matches: a run waits at the first empty node on its way up."""
        at = (i + self.n) // 2
        while at:
            if self.losers[at] < 0:
                self.losers[at] = i
                return
            if self.beats(self.losers[at], i):
                self.losers[at], i = i, self.losers[at]
            at //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        winner = self.losers[0]
        while self.heads[winner] is not None:
            yield self.heads[winner]
            self.advance(winner)
            at = (winner + self.n) // 2
            while at:
                if self.beats(self.losers[at], winner):
                    self.losers[at], winner = winner, self.losers[at]
                at //= 2
        self.losers[0] = winner


class ArchiveWriter:
    """mapInArrow function over captures: writes archives and their runs, returns a row for each run."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, entries, done = None, [], []
        for b in batches:
            for page_id, url, html, sha, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path, out = create(self.folder, "archive.warc.gz")
                    entries, at = [], 0
                payload = (html or "").encode()
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                press = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = press.compress(record_of(page_id, url, payload, len(payload), digest, refers_to, revisit)) + press.flush()
                out.write(data)
                entries.append((url_key(url), stamp_of(page_id), page_id, path, at, len(data)))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    done.append(self.end(out, entries))
                    out = None
        if out is not None:
            done.append(self.end(out, entries))
        if done:
            yield run_rows(done)

    def end(self, out, entries: list) -> tuple:
        out.close()
        entries.sort(key=sort_key)
        run = RunWriter(self.folder)
        for e in entries:
            run.add(e)
        return run.close(evenly([e[:3] for e in entries]))


def run_rows(rows: list[tuple]) -> pa.RecordBatch:
    sample = pa.list_(pa.struct([("urlkey", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64())]))
    path, entries, samples = zip(*rows, strict=True)
    return pa.record_batch([pa.array(path, pa.string()), pa.array(entries, pa.int64()), pa.array(samples, sample)], names=["run", "entries", "samples"])


def write_archives(pages: DataFrame, folder: str | None = None, min_payload: int = 0) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the runs.

    Of records with equal payloads of min_payload bytes or more, that with the largest page_id is a response and the
    others refer to it; rows that share this page_id are all responses, a null page_id counts as the smallest. A null
    html is an empty payload. Digests with several pages are found by a map-side aggregation and joined back by digest,
    a join whose hot digests AQE splits. An empty table writes nothing; other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    ready = pages.select("page_id", "url", html.alias("html")).withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    large = ready.where(F.octet_length("html") >= min_payload) if min_payload else ready
    copies = large.groupBy(F.col("sha").alias("same")).agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1 AND latest IS NOT NULL")
    later = (F.col("latest") > F.col("page_id")) | F.col("page_id").isNull() & F.col("latest").isNotNull()
    marked = ready.join(copies, F.col("sha") == F.col("same"), "left").withColumn("revisit", F.coalesce(later, F.lit(False)))
    rows = marked.select("page_id", "url", "html", "sha", F.when(F.col("revisit"), F.col("latest")).alias("refers_to"), "revisit")
    return stage(rows.mapInArrow(ArchiveWriter(folder), RUNS), "runs")


class RangeMerger:
    """mapInArrow function over (runs, low, high): merges the runs' slices; reads the records, or writes one longer run."""

    def __init__(self, folder: str | None = None):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for job in b.to_pylist():
                bound = lambda k: None if k is None else sort_key((k["urlkey"], k["stamp"], k["page_id"]))
                merged = iter(LoserTree([run_slice(p, bound(job["low"]), bound(job["high"])) for p in job["runs"]], sort_key))
                if self.folder:
                    run = RunWriter(self.folder)
                    for entry in merged:
                        run.add(entry)
                    yield run_rows([run.close(evenly(run.firsts))])
                else:
                    yield from self.records(merged)

    @staticmethod
    def records(merged: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        files, rows, held = OpenFiles(), [], 0
        for urlkey, stamp, _, path, offset, length in merged:
            r = parse_record(gzip.GzipFile(fileobj=io.BytesIO(files.read(path, offset, length))).read())
            rows.append({"urlkey": urlkey, "stamp": stamp} | r)
            held += len(r["payload"] or b"") + 500
            if held >= 1 << 22:
                yield records_batch(rows)
                rows, held = [], 0
        if rows:
            yield records_batch(rows)


def records_batch(rows: list[dict]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.record_batch([pa.array([r[n] for r in rows], kinds[x.split()[1]]) for n, x in zip(names, RECORDS.split(", "), strict=True)], names=names)


JOBS = "place int, runs array<string>, low struct<urlkey:string,stamp:string,page_id:long>, high struct<urlkey:string,stamp:string,page_id:long>"


def read_archives(runs: DataFrame) -> DataFrame:
    """Every record in global order of (urlkey, stamp, page_id): partitions hold ranges of keys, in their order.

    The driver sees a row a run with SAMPLES keys, never an entry. While there are more than FAN_IN runs, groups of
    FAN_IN are merged to longer ones, a task each; then each range's slices are merged and its records read.
    """
    spark = runs.sparkSession
    known = runs.collect()
    while len(known) > FAN_IN:
        groups = [(i, [r["run"] for r in known[i : i + FAN_IN]], None, None) for i in range(0, len(known), FAN_IN)]
        longer = spark.createDataFrame(groups, JOBS).repartition(len(groups), "place").mapInArrow(RangeMerger(new_path(spark, "runs")), RUNS)
        known = stage(longer, "runs").collect()
    total = sum(r["entries"] for r in known)
    if not total:
        return spark.createDataFrame([], RECORDS)
    keys = sorted({sort_key(k) for r in known for k in r["samples"]})
    n = max(1, min(len(keys), total // RANGE_ROWS + spark.sparkContext.defaultParallelism))
    cuts = [keys[i * len(keys) // n] for i in range(1, n)]
    ends = [None, *[(a, b, None if c == -1 << 63 else c) for a, b, c in cuts], None]
    every = [r["run"] for r in known]
    jobs = [(i, every, low, high) for i, (low, high) in enumerate(zip(ends, ends[1:], strict=False))]
    dealt = spark.createDataFrame(jobs, JOBS).repartitionByRange(len(jobs), "place").sortWithinPartitions("place")
    return dealt.mapInArrow(RangeMerger(), RECORDS)


def archive_report(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "stamp")
