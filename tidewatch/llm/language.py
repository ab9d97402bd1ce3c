"""Language identification with a byte convolutional network.

Embedded bytes pass filters of several widths, each filter's largest response in a window of fixed length is kept, and
a softmax layer votes for a language. The network is trained in numpy, on the driver, on a bounded sample: MAX_DOCS
documents, drawn by hash and the same on every run, and WINDOWS_PER_DOC windows of each. A document's windows overlap by the
widest filter less one, so all of its bytes count; its score is the mean probability over its windows, weighted by
their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import give_back, row_groups, spans, text_bytes

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
DIM = 8
MAX_DOCS = 3000
WINDOWS_PER_DOC = 4
UNKNOWN = "und"
REACH = max(WIDTHS)


@dataclass
class ByteNet:
    """langs and weights; embed maps a byte to DIM numbers, byte 0 (padding) to zeros."""

    langs: list[str]
    embed: np.ndarray
    filters: np.ndarray  # (REACH * DIM, filters), zero beyond a filter's width
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = windows.shape
        rows = length - REACH + 1
        embedded = self.embed[windows]
        patches = np.lib.stride_tricks.sliding_window_view(embedded.reshape(n, length * DIM), REACH * DIM, axis=1)[:, ::DIM]
        out = np.ascontiguousarray(patches).reshape(n * rows, REACH * DIM) @ self.filters
        return out.reshape(n, rows, -1), embedded

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.responses(windows)[0].max(axis=1) + self.bias, 0)
        z = pooled @ self.dense + self.dense_bias
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def filter_mask() -> np.ndarray:
    mask = np.zeros((REACH * DIM, len(WIDTHS) * FILTERS), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.003, seed: int = 7) -> ByteNet:
    """Adam on cross-entropy. A third of the windows are cut to a random length in each epoch, so short texts are known too."""
    rng = np.random.default_rng(seed)
    mask = filter_mask()
    f = mask.shape[1]
    net = ByteNet(langs, rng.normal(0, 0.5, (256, DIM)).astype(np.float32), (rng.normal(0, 0.2, mask.shape) * mask).astype(np.float32), np.zeros(f, np.float32), rng.normal(0, 0.2, (f, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    net.embed[0] = 0
    weights = [net.embed, net.filters, net.bias, net.dense, net.dense_bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    share = np.bincount(labels, minlength=len(langs)).astype(np.float32)
    weigh = (len(labels) / np.maximum(share, 1) / max(1, (share > 0).sum())) ** 0.5  # rare languages count somewhat more
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, y = windows[pick].copy(), labels[pick]
            for row in np.flatnonzero(rng.random(len(pick)) < 0.35):
                x[row, rng.integers(6, LENGTH) :] = 0
            out, embedded = net.responses(x)
            best = out.argmax(axis=1)
            top = np.take_along_axis(out, best[:, None], axis=1)[:, 0] + net.bias
            pooled = np.maximum(top, 0)
            z = pooled @ net.dense + net.dense_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = e / e.sum(axis=1, keepdims=True)
            g[np.arange(len(y)), y] -= 1
            g *= weigh[y][:, None] / len(y)
            gp = (g @ net.dense.T) * (top > 0)
            n, k = np.nonzero(gp)
            where = best[n, k][:, None] + np.arange(REACH)
            patch = embedded[n[:, None], where].reshape(len(n), REACH * DIM)
            gf = np.zeros_like(net.filters.T)
            np.add.at(gf, k, gp[n, k][:, None] * patch)
            ge = np.zeros_like(net.embed)
            np.add.at(ge, x[n[:, None], where].ravel(), (gp[n, k][:, None] * net.filters.T[k]).reshape(-1, DIM))
            ge[0] = 0
            step += 1
            for w, m, v, grad in zip(weights, first, second, (ge, gf.T * mask, gp.sum(axis=0), pooled.T @ g, g.sum(axis=0)), strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def cut_windows(body: np.ndarray, start: int, end: int, first: np.ndarray) -> np.ndarray:
    """Windows of LENGTH bytes from the given offsets of a text, padded with zeros."""
    at = first[:, None] + np.arange(LENGTH)
    inside = at < end - start
    return np.where(inside, body[start + np.minimum(at, max(0, end - start - 1))], 0).astype(np.uint8)


def sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to WINDOWS_PER_DOC windows of each text, spread evenly."""
    for b in batches:
        body, at = text_bytes(b.column("text"))
        langs, ids, out = b.column("lang"), b.column("doc_id"), []
        for i in range(b.num_rows):
            n = int(at[i + 1] - at[i])
            if n:
                first = np.unique(np.linspace(0, max(0, n - LENGTH), WINDOWS_PER_DOC).astype(np.int64))
                out += [(langs[i], ids[i], int(o), w.tobytes()) for o, w in zip(first, cut_windows(body, int(at[i]), int(at[i + 1]), first), strict=True)]
        if out:
            lang, doc, offset, window = zip(*out, strict=True)
            yield pa.record_batch([pa.array([x.as_py() for x in lang], pa.string()), pa.array([x.as_py() for x in doc], pa.int64()), pa.array(offset, pa.int64()), pa.array(window, pa.binary())], names=["lang", "doc_id", "at", "window"])


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS, seed: int = 7) -> ByteNet | None:
    """A network for all languages of `labelled` (doc_id long, text, lang); None if no row has a lang and a letter in its text.

    Of each language those documents are drawn whose hashes of id and text are least, max_docs / languages of them (one at
    least), so what reaches the driver is bounded by WINDOWS_PER_DOC windows of max_docs documents, or of one for each
    language if there are more of those. The draw is the same on every run, however the rows are dealt; rows that share an
    id, or have none, are drawn by their texts, and rows that repeat each other count once. Ties can't be told apart.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang", F.xxhash64("doc_id", "text", F.lit(seed)).alias("draw"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    each = max(1, max_docs // len(langs))
    share = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, (2.0 * each + 50) / r["n"])) for r in counts], "lang string, share double")
    near = rows.join(F.broadcast(share) if len(langs) < 10_000 else share, "lang").where(F.pmod("draw", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    first = near.groupBy("lang", "draw").agg(F.min_by("text", "draw").alias("text"), F.min("doc_id").alias("doc_id"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 30)), "draw"))
    drawn = first.withColumn("n", order).where(F.col("n") <= each).select("doc_id", "text", "lang")
    got = drawn.mapInArrow(sample_windows, "lang string, doc_id long, at long, window binary").collect()
    if len({r["lang"] for r in got}) < len(langs):  # rows that repeat each other may all lie beyond the share
        lacking = rows.where(~F.col("lang").isin([*{r["lang"] for r in got}])) if got else rows
        least = lacking.groupBy("lang").agg(F.min(F.struct(F.pmod("draw", F.lit(1 << 30)).alias("d"), "draw", "doc_id", "text")).alias("r")).select("r.doc_id", "r.text", "lang")
        got += least.mapInArrow(sample_windows, "lang string, doc_id long, at long, window binary").collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["at"], r["window"], r["lang"]))
    windows = np.frombuffer(b"".join(bytes(r["window"]) for r in got), np.uint8).reshape(-1, LENGTH)
    place = {x: i for i, x in enumerate(langs)}
    labels = np.array([place[r["lang"]] for r in got])
    del got
    net = train(windows, labels, langs, seed=seed)
    give_back()
    return net


class Predictor:
    """mapInArrow function: adds lang_pred and score to (text, has_letter, ...) rows."""

    def __init__(self, net: ByteNet | None, keep: list[str]):
        self.net, self.keep = net, keep

    def score(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text; texts are cut into windows some hundred at a time, whatever their lengths."""
        size, stride = np.diff(at), LENGTH - REACH + 1
        number = np.maximum(1, -(-(size - REACH + 1) // stride))
        owner = np.repeat(np.arange(len(size)), number)
        first = spans(np.zeros(len(size), np.int64), number) * stride
        total = np.zeros((len(size), len(self.net.langs)))
        for i in range(0, len(owner), 512):
            own, offset = owner[i : i + 512], first[i : i + 512]
            where = offset[:, None] + np.arange(LENGTH)
            inside = where < size[own][:, None]
            bytes_ = np.where(inside, body[np.minimum(at[own][:, None] + where, len(body) - 1)], 0)
            np.add.at(total, own, self.net.probabilities(bytes_) * inside.sum(axis=1)[:, None])
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, at = text_bytes(b.column("text"))
            letter = b.column("has_letter").to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            for i, j in row_groups(at, 1 << 23) if self.net else ():
                rows = i + np.flatnonzero(letter[i:j])
                if len(rows):
                    p = self.score(body[at[i] : at[j]], at[i : j + 1] - at[i])[rows - i]
                    pred[rows], score[rows] = np.array(self.net.langs, object)[p.argmax(axis=1)], p.max(axis=1)
            yield pa.record_batch([*(b.column(c) for c in self.keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*self.keep, "lang_pred", "score"])
        give_back()


def predict(docs: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """docs with lang_pred (a learned language, or `und` where the text is null or has no letter) and score (0 for `und`).

    Every column but lang_pred and score is returned as it was; columns of these two names are replaced. Without a
    network (no labelled rows) all rows are `und`. All windows of a text count, whatever its length; of equally likely
    languages the first by code point is returned. Repeated rows get the same answer; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    if text != "text" or "has_letter" in docs.columns:
        own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
        back = {v: k for k, v in own.items()}
        ready = docs.select(*[F.col(f"`{c}`").alias(v) for c, v in own.items()], F.col(f"`{text}`").alias("text"))
        out = predict(ready, net).drop("text")
        return out.select(*[F.col(v).alias(k) for v, k in back.items()], "lang_pred", "score")
    keep = docs.columns
    ready = docs.withColumn("has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = docs.schema.add("lang_pred", "string").add("score", "double")
    return ready.mapInArrow(Predictor(net, keep), schema)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the rows that aren't held out, and predicts every row: doc_id, held_out, lang_pred, score."""
    net = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
