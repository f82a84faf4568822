"""Operator 4: document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes.  Every passage of the whole text is
encoded from its bytes (pairs of character classes, and how its words repeat) by a small
network; gated attention weights, learned from document labels alone, add the encodings
up to one representation, which a logistic output scores.

The network is fitted here, on the driver, to at most ``SAMPLE`` labelled documents: those
with the smallest hash of their ids among labelled ids whose crc32 (of the id as text)
has a remainder by 5 other than 0.  Ids, languages, sources and labels are never inputs
of a score.

Cases: a null or empty text is one passage of zeros, scored like any other; null labels
are passed over and an id with several labels has their mean; without labels of both
kinds the score is the labels' mean (0.5 without any); rows that repeat an id, or have
none, are scored row by row; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import blocks
from .shared import row_schema, whole_row

PASSAGE = 1024
SAMPLE = 3000
HIDDEN, GATES = 24, 12
EPOCHS = 150
THRESHOLD = 0.3
SEED = 11
#: Passages that are encoded at once, padded with zeros, and decimals of a logit.
SHAPE, DIGITS = 512, 9


def _classes() -> np.ndarray:
    """A character class for each byte: 16 of them."""
    c = np.full(256, 15, dtype=np.int64)
    for k, chars in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOUBCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" ", b"\n\r", b".", b",", b"!?", b"|", b"*", b"#$%&", b"\"'()[]{}<>", b":;-_/\\@+=~^`")):
        c[list(chars)] = k
    c[128:192] = 14  # what follows in a character of several bytes
    return c


CLASSES = _classes()
#: A fixed random number for each byte, for hashes of words.
MARKS = np.random.default_rng(3).integers(1, 1 << 62, 256, dtype=np.int64)
WORD_BINS = 64
WIDTH = 256 + 8


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text); an empty text has one of zeros."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.asarray(pa.array(np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]))
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    whole = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    first = np.cumsum(counts) - counts
    number = np.arange(int(counts.sum())) - np.repeat(first, counts)
    begin = np.repeat(offsets[:-1] - offsets[0], counts) + number * PASSAGE
    length = np.clip(np.repeat(sizes, counts) - number * PASSAGE, 0, PASSAGE)
    out = np.zeros((len(begin), WIDTH), dtype=np.float32)
    for at in range(0, len(begin), 2048):
        b, n = begin[at : at + 2048], length[at : at + 2048]
        if n.sum():
            out[at : at + 2048] = _features(whole[b[0] : b[-1] + n[-1]], n)
    return out, counts


def _features(buf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of passages that lie one after another in ``buf``."""
    k = len(lengths)
    of = np.repeat(np.arange(k), lengths)
    c = CLASSES[buf]
    same = of[1:] == of[:-1]
    pair = (of[1:] * 256 + c[:-1] * 16 + c[1:])[same]
    pairs = np.bincount(pair, minlength=256 * k).reshape(k, 256)
    n = np.maximum(1, lengths)[:, None]
    blank = (c == 4) | (c == 5)
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1] | ~same]))
    x = np.zeros((k, 8), dtype=np.float64)
    if len(start):
        sums = np.cumsum(np.where(blank, 0, MARKS[buf]), dtype=np.int64)
        ends = np.append(start[1:], len(buf)) - 1
        marks = sums[ends] - sums[start] + MARKS[buf[start]]
        word_of = of[start]
        words = np.bincount(word_of, minlength=k)
        bins = np.bincount(word_of * WORD_BINS + (marks * 0x9E3779B97F4A7C1 >> 40) % WORD_BINS, minlength=k * WORD_BINS).reshape(k, WORD_BINS)
        share = bins / np.maximum(1, words)[:, None]
        for lag, place in ((1, 0), (2, 1)):
            again = (marks[lag:] == marks[:-lag]) & (word_of[lag:] == word_of[:-lag])
            x[:, place] = np.bincount(word_of[lag:][again], minlength=k) / np.maximum(1, words)
        x[:, 2] = share.max(axis=1)
        x[:, 3] = (share**2).sum(axis=1)
        x[:, 4] = (bins > 0).sum(axis=1) / np.minimum(WORD_BINS, np.maximum(1, words))
        x[:, 5] = words / n[:, 0]
    x[:, 6] = (pairs > 0).sum(axis=1) / 256
    x[:, 7] = np.log1p(lengths) / 7
    return np.concatenate([np.sqrt(pairs / n), x], axis=1)


class AttentionBag:
    """The network's weights, its scores and its gradients."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, gates: int = GATES, seed: int = SEED):
        r = np.random.default_rng(seed)
        init = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.p = {"w1": init(width, hidden), "b1": np.zeros(hidden, np.float32), "v": init(hidden, gates), "u": init(hidden, gates), "wa": init(gates, 1)[:, 0], "w": init(hidden, 1)[:, 0], "b": np.zeros(1, np.float32)}
        self.constant: float | None = None

    def encode(self, x: np.ndarray, p: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Encodings, both gates and the attention logit of each passage."""
        p = p or self.p
        h = np.tanh((x - self.mean) / self.scale @ p["w1"] + p["b1"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        return h, t, s, (t * s) @ p["wa"]

    @staticmethod
    def attention(e: np.ndarray, counts: np.ndarray) -> np.ndarray:
        first = np.cumsum(counts) - counts
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        return e / np.repeat(np.add.reduceat(e, first), counts)

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The same for a text wherever it stands: passages go through in blocks of one shape, in double precision, and logits are rounded."""
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        p = {k: v.astype(np.float64) for k, v in self.p.items()}
        h, e = np.empty((len(x), len(p["b1"]))), np.empty(len(x))
        for at in range(0, len(x), SHAPE):
            part = x[at : at + SHAPE]
            block = np.zeros((SHAPE, x.shape[1]))
            block[: len(part)] = part
            h_, _, _, e_ = self.encode(block, p)
            h[at : at + SHAPE], e[at : at + SHAPE] = h_[: len(part)], e_[: len(part)]
        z = np.add.reduceat(h * self.attention(e, counts)[:, None], np.cumsum(counts) - counts)
        logit = np.round((z * p["w"]).sum(axis=1) + p["b"][0], DIGITS)
        return np.round(1 / (1 + np.exp(-logit)), 12)

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-4) -> AttentionBag:
        if len(y) == 0 or len(np.unique(y > 0.5)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.02
        p = self.p
        m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
        xs = (x - self.mean) / self.scale
        for step in range(1, epochs + 1):
            for k, g in self.gradients(x, xs, counts, y).items():
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g**2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def gradients(self, x: np.ndarray, xs: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy; ``xs`` is ``x`` less the mean, over the scale."""
        p, first = self.p, np.cumsum(counts) - counts
        h, t, s, e = self.encode(x)
        a = self.attention(e, counts)
        z = np.add.reduceat(h * a[:, None], first)
        d = ((1 / (1 + np.exp(-(z @ p["w"] + p["b"][0]))) - y) / len(y)).astype(x.dtype)
        dz = np.repeat(d[:, None] * p["w"], counts, axis=0)
        da = (h * dz).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), counts))
        dg = de[:, None] * p["wa"]
        dt, ds = dg * s * (1 - t**2), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - h**2)
        return {"w1": xs.T @ dh, "b1": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "wa": (t * s).T @ de, "w": z.T @ d, "b": np.array([d.sum()])}


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)) == 0


def _featured(batches):
    for batch in batches:
        x, counts = passages(batch.column("text"))
        ends = np.concatenate([[0], np.cumsum(counts)]) * WIDTH
        # rows that repeat an id come in the order of their features, so that the same rows give the same network
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([zlib.crc32(x[a:b].tobytes()) for a, b in zip(ends[:-1] // WIDTH, ends[1:] // WIDTH)], pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.ravel()))], names=["doc_id", "quality", "crc", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionBag:
    usable = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out())
    one = usable.groupBy("doc_id").agg(F.avg("quality").cast("float").alias("quality"))
    drawn = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", "text")
    got = texts.mapInArrow(_featured, "doc_id long, quality float, crc long, x array<float>").toArrow().sort_by([("doc_id", "ascending"), ("crc", "ascending")])
    x = got["x"].combine_chunks()
    sizes = np.diff(np.asarray(x.offsets, dtype=np.int64)) // WIDTH
    values = np.asarray(x.flatten(), dtype=np.float32).reshape(-1, WIDTH)
    return AttentionBag().fit(values, sizes, np.asarray(got["quality"], dtype=np.float32))


def _scored(model: AttentionBag):
    def run(batches):
        for batch in batches:
            text = batch.column("text")
            text = text.cast(pa.large_string())
            out = []
            for _, part in blocks(text, 2 << 20):
                out.append(model.scores(*passages(part)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(np.concatenate(out) if out else np.empty(0))], names=[*batch.schema.names[:-1], "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: AttentionBag | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row for each row of ``docs``."""
    model = model or train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: AttentionBag | None = None) -> DataFrame:
    """``docs``' rows whose score is at least ``threshold``, with all their columns."""
    model = model or train(docs, labels)
    rows = docs.select(whole_row(docs), docs["text"].cast("string").alias("text"))
    scored = rows.mapInArrow(_scored(model), row_schema(rows, after="score double"))
    return scored.filter(F.col("score") >= threshold).select("row.*")
