"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 512 bytes. Each passage is encoded from hashed byte trigrams
and shape features; a gated attention (tanh times sigmoid) learned from document labels weighs the
passages, and the weighted representation is scored. Trained in numpy on a bounded number of rows: about
`per_class` labelled documents of each label. Training and scores use every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import buffers, slices
from .common import crc_fold
from .language_id import Adam, sampled

PASSAGE, BINS, SHAPES = 512, 1024, 12
PER_CLASS, WIDE, GATE = 1000, 24, 16
F32 = np.float32


def _classes() -> np.ndarray:
    kind = np.full(256, 7, np.uint8)
    for b in range(128):
        c = chr(b)
        kind[b] = 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 if c == "\n" else 4 if c.isspace() else 5 if c in ".,;:!?'\"-()" else 6
    return kind


CLASSES = _classes()


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the offsets of the texts' passages. An empty text has one empty passage."""
    n = np.diff(off)
    count = np.maximum(-(-n // PASSAGE), 1)
    to = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    start = off[text] + PASSAGE * (np.arange(to[-1]) - to[:-1][text])
    size = np.minimum(off[text + 1] - start, PASSAGE)
    passage = np.repeat(np.arange(to[-1]), size)
    x = np.zeros((to[-1], BINS + SHAPES), F32)
    length = np.maximum(size, 1).astype(F32)[:, None]
    if len(data):
        b = data.astype(np.uint32)
        one, two = np.zeros_like(b), np.zeros_like(b)
        one[1:], two[2:] = b[:-1], b[:-2]
        first = off[:-1][n > 0]
        one[first] = two[first] = two[off[:-1][n > 1] + 1] = 0  # no bytes of the text before
        h = b + one * np.uint32(0x9E37) + two * np.uint32(0x85EBCA6B)
        h *= np.uint32(0xC2B2AE35)
        h >>= np.uint32(22)
        counts = np.bincount(passage * BINS + h, minlength=to[-1] * BINS).reshape(-1, BINS).astype(F32)
        np.sqrt(counts / length, out=x[:, :BINS])
        kinds = np.bincount(passage * 8 + CLASSES[data], minlength=to[-1] * 8).reshape(-1, 8)
        x[:, BINS : BINS + 8] = kinds / length
        x[:, BINS + 8] = (counts > 0).sum(1) / length[:, 0]
        x[:, BINS + 9] = np.minimum((counts * counts).sum(1) / length[:, 0] / 16, 4)
        x[:, BINS + 10] = size / PASSAGE
    x[:, BINS + 11] = size == 0
    return x, to


class Bags:
    """Weights of the encoder, the gated attention and the document layer."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        width = BINS + SHAPES
        self.encode = rng.normal(0, 1 / np.sqrt(8), (width, WIDE)).astype(F32)
        self.encode_bias = np.zeros(WIDE, F32)
        self.value = rng.normal(0, WIDE**-0.5, (WIDE, GATE)).astype(F32)
        self.gate = rng.normal(0, WIDE**-0.5, (WIDE, GATE)).astype(F32)
        self.attend = rng.normal(0, GATE**-0.5, GATE).astype(F32)
        self.out = rng.normal(0, WIDE**-0.5, WIDE).astype(F32)
        self.bias = np.zeros(1, F32)

    def weights(self) -> list[np.ndarray]:
        return [self.encode, self.encode_bias, self.value, self.gate, self.attend, self.out, self.bias]

    def forward(self, x: np.ndarray, to: np.ndarray) -> tuple:
        z = np.tanh(x @ self.encode + self.encode_bias)
        v, g = np.tanh(z @ self.value), 1 / (1 + np.exp(-(z @ self.gate)))
        e = (v * g) @ self.attend
        each = np.diff(to)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, to[:-1]), each))
        a = e / np.repeat(np.add.reduceat(e, to[:-1]), each)
        bag = np.add.reduceat(z * a[:, None], to[:-1], axis=0)
        logit = bag @ self.out + self.bias[0]
        return z, v, g, a, bag, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def gradient(self, x: np.ndarray, to: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        z, v, g, a, bag, p = self.forward(x, to)
        each = np.diff(to)
        d = ((p - y) * weight / len(y)).astype(F32)
        d_bag = np.repeat(d[:, None] * self.out, each, axis=0)
        d_a = (z * d_bag).sum(1)
        d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, to[:-1]), each))
        d_v, d_g = d_e[:, None] * self.attend * g * (1 - v * v), d_e[:, None] * self.attend * v * g * (1 - g)
        d_z = (d_bag * a[:, None] + d_v @ self.value.T + d_g @ self.gate.T) * (1 - z * z)
        return [x.T @ d_z + 1e-5 * self.encode, d_z.sum(0), z.T @ d_v, z.T @ d_g, (v * g).T @ d_e, bag.T @ d, np.array([d.sum()], F32)]


def fit(bags: list[bytes], labels: list[int], weights: list[float], epochs: int = 40, batch: int = 128, seed: int = 3) -> Bags:
    model, rng = Bags(seed), np.random.default_rng(seed)
    y, w = np.array(labels, F32), np.array(weights, F32)
    off = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    data = np.frombuffer(b"".join(bags), np.uint8)
    parts = [features(data[off[k] : off[min(k + batch, len(bags))]], off[k : min(k + batch, len(bags)) + 1] - off[k])[0].astype(np.float16) for k in range(0, len(bags), batch)]
    x, to = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.maximum(-(-np.diff(off) // PASSAGE), 1))])
    adam, steps, s = Adam(model.weights(), 0.005), epochs * -(-len(bags) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(bags), batch):
            pick = order[k : k + batch]
            rows = np.concatenate([np.arange(to[i], to[i + 1]) for i in pick])
            own = np.concatenate([[0], np.cumsum((to[1:] - to[:-1])[pick])])
            adam.step(model.gradient(x[rows].astype(F32), own, y[pick], w[pick]), 0.005 * (1 - s / steps) + 0.0002)
            s += 1
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Bags | None:
    """A classifier from a bounded number of labelled rows (crc32 of doc_id modulo 5 not 0), or None without labels. Their whole texts are learned from."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter(F.col("quality").isin(0, 1) & (crc_fold(F.col("doc_id")) != 0))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return None
    chosen = known.filter(sampled(known, "quality", per_class, 2)).orderBy(F.xxhash64("doc_id"), "quality").limit(4 * per_class)
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    got = picked.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bag"), "quality").orderBy(F.xxhash64("doc_id"), "quality", F.xxhash64("bag")).limit(4 * per_class).collect()
    if not got:
        return None
    have = {v: sum(r["quality"] == v for r in got) for v in counts}
    total = sum(counts.values())
    weight = {v: counts[v] / total * len(got) / max(1, have[v]) for v in counts}
    return fit([bytes(r["bag"]) for r in got], [r["quality"] for r in got], [weight[r["quality"]] for r in got])


def _scored(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in slices(batches, "text", 1 << 20):
            x, to = features(*buffers(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.forward(x, to)[-1].astype(np.float64))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Bags | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `threshold` on) of every row of `docs`.

    A null or empty text is one empty passage and has the model's score for it. Without labels every
    score is 0.5. A null doc_id is not held out and never learned from. Repeated rows are judged each;
    other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model is None:
        out = source.select("doc_id", F.lit(0.5).alias("score"))
    else:
        held = docs.sparkSession.sparkContext.broadcast(model)  # weights of a fixed size
        out = source.mapInArrow(_scored(held), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _good(held, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            x, to = features(*buffers(part.column(part.schema.get_field_index("text"))))
            yield part.filter(pa.array(held.value.forward(x, to)[-1] >= threshold))

    return run


def keep_good(docs: DataFrame, model: Bags | None, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, that score `threshold` or more; all rows without a model."""
    return docs if model is None else docs.mapInArrow(_good(docs.sparkSession.sparkContext.broadcast(model), threshold), docs.schema)
