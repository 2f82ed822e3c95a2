"""Language identification with a bidirectional gated recurrent network over bytes.

A whole text is cut into windows of bytes. In each window one network reads forwards and one
backwards; at every byte their states give a probability for each language. The mean over all bytes
of the text is the document's probability. The network is trained in numpy by backpropagation
through time on a bounded number of rows: about `per_language` documents of each language, chosen by a hash
of doc_id. Every window of their whole texts is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import buffers, slices
from .common import crc_fold

HIDDEN, WINDOW = 8, 128
#: Documents of each language to learn from, and the most languages that can be told apart.
PER_LANGUAGE, LANGUAGES = 500, 200
F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.multiply(x, F32(0.5), out=x)
    np.tanh(x, out=x)
    np.add(x, F32(1), out=x)
    return np.multiply(x, F32(0.5), out=x)


class ByteGru:
    """Both directions and the layer that labels positions. Inputs: `byte[d]` has a row for each byte, `state[d]` maps states to gates."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.byte = [rng.normal(0, 0.3, (256, 3 * hidden)).astype(F32) for _ in range(2)]
        self.state = [rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(F32) for _ in range(2)]
        self.head = [rng.normal(0, 0.3, (hidden, len(languages))).astype(F32) for _ in range(2)]
        self.bias = np.zeros(len(languages), F32)

    def weights(self) -> list[np.ndarray]:
        return [*self.byte, *self.state, *self.head, self.bias]

    def step(self, d: int, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gates and the next state: h' = n + z * (h - n)."""
        k = self.hidden
        a, g = self.byte[d][x], h @ self.state[d]
        gates = sigmoid(a[:, : 2 * k] + g[:, : 2 * k])
        z, r = gates[:, :k], gates[:, k:]
        n = g[:, 2 * k :] * r
        n += a[:, 2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return z, r, n, g[:, 2 * k :], new

    def positions(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Summed position probabilities of each window. x: (time, window) bytes; inside: which hold text."""
        t_all, n = x.shape
        logits = np.empty((t_all, n, len(self.languages)), F32)
        ragged = not inside.all()
        for d, order in enumerate((range(t_all), range(t_all - 1, -1, -1))):
            h = np.zeros((n, self.hidden), F32)
            for t in order:
                h = self.step(d, x[t], h)[-1]
                if d and ragged:
                    h *= inside[t][:, None]
                if d:
                    logits[t] += h @ self.head[d]
                else:
                    np.matmul(h, self.head[d], out=logits[t])
                    logits[t] += self.bias
        logits -= logits.max(2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(2, keepdims=True)
        if ragged:
            logits *= inside[:, :, None]
        return logits.sum(0)

    def gradient(self, x: np.ndarray, y: np.ndarray, inside: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over positions and its gradient, by backpropagation through time."""
        t_all, n, k = *x.shape, self.hidden
        seen: list[list] = [[None] * t_all, [None] * t_all]
        states = np.zeros((2, t_all, n, k), F32)
        orders = (range(t_all), range(t_all - 1, -1, -1))
        for d, order in enumerate(orders):
            h = np.zeros((n, k), F32)
            for t in order:
                before = h
                *gates, h = self.step(d, x[t], h)
                if d:
                    h = h * inside[t][:, None]
                seen[d][t], states[d, t] = (*gates, before), h
        logits = states[0] @ self.head[0] + states[1] @ self.head[1] + self.bias
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        own = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (t_all, n, 1)), 2)
        total = inside.sum()
        loss = float(-(np.log(own[:, :, 0] + 1e-9) * inside).sum() / total)
        error = p
        np.put_along_axis(error, np.broadcast_to(y[None, :, None], (t_all, n, 1)), own - 1, 2)
        error *= (inside / total)[:, :, None].astype(F32)
        to_byte, to_state, to_head = [], [], []
        for d, order in enumerate(orders):
            to_head.append(np.einsum("tnk,tnl->kl", states[d], error, optimize=True))
            outside = error @ self.head[d].T
            grad_in = np.empty((t_all, n, 3 * k), F32)
            grad_u, dh = np.zeros_like(self.state[d]), np.zeros((n, k), F32)
            for t in reversed(order):
                z, r, m, g, before = seen[d][t]
                dh = dh + outside[t]
                if d:
                    dh = dh * inside[t][:, None]
                dm = dh * (1 - z) * (1 - m * m)
                dz, dr = dh * (before - m) * z * (1 - z), dm * g * r * (1 - r)
                through = np.concatenate([dz, dr, dm * r], 1)
                grad_in[t, :, : 2 * k], grad_in[t, :, 2 * k :] = through[:, : 2 * k], dm
                grad_u += before.T @ through
                dh = dh * z + through @ self.state[d].T
            to_state.append(grad_u)
            flat, rows = x.ravel(), grad_in.reshape(-1, 3 * k)
            order_ = np.argsort(flat, kind="stable")
            ids, first = np.unique(flat[order_], return_index=True)
            grad_b = np.zeros_like(self.byte[d])
            grad_b[ids] = np.add.reduceat(rows[order_], first, axis=0)
            to_byte.append(grad_b)
        return loss, [*to_byte, *to_state, *to_head, error.sum((0, 1))]


class Adam:
    def __init__(self, weights: list[np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m, self.v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def step(self, grads: list[np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        for w, g, m, v in zip(self.w, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (rate or self.rate) * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def windows(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time, window) bytes, which of them hold text, and the text of each window."""
    n = np.diff(off)
    count = -(-n // size)
    text = np.repeat(np.arange(len(n)), count)
    start = off[text] + size * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    left = np.minimum(off[text + 1] - start, size)
    at = start[None, :] + np.arange(size)[:, None]
    inside = np.arange(size)[:, None] < left[None, :]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0) if len(data) else np.zeros((size, 0), np.uint8), inside, text


def fit(texts: list[bytes], labels: list[str], steps: int = 260, batch: int = 256, seed: int = 1, hidden: int = HIDDEN) -> ByteGru:
    """Train on all windows of the texts; each language gets an equal share of every batch. There are `steps` batches, or as many as take the language with the most windows through all of them."""
    languages = sorted(set(labels))
    model, rng = ByteGru(languages, hidden, seed), np.random.default_rng(seed)
    number = {v: i for i, v in enumerate(languages)}
    y = np.array([number[v] for v in labels])
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x, inside, of = windows(data, off, WINDOW)
    y = y[of]
    members = [np.flatnonzero(y == i) for i in range(len(languages))]
    adam = Adam(model.weights(), 0.01)
    share = max(1, batch // len(languages))
    steps = max(steps, -(-max(map(len, members)) // share))
    turns = [np.concatenate([rng.permutation(m) for _ in range(-(-steps * share // len(m)))]) for m in members]  # each language's windows, again and again
    for s in range(steps):
        pick = np.concatenate([t[s * share : (s + 1) * share] for t in turns])
        _, grads = model.gradient(x[:, pick], y[pick], inside[:, pick])
        adam.step(grads, 0.01 * (1 - s / steps) + 0.0005)
    return model


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of doc_id as text modulo 5 is not 0; text and lang are there."""
    return docs.filter((crc_fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def sampled(rows: DataFrame, key: str, per_value: int, most: int) -> Column:
    """A condition that holds for about `per_value` rows of each value of `key`, by a hash of doc_id; fails if there are over `most` values."""
    counts = rows.groupBy(key).count().limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"{key} has over {most} values")
    place, chosen = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(77)), F.lit(1 << 24)), F.lit(False)
    for r in counts:
        chosen = chosen | ((F.col(key) == r[key]) & (place < int(min(1.0, per_value / r["count"]) * (1 << 24))))
    return chosen


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, steps: int = 260) -> ByteGru | None:
    """A network learned from the whole texts of a bounded number of rows, or None if no row may be learned from. An empty text teaches nothing."""
    rows = learnable(docs.select("doc_id", "lang", "text"))
    chosen = rows.filter(sampled(rows, "lang", per_language, LANGUAGES))
    got = chosen.filter(F.col("text") != "").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "lang").limit(2 * per_language * LANGUAGES).collect()
    pairs = [(r["text"].encode(), r["lang"]) for r in got]
    return fit([p[0] for p in pairs], [p[1] for p in pairs], steps) if pairs else None


def _pooled(model: ByteGru, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The best language of each text and its mean probability over all bytes."""
    data, off = buffers(text)
    x, inside, of = windows(data, off, WINDOW)
    total = np.zeros((len(off) - 1, len(model.languages)))
    for s in range(0, x.shape[1], 4096):
        np.add.at(total, of[s : s + 4096], model.positions(x[:, s : s + 4096], inside[:, s : s + 4096]))
    mean = total / np.maximum(np.diff(off), 1)[:, None]
    best = mean.argmax(1)
    return best, np.minimum(mean[np.arange(len(best)), best], 1.0)


def _predicted(held):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in slices(batches, "text", 1 << 19):
            best, score = _pooled(model, part.column(1))
            blank = ~part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names = np.array(model.languages, object)[best]
            names[blank] = "und"
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.where(blank, 0.0, score))], schema=schema)

    return run


def _spoken(held, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 19):
            yield part.filter(pa.array(_pooled(held.value, part.column(part.schema.get_field_index("text")))[1] >= least))

    return run


def keep_spoken(docs: DataFrame, model: ByteGru, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose text has a letter and a language with a score of `least` or more."""
    return docs.filter(F.col("text").rlike(r"\p{L}")).mapInArrow(_spoken(docs.sparkSession.sparkContext.broadcast(model), least), docs.schema)


def predict(docs: DataFrame, model: ByteGru | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of `docs`, from whole texts.

    A text that is null, empty or without a letter is `und` with score 0, and so is every text if
    nothing could be learned. A null doc_id is not held out and never learned from. Repeated rows are
    judged each; other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        out = source.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        held = docs.sparkSession.sparkContext.broadcast(model)  # weights of a fixed size
        out = source.mapInArrow(_predicted(held), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
