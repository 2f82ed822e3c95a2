"""What a task or a broadcast holds stays bounded; forward passes, fingerprints and training samples against plain versions."""

import os
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language_id, minhash, quality, substring
from tidemark.llm.arrow_text import LOWER, Words, buffers
from tidemark.sources.shared import shared_dir


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    a = ["a"]
    while len(a) < 2048:
        a += ["b" if x == "a" else "a" for x in a]
    one = "".join(a)
    two = one.translate(str.maketrans("ab", "ba"))
    got = minhash.near_duplicates(spark.createDataFrame([(1, f"{one} x"), (2, f"{two} x")], "doc_id long, text string"), 2, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2}


def test_hashes_are_of_lowered_words():
    import pyarrow as pa

    w = Words(pa.array(["Ab aB", None, "", "ab É é", "x" * 5000]), LOWER)
    h = w.hashes()
    assert h[0] == h[1] == h[2] and len({int(x) for x in h}) == 4 and len(h) == len(w) == 6


def test_one_large_bucket_of_unlinked_texts(spark, monkeypatch):
    """Texts of one boilerplate and some words of their own: below the threshold, so hardly any link, but in common buckets."""
    rng, seen = random.Random(2), []
    real = minhash._block_links

    def watched(*args):
        run = real(*args)

        def inner(table):
            rows, size = table.num_rows, table.nbytes
            out = run(table)
            with open(f"{folder}/{rng.getrandbits(40)}-{os.getpid()}-{np.random.default_rng().integers(1 << 40)}", "w") as f:
                f.write(f"{rows} {size}")
            return out

        return inner

    folder = f"{shared_dir(spark)}/groups"
    os.makedirs(folder, exist_ok=True)
    monkeypatch.setattr(minhash, "_block_links", watched)
    monkeypatch.setattr(minhash, "REST_BYTES", 60_000)
    monkeypatch.setattr(minhash, "ALL_BYTES", 120_000)
    monkeypatch.setattr(minhash, "GROUP_BYTES", 120_000)
    base = [f"b{i}" for i in range(90)]
    texts = {i: " ".join(base + [f"n{i}_{k}" for k in range(14)]) for i in range(700)}
    texts |= {1000 + i: " ".join(base + [f"n{i}_{k}" for k in range(13)]) for i in range(40)}  # linked with one each
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), 2, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - 1000 if i >= 1000 else i for i in texts}
    for name in os.listdir(folder):
        seen.append(tuple(map(int, open(f"{folder}/{name}").read().split())))
    assert len(seen) > 10 and max(size for _, size in seen) < 900_000  # a few blocks of 180 kB at most


def test_scratch_tables_are_deleted(spark):
    rows = [(i, " ".join(f"w{(i // 2) * 7 + k}" for k in range(40)) + (" z" if i % 2 else "")) for i in range(60)]
    root = f"{shared_dir(spark)}/tidemark"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    left = set(os.listdir(root)) - before
    assert len(left) == 2  # what the result reads
    assert got.filter("kept").count() == 30


def test_a_long_document_is_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_WORDS", 1000)
    monkeypatch.setattr(substring, "GROUP_BYTES", 300_000)
    rng = random.Random(4)
    long_ = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    other = list(long_)
    for k in range(0, len(other), 997):
        other[k] = f"c{k}"  # no copy, so it streams
    docs = {1: " ".join(long_), 2: " ".join(other), 3: " ".join(long_[400:460])}
    sizes, real = [], substring.Group.__init__

    def watched(self, shards, span):
        real(self, shards, span)
        sizes.append((len(shards), sum(x.nbytes for x in self.arrays.values())))

    monkeypatch.setattr(substring.Group, "__init__", watched)
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), span=20).collect()}
    seen, want = set(), {}
    for i in sorted(docs):
        w = docs[i].split()
        gone = set()
        for k in range(len(w) - 19):
            t = tuple(w[k : k + 20])
            if t in seen:
                gone |= set(range(k, k + 20))
            seen.add(t)
        want[i] = len(gone)
    assert got == want
    assert len(sizes) > 3 and max(s for _, s in sizes) < 2_000_000


def test_recurrent_network_by_plain_loops():
    texts = ["plain words here", "é" * 100, "", "x", "long " * 60]
    model = language_id.ByteGru(["a", "b", "c"], seed=5)
    import pyarrow as pa

    best, score = language_id._pooled(model, pa.array(texts))
    sig = lambda v: 1 / (1 + np.exp(-v))
    k = model.hidden
    for i, t in enumerate(texts):
        raw, total = t.encode(), np.zeros(3)
        for at in range(0, len(raw), language_id.WINDOW):
            part = raw[at : at + language_id.WINDOW]
            logits = np.zeros((len(part), 3)) + model.bias
            for d, order in ((0, range(len(part))), (1, range(len(part) - 1, -1, -1))):
                h = np.zeros(k)
                for p in order:
                    a, g = model.byte[d][part[p]].astype(float), h @ model.state[d].astype(float)
                    z, r = sig(a[:k] + g[:k]), sig(a[k : 2 * k] + g[k : 2 * k])
                    n = np.tanh(a[2 * k :] + r * g[2 * k :])
                    h = n + z * (h - n)
                    logits[p] += h @ model.head[d]
            e = np.exp(logits - logits.max(1, keepdims=True))
            total += (e / e.sum(1, keepdims=True)).sum(0)
        mean = total / max(len(raw), 1)
        assert abs(score[i] - mean.max()) < 1e-4 and (not raw or best[i] == mean.argmax())


def test_attention_by_plain_loops():
    import pyarrow as pa

    texts = [None, "short", "Word 12, " * 400, "x" * 512]
    model = quality.Bags(9)
    x, to = quality.features(*buffers(pa.array(texts)))
    got = model.forward(x, to)[-1]
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        passages = [raw[k : k + quality.PASSAGE] for k in range(0, len(raw), quality.PASSAGE)] or [b""]
        z, e = [], []
        for p in passages:
            f, counts = np.zeros(quality.BINS + quality.SHAPES), Counter()
            for j, b in enumerate(p):
                at = passages.index(p) * quality.PASSAGE + j if len(passages) > 1 else j
                one, two = (raw[at - 1] if at > 0 else 0), (raw[at - 2] if at > 1 else 0)
                counts[((b + one * 0x9E37 + two * 0x85EBCA6B) * 0xC2B2AE35 & 0xFFFFFFFF) >> 22] += 1
                f[quality.BINS + int(quality.CLASSES[b])] += 1 / len(p)
            for h, n in counts.items():
                f[h] = np.sqrt(n / len(p))
            m = max(len(p), 1)
            f[quality.BINS + 8 :] = (len(counts) / m, min(sum(n * n for n in counts.values()) / m / 16, 4), len(p) / quality.PASSAGE, not p)
            v = np.tanh(f @ model.encode + model.encode_bias)
            z.append(v)
            e.append((np.tanh(v @ model.value) / (1 + np.exp(-(v @ model.gate)))) @ model.attend)
        a = np.exp(np.array(e) - max(e))
        bag = (a / a.sum()) @ np.array(z)
        assert abs(got[i] - 1 / (1 + np.exp(-(bag @ model.out + model.bias[0])))) < 1e-4


def test_training_reads_whole_texts(spark, monkeypatch):
    """A label that only the last words of long texts tell is learned, and every window and passage reaches the fit."""
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda bags, *rest: seen.setdefault("bags", bags))
    monkeypatch.setattr(language_id, "fit", lambda texts, *rest: seen.setdefault("texts", texts))
    docs = spark.createDataFrame([(i, f"é{i} " * 30_000, "x") for i in range(10)] + [(50, None, "x"), (51, "", "x")], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    quality.train(docs, labels)
    language_id.train(docs)
    whole = {r["text"].encode() for r in docs.filter("text is not null").collect()}
    assert set(seen["bags"]) <= whole and max(map(len, seen["bags"])) > 100_000
    assert set(seen["texts"]) <= whole and min(map(len, seen["texts"])) > 100_000


def test_each_file_looks_up_its_own_rarest_words():
    from tidemark.llm.licenses import Index

    index = Index({w: float(len(w)) for t in ("mozilla public license", "mit license", "cc by") for w in t.split()})
    number = {w: i for i, w in enumerate(index.words)}
    has = np.zeros((4, len(index.words)), bool)
    for row, text in enumerate(("the mit license", "the mit license mozilla public", "cc by mit", "license")):
        has[row, [number[w] for w in text.split()]] = True
    looked = [{index.words[k] for k in np.flatnonzero(r)} for r in index.looked_up(has)]
    assert looked[0] == {"license", "mit"}  # by idf: license, mit, the
    assert looked[1] == {"mozilla", "public", "license", "mit"}
    assert {"cc", "by"} <= looked[2] and not looked[3]
