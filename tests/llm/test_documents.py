"""Operations on documents against brute force, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, licenses, minhash, packing, quality, substring
from tidemark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, class string, n int, row string"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=5, n=60):
    """Random texts over few words, with copies, near copies, shared passages, odd blanks, nulls and one long text."""
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    make = lambda k: [rng.choice(words) for _ in range(k)]
    passage, texts = make(60), []
    for i in range(n):
        w = make(rng.choice([1, 3, 19, 20, 45, 120]))
        if i % 5 == 0:
            w = w + passage[: rng.choice([15, 22, 60])] + make(5)
        texts.append(rng.choice([" ", "\n", " \t "]).join(w))
    for i in range(0, n, 6):
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts += [texts[i], " ".join(w)]
    texts += [None, "", " \n ", "one", "two words", " ".join(["same"] * 90), " ".join(make(9000)), "a b " * 40, "12 34", "x\x00y \x85 z\u2003q", "ß" * 700]
    rows = [(i * 3, t, "x", 1, "y") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame(rows, SCHEMA).repartition(3), {r[0]: r[1] for r in rows}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_near(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = BLANK.findall(low(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(i for i in texts if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, width):
    got = minhash.near_duplicates(docs[0], width, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_near(docs[1], width, 80)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_chain_in_one_bucket(spark, monkeypatch):
    """Many classes around a base, linked in chains that the bucket's ends do not see, over several blocks."""
    monkeypatch.setattr(minhash, "REST_BYTES", 3000)
    monkeypatch.setattr(minhash, "ALL_BYTES", 6000)
    monkeypatch.setattr(minhash, "GROUP_BYTES", 9000)
    rng = random.Random(3)
    base, texts = [f"b{i}" for i in range(60)], {}
    w = list(base)
    for i in range(60):
        w = list(w) if i % 3 else list(base)
        for k in rng.sample(range(60), 3):
            w[k] = f"n{i}_{k}"
        texts[i] = " ".join(w)
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 2, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_near(texts, 2, 80)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_of_the_table_lose_no_link(spark, width):
    """Recall on a whole table: the components of all exact links."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10**6))
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    want = brute_near(texts, width, 80)
    assert sum(not kept for *_, kept in want.values()) > 20
    got = minhash.near_duplicates(table, width, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def test_near_duplicates_null_and_repeated_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d"), (None, "q r"), (1, "z y x"), (5, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in got) == sorted(
        [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (-1, 3, 1, False), (-1, 1, -1, True), (1, 2, 1, True), (5, 0, 5, True)]
    )


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0.3, 0.8, 1.0):
        a, b = np.sort(pool[:1000]), np.sort(pool[int(1000 * (1 - share)) :][:1000])
        r = minhash.registers(np.concatenate([a, b]), np.array([0, 1000, 2000]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = minhash.estimate((r[:1] == r[1:]).sum(1), np.array([1000]), np.array([1000]))[0]
        assert abs(got - true) < 0.15
    r = minhash.registers(np.sort(rng.integers(0, 2**63, 200_000, dtype=np.uint64)), np.arange(0, 200_001, 100))
    assert (r[::2] == r[1::2]).mean() == pytest.approx(minhash.collision(np.array([100]), np.array([100]))[0], rel=0.5)


def brute_repeats(texts, span):
    words = {i: BLANK.findall(t or "") for i, t in texts.items()}
    seen, out = set(), {}
    for i in sorted(texts):
        w, gone = words[i], set()
        for s in range(len(w) - span + 1):
            key = tuple(w[s : s + span])
            if key in seen:
                gone.update(range(s, s + span))
            seen.add(key)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("words", [200, 150_000])
@pytest.mark.parametrize("span", [5, 20])
def test_repeats(spark, docs, monkeypatch, words, span):
    """Few words a shard make several shards, and a group of its own of each."""
    monkeypatch.setattr(substring, "SHARD_WORDS", words)
    monkeypatch.setattr(substring, "GROUP_BYTES", words * 100)
    monkeypatch.setattr(substring, "PIECE", 16)
    want = brute_repeats(docs[1], span)
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs[0], span, keep_text=True).collect()}
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == {i: w[:3] for i, w in want.items()}
    for i, r in got.items():
        assert " ".join(BLANK.findall(r["kept_text"] or "")) == want[i][3]
    assert substring.remove_repeats(empty(spark), span).count() == 0


def test_repeats_same_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text), (7, text), (None, text), (8, "x " + text), (9, None)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    assert sorted((r["doc_id"] or 99, r["n_words"], r["n_removed"]) for r in got) == [(7, 30, 0), (7, 30, 0), (8, 31, 30), (9, 0, 0), (99, 30, 30)]


def _cut(spark, texts, span=20):
    got = substring.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), span).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {i: w[:3] for i, w in brute_repeats(texts, span).items()}


def test_repeats_of_short_texts_only(spark):
    """No text has a window, or none repeats."""
    _cut(spark, {1: "short text", 2: None, 3: "", 4: "short text"})
    _cut(spark, {1: " ".join(f"a{i}" for i in range(19)), 2: " ".join(f"a{i}" for i in range(19))})
    _cut(spark, {1: " ".join(f"a{i}" for i in range(40)), 2: "b " * 5})


def test_repeats_of_one_phrase_in_many_contexts(spark):
    """An anchor with many segments: most windows are not in its first one, and some of those repeat."""
    rng = random.Random(8)
    phrase, ends = [f"p{i}" for i in range(12)], [[f"e{k}_{i}" for i in range(14)] for k in range(6)]
    texts = {}
    for i in range(60):
        before = [f"{rng.choice('xyz')}{rng.randrange(9)}" for _ in range(rng.randrange(30))]
        texts[i] = " ".join(before + phrase + ends[rng.randrange(6)][: rng.randrange(4, 15)] + [f"u{i}"])
    texts[99] = " ".join(["same"] * 700 + phrase + ["same"] * 40)
    for span in (5, 20):
        _cut(spark, texts, span)


@pytest.mark.parametrize("length", [16, 4096])
def test_packing(spark, docs, length):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    model, rows = Tokenizer.from_file(path), packing.pack(docs[0], path, 2, length).collect()
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in docs[1].items():
        ids, at = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == length or (at < length and at & (at - 1) == 0)
    assert packing.pack(empty(spark), path).count() == 0


def test_special_tokens_and_contractions_keep_their_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    model, own = Tokenizer.from_file(path), packing.WordTokens(path, 2)
    for text in ("it's don't 'll!'s a1b22 c'D", "x<|endoftext|>y <|STARTOFTEXT|>", "é.è!? e\u0301. ﬁ ½ Σας", "中文，abc\u3000d\x85e"):
        ids, off, _ = own.encode(pa.array([text]))
        assert ids.tolist() == [*model.encode(text, add_special_tokens=False).ids, 2]


def test_hilbert_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_licences(spark):
    rows = {
        1: "Licensed under the Apache License, Version 2.0.", 2: "mit license MIT-License gnu general public licensex", 3: None, 4: "",
        5: "This is licensed under the GNU General Public License, version 3. cc by cc by", 6: "apache\nlicense", 7: "word " * 5000 + "MIT License",
        8: "licensed under the gnu general public license version", 9: "license apache", 10: "CC BY-NC 4.0 é apache",
        11: f"x {licenses.TEMPLATES[11][0].upper()}. y", 12: f"{licenses.TEMPLATES[12][0]} cc by {licenses.TEMPLATES[11][0][:300]}",
    }
    frame = spark.createDataFrame([(i, t, "q") for i, t in rows.items()], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.scan(frame).collect()}
    for i, t in rows.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        hits = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(hits))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    seen = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))) for t in rows.values()]
    idf = lambda x: max(np.log((1 + len(rows)) / (1 + sum(x in s for s in seen))), 1e-6)
    for i, t in rows.items():  # the method's labels and score by trying every template at every place
        w, labels, score = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)), set(), 0.0
        for template, phrase, label in (*((p, p, b) for p, b in licenses.BASE), *licenses.TEMPLATES):
            parts, key = template.split(), phrase.split()
            must = next(k for k in range(len(parts)) if parts[k : k + len(key)] == key)
            for k in range(len(w)):
                if w[k : k + len(key)] == key:
                    fit = sum(idf(x) for j, x in enumerate(parts) if 0 <= k - must + j < len(w) and w[k - must + j] == x) / sum(map(idf, parts))
                    if label in dict((b, p) for p, b in licenses.BASE) or fit >= 0.75:
                        labels.add(label)
                        score = max(score, fit)
        assert set(filter(None, got[i]["labels"].split(","))) == labels and got[i]["score"] == pytest.approx(score), i
    assert "apache-2.0" in got[1]["labels"] and "gpl-3.0" in got[5]["labels"] and "gpl-3.0" not in got[8]["labels"]
    assert licenses.scan(frame.limit(0)).count() == 0


def _spoken(rng, kind, k):
    parts = {"aa": ["th", "er", "an", "in", "the "], "bb": ["eau", "é", "ou", "ez ", "que "], "cc": ["sch", "ung ", "ß", "ver", "keit "]}[kind]
    return "".join(rng.choice(parts) for _ in range(k))


def test_language(spark):
    rng = random.Random(2)
    rows = [(i, _spoken(rng, k, rng.choice([30, 200])), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 345 !", "bb"), (None, rows[0][1], "cc"), (0, rows[0][1], "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(frame, per_language=40, steps=80)
    got = language_id.predict(frame, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[None]["held_out"] is False
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(180))
    held = [(by[i]["lang_pred"], k) for i, _, k in rows[:180] if by[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert {r["lang_pred"] for r in language_id.predict(frame, language_id.train(frame.limit(0))).collect()} == {"und"}
    assert language_id.predict(frame.limit(0), model).count() == 0


def test_language_gradient():
    rng = np.random.default_rng(0)
    model = language_id.ByteGru(["a", "b"], hidden=3)
    for d in range(2):
        model.byte[d], model.state[d], model.head[d] = (w.astype(np.float64) for w in (model.byte[d], model.state[d], model.head[d]))
    x, y, inside = rng.integers(97, 100, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0]), np.arange(6)[:, None] < np.array([6, 3, 5, 6])
    _, grads = model.gradient(x, y, inside)
    for w, g in zip(model.weights()[:6], grads[:6], strict=True):
        for at in [(98, 1), (98, 4), (98, 7)] if len(w) == 256 else [(0, 0), (2, 1)]:
            old = w[at]
            w[at] = old + 1e-2
            up = model.gradient(x, y, inside)[0]
            w[at] = old - 1e-2
            down = model.gradient(x, y, inside)[0]
            w[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4)


def test_quality(spark):
    rng = random.Random(4)
    text = lambda bad, k: " ".join((_spoken(rng, "aa", 3).strip() + ("###" if bad else "")) for _ in range(k))
    rows = [(i, text(i % 3 == 0, rng.choice([5, 60, 300])), "x") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)] + [(3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (None, "abc", "x"), (0, rows[0][1], "x")], "doc_id long, text string, predicted string")
    model = quality.train(frame, labels)
    got = quality.score(frame, model).collect()
    assert len(got) == 244 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(r["predicted"], int(r["doc_id"] % 3 != 0)) for r in got if r["held_out"] and r["doc_id"] < 240]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert {r["score"] for r in quality.score(frame, quality.train(frame, labels.limit(0))).collect()} == {0.5}
    assert quality.score(frame.limit(0), model).count() == 0


def test_quality_gradient():
    rng = np.random.default_rng(0)
    model = quality.Bags()
    for name in ("encode", "encode_bias", "value", "gate", "attend", "out", "bias"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    x, to, y, w = rng.random((5, quality.BINS + quality.SHAPES)) * 0.1, np.array([0, 2, 5]), np.array([1.0, 0.0]), np.ones(2)

    def loss():
        p = model.forward(x, to)[-1]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for a, g in zip(model.weights(), model.gradient(x, to, y, w), strict=True):
        at = tuple(0 for _ in a.shape)
        old = a[at]
        a[at] = old + 1e-4
        up = loss()
        a[at] = old - 1e-4
        down = loss()
        a[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-4, rel=0.02, abs=2e-5)
