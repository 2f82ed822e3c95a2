"""Each stage of the pipeline against brute force on its own input, and the catalogue's fingerprints."""

import hashlib
import random

import pytest

import corpus_pipeline
from tidemark.llm import imatch, language_id, quality
from tidemark.llm.common import table

from .test_documents import BLANK, brute_near, brute_repeats

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The output of every stage."""
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema) if len(out) < 4 else stage(spark, docs, SF)
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_filters_keep_whole_rows(spark, stages):
    docs = table(spark, SF, "documents")
    assert all(s.columns == COLUMNS for s in stages[:4])
    scores = quality.score(docs, quality.train(docs, table(spark, SF, "labels"))).collect()
    assert set(texts(stages[0])) == {r["doc_id"] for r in scores if r["predicted"]}
    told = language_id.predict(stages[0], language_id.train(stages[0])).collect()
    assert set(texts(stages[1])) == {r["doc_id"] for r in told if r["lang_pred"] != "und" and r["score"] >= 0.5}
    before = texts(docs)
    assert all(before[i] == t for i, t in texts(stages[1]).items())


def test_dedup_stages(stages):
    near = brute_near(texts(stages[1]), 5, 80)
    assert set(texts(stages[2])) == {i for i, (_, _, kept) in near.items() if kept}
    want, got = brute_repeats(texts(stages[2]), 20), texts(stages[3])
    assert {i: " ".join(BLANK.findall(t)) for i, t in got.items()} == {i: w[3] for i, w in want.items()}


def test_packed(stages):
    rows = stages[4].collect()
    assert {r["doc_id"] for r in rows} == set(texts(stages[3]))
    assert all(0 <= r["offset"] and r["offset"] + r["length"] <= 4096 for r in rows)


def test_fingerprints(spark):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(150)]
    rows = [(i * 70_000 - 5, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 60, 300]))), "x") for i in range(50)]
    rows += [(3, rows[4][1], "x"), (4, None, "x"), (5, "", "x"), (6, "é€😀!", "x"), (None, "last one", "x"), (7, rows[4][1], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)
    got = {r["doc_id"]: r for r in imatch.fingerprints(frame, 0.02, 0.5).collect()}
    order = sorted(rows, key=lambda r: 1 << 63 if r[0] is None else r[0])
    seen = {}
    for k, (i, t, _) in enumerate(order):
        t, follow = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + follow[:q]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"] and seen.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        after = got[order[(k + 1) % len(order)][0]]["fingerprint"]
        for a, b, like in ((r["fingerprint"], r["edited_fingerprint"], r["near_edited"]), (r["fingerprint"], after, r["near_next"])):
            pairs = [(x, y) for x, y in zip(a.split("."), b.split("."), strict=True) if (x, y) != ("-", "-")]
            assert like == pytest.approx(sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0)
    assert imatch.fingerprints(frame.limit(0)).count() == 0
    repeated = imatch.fingerprints(spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "z")], "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in repeated) == [1, 1, 2]
    one = imatch.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
