"""Stages of the pipeline on rows whose doc_id is repeated or null: each row counts by its own text."""

import random
from collections import Counter

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(11)


def words(n):
    return [rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(n)]


def near(text):
    return " ".join([*text.split()[:-1], "other"])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_near_duplicates_by_row(spark):
    a, b, c, d, e, f = (" ".join(words(60)) for _ in range(6))
    rows = [(3, a), (7, near(a)), (7, b), (8, c), (8, d), (None, e), (None, f), (None, near(f)), (None, near(b)), (9, d), (9, e), (9, e), (None, None), (None, None)]
    got = pairs(corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), None))
    one_of_f = [x for x in (f, near(f)) if (None, x) in got]
    assert len(one_of_f) == 1
    assert got == Counter([(3, a), (7, b), (8, c), (8, d), (9, e), (None, one_of_f[0]), (None, None), (None, None)])


def test_repeats_by_row(spark):
    shared, a, b, c, d = (words(k) for k in (30, 40, 40, 40, 40))
    text = lambda *parts: " ".join(sum(parts, []))
    rows = [(1, text(a, shared)), (2, text(shared, b)), (2, text(c)), (2, text(c)), (None, text(d)), (None, text(shared, d[:10]))]
    got = pairs(corpus_pipeline.drop_repeats(spark, frame(spark, rows), None))
    assert got == Counter([(1, text(a, shared)), (2, text(b)), (2, text(c)), (2, text(c)), (None, text(d)), (None, text(d[:10]))])


def test_clashing_columns_and_no_n_chars(spark):
    shared, a, b = words(30), words(40), words(40)
    rows = [(1, " ".join(a + shared), "p", "q"), (2, " ".join(shared + b), "r", "s"), (3, "short", "t", "u"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut_text string, kept_id string")
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.drop_repeats(spark, docs, None).collect()}
    assert got == {1: rows[0][1:], 2: (" ".join(b), "r", "s"), 3: rows[2][1:], 4: rows[3][1:]}
    near_ = corpus_pipeline.drop_near_duplicates(spark, docs.withColumnsRenamed({"cut_text": "body", "kept_id": "kept"}), None)
    assert near_.columns == ["doc_id", "text", "body", "kept"] and near_.count() == 4


def test_short_texts_and_no_labels(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, [(1, "short text"), (2, None), (3, ""), (4, "other words")]).drop("lang").selectExpr("*", "cast(null as string) as lang")
    want = pairs(docs)
    assert pairs(corpus_pipeline.keep_quality(spark, docs, str(tmp_path))) == want
    assert pairs(corpus_pipeline.keep_language(spark, docs, str(tmp_path))) == want
    assert pairs(corpus_pipeline.drop_repeats(spark, docs, None)) == want
    assert pairs(corpus_pipeline.drop_near_duplicates(spark, docs, None)) == want
    empty = docs.limit(0)
    assert not any(f(spark, empty, str(tmp_path)).count() for _, f in corpus_pipeline.STAGES)
