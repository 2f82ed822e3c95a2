"""Piece encoding against the library, a brute-force Viterbi search and exact round trips."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece

from tidemark.llm import pieces
from tidemark.llm.queries import tokenizer_path

TEXTS = [None, "", " ", "a▁b ▁ c▁", "▁", "   two  blanks   ", "Hello world\n\ttabs\r\n", "e.g. def f(x):\n    return x+1  # 12,345.67", "é é ﬁ 中文。日本 \U0001f600", "a\x00b\x85", "THE the The", "ß" * 300, "word " * 3000, "naïve naïveté naïvely nai"]


def test_equals_the_library_and_comes_back(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "x")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, ids string")
    coded = pieces.encode(docs, path)
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in coded.collect()) == sorted((str(i), model.encode(t or "")) for i, t in rows)
    blank = lambda t: (t or "").replace("▁", " ")
    assert sorted((str(r["doc_id"]), r["text"]) for r in pieces.decode(coded, path).collect()) == sorted((str(i), blank(t)) for i, t in rows)
    for r in pieces.round_trips(docs, path).collect():
        t = "x" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = np.array(model.encode(t), "<u4")
        assert (r["n_ids"], r["ids_crc32"], r["decoded_sha256"], r["round_trip"]) == (len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(blank(t).encode()).hexdigest(), "▁" not in t)
    assert pieces.round_trips(docs.limit(0), path).count() == 0


def test_unigram_model_takes_the_best_sum():
    rng = random.Random(1)
    parts = {"".join(p) for n in (1, 2, 3) for p in itertools.product("ab▁", repeat=n) if "▁" not in p[1:]}
    vocabulary = pieces.Vocabulary({p: (i + 1, -rng.random() * 4 - 0.1) for i, p in enumerate(sorted(parts))}, None, 0, False, len(parts) + 1)
    words = sorted({"▁" + "".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(60)})

    def best(w):
        if not w:
            return 0.0, []
        return max(((s + vocabulary.pieces[p][1], [*ids, vocabulary.pieces[p][0]]) for n in range(1, len(w) + 1) if (p := w[-n:]) in vocabulary.pieces for s, ids in [best(w[:-n])]), key=lambda x: x[0])

    assert vocabulary.encode_sorted(words) == [best(w)[1] for w in words]


def test_table_forgets_when_full(monkeypatch):
    from tidemark.llm import word_table

    monkeypatch.setattr(word_table, "REMEMBERED", 5)
    path = tokenizer_path("piece_bpe_32k.model")
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceTable(pieces.vocabulary_of(path))
    for text in ("one two three four", "five six seven", "one two nine", "four five"):
        ids, off = own.encode(pa.array([text, None]))
        assert ids.tolist() == model.encode(text) and off.tolist() == [0, len(ids), len(ids)]


def test_packing_table_keeps_what_is_at_hand(monkeypatch):
    from tokenizers import Tokenizer

    from tidemark.llm import packing, word_table

    monkeypatch.setattr(word_table, "REMEMBERED", 6)
    path = tokenizer_path("word_bpe_49k.json")
    model, own, rng = Tokenizer.from_file(path), packing.WordTokens(path, 2), random.Random(2)
    fresh = lambda t: packing.WordTokens(path, 2).encode(pa.array([t]))[2]
    for _ in range(40):
        text = " ".join(rng.choice(["alpha", "beta7", "gamma's", "delta,", "it", "of", "x" * 9, "é", "naïve"]) for _ in range(rng.randrange(9)))
        ids, off, vec = own.encode(pa.array([text]))
        assert ids.tolist() == [*model.encode(text, add_special_tokens=False).ids, 2] and (vec == fresh(text)).all()
