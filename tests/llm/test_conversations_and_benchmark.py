"""Prefix trie, resampling and decontamination against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontaminate, ordered, prefix_trie, resample
from tidemark.llm.arrow_text import ALNUM, Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CONV = "conv_id long, turn long, role string, text string, depth string, size int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), hashlib.sha256((sha(role or "") + (text or "")).encode()).digest(), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    return Counter(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(n)))))) for n, m in members.items()
    )


def conversations(seed):
    rng, rows = random.Random(seed), []
    said = ["", "a", "b", "é" * 9, "long " * 50, None]
    for c in [*range(-12, 90), 10**12, 10**12 + 1]:
        if c % 7 == 3:
            continue
        n = rng.choice([0, 1, 2, 3, 8, 9, 14]) if c % 6 else 4
        rows += [(c, t if rng.random() > 0.1 else None, rng.choice(["u", None, ""]) if c % 6 else "u", rng.choice(said[:4]) if t > 2 else rng.choice(said[4:]) if c % 6 else "same", "x", 1) for t in range(n)]
        if n and c % 11 == 0:
            rows += [rows[-1], rows[-1]]
    rows += [(200, t, "u", str(t % 3), "y", 2) for t in range(700)] + [(205, t, "u", str(t % 3), "y", 2) for t in range(690)]  # long, shared and not
    rows += [(300, t, "u", f"t{t}", "y", 2) for t in range(400)]
    rows += [(None, 1, "u", "nobody's", "z", 3)] * 5
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "run_turns", "range_turns"), [(1, 40, 60), (2, 100_000, 100_000)])
def test_trie(spark, seed, run_turns, range_turns):
    rows = conversations(seed)
    frame = spark.createDataFrame(rows, CONV).repartition(5)
    got = Counter(tuple(r) for r in prefix_trie.trie(frame, run_turns, range_turns).collect())
    assert got == brute_trie(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], CONV)
    assert prefix_trie.trie(none).count() == 0
    only = spark.createDataFrame([(8, 0, "u", "x", "", 0)], CONV)
    got = {tuple(r) for r in prefix_trie.trie(only).collect()}
    assert got == set(brute_trie([(8, 0, "u", "x")]))


def test_loser_tree_merges_by_shared_turns():
    rng = random.Random(3)
    key = lambda t: bytes([t]) * prefix_trie.KEY
    convs = [(b"".join(key(rng.randrange(3)) for _ in range(rng.randrange(7))), i) for i in range(500)]
    for k in (1, 2, 3, 7, 64):
        runs = []
        for r in range(k):
            part, last = sorted(convs[r::k]), b""
            run = []
            for s, i in part:
                run.append([prefix_trie.shared_turns(last, s), s, i, None])
                last = s
            runs.append(iter(run))
        out = [tuple(x) for x in prefix_trie.LoserTree(runs)]
        assert [(s, i) for _, s, i, _ in out] == sorted(convs)
        assert [x[0] for x in out[1:]] == [prefix_trie.shared_turns(a[1], b[1]) for a, b in zip(out, out[1:], strict=False)]
    assert list(prefix_trie.LoserTree([])) == []


def test_numbered(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), i) for i in range(1000)]
    frame = spark.createDataFrame(rows, "k long, i long").repartition(6)
    got = ordered.numbered(frame, [frame["k"].desc_nulls_last(), frame["i"].asc()], "t").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r["k"], r["i"]) for r in sorted(got, key=lambda r: r["at"])] == want
    assert sorted(r["at"] for r in got) == list(range(1000))


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "x" * 300]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 9, 10, 14, 40]))] for _ in range(30)]
    items = [(i, " ".join(p), "e") for i, p in enumerate(passages)]
    items += [(100, items[4][1].upper(), "e"), (100, items[4][1], "e"), (None, items[5][1], "e"), (7, None, "e"), (8, " .,", "e"), (9, "", "e"), (10, " ".join(rng.choice(vocabulary) for _ in range(5000)), "e")]
    docs = []
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 19, 20, 60]))]
        if i % 3 == 0:
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w = w + p[a : a + rng.choice([9, 10, 11, 40])] + w[:3]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).title() if i % 2 else " ".join(w), "x", 1))
    docs += [docs[3], docs[3], (3, "other", "x", 1), (None, docs[6][1], "x", 1), (None, docs[6][1], "x", 1), (500, None, "x", 1), (501, "", "x", 1), (502, " ".join(rng.choice(vocabulary) for _ in range(20_000)) + " " + items[10][1], "x", 1)]
    rng.shuffle(docs)
    return docs, items


DOCS, ITEMS = "doc_id long, text string, items string, n_words int", "item_id long, text string, doc_id string"


def brute_hits(docs, items, span):
    tests = defaultdict(set)
    for i, t, *_ in items:
        w = words(t)
        for k in range(len(w) - min(span, len(w)) + 1 if w else 0):
            tests[tuple(w[k : k + span])].add(i)
    out = Counter()
    for d, t, *_ in docs:
        w, hit, met = words(t), set(), set()
        for size in {len(x) for x in tests}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in tests:
                    hit |= set(range(k, k + size))
                    met |= tests[x]
        names = sorted(str(i) for i in met if i is not None)
        out[d, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)] += 1
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 23, 4000])
def test_decontamination(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(decontaminate, "PIECE", 64)
    docs, items = texts(5)
    frame, bench = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS).repartition(2)
    got = Counter(tuple(r) for r in decontaminate.contamination(frame, bench, 10, shard_bytes).collect())
    assert got == brute_hits(docs, items, 10)


def test_decontamination_of_nothing(spark):
    docs, items = texts(6)
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0
    assert not decontaminate.contamination(frame, bench.limit(0)).filter("contaminated or n_hit > 0 or n_items > 0").count()


def test_matcher_finds_what_shifts_could_skip():
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 10):
        ids = rng.integers(0, 3, 4000).astype(np.int32)
        off = np.array([0, 0, 1, 700, 701, 3000, 4000])
        strings = np.unique(rng.integers(1, 3, (40, size)).astype(np.int32), axis=0)
        place, string = decontaminate.Matcher(strings).find(ids, off)
        want = {(p, tuple(s)) for a, b in zip(off, off[1:], strict=False) for p in range(a, b - size + 1) for s in strings.tolist() if ids[p : p + size].tolist() == s}
        assert {(p, tuple(strings[s].tolist())) for p, s in zip(place.tolist(), string.tolist(), strict=True)} == want


def test_crc_algebra():
    column = pa.array(["one two three", "", None, "x", "Ünï " + "y" * 5000 + " z z", "." * 40, "a b"])
    shifts = resample.Shifts()
    for k, (text, crc) in enumerate(resample.feature_crcs(Words(column, ALNUM), 3, shifts)):
        want = [(i, zlib.crc32(" ".join(w[j : j + k + 1]).encode())) for i, t in enumerate(column.to_pylist()) for w in [words(t)] for j in range(len(w) - k)]
        assert list(zip(text.tolist(), crc.tolist(), strict=True)) == want


def brute_sample(docs, items, buckets=10_000, percent=25, least=20, seed=7):
    feats = lambda t: [" ".join(w[k : k + n]) for w in [words(t)] for n in (1, 2) for k in range(len(w) - n + 1)]
    count = lambda rows: Counter(zlib.crc32(f.encode()) % buckets for _, t, *_ in rows for f in feats(t))
    s, t = count(docs), count(items)
    gain = [math.floor(1000 * math.log(((t[k] + 1) * (s.total() + buckets)) / ((s[k] + 1) * (t.total() + buckets)))) for k in range(buckets)]
    rows = []
    for d, text, *_ in docs:
        f = feats(text)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(sha(f"{seed}:{'' if d is None else d}")[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = percent * len(able) // 100
    return Counter([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if not r[4]])


def test_resampling(spark):
    docs, items = texts(8)
    frame, bench = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS)
    assert Counter(tuple(r) for r in resample.resample(frame, bench).collect()) == brute_sample(docs, items)
    assert Counter(tuple(r) for r in resample.resample(frame, bench.limit(0), percent=100).collect()) == brute_sample(docs, [], percent=100)
    assert resample.resample(frame.limit(0), bench).count() == 0


def test_registered_queries_equal_their_sql(spark):
    import os

    import duckdb

    from tidemark.llm import queries

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(sf):
        db.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}{'/*.parquet' if os.path.isdir(f'{sf}/{f}') else ''}'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf), db.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall()), name
