"""Benchmark decontamination by Wu-Manber search over words.

Test strings are windows of `span` consecutive words of benchmark items (the whole item, if it has fewer). For
each length of test string there is a matcher: a shift table over blocks of two words says how far a window's
end may jump; where it says 0, the bucket of that suffix block (and of the window's first block) names the test strings
that may stand there, and these are compared word for word. Many places of a slice of texts are
moved along at once, each over its own stretch.

The benchmark is cut into pieces that overlap by `span - 1` words and dealt into shards of bounded bytes. One shard at a time
is gathered, made into tables and broadcast, so neither the driver nor a task holds more than a shard, whatever the benchmark's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import ALNUM, Words, slices

#: Bytes of benchmark pieces in a shard, words of a piece, and window ends that one cursor walks over.
SHARD_BYTES, PIECE, STRETCH = 8 << 20, 2048, 128
#: Candidates times test strings that are compared at once.
COMPARED = 1 << 16
_BITS = 18
FOUND = "doc_id long, body long, n_words long, spans array<struct<a: int, b: int>>, items array<string>"


class Matcher:
    """Shift table and buckets of test strings of one length, given as rows of word numbers from 1 (0 is a word that no item has)."""

    def __init__(self, strings: np.ndarray):
        self.size = size = strings.shape[1]
        self.block = min(2, size)
        self.shift = np.full(1 << _BITS, size - self.block + 1, np.uint8)
        for end in range(self.block, size + 1):
            np.minimum.at(self.shift, self.hashed(strings[:, end - self.block : end]), size - end)
        key = self.keys(strings)
        order = np.argsort(key, kind="stable")
        self.key, self.strings, self.number = key[order], strings[order], order

    def hashed(self, blocks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(blocks), np.uint64)
        for k in range(self.block):
            out = (out + blocks[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (out >> np.uint64(64 - _BITS)).astype(np.int64)

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """The bucket of a window: of its last block and its first one."""
        return self.hashed(windows[:, self.size - self.block :]) << _BITS | self.hashed(windows[:, : self.block])

    def find(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each occurrence, its test string). ids: word numbers of texts; text i has words off[i] to off[i + 1]."""
        size, out = self.size, []
        length = np.maximum(np.diff(off) - size + 1, 0)  # window ends of each text
        cursors = -(-length // STRETCH)
        text = np.repeat(np.arange(len(length)), cursors)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(cursors) - cursors, cursors)
        at = off[text] + size - 1 + nth * STRETCH
        stop = np.minimum(at + STRETCH, off[text + 1])
        behind = np.arange(self.block) - self.block + 1
        while len(at):
            jump = self.shift[self.hashed(ids[at[:, None] + behind])].astype(np.int64)
            hit = at[jump == 0]
            if len(hit):
                out.append(self.confirmed(ids, hit - size + 1))
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def confirmed(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a place and a test string of its bucket whose words are the same."""
        key = self.keys(ids[start[:, None] + np.arange(self.size)])
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        some = low < high
        start, low, many = start[some], low[some], (high - low)[some]
        places, strings = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        upto, a = np.cumsum(many), 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + COMPARED, "right")))
            place = np.repeat(start[a:b], many[a:b])
            row = np.arange(len(place)) - np.repeat(upto[a:b] - many[a:b] - (upto[a - 1] if a else 0), many[a:b]) + np.repeat(low[a:b], many[a:b])
            same = (ids[place[:, None] + np.arange(self.size)] == self.strings[row]).all(1)
            places.append(place[same])
            strings.append(self.number[row[same]])
            a = b
        return np.concatenate(places), np.concatenate(strings)


class Shard:
    """Matchers of all test strings of some pieces, and the items of each test string."""

    def __init__(self, pieces: list[tuple[str | None, str]], span: int):
        self.items = sorted({i for i, _ in pieces if i is not None})
        number = {x: k for k, x in enumerate(self.items)}
        words = Words(pa.array([t for _, t in pieces], pa.string()), ALNUM)
        coded = words.array().dictionary_encode()
        self.vocabulary = coded.dictionary
        ids = np.asarray(coded.indices, np.int32) + 1 if len(words) else np.zeros(0, np.int32)
        item = np.array([-1 if i is None else number[i] for i, _ in pieces], np.int64)
        length = np.diff(words.off)
        self.matchers: list[tuple[Matcher, np.ndarray, np.ndarray]] = []
        for size in np.unique(np.minimum(length[length > 0], span)).tolist():
            of = np.flatnonzero(np.minimum(length, span) == size)
            many = length[of] - size + 1
            piece = np.repeat(of, many)
            start = words.off[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
            strings, at = np.unique(ids[start[:, None] + np.arange(size)], axis=0, return_inverse=True)
            known = item[piece] >= 0
            pairs = np.unique(at.reshape(-1)[known] * max(len(self.items), 1) + item[piece][known])
            owner = pairs // max(len(self.items), 1)
            self.matchers.append((Matcher(strings), pairs % max(len(self.items), 1), np.searchsorted(owner, np.arange(len(strings) + 1))))

    def find(self, words: Words) -> tuple[np.ndarray, list[list[str]]]:
        """(whether each word is inside an occurrence, the sorted items of each text)."""
        coded = words.array().dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
        ids = known[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int32)
        edge, text_of, pairs = np.zeros(len(ids) + 1, np.int64), words.text_of(), [np.zeros(0, np.int64)]
        for matcher, items, off in self.matchers:
            place, string = matcher.find(ids, words.off)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + matcher.size, -1)
            met = np.unique(text_of[place] * len(matcher.strings) + string)
            text, string = met // len(matcher.strings), met % len(matcher.strings)
            many = off[string + 1] - off[string]
            row = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(off[string], many)
            pairs.append(np.unique(np.repeat(text, many) * max(len(self.items), 1) + items[row]))
        own: list[list[str]] = [[] for _ in range(len(words.off) - 1)]
        for p in np.unique(np.concatenate(pairs)).tolist():
            own[p // len(self.items)].append(self.items[p % len(self.items)])
        return np.cumsum(edge[:-1]) > 0, own


def _cut(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column(1), ALNUM)
            flat, names = words.array().to_pylist(), part.column(0).to_pylist()
            rows = []
            for name, a, b in zip(names, words.off[:-1].tolist(), words.off[1:].tolist(), strict=True):
                rows += [(name, " ".join(flat[k : min(k + PIECE + span - 1, b)])) for k in range(a, max(b - span + 1, a + 1), PIECE) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["item", "piece"])

    return run


def _searched(shard):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column(2), ALNUM)
            hit, items = shard.value.find(words)
            edge = hit.copy()
            first = words.off[:-1][words.off[:-1] < words.off[1:]]
            if len(hit):
                edge[1:] &= ~hit[:-1]
                edge[first] |= hit[first]
            start = np.flatnonzero(edge)
            last = hit.copy()
            if len(hit):
                last[:-1] &= ~hit[1:]
                final = words.off[1:][words.off[:-1] < words.off[1:]] - 1
                last[final] |= hit[final]
            stop = np.flatnonzero(last) + 1
            text = words.text_of()[start]
            own = words.off[text]
            spans = pa.StructArray.from_arrays([pa.array(start - own, pa.int32()), pa.array(stop - own, pa.int32())], names=["a", "b"])
            to = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(words.off), pa.int64()), pa.ListArray.from_arrays(pa.array(to), spans), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "body", "n_words", "spans", "items"],
            )

    return run


def _covered(spans: Column) -> Column:
    """How many words the spans cover together."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["upto"], s["b"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["upto"], s["a"]))).alias("n")
    )
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Words of every whole text that stand inside a test string, and the items these belong to.

    Takes `doc_id` and `text` of `docs`, `item_id` and `text` of `benchmark`; other columns are ignored. Words are
    `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. A null or empty text has no words and no hits, a null or empty item no test strings;
    an item without an id marks words but is not listed. Rows that repeat are judged each; an item that repeats is listed once.
    An empty table of documents gives no rows, an empty benchmark leaves all clean. A text of any length is searched whole.

    With one shard there is no shuffle. With more, each is a pass over the documents, and the spans of a document (rows
    equal in doc_id and text are one) are put together.
    """
    pieces = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(_cut(span), "item string, piece string").distinct()
    total = pieces.agg(F.sum(F.octet_length("piece") + 64)).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    asked = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("body"), F.col("text").cast("string"))
    context, parts = docs.sparkSession.sparkContext, []
    for k in range(shards):
        rows = pieces.filter(F.pmod(F.xxhash64("piece", "item"), F.lit(shards)) == k).collect()
        parts.append(asked.mapInArrow(_searched(context.broadcast(Shard([(r["item"], r["piece"]) for r in rows], span))), FOUND))
    found = parts[0]
    if shards > 1:
        some = reduce(DataFrame.unionAll, [p.filter(F.size("spans") > 0) for p in parts])
        some = some.groupBy("doc_id", "body").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        some = some.select(F.col("doc_id").alias("id"), F.col("body").alias("hash"), "spans", "items")
        base = parts[0].select("doc_id", "body", "n_words")
        found = base.join(some, base["doc_id"].eqNullSafe(some["id"]) & (base["body"] == some["hash"]), "left")
        found = found.withColumns({c: F.coalesce(c, F.array().cast(found.schema[c].dataType)) for c in ("spans", "items")})
    n_hit = _covered(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
