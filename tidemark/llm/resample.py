"""Importance resampling towards a target: hashed word n-grams, log ratios of bucket counts, and draws with Gumbel noise.

A feature's bucket is the CRC-32 of its bytes. The CRC of each distinct word is computed once; the CRC of a longer
run follows by the algebra of the code: crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where shifting by n bytes is a
32 x 32 matrix over GF(2). Matrices for 1, 2, 4, ... bytes are kept as four tables of 256 entries each, and
a shift by any length is a product of those. No string of an n-gram is ever made.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import ALNUM, Words, slices
from .common import written
from .ordered import numbered


def byte_step(crc: np.ndarray) -> np.ndarray:
    """The register after one zero byte, bit by bit from the code's polynomial."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (crc & np.uint32(1)))
    return crc


def as_tables(columns: np.ndarray) -> np.ndarray:
    """A matrix, given by the images of the 32 single bits, as the images of all values of each of the four bytes."""
    out = np.zeros((4, 256), np.uint32)
    for bit in range(8):
        out[:, (np.arange(256) >> bit & 1) == 1] ^= columns.reshape(4, 8)[:, bit, None]
    return out


def times(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0, crc & 255] ^ tables[1, crc >> 8 & 255] ^ tables[2, crc >> 16 & 255] ^ tables[3, crc >> 24]


class Shifts:
    """Shifts of CRCs by any number of bytes; the matrix of 2^k bytes is the square of the one before."""

    def __init__(self):
        self.columns = byte_step(np.uint32(1) << np.arange(32, dtype=np.uint32))
        self.tables = [as_tables(self.columns)]

    def by(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        crc = crc.copy()
        for k in range(int(length.max(initial=0)).bit_length()):
            if k == len(self.tables):
                self.columns = times(self.tables[-1], self.columns)
                self.tables.append(as_tables(self.columns))
            at = np.flatnonzero(length >> k & 1)
            crc[at] = times(self.tables[k], crc[at])
        return crc


SPACE = np.uint32(zlib.crc32(b" "))


def feature_crcs(words: Words, width: int, shifts: Shifts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to `width` words: (text of each run, CRC of its words joined by one space)."""
    coded = words.array().dictionary_encode()
    distinct, at = coded.dictionary.cast(pa.binary()).to_pylist(), np.asarray(coded.indices)
    crc, length = np.array([zlib.crc32(w) for w in distinct], np.uint32), np.array([len(w) for w in distinct], np.int64)
    spaced = shifts.by(np.full(len(crc), SPACE), length) ^ crc  # of a blank and the word
    text = words.text_of()
    run = crc[at] if len(at) else np.zeros(0, np.uint32)
    yield text, run
    for k in range(1, width):
        both = text[k:] == text[:-k] if k < len(text) else np.zeros(0, bool)
        run = shifts.by(run[: max(len(at) - k, 0)], length[at[k:]] + 1) ^ spaced[at[k:]] if len(both) else np.zeros(0, np.uint32)
        yield text[k:][both], run[both]  # `run` goes on over all places; those across texts are left out here


def _counted(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, n = Shifts(), np.zeros(buckets, np.int64)
        for part in slices(batches, "text"):
            for _, crc in feature_crcs(Words(part.column(0), ALNUM), width, shifts):
                n += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, width: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket: `buckets` numbers reach the driver, whatever the size."""
    each = texts.select(F.col("text").cast("string")).mapInArrow(_counted(width, buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, the log ratio of its smoothed shares, in floored thousandths."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(t + 1) * float(s_all + buckets)) / (float(s + 1) * float(t_all + buckets))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ], np.int64)


def _weighed(gain: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = Shifts()
        for part in slices(batches, "text"):
            words = Words(part.column(1), ALNUM)
            n, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            for text, crc in feature_crcs(words, width, shifts):
                upto = np.searchsorted(text, np.arange(part.num_rows + 1))
                n += np.diff(upto)
                total += np.diff(np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])[upto])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(words.off), pa.int64()), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"]
            )

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document, in floored thousandths; it depends on the seed and the id alone."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, benchmark: DataFrame, width: int = 2, buckets: int = 10_000, percent: int = 25, least: int = 20, seed: int = 7) -> DataFrame:
    """Weight, score and rank of every document; the drawn ones are those with a rank.

    Takes `doc_id` and `text` of `docs` and `text` of `benchmark`; other columns are ignored. Of the documents with `least` words or
    more, `percent` in a hundred with the highest scores are drawn, ties to the smaller doc_id, null ids last; rows
    that tie in both are ranked by their number of features and then in any order. A null or empty text has no features and weight 0, and is not drawn.
    A null doc_id draws its noise as an empty name. Rows that repeat count each. Empty tables: no documents, no rows; no benchmark, all target counts are 0.

    Features are counted in one pass, weighed in a second; the ranks come from a range sort over all partitions.
    """
    gain = gains(bucket_counts(docs, width, buckets), bucket_counts(benchmark, width, buckets))
    weighed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_weighed(gain, width), "doc_id long, n_words long, n_features long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()), "scored")
    able, columns = F.col("n_words") >= least, ["doc_id", "n_features", "weight", "score"]
    drawn = percent * scored.filter(able).count() // 100
    ranked = numbered(scored.filter(able), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")], "ranked")
    rank = F.col("at") + 1
    some = ranked.select(*columns, F.when(rank <= drawn, rank).alias("rank"))
    return some.unionByName(scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
