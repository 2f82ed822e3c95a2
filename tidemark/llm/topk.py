"""Exact top-k inner products with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments. With the segments' means and standard deviations,
Cauchy-Schwarz bounds an inner product from above (and so the distance from below):
`sum(L * mean_q * mean_x + L * sd_q * sd_x)`. Bounds are taken coarse to fine, each only for pairs
that the one before left above the query's current k-th score; survivors get the exact integer score.

Of the first rows that a query meets, those with the best bounds are scored first, so that the others meet a k-th score.
How much is pruned depends on the vectors: where neighbouring components go together, nearly all; where they are
independent of each other, the bounds lie above the scores and all pairs are scored.

Queries come in blocks of bounded size; one block after another is broadcast, met by one
pass over all rows, and dropped. Each task keeps the k best of its rows for each query, then these are merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, shared_dir, written

SEGMENTS = (1, 4, 16)
#: Queries in a block, and the most bytes a broadcast block may have.
BLOCK, BLOCK_BYTES = 4096, 32 << 20
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) * mean and sqrt(L) * sd of each segment: the dot product of two such rows bounds the inner product."""
    cuts = [s for s in np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1]))) if len(s)]
    root = np.sqrt([len(s) for s in cuts])
    mean = np.stack([x[:, s].mean(1) for s in cuts], 1)
    sd = np.stack([x[:, s].std(1) for s in cuts], 1)
    return np.concatenate([mean * root, sd * root], 1)


def usable(column: pa.Array) -> np.ndarray:
    """Whether each vector is present, has components and holds no null or non-finite one."""
    column = column.cast(pa.list_(pa.float64()))
    off, flat = np.asarray(column.offsets), column.values
    good = np.isfinite(flat.to_numpy(zero_copy_only=False)) if len(flat) else np.zeros(0, bool)
    bad = np.concatenate([[0], np.cumsum(~good)])
    return (bad[off[1:]] == bad[off[:-1]]) & (off[1:] > off[:-1]) & column.is_valid().to_numpy(zero_copy_only=False)


def by_size(ids: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(scale * component)) of the usable vectors, for each number of components."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    off, ok = np.asarray(vectors.offsets), usable(vectors) & ids.is_valid().to_numpy(zero_copy_only=False)
    flat, size = vectors.values.to_numpy(zero_copy_only=False), np.diff(off)
    ids = ids.fill_null(0).to_numpy()
    for n in np.unique(size[ok]):
        at = np.flatnonzero(ok & (size == n))
        yield ids[at], np.floor(scale * flat[off[at][:, None] + np.arange(n)])


class Best:
    """The k best (score, smaller id first) candidates of each query so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, queries, k
        self.stats = [statistics(queries, s) for s in SEGMENTS]
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        #: Pairs met, and pairs left after each resolution.
        self.pairs = np.zeros(1 + len(SEGMENTS), np.int64)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        if len(ids) > self.k and np.isneginf(self.score[:, -1]).any():  # the rows with the best bounds first
            bound = (self.stats[-1] @ statistics(x, SEGMENTS[-1]).T).max(0)
            order = np.argsort(-bound, kind="stable")
            first = order[: 2 * self.k]
            self._met(ids[first], x[first])
            ids, x = ids[order[2 * self.k :]], x[order[2 * self.k :]]
        if len(ids):
            self._met(ids, x)

    def _met(self, ids: np.ndarray, x: np.ndarray) -> None:
        floor = self.score[:, -1]
        coarse, *finer = (statistics(x, s) for s in SEGMENTS)
        slack = 1e-9 * (1 + np.abs(self.q).sum(1) * np.abs(x).max(initial=0))
        left = self.stats[0] @ coarse.T + slack[:, None] >= floor[:, None]
        left &= self.ids[:, None] != ids[None, :]
        qi, xi = np.nonzero(left)
        self.pairs[:2] += left.size, len(qi)
        for level, (of_q, of_x) in enumerate(zip(self.stats[1:], finer, strict=True), 2):
            keep = self._products(of_q, of_x, qi, xi) + slack[qi] >= floor[qi]
            qi, xi = qi[keep], xi[keep]
            self.pairs[level] += len(qi)
        score = self._products(self.q, x, qi, xi)
        keep = score >= floor[qi]
        qi, xi, score = qi[keep], xi[keep], score[keep]
        touched = np.unique(qi)
        at = np.concatenate([np.repeat(touched, self.k), qi])
        score = np.concatenate([self.score[touched].ravel(), score])
        vec = np.concatenate([self.vec[touched].ravel(), ids[xi]])
        order = np.lexsort((vec, -score, at))
        at, score, vec = at[order], score[order], vec[order]
        start = np.searchsorted(at, touched)
        pick = start[:, None] + np.arange(self.k)
        self.score[touched], self.vec[touched] = score[pick], vec[pick]

    @staticmethod
    def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Dot products of row pairs: one matrix product if most pairs are asked for."""
        if 4 * len(i) > len(a) * len(b):
            return (a @ b.T)[i, j]
        out = np.empty(len(i))
        for s in range(0, len(i), 1 << 16):
            out[s : s + (1 << 16)] = np.einsum("ij,ij->i", a[i[s : s + (1 << 16)]], b[j[s : s + (1 << 16)]])
        return out

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, r = np.nonzero(np.isfinite(self.score))
        return self.ids[q], self.vec[q, r], self.score[q, r].astype(np.int64)


def _search(block, k: int, scale: float, rows: int = 1024):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = (pa.array(x) for x in block.value)
        best = {q.shape[1]: Best(i, q, k) for i, q in by_size(ids, vectors, scale)}
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                for i, x in by_size(part.column(0), part.column(1), scale):
                    if x.shape[1] in best:
                        best[x.shape[1]].meet(i, x)
        for b in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in b.rows()], schema=_SCHEMA)

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, block: int = BLOCK) -> DataFrame:
    """For every query row, its `k` highest integer inner products with all other rows.

    Takes `vec_id` and `embedding`. Components count as floor(scale * x). Ties go to the smaller
    vec_id. Null ids, vectors that are null or empty or hold a null or non-finite component take no
    part; vectors meet only vectors with as many components. Of rows with the same vec_id each is a
    candidate, none of them for a query with that id; a repeated query id is asked once, with its
    smallest vector. An empty table gives no rows.
    """
    spark = rows.sparkSession
    usable_rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("_q")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    # Before the minimum, as an unusable vector could be the smallest. NaN counts as greater than infinity.
    finite = (F.size("embedding") > 0) & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    asked = written(usable_rows.filter("_q").filter(finite).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "asked")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.size("embedding") + 8).alias("bytes")).first()
    blocks = max(-(-size["n"] // block), -(-2 * (size["bytes"] or 0) // BLOCK_BYTES))
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Dealt out in turn, blocks are of one size; each is a partition of the written table.
    numbered = written(asked.repartition(blocks).withColumn("_block", F.spark_partition_id()), "queries")
    path = f"{shared_dir(spark)}/tidemark/found-{uuid.uuid4().hex}"
    for number in range(blocks):
        own = numbered.filter(F.col("_block") == number).select("vec_id", "embedding").collect()  # `block` queries, BLOCK_BYTES at most
        held = spark.sparkContext.broadcast(([x["vec_id"] for x in own], [x["embedding"] for x in own]))
        one = usable_rows.select("vec_id", "embedding").mapInArrow(_search(held, k, scale), "query_id long, vec_id long, score long")
        one.write.mode("append").option("compression", "zstd").parquet(path)
        held.destroy()
    released(asked, numbered)
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
