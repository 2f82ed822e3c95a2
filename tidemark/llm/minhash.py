"""Near-duplicate documents with HyperMinHash sketches.

Each bucket of a sketch has a hash function of its own and stores, of the least hash of the
document's shingles, the leading-zero count and the ten bits behind the first one: 16 bits. Four
buckets make a band. Documents that share a band are candidates; the Jaccard estimate from whole
sketches, corrected for chance collisions of compressed registers, drops most of them; what is
left is confirmed on the full shingle sets. With 32 bands of 4, a pair at similarity 0.8 has no
common band with probability 5e-8.

No group is expanded into all pairs. Equal shingle sets are one class from the start. In a band's
bucket each class meets the bucket's least and greatest class only; the confirmed links are closed
into components. Buckets that still hold several components then compare, in blocks of bounded size, only
classes outside the bucket's main component with the others: by sketch, then on the full sets, best
estimates first and only while the two are not in one component. This finds every other link that
joins components, and only such links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import LOWER, U64, Words, binaries, distinct_by_text, mix, shingles, slices
from .common import Scratch, released, written

BANDS, ROWS, MANTISSA = 32, 4, 10
BUCKETS = BANDS * ROWS
#: How far below the threshold an estimate may lie (six standard deviations at 128 buckets).
MARGIN = 0.22
#: Bytes (sketches and sets) of a block outside the main component, of one of all rows, and of the blocks that a task takes together, on average.
REST_BYTES, ALL_BYTES, GROUP_BYTES = 2 << 20, 8 << 20, 8 << 20
_rng = np.random.default_rng(42)
_FLIP = _rng.integers(0, 2**63, BUCKETS, dtype=U64)
_MULT = _rng.integers(0, 2**62, BUCKETS, dtype=U64) * U64(4) + U64(1)
_SALT = _rng.integers(0, 2**63, BANDS, dtype=U64)


def registers(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(document, bucket) registers; a document without shingles has zeros."""
    out = np.zeros((len(off) - 1, BUCKETS), np.uint16)
    full = np.flatnonzero(np.diff(off))
    if not len(full):
        return out
    start, work = off[:-1][full], np.empty_like(values)
    least = np.empty((BUCKETS, len(full)), U64)
    for k in range(BUCKETS):
        np.bitwise_xor(values, _FLIP[k], out=work)
        np.multiply(work, _MULT[k], out=work)
        np.minimum.reduceat(work, start, out=least[k])
    fraction, exponent = np.frexp(least.T.astype(np.float64))
    bits = np.minimum((2 * fraction - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).astype(np.uint16)
    out[full] = (np.clip(64 - exponent, 0, 63).astype(np.uint16) << MANTISSA) | np.where(least.T > 0, bits, 0)
    return out


def collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that the registers of two disjoint sets of n and m shingles are equal."""
    n, m, total = n.astype(float), m.astype(float), np.zeros(len(n))
    for zeros in range(48):
        low, high = 2.0 ** -(zeros + 1), 2.0**-zeros
        # The leading-zero count is shared; mantissas are near uniform within it.
        total += (np.exp(-n * low) - np.exp(-n * high)) * (np.exp(-m * low) - np.exp(-m * high))
    return total / (1 << MANTISSA)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for collisions."""
    c = collision(n, m)
    return (equal / BUCKETS - c) / (1 - c)


def _sets(part: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(part, LOWER)
    return distinct_by_text(*shingles(words.hashes(), words.off, width))


def _keys(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for the shingle set, whatever its order; the second carries its size."""
    one, two = (np.concatenate([np.zeros(1, U64), np.cumsum(mix(values ^ s), dtype=U64)]) for s in (_FLIP[0], _FLIP[1]))
    n = np.diff(off).astype(U64)
    return mix(one[off[1:]] - one[off[:-1]] + n).view(np.int64), mix(two[off[1:]] - two[off[:-1]] ^ n).view(np.int64)


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 19):
            values, off = _sets(part.column(1), width)
            one, two = _keys(values, off)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BUCKETS), part.num_rows, [None, pa.py_buffer(registers(values, off))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(one), pa.array(two), packed, *part.columns[2:]], names=["doc_id", "n", "key1", "key2", "regs", *part.schema.names[2:]])

    return run


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        regs = np.frombuffer(b"".join(b.column(1).to_pylist()), U64).reshape(-1, BANDS)
        keys = mix(regs ^ _SALT).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows))], names=["key", "class", "band"])


def _estimated(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (4, 5))
            keep = estimate((a == c).sum(1), b.column(2).to_numpy(), b.column(3).to_numpy()) >= least
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values, off = _sets(part.column(0), width)
            yield pa.RecordBatch.from_arrays([*map(pa.array, _keys(values, off)), binaries(values, off)], names=["key1", "key2", "set"])

    return run


def _confirmed(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                shared = _shared(x, y)
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _block_links(least: float, num: int, den: int):
    """Links of each block between rows outside the main component and all rows, best estimates first, until what is linked is in one component."""

    def run(table: pa.Table) -> pa.Table:
        key = np.stack([table.column(c).to_numpy() for c in ("main", "rest_block", "all_block")])
        order = np.lexsort(key)
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(key[:, order]) != 0).any(0), [True]]))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        sets = [np.frombuffer(x, U64) for x in table.column("set").to_pylist()]
        cls, comp, n, rest = (table.column(c).to_numpy() for c in ("class", "component", "n", "rest"))
        left, right = [], []
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            own = order[s:e]
            asked, others = own[rest[own]], own[~rest[own]]
            root: dict[int, int] = {}

            def find(c: int, root: dict[int, int] = root) -> int:
                while c in root:
                    c = root[c]
                return c

            for i in asked:
                near = estimate((regs[others] == regs[i]).sum(1), np.full(len(others), n[i]), n[others])
                at = np.flatnonzero((comp[others] != comp[i]) & (near >= least))
                for j in others[at[np.argsort(-near[at], kind="stable")]]:
                    a, b = find(comp[i]), find(comp[j])
                    if a != b:
                        shared = _shared(sets[i], sets[j])
                        if den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
                            root[a] = b
                            left.append(cls[i])
                            right.append(cls[j])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (a, b); the component is its least node.

    Alternates large-star and small-star steps until the links are stars; each step is a minimum by
    node and a join, so no neighbourhood is gathered in one place.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        old = edges
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")  # so that a hub's edges can be split over tasks
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        released(old, least)
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out.written_to = edges.written_to
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Takes `doc_id` and `text`; other columns are ignored. A document's set holds its distinct
    `width`-word shingles (of A-Z lower-cased words), or its whole word sequence if it is shorter. A
    null or empty text, or one without words, is linked with nothing. Documents are linked if the
    shared shingles are at least `percent` per cent of the union. component_id is the least doc_id
    reachable; kept holds for that document. Rows with the same doc_id are judged each by its text and
    keep the id; a null doc_id is kept only where no other id is reachable. An empty table gives no rows.

    With `by_text` the rows also have `body`, the xxhash64 of the text, and kept holds for one
    (doc_id, body) of each component, whatever ids repeat or are null: the least, a null doc_id
    last. Rows that are equal in both are equally kept. A text without words is always kept.
    """
    own = [F.xxhash64(F.col("text").cast("string")).alias("body")] if by_text else []
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scratch = Scratch()
    sketches = scratch.written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *own).mapInArrow(_sketched(width), f"doc_id long, n long, key1 long, key2 long, regs binary{', body long' * by_text}"), "sketches")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    least_row = [F.min(at).alias("at")] if by_text else []
    distinct = sketches.filter("n > 0").groupBy("key1", "key2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("regs").alias("regs"), *least_row)
    # 128 bits tell shingle sets apart; a number of their own, fixed once it is written, stands for them from here on.
    classes = scratch.written(distinct.withColumn("class", F.monotonically_increasing_id()), "classes")
    bands = classes.select("class", "regs").mapInArrow(_banded, "key long, class long, band int")
    # Written, so that the join reads two shuffles and a key with very many rows can be split over tasks.
    shared = scratch.written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("low"), F.max("class").alias("high")).filter("size > 1"), "shared")
    buckets = scratch.written(bands.join(shared, "key"), "buckets")
    near = buckets.select(F.col("class").alias("a"), F.explode(F.array("low", "high")).alias("b")).filter("a <> b")
    links = _links(scratch, source, classes, _ordered(near), width, percent)
    first = components(links)
    more = _rest(scratch, source, buckets, classes, first, width, percent)
    found = components(scratch.written(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "links"))
    scratch.tables += [first, found]
    rooted = classes.drop("n", "regs").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    rooted = scratch.written(rooted, "rooted")
    least = scratch.written(rooted.groupBy("component").agg(F.min("doc_id").alias("component_id"), *[F.min("at").alias("at")] * by_text), "roots")
    of_class = scratch.written(rooted.drop("at").join(least, "component").select("key1", "key2", "component_id", *["at"] * by_text), "components")
    scratch.release(sketches, of_class)
    body = ["body"] * by_text
    worded = sketches.filter("n > 0").join(of_class, ["key1", "key2"])
    kept = at == F.col("at") if by_text else F.col("doc_id").eqNullSafe(F.col("component_id"))
    worded = worded.select("doc_id", F.col("n").alias("n_shingles"), "component_id", *body, kept.alias("kept"))
    return worded.unionByName(sketches.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *body, F.lit(True).alias("kept")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(scratch: Scratch, source: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of classes whose full sets are similar enough."""
    a, b = (classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")) for x in "ab")
    likely = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    likely = scratch.written(likely.mapInArrow(_estimated(percent / 100 - MARGIN), "a long, b long"), "likely")
    sets = _sets_of(scratch, source, classes, likely.select(F.explode(F.array("a", "b")).alias("class")).distinct(), width)
    full = likely.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
    return scratch.written(full.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent, 100), "a long, b long"), "links")


def _sets_of(scratch: Scratch, source: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(class, set) of the wanted classes, each from one of its rows."""
    ids = wanted.join(classes.select("class", "doc_id", "key1", "key2"), "class")
    # A text that shares the id but not the class is left out by the second join.
    own = source.join(ids.select("doc_id").distinct(), source["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    sets = own.select("text").mapInArrow(_set_rows(width), "key1 long, key2 long, set binary").join(ids.drop("doc_id"), ["key1", "key2"])
    return scratch.written(sets.select("class", "set").dropDuplicates(["class"]), "sets")


def _rest(scratch: Scratch, source: DataFrame, buckets: DataFrame, classes: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """Links in buckets that hold several components; the first round has met all pairs of buckets of two.

    Buckets with the same main component are taken together, so a class comes once for all its bands. Blocks are cut by the bytes of
    sketches and sets, and the number of groups follows from the bytes that are dealt, so a task's memory does not grow with a bucket.
    """
    placed = scratch.written(buckets.filter("size > 2").select("key", "class").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")), "placed")
    by = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    main = by.groupBy("key").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("held")).filter("held > 1").select("key", "main")
    main = scratch.written(main, "main")  # as with `shared`: so that a key with very many rows can be split over tasks
    weight = 8 * F.col("n") + 2 * BUCKETS
    rows = placed.join(main, "key").select("main", "class", "component").distinct()
    rows = scratch.written(rows.join(classes.select("class", weight.alias("bytes")), "class"), "open")
    outside = F.when(F.col("component") != F.col("main"), F.col("bytes")).otherwise(0)
    blocks = lambda total, most: F.ceil(total / most).cast("int")
    sizes = rows.groupBy("main").agg(F.sum("bytes").alias("of"), F.sum(outside).alias("outside"))
    sizes = scratch.written(sizes.select("main", blocks(F.col("of"), ALL_BYTES).alias("all_blocks"), blocks(F.col("outside"), REST_BYTES).alias("rest_blocks"), (F.col("outside") * blocks(F.col("of"), ALL_BYTES) + F.col("of") * blocks(F.col("outside"), REST_BYTES)).alias("dealt")), "blocks")
    sets = _sets_of(scratch, source, classes, rows.select("class").distinct(), width)
    open_ = rows.drop("bytes").join(sizes.drop("dealt"), "main").join(classes.select("class", "n", "regs"), "class").join(sets, "class")
    rest_blocks, all_blocks = F.col("rest_blocks"), F.col("all_blocks")
    place = F.pmod(F.xxhash64("class"), F.lit(1 << 30))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["main", "rest_block", "all_block", "class", "component", "n", "rest", "regs", "set"]
    asked = open_.filter("component <> main").withColumns({"rest_block": (place % rest_blocks).cast("int"), "rest": F.lit(True)}).withColumn("all_block", every(all_blocks))
    others = open_.withColumns({"all_block": (place % all_blocks).cast("int"), "rest": F.lit(False)}).withColumn("rest_block", every(rest_blocks))
    groups = max(1, (sizes.agg(F.sum("dealt")).first()[0] or 0) // GROUP_BYTES)
    dealt = asked.select(columns).unionByName(others.select(columns)).groupBy(F.pmod(F.xxhash64("main", "rest_block", "all_block"), F.lit(groups)).alias("g"))
    return scratch.written(dealt.applyInArrow(_block_links(percent / 100 - MARGIN, percent, 100), "a long, b long"), "more")
