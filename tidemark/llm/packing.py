"""Packing along a space-filling curve.

Each document's words are hashed into a vector, projected to three dimensions and placed on a
Hilbert curve. Documents are range-sorted by their place on the curve and laid end to end, so
neighbours on the curve share training sequences. The token stream is cut every `length` tokens,
and its last part into sequences of powers of two, so no sequence is padded.

Shuffles: narrow rows (curve key, row, token count) by range, then the token ids once by row.
Equal keys (copies) are spread by the row number, which is the second sort key.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .arrow_text import Words, buffers, byte_table, slices
from .common import written
from .word_table import LOOKUP_BYTES, WordTable, run_binaries

DIMS, BITS, HASHED = 3, 10, 256
#: A special token of the tokenizer, and the words that are read in a row.
PART, JOINED = "<|endoftext|>", 1000
#: Blanks at which a text may be cut without changing any token: no pre-token holds one.
SAFE = byte_table(b" \t\n\r", lower=False)
#: The tokenizer lower-cases, so words that differ in case share their ids.
FOLDED = byte_table(b" \t\n\r", lower=True)


def _inner_cuts() -> np.ndarray:
    """Cuts inside words that are pre-token ends whatever stands around them.

    A digit is a pre-token of its own, and letters and punctuation part, if both bytes are ASCII.
    Next to an apostrophe (which may start a contraction) or a non-ASCII byte nothing is cut.
    """
    kind = np.zeros(256, np.uint8)
    for b in range(33, 127):
        kind[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 0 if chr(b) == "'" else 3
    known = (kind[:, None] > 0) & (kind[None, :] > 0)
    return known & ((kind[:, None] != kind[None, :]) | (kind[:, None] == 2))


INNER = _inner_cuts()


class WordTokens(WordTable):
    """Ids of words by a `tokenizers` file, and the projected hash vector of each word."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.end_id, self.part_id = end_id, self.model.token_to_id(PART)
        self.projection = np.random.default_rng(20).standard_normal((HASHED, DIMS)).astype(np.float32)
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.vec = np.zeros((1 << 12, DIMS), np.float32)
        self.ids[0], self.len[0], self.n, self.used = self.end_id, 1, 1, 1  # slot 0 ends a document

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words without `<|` are read a thousand in a row, parted by a special token, which is cut from what stands around it."""
        if any("<|" in w for w in words):
            got = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.uint32), np.fromiter(map(len, got), np.int32, len(got))
        rows = [PART.join(words[i : i + JOINED]) + PART for i in range(0, len(words), JOINED)]
        ids = [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(rows, add_special_tokens=False)]
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
        ends = np.flatnonzero(flat == self.part_id)
        return np.delete(flat, ends), np.diff(ends, prepend=-1).astype(np.int32) - 1

    def learn(self, words: list[str]) -> None:
        first = self.n
        super().learn(words)
        self.grown("vec", self.n)
        h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        sign = np.where(h >> np.uint64(63), -1, 1).astype(np.float32)
        self.vec[first : self.n] = self.projection[h % np.uint64(HASHED)] * sign[:, None]

    def keep(self, words: pa.Array, slots: np.ndarray) -> None:
        vec = self.vec[slots]
        super().keep(words, slots)
        self.grown("vec", self.n)
        self.vec[self.n - len(slots) : self.n] = vec

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts with the end id after each, their offsets, and the projected vectors."""
        plain = b"<|" in memoryview(buffers(column)[0]).tobytes()  # a special token may stand in the text
        words = Words(column, SAFE) if plain else Words(column, FOLDED, INNER)
        each = self.slots(words)
        n = np.diff(words.off)
        vec = np.zeros((len(n), DIMS))
        if full := np.flatnonzero(n).tolist():
            vec[full] = np.add.reduceat(self.vec[each], words.off[:-1][full], axis=0)
        vec /= np.maximum(n, 1)[:, None]
        ids, to = self.gathered(np.insert(each, words.off[1:], 0))
        return ids, np.concatenate([[0], to[1:][words.off[1:] + np.arange(len(n))]]), vec


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point (integer coordinates below 2**bits) on the Hilbert curve."""
    x = [points[:, k].astype(np.int64) for k in range(points.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x = [v ^ t for v in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> b) & 1)
    return key


def curve_key(vec: np.ndarray) -> np.ndarray:
    """Means of projected word vectors, squashed to the grid of the curve."""
    grid = (0.5 + 0.5 * np.tanh(3.0 * vec)) * (1 << BITS)
    return hilbert(np.clip(grid, 0, (1 << BITS) - 1).astype(np.int64))


_models: dict[tuple[str, int], WordTokens] = {}


def model_of(tokenizer: str, end_id: int) -> WordTokens:
    """The table of this worker. A function of the module, so that all tasks of a worker find the same one."""
    if (key := (tokenizer, end_id)) not in _models:
        _models[key] = WordTokens(*key)
    return _models[key]


def _tokenized(tokenizer: str, end_id: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("curve", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = model_of(tokenizer, end_id), TaskContext.get().partitionId() << 33
        for part in slices(batches, "text", LOOKUP_BYTES):
            ids, off, vec = model.encode(part.column(1))
            packed = run_binaries(ids, off, "<u2" if model.model.get_vocab_size() <= 1 << 16 else "<u4")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + part.num_rows)), part.column(0), pa.array(curve_key(vec)), pa.array(np.diff(off)), packed], schema=schema)
            row += part.num_rows

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        n = np.asarray(b.column(1))
        upto = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(upto - n), b.column(1)], names=["row", "part", "within", "n"])
        before = int(upto[-1]) if len(n) else before


def tail_cuts(total: int, length: int) -> list[int]:
    """Starts of the sequences after the last full one: its rest falls into powers of two, the largest first."""
    at, cuts = total - total % length, []
    for k in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> k & 1:
            cuts.append(at)
            at += 1 << k
    return cuts


def _pieces(total: int, length: int, wide: bool):
    full, tail = total // length, np.array(tail_cuts(total, length), np.int64)
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, begin, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids = np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2").astype("<u4")
                end, at = begin + len(ids), begin
                cuts = list(range((begin // length + 1) * length, min(end, full * length + 1), length)) + [int(c) for c in tail if begin < c < end and c != full * length]
                for to in [*cuts, end]:
                    k = int(np.searchsorted(tail, at, side="right"))
                    seq, base = (full - 1 + k, int(tail[k - 1])) if at >= full * length and k else (at // length, at // length * length)
                    rows.append((doc_id, at - begin, to - at, zlib.crc32(ids[at - begin : to - begin].tobytes()), len(ids), seq, at - base))
                    at = to
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=fields)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` tokens.

    Takes `doc_id` and `text`; other columns are ignored. A null or empty text is its end id alone.
    Rows with the same or a null doc_id are packed as documents of their own. An empty table gives
    no pieces. `length` must be a power of two.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tokens = written(source.mapInArrow(_tokenized(tokenizer, end_id), "row long, doc_id long, curve long, n long, ids binary"), "tokens")
    order = tokens.select("curve", "row", "n").repartitionByRange("curve", "row").sortWithinPartitions("curve", "row")
    placed = written(order.select("row", "n").mapInArrow(_running, "row long, part int, within long, n long"), "placed")
    sums = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each partition
    parts = sorted(sums)
    base = dict(zip(parts, np.cumsum([0] + [sums[p] for p in parts])[:-1].tolist(), strict=True))
    total = sum(sums.values())
    bases = docs.sparkSession.createDataFrame(list(base.items()), "part int, base long")
    begin = placed.join(F.broadcast(bases), "part").select("row", (F.col("base") + F.col("within")).alias("begin"))
    wide = _vocabulary(tokenizer) > 1 << 16
    joined = tokens.join(begin, "row").select("doc_id", "begin", "ids")
    return joined.mapInArrow(_pieces(total, length, wide), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()
