"""Columnar word splitting and hashing over Arrow string arrays.

Every function works on whole texts. A batch is cut into slices of bounded bytes, so that the
memory of a Python worker follows the slice size (or the longest single text), never the input.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
SLICE_BYTES = 2 << 20


def byte_table(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(value of each byte, whether it belongs to a word)."""
    value = np.arange(256, dtype=np.uint8)
    if lower:
        value[65:91] += 32
    in_word = np.ones(256, bool)
    in_word[list(separators)] = False
    return value, in_word


BLANKS = b" \t\n\x0b\x0c\r"
#: Words are `[^\x20\x09-\x0D]+`, as they are and with A-Z lower-cased.
PLAIN = byte_table(BLANKS, lower=False)
LOWER = byte_table(BLANKS, lower=True)
#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the lower-cased text.
ALNUM = byte_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)), lower=True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null counts as empty."""
    column = column.cast(pa.binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose text holds about `most` bytes, or one text if it is longer. At their end the worker gives back what it freed."""
    for batch in batches:
        _, off = buffers(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    trim()


def trim() -> None:
    """Returns freed memory to the system: a Python worker lives on for the tasks of later steps."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


class Words:
    """Words of the texts of a column: starts and ends are byte positions in `data`, `off[i]` is the first word of text i."""

    __slots__ = ("data", "ends", "inside", "off", "starts", "text_off", "value")

    def __init__(self, column: pa.Array, table: tuple[np.ndarray, np.ndarray], cut: np.ndarray | None = None):
        """cut[a, b]: whether words are also cut between neighbouring bytes a and b."""
        self.value, in_word = table
        self.data, self.text_off = buffers(column)
        self.inside = inside = in_word[self.data]
        first, last = inside.copy(), inside.copy()
        if len(inside):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            filled = self.text_off[:-1] < self.text_off[1:]
            edge = self.text_off[:-1][filled]
            first[edge] |= inside[edge]
            edge = self.text_off[1:][filled] - 1
            last[edge] |= inside[edge]
            if cut is not None:
                at = cut[self.data[:-1], self.data[1:]] & inside[:-1] & inside[1:]
                first[1:] |= at
                last[:-1] |= at
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.starts, self.text_off)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash (xxh3) of each word's bytes; each distinct word is hashed once."""
        if not len(self):
            return np.zeros(0, U64)
        coded = self.array().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), U64, len(distinct))[np.asarray(coded.indices)]

    def array(self) -> pa.StringArray:
        """The words as an Arrow array (without case folding of `data` unless the table folds)."""
        to = np.zeros(len(self) + 1, np.int32)
        np.cumsum(self.ends - self.starts, out=to[1:])
        return pa.StringArray.from_buffers(len(self), pa.py_buffer(to), pa.py_buffer(self.value[self.data[self.inside]]))

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(hashes: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `width`-word runs within texts, and their offsets by text.

    A text with fewer words, but at least one, has its whole sequence as the one shingle.
    """
    n = np.diff(off)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    to = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=to[1:])
    at = np.repeat(off[:-1] - to[:-1], count) + np.arange(to[-1])
    padded = np.concatenate([hashes, np.zeros(width, U64)])
    have = np.repeat(n, count)
    out = np.zeros(to[-1], U64)
    for k in range(width):
        part = padded[at + k]
        if k:
            part = np.where(have > k, part, U64(0)) if (have <= k).any() else part
        out = mix(out * _MULT + part + U64(k + 1))
    return out, to


def distinct_by_text(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text."""
    if not len(values):
        return values, off
    values, at = values.copy(), off.tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[off[:-1][off[:-1] < off[1:]]] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], upto[off]


def binaries(values: np.ndarray, off: np.ndarray) -> pa.BinaryArray:
    """Runs of a numeric array as a binary column."""
    size = values.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
