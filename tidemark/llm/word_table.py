"""Ids of words, each distinct word encoded once; gathered for whole columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrow_text import Words

#: Words that a worker remembers with their ids, and the bytes of text that are looked up at once.
REMEMBERED, LOOKUP_BYTES = 600_000, 4 << 20


class WordTable:
    """Remembers the ids of words. When full it forgets all but those of the slice at hand, so its memory is bounded.

    The words stay in Arrow: a slice's distinct words are looked up among the known ones by their bytes,
    and only new words become Python strings.
    """

    def __init__(self):
        self.forget()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and the number of ids of each."""
        raise NotImplementedError

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.off, self.len, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32)
        self.n = self.used = 0

    def grown(self, name: str, need: int) -> None:
        a = getattr(self, name)
        if len(a) < need:
            wide = np.zeros((max(need, 2 * len(a)), *a.shape[1:]), a.dtype)
            wide[: len(a)] = a
            setattr(self, name, wide)

    def learn(self, words: list[str]) -> None:
        """Gives the words the next slots, in their order."""
        self._append(*self.encode_words(words))

    def _append(self, got: np.ndarray, length: np.ndarray) -> None:
        to = self.n + len(length)
        for name, need in (("off", to), ("len", to), ("ids", self.used + len(got))):
            self.grown(name, need)
        self.ids[self.used : self.used + len(got)] = got
        self.len[self.n : to] = length
        self.off[self.n : to] = self.used + np.cumsum(length, dtype=np.int64) - length
        self.n, self.used = to, self.used + len(got)

    def keep(self, words: pa.Array, slots: np.ndarray) -> None:
        """Forgets all words but these, which stand in these slots."""
        length, (ids, _) = self.len[slots], self.gathered(slots)
        self.forget()
        self.known = words
        self._append(ids, length)

    def slots(self, words: Words) -> np.ndarray:
        """The slot of each word; new words are learned."""
        if not len(words):
            return np.zeros(0, np.int64)
        coded = words.array().dictionary_encode()
        distinct = coded.dictionary
        first = self.n - len(self.known)  # slots before the words'
        at = pc.index_in(distinct, value_set=self.known)
        if len(self.known) + at.null_count > REMEMBERED and len(self.known):
            self.keep(distinct.filter(at.is_valid()), first + np.asarray(at.drop_null(), np.int64))
            at = pc.index_in(distinct, value_set=self.known)
        if at.null_count:
            new = distinct.filter(at.is_null())
            self.learn(new.to_pylist())
            slot = np.array(at.fill_null(-1), np.int64)
            slot[slot < 0] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
        else:
            slot = np.asarray(at, np.int64)
        return (slot + first)[np.asarray(coded.indices)]

    def gathered(self, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the slots end to end, and where each slot's ids start (one more at the end)."""
        length = self.len[each]
        to = np.zeros(len(each) + 1, np.int64)
        np.cumsum(length, out=to[1:])
        at = np.repeat(self.off[each] - to[:-1], length)
        at += np.arange(to[-1])
        return self.ids[at], to


def run_binaries(values: np.ndarray, off: np.ndarray, dtype: str) -> pa.BinaryArray:
    size = np.dtype(dtype).itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * size).astype(np.int32)), pa.py_buffer(values.astype(dtype))])
