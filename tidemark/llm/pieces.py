"""SentencePiece encoding and decoding with a shared-prefix Viterbi search.

A text with its marker is cut wherever no piece of the vocabulary crosses: what lies between are
marked words. The distinct words of a slice are sorted, which is a depth-first walk of their trie;
the forward table of a word keeps the rows of the prefix that it shares with the word before.

Two kinds of model are read. For a unigram model the forward score of a prefix is the best sum of
piece scores. A BPE model has merge ranks, not sums: a prefix has exactly one last piece, the one
that is compatible with the last piece of what stands before it (their own merge gives the two
pieces back), so the forward row holds that piece, and the ids equal the library's.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import Words, buffers, byte_table, slices
from .word_table import WordTable, run_binaries

MARK = "▁"
ALL = byte_table(b"", lower=False)
#: Compatible pairs that a worker remembers.
PAIRS = 1_000_000
#: Fixed values of the model files: the fields of the trainer's settings and of the type in them, and the types.
TRAINER, MODEL_TYPE, UNIGRAM, BPE = 2, 3, 1, 2


class Vocabulary:
    """Pieces of a model with their scores; `bpe` says how they combine."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown: int, bpe: bool, size: int):
        self.pieces, self.byte_ids, self.unknown, self.bpe = pieces, byte_ids, unknown, bpe
        self.low = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self.text = [b""] * size
        for p, (i, _) in pieces.items():
            self.text[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids or []):
            self.text[i] = bytes([b])
        within = np.zeros((256, 256), bool)
        for p in pieces:
            raw = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8)
            within[raw[:-1], raw[1:]] = True
        self.cut = ~within
        self.cut[:, 128:192] = False  # never inside a character
        ends: dict[str, set[int]] = {}
        for p in pieces:
            ends.setdefault(p[-1], set()).add(len(p))
        self.ends = {c: sorted(n, reverse=True) for c, n in ends.items()}
        self.known: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by repeatedly merging the best-scored neighbours, the leftmost on ties."""
        parts, pieces = list(text), self.pieces
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = pieces.get(parts[i] + parts[i + 1])
                if got is not None and (best is None or got[1] > best):
                    best, at = got[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are when they meet."""
        key = (left, right)
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            got = self.known[key] = self.merged(left + right) == [left, right]
        return got

    def alone(self, piece: str) -> bool:
        """Whether merging the piece's own characters gives the piece."""
        got = self.whole.get(piece)
        if got is None:
            got = self.whole[piece] = self.merged(piece) == [piece]
        return got

    def ids_of(self, piece: str) -> list[int]:
        got = self.pieces.get(piece)
        if got is not None:
            return [got[0]]
        return [self.byte_ids[b] for b in piece.replace(MARK, " ").encode()] if self.byte_ids else [self.unknown]

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of sorted distinct words. Row i of the forward table: the last piece of word[:i] and the score so far."""
        last: list[str] = [""]
        score: list[float] = [0.0]
        before, out = "", []
        for word in words:
            n, shared = min(len(word), len(before)), 0
            while shared < n and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], score[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                self._forward(word, i, last, score)
            path, at = [], len(word)
            while at:
                path.append(last[at])
                at -= len(last[at])
            out.append([k for p in reversed(path) for k in self.ids_of(p)])
            before = word
        return out

    def _forward(self, word: str, i: int, last: list[str], score: list[float]) -> None:
        pieces, best, own = self.pieces, None, word[i - 1]
        for n in self.ends.get(own, ()):
            if n > i:
                continue
            piece = word[i - n : i]
            got = pieces.get(piece)
            if got is None:
                continue
            if not self.bpe:
                total = score[i - n] + got[1]
                if best is None or total > best:
                    best, own = total, piece
            elif self.fits(last[i - n], piece) if i > n else self.alone(piece):
                last.append(piece)
                score.append(score[i - n] + got[1])
                return
        if self.bpe or best is None:  # a character of its own, known or not
            best = score[i - 1] + self.low
            own = word[i - 1]
        last.append(own)
        score.append(best)


def vocabulary_of(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size, pieces, byte_ids = model.get_piece_size(), {}, [0] * 256
    for i in range(size):
        p = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[p] = (i, model.get_score(i))
    kind = _field(_field(model.serialized_model_proto(), TRAINER, b""), MODEL_TYPE, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind} is neither unigram nor BPE")
    return Vocabulary(pieces, byte_ids if any(byte_ids) else None, model.unk_id(), kind == BPE, size)


def _field(message: bytes, wanted: int, default):
    """A field of a serialized message: an integer, or the bytes of a nested message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 128:
                return value, at

    at, found = 0, default
    while at < len(message):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            size, at = varint(at)
            value, at = message[at : at + size], at + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, at = message[at : at + size], at + size
        if key >> 3 == wanted:
            found = value
    return found


class PieceTable(WordTable):
    """Remembered ids of marked words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        super().__init__()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words are sorted, so that neighbours share prefixes, and their ids put back in the given order."""
        order = sorted(range(len(words)), key=words.__getitem__)
        got: list[list[int]] = [[]] * len(words)
        for at, ids in zip(order, self.vocabulary.encode_sorted([words[i].replace(" ", MARK) for i in order]), strict=True):
            got[at] = ids
        return np.array([i for x in got for i in x], np.uint32), np.fromiter(map(len, got), np.int32, len(got))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their offsets. A text that is not empty gets a marker in front; the marker character itself is read as a blank."""
        column = pc.replace_substring(column.cast(pa.string()).fill_null(""), MARK, " ")
        marked = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(" ", column, ""))
        words = Words(marked.combine_chunks() if isinstance(marked, pa.ChunkedArray) else marked, ALL, self.vocabulary.cut)
        ids, to = self.gathered(self.slots(words))
        return ids, to[words.off]


def decoded(vocabulary: Vocabulary, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
    """The texts of runs of ids: pieces and bytes joined, without the marker in front."""
    length = np.array([len(t) for t in vocabulary.text], np.int64)
    start = np.cumsum(length) - length
    flat = np.frombuffer(b"".join(vocabulary.text), np.uint8)
    n = length[ids]
    to = np.concatenate([[0], np.cumsum(n)])
    raw = flat[np.repeat(start[ids] - to[:-1], n) + np.arange(to[-1])].tobytes()
    at = to[off].tolist()
    return [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(at[:-1], at[1:], strict=True)]


_tables: dict[str, PieceTable] = {}


def table_of(path: str) -> PieceTable:
    if path not in _tables:
        _tables[path] = PieceTable(vocabulary_of(path))
    return _tables[path]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(path)
        for part in slices(batches, "text"):
            ids, off = table.encode(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), run_binaries(ids, off, "<u4")], names=["doc_id", "text", "ids"])

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = table_of(path).vocabulary
        for part in slices(batches, "ids"):
            raw, off = buffers(part.column(1))
            texts = decoded(vocabulary, np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), off // 4)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return run


def _checked(path: str):
    """Encodes and decodes each text in one pass, so that ids and texts need not be moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(path)
        for part in slices(batches, "text"):
            ids, off = table.encode(part.column(1))
            texts = decoded(table.vocabulary, ids.astype(np.int64), off)
            raw, at = buffers(part.column(1))
            raw, little, cuts, own = raw.tobytes(), ids.astype("<u4").tobytes(), off.tolist(), at.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(np.diff(off)),
                    pa.array([zlib.crc32(little[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    pa.array([t == raw[a:b] for t, a, b in zip(texts, own[:-1], own[1:], strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    return run


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text and ids (little-endian unsigned 32-bit) of every whole text. Null and empty texts have no ids."""
    return _source(docs).mapInArrow(_encoded(model), "doc_id long, text string, ids binary")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids). Null or empty ids give an empty text; ids outside the vocabulary fail."""
    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("binary")).mapInArrow(_decoded(model), "doc_id long, text string")


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """Number and crc32 of the ids of every whole text, the sha256 of the decoded text, and whether it equals the text.

    Takes `doc_id` and `text`; other columns are ignored. A null text counts as empty. A marker
    character in a text comes back as a blank, as in the library. Repeated rows
    are encoded each; an empty table gives no rows.
    """
    return _source(docs).mapInArrow(_checked(model), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
