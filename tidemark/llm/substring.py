"""Repeated passages across documents, found with broadcast suffix automata of reference shards.

A window is `span` consecutive words; a word goes if a window over it also starts earlier in the
corpus. The corpus is its own reference, so only what can be the first place of a repeat enters it:

* Documents with equal word sequences (by SHA-256) are one class: all but the first are repeats as a whole.
* Of every window, the 8-word run with the least hash is its anchor; a segment is the stretch of windows that share one
  anchor place. Equal windows have equal anchors, so an anchor that stands once among different documents has no
  repeated window. Of an anchor that stands more often, the segments of the first document join the reference.
* The reference is dealt into shards of bounded size by stretches of a document: all of an anchor goes to the stretch where it first stands,
  so a document of any length is spread over many shards. A task builds a shard's suffix automaton; each state
  knows the first place of its strings. Shards are broadcast one bounded group after another, and the segments
  whose anchor leads to the group stream against it. Where the matching statistic reaches `span`, the
  window is a repeat if the state's first place is an earlier one. Words are compared as words.
* Windows that their anchor's first document lacks (one phrase in many contexts) go through the same steps
  again with anchors as long as the window. Then each anchor has one content, and its first document holds it.

So of an anchor only its first document and whether it repeats are aggregated, combined before the
shuffle; a phrase that stands in a third of all documents costs each task its own share of them.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import PLAIN, U64, Words, mix, slices
from .common import released, shared_dir, written

GRAM = 8
#: Words of a reference shard on average, windows of a streamed piece, and bytes of automata (before compression) that are broadcast at once.
SHARD_WORDS, PIECE, GROUP_BYTES = 50_000, 256, 40 << 20
NO_ID = 1 << 62
_EMPTY = hashlib.sha256(b"").hexdigest()


class SuffixAutomaton:
    """A generalised suffix automaton over words. `first` is the place of the last word of a state's first occurrence."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first, self.words = [-1], [0], [-1], 0

    def add(self, words: list) -> None:
        """Adds a string; its words take the next places."""
        nxt, link, length, first, last = self.next, self.link, self.length, self.first, 0
        for at, w in enumerate(words, self.words):
            q = nxt[last].get(w)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            first.append(at)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = new
        self.words += len(words)

    def _split(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        self.first.append(self.first[q])
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def arrays(self) -> dict[str, np.ndarray]:
        each = np.fromiter(map(len, self.next), np.int32, len(self.next))
        total = int(each.sum())
        return {
            "state": np.repeat(np.arange(len(each), dtype=np.int32), each),
            "word": np.fromiter((w for x in self.next for w in x), np.int32, total),
            "to": np.fromiter((q for x in self.next for q in x.values()), np.int32, total),
            "link": np.array(self.link, np.int32),
            "length": np.array(self.length, np.int32),
            "first": np.array(self.first, np.int32),
        }


def squeezed(arrays: dict[str, np.ndarray]) -> dict[str, tuple]:
    """Arrays as compressed differences: most states follow their neighbour, so these are mostly ones."""
    return {name: (x.dtype.str, len(x), pa.compress(np.diff(x, prepend=x.dtype.type(0)).tobytes(), "zstd", asbytes=True)) for name, x in arrays.items()}


def restored(packed: dict[str, tuple]) -> dict[str, np.ndarray]:
    out = {}
    for name, (kind, n, raw) in packed.items():
        flat = np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)
        out[name] = np.cumsum(flat, dtype=kind)
    return out


class Group:
    """Automata of several shards as one set of arrays; each shard keeps a root of its own.

    Transitions are sorted by state and word. The group is pickled in its compressed form.
    """

    def __init__(self, shards: dict[int, dict], span: int):
        vocabulary = pa.concat_arrays([x["vocabulary"] for x in shards.values()]).dictionary_encode()
        word = np.asarray(vocabulary.indices, np.int32)
        self.vocabulary, self.span, self.root = vocabulary.dictionary, span, {}
        states = words = known = 0
        parts: dict[str, list] = {name: [] for name in ("state", "word", "to", "link", "length", "first", "begin", "doc", "body", "at")}
        for k, x in shards.items():
            a = restored(x["arrays"])
            self.root[k] = states
            parts["state"].append(a["state"] + states)
            parts["word"].append(word[known + a["word"]])
            parts["to"].append(a["to"] + states)
            parts["link"].append(np.where(a["link"] < 0, -1, a["link"] + states).astype(np.int32))
            parts["first"].append(a["first"] + words)
            parts["begin"].append(a["begin"] + words)
            for name in ("length", "doc", "body", "at"):
                parts[name].append(a[name])
            states, words, known = states + len(a["link"]), words + x["n_words"], known + len(x["vocabulary"])
        self.arrays = {name: np.concatenate(x) for name, x in parts.items()}
        order = np.lexsort((self.arrays["word"], self.arrays["state"]))
        for name in ("state", "word", "to"):
            self.arrays[name] = self.arrays[name][order]
        # The state of the last `span` words: up the links as long as they hold as many, in steps that double.
        up = np.maximum(self.arrays["link"], 0)
        top = np.where(self.arrays["length"][up] >= span, up, np.arange(states, dtype=np.int32))
        while not np.array_equal(to := top[top], top):
            top = to
        self.arrays["top"] = top
        self._open()

    def _open(self) -> None:
        self.__dict__.update((name, self.arrays[name]) for name in ("to", "link", "length", "first", "top", "begin", "doc", "body", "at"))
        self.keys = self.arrays["state"].astype(np.int64) << 32 | self.arrays["word"]

    def __getstate__(self) -> tuple:
        return squeezed(self.arrays), self.vocabulary, self.span, self.root

    def __setstate__(self, packed: tuple) -> None:
        arrays, self.vocabulary, self.span, self.root = packed
        self.arrays = restored(arrays)
        self._open()
        del self.arrays

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether there is one."""
        key = state.astype(np.int64) << 32 | word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.to[at], self.keys[at] == key

    def matches(self, words: np.ndarray, off: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """For each word, the reference place of the first occurrence of the `span` words up to it, or -1.

        All pieces stream side by side, a word of each at a time.
        """
        n = np.diff(off)
        lanes = np.argsort(-n, kind="stable")
        begin, n = off[:-1][lanes], n[lanes]
        roots = np.array([self.root[k] for k in shard[lanes].tolist()], np.int32)
        state, have, out = roots.copy(), np.zeros(len(n), np.int32), np.full(len(words), -1, np.int64)
        for t in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -t, side="left"))  # pieces of more than t words
            at = begin[:live] + t
            w, s, h = words[at], state[:live], have[:live]
            to, found = self.step(s, w)
            todo = np.flatnonzero(~found & (w >= 0) & (s != roots[:live]))
            while len(todo):
                up = self.link[s[todo]]
                s[todo], h[todo] = up, self.length[up]
                to[todo], found[todo] = self.step(up, w[todo])
                todo = todo[~found[todo] & (up != roots[todo])]
            state[:live] = np.where(found, to, roots[:live])
            have[:live] = np.where(found, h + 1, 0)
            if t >= self.span - 1:
                hit = np.flatnonzero(have[:live] >= self.span)
                out[at[hit]] = self.first[self.top[state[hit]]]
        return out


def anchors(hashes: np.ndarray, off: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of all texts as (anchor, first window, last window), windows counted from the text's start, and offsets by text."""
    gram = min(GRAM, span)
    n, total = np.diff(off), len(hashes)
    windows = np.maximum(n - span + 1, 0)
    to = np.concatenate([[0], np.cumsum(windows)])
    if not to[-1]:
        none = np.zeros(0, np.int64)
        return none.view(U64), none, none, np.zeros(len(off), np.int64)
    run = runs_of(hashes, gram, 0)
    text = np.repeat(np.arange(len(n)), windows)
    at = np.arange(to[-1]) - np.repeat(to[:-1] - off[:-1], windows)  # word number of each window's start
    best, place = run[at], at.copy()
    for k in range(1, span - gram + 1):
        other = run[at + k]
        less = other < best
        best[less] = other[less]
        place[less] = at[less] + k
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    begin = off[text[first]]
    return best[first], at[first] - begin, at[last] - begin, np.searchsorted(text[first], np.arange(len(n) + 1))


def runs_of(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The hash of the `width` words from each word on (past the end, of zeros)."""
    run = np.full(len(hashes), seed, U64)
    padded = np.concatenate([hashes, np.zeros(width, U64)])
    for k in range(width):
        run = mix(run + padded[k : k + len(hashes)] + U64(k))
    return run


def joined(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, each followed by one space, and the place of each word (one more at the end)."""
    to = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words.ends - words.starts + 1, out=to[1:])
    body = np.full(to[-1], 32, np.uint8)
    own = np.ones(to[-1], bool)
    own[to[1:] - 1] = False
    body[own] = words.data[words.inside]
    return body, to


def _profiled(span: int):
    """Per text: words, SHA-256, and its segments: anchor, windows as (first << 32) + more windows, and whether the anchor stands there twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column(1), PLAIN)
            off = words.off
            body, to = joined(words)
            raw = body.tobytes()
            sha = [hashlib.sha256(raw[a : max(b - 1, a)]).hexdigest() for a, b in zip(to[off[:-1]].tolist(), to[off[1:]].tolist(), strict=True)]
            anchor, first, last, seg = anchors(words.hashes(), off, span)
            text = np.repeat(np.arange(len(off) - 1), np.diff(seg))
            order = np.lexsort((anchor, text))
            same = (text[order[1:]] == text[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]])
            again = np.zeros(len(anchor), bool)
            again[order[1:][same]] = True
            cuts = pa.array(seg.astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (anchor.view(np.int64), first << 32 | last - first, again)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(np.diff(off)), pa.array(sha, pa.string()), *lists], names=["doc", "body", "no_id", "n_words", "sha", "anchor", "place", "again"])

    return run


def _stretched(span: int, shards: int):
    """Text of the runs of windows: `ref` rows of first segments, whole; others in pieces of at most PIECE windows."""
    schema = pa.schema([("ref", pa.bool_()), ("shard", pa.int32()), ("doc", pa.int64()), ("body", pa.int64()), ("first", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column(2), PLAIN)
            raw, to = joined(words)
            raw = raw.tobytes()
            runs = part.column(3)
            flat = runs.flatten()
            text = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(runs.offsets)))
            place, origin, stretch = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            shard = (mix(mix(origin.view(np.uint64)) + stretch.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)
            # A segment of the anchor's first document is reference, and is streamed as well: it may repeat within the document.
            own = np.flatnonzero(origin == np.asarray(part.column(0))[text])
            head = np.arange(len(text) + len(own)) >= len(text)
            text, place, shard = (np.concatenate([x, x[own]]) for x in (text, place, shard))
            first = place >> 32
            last = first + (place & 0xFFFFFFFF)
            order = np.lexsort((first, shard, head, text))
            text, first, last, shard, head = (x[order] for x in (text, first, last, shard, head))
            new = np.ones(len(text), bool)  # the reference is joined across shared words, the rest only from window to window
            reach = np.where(head[:-1], span, 1)
            new[1:] = (text[1:] != text[:-1]) | (shard[1:] != shard[:-1]) | (head[1:] != head[:-1]) | (first[1:] > last[:-1] + reach)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(text)) - 1
            count = last[end] - first[begin] + 1
            cuts = np.where(head[begin], 1, -(-count // PIECE))
            row = np.repeat(begin, cuts)
            at = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * PIECE
            lo = first[row] + at
            hi = np.where(head[row], np.repeat(last[end], cuts), np.minimum(lo + PIECE - 1, np.repeat(last[end], cuts)))
            base = words.off[text[row]]
            own = [raw[a:b] for a, b in zip(to[base + lo].tolist(), (to[base + hi + span] - 1).tolist(), strict=True)]
            of = pa.array(text[row])
            yield pa.RecordBatch.from_arrays([pa.array(head[row]), pa.array(shard[row]), part.column(0).take(of), part.column(1).take(of), pa.array(lo, pa.int32()), pa.array(own, pa.binary()).cast(pa.string())], schema=schema)

    return run


def _built(table: pa.Table) -> pa.Table:
    """The suffix automaton of a shard's reference, added in corpus order."""
    table = table.combine_chunks().sort_by([("doc", "ascending"), ("body", "ascending"), ("first", "ascending")])
    words = Words(table.column("words").combine_chunks(), PLAIN)
    coded = words.array().dictionary_encode()
    ids, off = np.asarray(coded.indices).tolist(), words.off.tolist()
    automaton = SuffixAutomaton()
    for a, b in zip(off[:-1], off[1:], strict=True):
        automaton.add(ids[a:b])
    arrays = automaton.arrays() | {"begin": words.off[:-1].astype(np.int32), "doc": np.array(table.column("doc"), np.int64), "body": np.array(table.column("body"), np.int64), "at": np.array(table.column("first"), np.int32)}
    size = sum(x.nbytes for x in arrays.values())
    raw = pickle.dumps({"vocabulary": coded.dictionary, "n_words": len(ids), "arrays": squeezed(arrays)}, protocol=5)
    return pa.table({"shard": table.column("shard")[:1], "size": pa.array([size], pa.int64()), "blob": pa.array([raw], pa.binary())})


def _matched(group, span: int, seed: int):
    """Repeated spans as (doc, body, first word, last word, null), and windows not found as (doc, body, window, window, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for part in slices(batches, "words", 1 << 20):
            own = own or group.value
            words = Words(part.column(4), PLAIN)
            coded = words.array().dictionary_encode()
            known = pc.index_in(coded.dictionary, value_set=own.vocabulary).fill_null(-1)
            ids = np.asarray(known, np.int64)[np.asarray(coded.indices)]
            place = own.matches(ids, words.off, np.asarray(part.column(0)))
            piece = words.text_of()
            end = np.flatnonzero(np.arange(len(ids)) - words.off[piece] >= span - 1)  # last words of windows
            place, piece = place[end], piece[end]
            doc, body, base = (np.asarray(part.column(i)).astype(np.int64) for i in (1, 2, 3))
            lo = base[piece] + end - (span - 1) - words.off[piece]
            found = place >= 0
            ref = np.searchsorted(own.begin, np.maximum(place, 0), side="right") - 1
            at = place - own.begin[ref] - (span - 1) + own.at[ref]
            mine = (doc[piece], body[piece], lo)
            theirs = (own.doc[ref], own.body[ref], at)
            less = (theirs[0] < mine[0]) | ((theirs[0] == mine[0]) & ((theirs[1] < mine[1]) | ((theirs[1] == mine[1]) & (theirs[2] < mine[2]))))
            same = (theirs[0] == mine[0]) & (theirs[1] == mine[1]) & (theirs[2] == mine[2])
            gone = np.flatnonzero(found & less)
            new = np.ones(len(gone), bool)
            new[1:] = (piece[gone[1:]] != piece[gone[:-1]]) | (lo[gone[1:]] != lo[gone[:-1]] + 1)
            a = gone[new]
            b = gone[np.append(np.flatnonzero(new)[1:], len(gone)) - 1] if len(gone) else gone
            rest = np.flatnonzero(~found | ~(less | same))
            anchor = runs_of(words.hashes(), span, seed)[end[rest] - (span - 1)].view(np.int64)
            at = np.concatenate([a, rest])
            columns = [doc[piece[at]], body[piece[at]], lo[at], np.concatenate([lo[b] + span - 1, lo[rest]])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(anchor)])], names=["doc", "body", "lo", "hi", "anchor"])

    return run


def _streamed(held: DataFrame, shards: int, span: int, seed: int) -> DataFrame:
    """What _matched says of all runs of `held`, one broadcast group of shards after another."""
    spark = held.sparkSession
    pieces = held.mapInArrow(_stretched(span, shards), "ref boolean, shard int, doc long, body long, first int, words string")
    pieces = written(pieces.repartitionByRange("shard", "doc").sortWithinPartitions("shard"), "stretches")
    automata = written(pieces.filter("ref").drop("ref").repartition(-(-shards // 4), "shard").groupBy("shard").applyInArrow(_built, "shard int, size long, blob binary"), "automata")
    together = shards
    while together > 1 and automata.groupBy(F.floor(F.col("shard") / together)).agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] > GROUP_BYTES:
        together = -(-together // 2)
    path = f"{shared_dir(spark)}/tidemark/matched-{uuid.uuid4().hex}"
    for begin in range(0, shards, together):
        inside = F.col("shard").between(begin, begin + together - 1)
        blobs = {r["shard"]: pickle.loads(r["blob"]) for r in automata.filter(inside).select("shard", "blob").collect()}  # of GROUP_BYTES at most, or one shard, whose stretches have SHARD_WORDS each
        if blobs:
            group = spark.sparkContext.broadcast(Group(blobs, span))
            rows = pieces.filter(inside & ~F.col("ref")).drop("ref").mapInArrow(_matched(group, span, seed), "doc long, body long, lo long, hi long, anchor long")
            rows.write.mode("append").option("compression", "zstd").parquet(path)
            group.destroy()
    released(pieces, automata)
    return spark.read.schema("doc long, body long, lo long, hi long, anchor long").parquet(path)


def _live(segments: DataFrame) -> DataFrame:
    """Anchors that stand in two documents of different words, or twice in one, the first document of each, and the stretch of it where the anchor first stands."""
    first = F.struct("doc", F.floor(F.shiftright("place", 32) / SHARD_WORDS).cast("long").alias("stretch"))
    met = segments.groupBy("anchor").agg(F.min(first).alias("first"), F.min("class").alias("least"), F.max("class").alias("most"), F.max("again").alias("again"))
    return written(met.filter("again or least <> most").select("anchor", F.col("first.doc").alias("origin"), "first.stretch"), "live")


def _runs(segments: DataFrame, live: DataFrame, own: DataFrame) -> DataFrame:
    """The segments with a live anchor of each document that is no copy."""
    runs = segments.join(live.hint("merge"), "anchor").groupBy("doc", "body").agg(F.collect_list(F.struct("place", "origin", "stretch")).alias("runs"))
    return written(runs.join(own.filter("not copy").select("doc", "body").dropDuplicates().hint("merge"), ["doc", "body"]), "runs")


def _removed(keep_text: bool):
    names = ["doc", "body", "n_removed", "sha", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column(2), PLAIN)
            spans = part.column(3)
            flat, at = spans.flatten(), np.asarray(spans.offsets)
            text = np.repeat(np.arange(part.num_rows), np.diff(at))
            lo, hi = (words.off[text] + np.asarray(flat.field(i)) for i in range(2))
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, lo, 1)
            np.add.at(change, hi + 1, -1)
            gone = np.cumsum(change)[:-1] > 0
            counts = np.concatenate([[0], np.cumsum(gone)])
            removed = counts[words.off[1:]] - counts[words.off[:-1]]
            body, to = joined(words)
            stay = body[np.repeat(~gone, np.diff(to))].tobytes()
            kept_to = np.concatenate([[0], np.cumsum(np.where(gone, 0, np.diff(to)))])[words.off]
            sha = [hashlib.sha256(stay[a : max(b - 1, a)]).hexdigest() for a, b in zip(kept_to[:-1].tolist(), kept_to[1:].tolist(), strict=True)]
            kept = [None] * part.num_rows
            if keep_text:  # the blanks after a kept word stay with it
                upto = np.append(words.starts[1:], len(words.data))
                ends = words.text_off[1:][words.text_of()]
                upto = np.minimum(upto, ends)
                raw = words.data.tobytes()
                for i in range(part.num_rows):
                    a, b = words.off[i], words.off[i + 1]
                    kept[i] = b"".join(raw[s:e] for s, e, g in zip(words.starts[a:b].tolist(), upto[a:b].tolist(), gone[a:b].tolist(), strict=True) if not g).rstrip(b" \t\n\x0b\x0c\r").decode()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed), pa.array(sha), pa.array(kept, pa.string())], names=names)

    return run


def remove_repeats(docs: DataFrame, span: int = 20, keep_text: bool = False, changed_only: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and with `keep_text` the column kept_text) of every row.

    Takes `doc_id` and `text`; other columns are ignored. Null text has no words; a text of fewer than `span` words
    stays. Earlier means a smaller doc_id, or the same document and an earlier start. Null ids come last (as ids from
    2**62 on), in the order of the texts' hashes, and so do different texts of one doc_id among each other; of rows that
    share a doc_id (or have none), equal texts are judged alike and neither repeats the other.
    An empty table gives no rows. kept_text is null for a null text; with `changed_only` it is null wherever nothing was
    removed, unchanged texts are not moved for it, and `body`, the xxhash64 of the text, tells rows of one doc_id apart.
    """
    body = F.xxhash64(F.col("text").cast("string"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(body, 2))
    source = docs.select(key.alias("doc"), F.col("text").cast("string").alias("text"), body.alias("body"), F.col("doc_id").isNull().alias("no_id"))
    profile = written(
        source.mapInArrow(_profiled(span), "doc long, body long, no_id boolean, n_words long, sha string, anchor array<long>, place array<long>, again array<boolean>"), "profile"
    )
    classes = profile.filter(F.col("n_words") >= span).groupBy("sha").agg(F.min(F.struct("doc", "body")).alias("origin"), F.count(F.lit(1)).alias("copies"))
    copied = written(classes.filter("copies > 1").select("sha", "origin"), "copied")  # unique documents need no join partner
    copy = F.coalesce((F.struct("doc", "body") != F.col("origin")) & (F.col("n_words") >= span), F.lit(False))
    own = written(profile.select("doc", "body", "no_id", "n_words", "sha").join(copied.hint("merge"), "sha", "left").withColumn("copy", copy).drop("origin"), "own")
    segments = profile.withColumn("class", F.xxhash64("sha")).select("doc", "body", "class", F.explode(F.arrays_zip("anchor", "place", "again")).alias("r")).select("doc", "body", "class", "r.*")
    spans, held, level, spent = [], None, 0, [profile, copied]
    while anchors_ := (live := _live(segments)).count():
        level += 1
        runs = _runs(segments.select("anchor", "doc", "body", "place"), live, own)
        released(live, *spent)
        if held is None:  # the texts that hold a repeated anchor; all later steps read these
            held = written(source.select("doc", "body", "text").join(runs.hint("merge"), ["doc", "body"]).dropDuplicates(["doc", "body"]), "held")
        texts = held if level == 1 else held.drop("runs").join(runs.hint("merge"), ["doc", "body"]).select("doc", "body", "text", "runs")
        found = _streamed(texts, -(-anchors_ * span // SHARD_WORDS), span, level)
        spent = [runs]
        spans.append(found.filter("anchor is null").select("doc", "body", "lo", "hi"))
        rest = found.filter("anchor is not null")
        segments = rest.select("doc", "body", F.xxhash64("doc", "body", "lo").alias("class"), "anchor", F.shiftleft("lo", 32).alias("place"), F.lit(False).alias("again"))
    released(live, *spent)
    out = own.select("doc", "body", "no_id", "n_words", "copy", F.col("sha").alias("whole"))
    if held is None:
        out = out.withColumns({"n_removed": F.lit(None).cast("long"), "sha": F.lit(None).cast("string"), "kept": F.lit(None).cast("string")})
    else:
        every = spans[0]
        for more in spans[1:]:
            every = every.unionByName(more)
        every = every.groupBy("doc", "body").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
        cut = held.drop("runs").join(every.hint("merge"), ["doc", "body"]).select("doc", "body", "text", "spans").mapInArrow(_removed(keep_text), "doc long, body long, n_removed long, sha string, kept string")
        out = out.join(cut.hint("merge"), ["doc", "body"], "left")
    result = [
        F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(_EMPTY)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
    ]
    if not keep_text:
        return out.select(result)
    if changed_only:
        return out.select(*result, F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept_text"), "body")
    texts = source.select("doc", "body", "text").dropDuplicates(["doc", "body"])
    kept = F.when(F.col("copy"), F.lit("")).otherwise(F.coalesce("kept", "text"))
    return out.join(texts, ["doc", "body"]).select(*result, kept.alias("kept_text"))
