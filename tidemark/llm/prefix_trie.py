"""Trie of shared conversation prefixes, by an LCP-aware external mergesort.

A turn is known by 16 bytes of the SHA-256 of its role and text. A conversation is the string of its turns' keys:

* Runs: each task sorts the conversations it reads in bounded runs; every row carries the number of turns that it
  shares with the row before it in its run (its LCP). Runs are written to the shared folder.
* Merge: rows are dealt by ranges of (string, conv_id), so equal conversations can fall in several ranges. A task merges the runs of its
  range with a tree of losers. Each contender knows how many turns it shares with the last winner; of two, the one that shares more is the
  smaller, and only if both share the same number are turns compared, from there on.
* Nodes: the merged stream pushes and pops a stack, the open path. A node that is popped is finished, with all sums over its subtree;
  its children wait with it for its smallest member. Nodes on the first or last path of a range may go on in the next one:
  their partial sums, two paths for each range, are put together by one more stack that walks over them in order.

Only heads take part: the turns of a conversation up to the first that no other has at that depth. What follows
is a chain of nodes with one member, made row by row. So a conversation that is long because nobody shares it costs no task more memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written
from .ordered import numbered

KEY = 16
#: Turns of a run, and turns of a range that a task merges, on average.
RUN_TURNS, RANGE_TURNS = 200_000, 200_000
_NONE = hashlib.sha256(b"").hexdigest()
_ROOT = b"\0" * KEY


def shared_turns(a: bytes, b: bytes, at: int = 0) -> int:
    """How many whole turns two strings share, of which `at` are known to be."""
    most = min(len(a), len(b)) // KEY
    step = 1
    while at < most:  # in growing steps, then back in halves
        to = min(at + step, most)
        if a[at * KEY : to * KEY] == b[at * KEY : to * KEY]:
            at, step = to, step * 2
        elif step == 1:
            return at
        else:
            step = max(1, (to - at) // 2)
    return at


class LoserTree:
    """Merges sorted runs. A contender is [LCP with the last winner, string, conv_id, payload]; an ended run has None."""

    def __init__(self, runs: list[Iterator[list]]):
        self.runs = runs
        self.n = max(1, len(runs))
        self.now: list[list | None] = [next(r, None) for r in runs] or [None]
        for x in self.now:
            if x is not None:
                x[0] = 0
        self.loser = [-1] * self.n
        self.winner = self._build(1)

    def _build(self, at: int) -> int:
        if at >= self.n:
            return at - self.n
        left, right = self._build(2 * at), self._build(2 * at + 1)
        return self._play(at, left, right)

    def _play(self, at: int, a: int, b: int) -> int:
        """The winner of contenders a and b; the loser stays at the tree's node, with its LCP with the winner."""
        x, y = self.now[a], self.now[b]
        if x is None or y is None:
            won, lost = (b, a) if x is None else (a, b)
        elif x[0] != y[0]:
            won, lost = (a, b) if x[0] > y[0] else (b, a)
        else:
            lcp = shared_turns(x[1], y[1], x[0])
            turn = slice(lcp * KEY, lcp * KEY + KEY)  # of an ended string: empty, so it comes first
            won, lost = (a, b) if (x[1][turn], x[2]) <= (y[1][turn], y[2]) else (b, a)
            self.now[lost][0] = lcp
        self.loser[at] = lost
        return won

    def __iter__(self) -> Iterator[list]:
        while (x := self.now[self.winner]) is not None:
            yield x
            run = self.winner
            self.now[run] = next(self.runs[run], None)  # its LCP with the row before it, which has just won
            at = (run + self.n) // 2
            while at:
                run = self._play(at, run, self.loser[at])
                at //= 2
            self.winner = run


class Node:
    """An open node: sums of its members so far and of its finished descendants."""

    __slots__ = ("children", "count", "edge", "ends", "key", "leaves", "least", "parent", "saved", "size", "waiting")

    def __init__(self, key: bytes, parent: bytes, size: int, edge: bool):
        self.key, self.parent, self.size, self.edge = key, parent, size, edge
        self.count = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[str] = []
        self.waiting: list[tuple] = []

    def totals(self) -> tuple[int, int]:
        """(leaves, saved tokens) of the whole subtree of a finished node."""
        return self.leaves or 1, self.saved + (self.count - 1) * self.size


#: A row of the merge: a finished node, or (edge) the part of a node that one range has seen.
PARTS = "edge boolean, range int, branch int, depth long, node binary, parent binary, size long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def _digest(ends: list[str]) -> str:
    return hashlib.sha256(",".join(ends).encode()).hexdigest()


def walk(stream: Iterator[list], number: int) -> Iterator[tuple]:
    """Rows of PARTS from a range's conversations in order: [LCP, string, conv_id, (sizes of the turns, whether a tail follows)]."""
    path = [Node(_ROOT, b"", 0, True)]
    first = True

    def row(node: Node, depth: int, edge: bool, branch: int, least: int | None) -> tuple:
        ends = ",".join(node.ends) if edge else _digest(node.ends)
        leaves, saved = (node.leaves, node.saved) if edge else node.totals()
        return edge, number, branch, depth, node.key, node.parent, node.size, node.least, least, node.count, node.children, leaves, saved, ends

    def close(depth: int) -> Iterator[tuple]:
        while len(path) > depth + 1:
            node, up = path.pop(), path[-1]
            up.count += node.count
            up.least = node.least if up.least is None else min(up.least, node.least)
            for x in node.waiting:
                yield x[:8] + (None if node.edge else node.least,) + x[9:]
            if node.edge:
                yield row(node, len(path), True, 0, None)
                continue
            leaves, saved = node.totals()
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
            up.waiting.append(row(node, len(path), False, 0, None))

    for lcp, string, conv, (sizes, tail) in stream:
        yield from close(lcp)
        for d in range(lcp, len(string) // KEY):
            above = path[-1].key
            path.append(Node(hashlib.sha256(above + string[d * KEY : d * KEY + KEY]).digest()[:KEY], above, sizes[d], first))
        end = path[-1]
        end.count += 1
        end.least = conv if end.least is None else min(end.least, conv)
        if tail:
            end.children, end.leaves = end.children + 1, end.leaves + 1
        else:
            end.ends.append(str(conv))
        first = False
    # The last path is on the edge too: nodes that the first conversation did not open come after its own.
    branch = [0 if n.edge else 1 for n in path]
    for n in path:
        n.edge = True
    while len(path) > 1:
        node, up = path.pop(), path[-1]
        up.count += node.count
        up.least = node.least if up.least is None else min(up.least, node.least)
        yield from (x[:8] + (None,) + x[9:] for x in node.waiting)
        yield row(node, len(path), True, branch[len(path)], None)
    yield from (x[:8] + (None,) + x[9:] for x in path[0].waiting)
    if path[0].count:
        yield row(path[0], 0, True, 0, None)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about `most` bytes."""
    buffer: list[tuple] = []
    held = 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buffer, strict=True), schema, strict=True)], schema=schema)
    for x in rows:
        buffer.append(x)
        held += 100 + sum(len(v) for v in x if isinstance(v, bytes | str | list))
        if held >= most:
            yield made()
            buffer, held = [], 0
    if buffer:
        yield made()


RUNS = "run long, place long, lcp int, string binary, conv_id long, sizes array<long>, tail boolean"


def _runs(run_turns: int):
    """Sorted runs from rows (conv_id, depth, key, size, tail, task) that come by conversation and depth."""
    schema = pa.schema([("run", pa.int64()), ("place", pa.int64()), ("lcp", pa.int32()), ("string", pa.binary()), ("conv_id", pa.int64()), ("sizes", pa.list_(pa.int64())), ("tail", pa.bool_())])

    def sorted_run(convs: list[tuple], run: int) -> Iterator[tuple]:
        convs.sort(key=lambda x: x[:2])
        last = b""
        for place, (string, conv, sizes, tail) in enumerate(convs):
            yield run, place, shared_turns(last, string), string, conv, sizes, tail
            last = string

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        convs, held, task, n = [], 0, 0, 0
        now, keys, sizes, tail = None, bytearray(), [], False
        for batch in batches:
            for conv, depth, key, size, more, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                task = at
                if conv != now:
                    if now is not None:
                        convs.append((bytes(keys), now, sizes, tail))
                        held += len(sizes) + 1
                        if held >= run_turns:
                            yield from sorted_run(convs, task << 24 | n)
                            convs, held, n = [], 0, n + 1
                    now, keys, sizes, tail = conv, bytearray(), [], more
                if depth:
                    keys += key
                    sizes.append(size)
        if now is not None:
            yield from sorted_run([*convs, (bytes(keys), now, sizes, tail)], task << 24 | n)

    return lambda batches: _batches(rows(batches), schema)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows come by run and place; the runs are merged and walked."""
    schema = pa.schema([
        ("edge", pa.bool_()), ("range", pa.int32()), ("branch", pa.int32()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("size", pa.int64()), ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
    ])
    runs: dict[int, list[list]] = {}
    number = 0
    for batch in batches:
        for run, _, lcp, string, conv, sizes, tail, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
            runs.setdefault(run, []).append([lcp, string, conv, (sizes, tail)])
    return _batches(walk(iter(LoserTree([iter(r) for r in runs.values()])), number), schema)


NODES = "depth long, node binary, parent binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes on the edges of ranges, from their parts in order of range, branch and depth: one more open path."""
    schema = pa.schema([("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])

    def rows() -> Iterator[tuple]:
        path: list[tuple[Node, hashlib._Hash, list]] = []

        def close(depth: int) -> Iterator[tuple]:
            while len(path) > depth:
                node, digest, _ = path.pop()
                leaves, saved = node.totals()
                if path:
                    up = path[-1][0]
                    up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
                yield len(path), node.key, node.parent, node.least, node.count, node.children, leaves, saved, digest.hexdigest()

        for batch in batches:
            for depth, key, parent, size, least, count, children, leaves, saved, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if depth >= len(path) or path[depth][0].key != key:
                    yield from close(depth)
                    path.append((Node(key, parent, size, True), hashlib.sha256(), []))
                node, digest, begun = path[depth]
                node.least = least if node.least is None else min(node.least, least)
                node.count, node.children, node.leaves, node.saved = node.count + count, node.children + children, node.leaves + leaves, node.saved + saved
                if ends:
                    digest.update(("," * bool(begun) + ends).encode())
                    begun[:] = [True]
        yield from close(0)

    return _batches(rows(), schema)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(conv_id, depth, key, size) of every rebuilt turn, from depth 1, (conv_id, length) of every conversation, and the written tables that both read.

    The first h turns are those of conversation c - c % 5, the others its own, with h = crc32(c) % 9.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.sha2(role.cast("binary"), 256), text).cast("binary"), 256), 1, 2 * KEY))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    placed = numbered(turns.withColumn("row", F.monotonically_increasing_id()), [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("key"), F.asc("row")], "turns")
    base = F.col("conv_id") - F.col("conv_id") % 5
    convs = written(placed.groupBy("conv_id").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n")), "conversations")
    made = [placed, convs]
    convs = convs.withColumns({"base": base, "h": F.when(F.col("conv_id") == base, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9)})
    bases = convs.filter("conv_id = base").select(F.col("conv_id").alias("of"), F.col("n").alias("base_n"))
    convs = convs.join(bases, convs["base"] == bases["of"], "left").withColumn("lent", F.least(F.col("h"), F.coalesce("base_n", F.lit(0))))
    turn = placed.join(convs.select("conv_id", "start", "h", "lent"), "conv_id").withColumn("i", F.col("at") - F.col("start"))
    own = turn.filter("i >= h").select("conv_id", (F.col("lent") + F.col("i") - F.col("h") + 1).alias("depth"), "key", "size")
    first = turn.filter("i < 8 and conv_id % 5 = 0").select(F.col("conv_id").alias("base"), "i", "key", "size")
    lent = first.join(convs.filter("h > 0").select("conv_id", "base", "h"), "base").filter("i < h").select("conv_id", (F.col("i") + 1).alias("depth"), "key", "size")
    return own.unionByName(lent), convs.select("conv_id", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), made


def trie(conversations: DataFrame, run_turns: int = RUN_TURNS, range_turns: int = RANGE_TURNS) -> DataFrame:
    """A row for each node of the trie of all rebuilt conversations.

    Takes `conv_id`, `turn`, `role` and `text`; other columns are ignored. Turns are ordered by `turn`, null first; turns that tie are
    ordered by the SHA-256 of role and text, so repeated rows are repeated turns. A null role or text is empty. Rows without a conv_id belong to no
    conversation and take no part. `c - c % 5` truncates towards 0 for negative ids. A conversation whose turns all fall away still counts at the root.
    An empty table gives no rows. Texts are read once, for their key and size, and never shuffled.
    """
    turns, convs, made = rebuilt(conversations)
    turns = written(turns, "rebuilt")
    alone = turns.groupBy("depth", "key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).filter("n = 1")
    convs = written(convs.join(alone.groupBy("conv_id").agg(F.min("depth").alias("head")), "conv_id", "left"), "lengths")
    released(*made)
    each = turns.join(convs.withColumn("tail", F.coalesce(F.col("head") < F.col("length"), F.lit(False))), "conv_id")
    head = each.filter("head is null or depth <= head").select("conv_id", "depth", "key", "size", "tail")
    silent = convs.filter("length = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("key"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("tail"))
    whole = head.unionByName(silent).repartition("conv_id").sortWithinPartitions("conv_id", "depth").withColumn("task", F.spark_partition_id())
    runs = written(whole.mapInArrow(_runs(run_turns), RUNS), "runs")
    total = runs.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    ranges = max(1, -(-total // range_turns), min(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 50))
    dealt = runs.repartitionByRange(ranges, "string", "conv_id").sortWithinPartitions("run", "place").withColumn("range", F.spark_partition_id())
    parts = written(dealt.mapInArrow(_merged, PARTS), "parts")
    released(runs)
    edge = parts.filter("edge").select("range", "branch", "depth", "node", "parent", "size", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    edge = edge.coalesce(1).sortWithinPartitions("range", "branch", "depth").drop("range", "branch")
    nodes = written(edge.mapInArrow(_joined, NODES), "edges")
    up = nodes.select(F.col("node").alias("above"), F.col("conv_id").alias("above_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = parts.filter("not edge").withColumnRenamed("ends", "ends_sha256")
    found = inner.filter("parent_conv_id is null").drop("parent_conv_id").select(nodes.columns).unionByName(nodes)
    found = found.join(up, found["parent"] == up["above"], "left").withColumn("parent_conv_id", F.col("above_id"))
    ends = F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(_NONE))
    one = F.lit(1).cast("long")
    tails = each.filter("depth > head").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ends.alias("ends_sha256"),
    )
    return reduce(DataFrame.unionByName, [inner.filter("parent_conv_id is not null").select(columns), found.select(columns), tails])
