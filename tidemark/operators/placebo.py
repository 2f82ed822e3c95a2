"""Placebo tests of walk-forward regressions: features dealt anew within groups, refitted every year, compared by their share at least as good.

The rows of a group, by key, meet the same rows by a digest of seed, replicate and key: the place in one order is the place in the other. Groups stand
end to end, so that a place is one number; stretches of it, the cells, are paired each on its own and reduced at once to moments for each scheme,
replicate and year. Fits and squared errors follow from moments. Permutations are made in rounds, so that disk grows with the rows and not with the replicates.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import released, written

from .expanding import accumulated, moments_of, solved

#: A larger group is cut into cells of about so many rows, by digest; smaller ones share a cell.
CELL = 1 << 17
#: Rows, each for a scheme and replicate, that a round deals (about 50 bytes of shuffle each); one permutation at least. Rows that a task holds back before it sends them.
ROUND, HELD = 1 << 25, 1 << 19
#: Replicates whose cells are counted in one pass.
COUNTED = 20


def _placed(rows: DataFrame, within: list[str], key: str, i: int) -> tuple[DataFrame, list[DataFrame], list[tuple[int, int]]]:
    """`rows` with their place `_p{i}` by groups and key, and the start `_s{i}` and size `_n{i}` of their group; the tables written for it; start and size of the groups of more than CELL rows.

    A null in a grouping column counts as a value. Rows are dealt by ranges and written; one number for each range reaches the driver.
    """
    order = [F.col(c) for c in (*within, key)]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumns({"_range": F.spark_partition_id(), "_within": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "placebo")
    before, starts = 0, []
    for r in sorted(dealt.groupBy("_range").count().collect()):
        starts.append((r["_range"], before))
        before += r["count"]
    start = dealt.sparkSession.createDataFrame(starts, "_range int, _start long")
    out = dealt.join(F.broadcast(start), "_range").withColumn(f"_p{i}", F.col("_start") + F.col("_within")).drop("_range", "_start", "_within")
    named = {c: f"_g{j}" for j, c in enumerate(within)}
    groups = out.groupBy(*[F.col(c).alias(n) for c, n in named.items()]).agg(F.min(f"_p{i}").alias(f"_s{i}"), F.count(F.lit(1)).alias(f"_n{i}"))
    groups = written(groups, "placebo")
    large = groups.filter(F.col(f"_n{i}") > CELL).select(f"_s{i}", f"_n{i}").collect()
    same: Column = F.lit(True)
    for c, n in named.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return out.join(groups, same).drop(*named.values()), [dealt, groups], sorted(tuple(r) for r in large)


def _digest(seed: int, rep: int) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(rep)), F.col("_id").cast("string")).cast("binary")))


class _Cells:
    """Numbers of cells in one scheme: first those of the large groups, `parts` for each, by the leading bits of the digest; then one for each stretch of CELL places, with the groups that start there."""

    def __init__(self, large: list[tuple[int, int]]):
        self.rows = CELL
        self.starts = np.array([s for s, _ in large], np.int64)
        self.parts = np.array([-(-n // self.rows) for _, n in large], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.parts)]).astype(np.int64)
        self.cuts = np.zeros(0, np.int64)  # where the cells of large groups start

    def counted(self, counts: dict[int, int]) -> _Cells:
        """With the cells' places, from the rows in each."""
        out = _Cells([])
        out.__dict__.update(self.__dict__)
        sizes = np.array([counts.get(c, 0) for c in range(self.first[-1])], np.int64)
        places = [s + np.concatenate([[0], np.cumsum(sizes[a:b])[:-1]]) for s, a, b in zip(self.starts, self.first, self.first[1:], strict=False)]
        out.cuts = np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int64)
        return out

    def by_digest(self, start: np.ndarray, size: np.ndarray, lead: np.ndarray) -> np.ndarray:
        cell, big = self.first[-1] + start // self.rows, size > self.rows
        if big.any():
            g = np.searchsorted(self.starts, start[big])
            cell[big] = self.first[g] + ((lead[big] >> np.uint64(32)) * self.parts[g].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        return cell

    def by_place(self, start: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and places within them."""
        cell, at, big = self.first[-1] + start // self.rows, place - start // self.rows * self.rows, size > self.rows
        if big.any():
            cell[big] = np.searchsorted(self.cuts, place[big], "right") - 1  # of cells without rows that start at one place, the last has the place
            at[big] = place[big] - self.cuts[cell[big]]
        return cell, at


def _columns(batches: Iterator[pa.RecordBatch], digests: int) -> Iterator[dict[str, np.ndarray]]:
    """Columns of about HELD rows, fewer if they have many digests; a digest as two unsigned numbers."""

    def joined() -> dict[str, np.ndarray]:
        out = {}
        for name in held[0].schema.names:
            parts = [b.column(name) for b in held]
            if pa.types.is_binary(parts[0].type):
                out[name] = np.frombuffer(pa.concat_arrays([p.cast(pa.binary(16)) for p in parts]).buffers()[1], ">u8").astype(np.uint64).reshape(-1, 2)
            else:
                out[name] = np.concatenate([p.to_numpy(zero_copy_only=False) for p in parts])
        return out

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= HELD // digests:
            yield joined()
            held = []
    if held:
        yield joined()


def _counts(rows: DataFrame, pairs: list[tuple[int, int]], cells: list[_Cells], seed: int) -> dict[tuple[int, int], dict[int, int]]:
    """Rows in each cell of the large groups, for each scheme and replicate."""
    pairs = [(i, rep) for i, rep in pairs if len(cells[i].starts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {p: np.zeros(cells[p[0]].first[-1], np.int64) for p in pairs}
        for x in _columns(batches, len(pairs)):
            for i, rep in pairs:
                big = x[f"_n{i}"] > cells[i].rows
                cell = cells[i].by_digest(x[f"_s{i}"][big], x[f"_n{i}"][big], x[f"_d{rep}"][big, 0])
                total[i, rep] += np.bincount(cell, minlength=len(total[i, rep]))
        for (i, rep), n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v), t) for v, t in ((i, pa.int32()), (rep, pa.int32()))] + [pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["i", "rep", "cell", "n"])

    out: dict[tuple[int, int], dict[int, int]] = {p: {} for p in pairs}
    if pairs:
        used = sorted({i for i, _ in pairs})
        x = rows.select(*[c for i in used for c in (f"_s{i}", f"_n{i}")], *[_digest(seed, rep).alias(f"_d{rep}") for rep in sorted({rep for _, rep in pairs})])
        for r in x.mapInArrow(run, "i int, rep int, cell int, n long").groupBy("i", "rep", "cell").agg(F.sum("n").alias("n")).collect():
            out[r["i"], r["rep"]][r["cell"]] = r["n"]
    return out


def _round(rows: DataFrame, pairs: list[tuple[int, int]], cells: list[_Cells], kept: list[str], moved: list[str], seed: int) -> list:
    """Moments (i, rep, year) of the permutations `pairs`; kept: what stays, with the target as the last."""
    used, reps, k = sorted({i for i, _ in pairs}), sorted({rep for _, rep in pairs}), len(kept) + len(moved)
    by_digest = np.dtype([("s", "u4"), ("hi", "u8"), ("lo", "u8"), *[(c, "f8") for c in moved]])
    by_place = np.dtype([("p", "u4"), ("year", "i4"), *[(c, "f8") for c in kept]])
    names = [*kept[:-1], *moved, kept[-1]]
    products = [(a, b) for a in range(k) for b in range(a, k)]

    def sent(i: int, rep: int, own: bool, cell: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(cell.astype(np.uint16) if cell.max() < 1 << 16 else cell, kind="stable")
        cell, data = cell[order], data[order]
        cuts = np.flatnonzero(np.diff(cell, prepend=-1))
        blobs = [data[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
        n = len(cuts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, i), pa.int32()), pa.array(np.full(n, rep), pa.int32()), pa.array(cell[cuts], pa.int32()), pa.array([own] * n), pa.array(blobs, pa.binary())], names=["i", "rep", "cell", "own", "data"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _columns(batches, len(reps)):
            for i, rep in pairs:
                start, size, digest = x[f"_s{i}"], x[f"_n{i}"], x[f"_d{rep}"]
                data = np.empty(len(start), by_digest)
                data["s"], data["hi"], data["lo"] = np.where(size > cells[i, rep].rows, 0, start % cells[i, rep].rows), digest[:, 0], digest[:, 1]
                for c in moved:
                    data[c] = x[c]
                yield sent(i, rep, False, cells[i, rep].by_digest(start, size, digest[:, 0]), data)
                data = np.empty(len(start), by_place)
                cell, data["p"] = cells[i, rep].by_place(start, size, x[f"_p{i}"])
                for c in ("year", *kept):
                    data[c] = x[c]
                yield sent(i, rep, True, cell, data)

    def pair(table: pa.Table) -> pa.Table:
        own, data = table.column("own").to_pylist(), table.column("data").to_pylist()
        left = np.frombuffer(b"".join(d for d, o in zip(data, own, strict=True) if o), by_place)
        right = np.frombuffer(b"".join(d for d, o in zip(data, own, strict=True) if not o), by_digest)
        if len(left) != len(right):
            raise ValueError(f"a cell has {len(left)} places and {len(right)} rows")
        s, hi, lo = (np.ascontiguousarray(right[c]) for c in ("s", "hi", "lo"))
        order = np.lexsort((hi, s)) if s.any() else np.argsort(hi)
        if ((np.diff(hi[order]) == 0) & (np.diff(s[order]) == 0)).any():
            order = np.lexsort((lo, hi, s))
        place = left["p"].astype(np.int64) - int(left["p"].min())
        x = {c: np.empty(len(left)) for c in kept} | {c: np.ascontiguousarray(right[c])[order] for c in moved}
        year = np.empty(len(left), np.int64)
        year[place] = left["year"]
        for c in kept:
            x[c][place] = left[c]
        low = int(year.min())
        n = np.bincount(year - low)
        at = np.flatnonzero(n)
        sums = [np.bincount(year - low, x[c])[at] for c in names] + [np.bincount(year - low, x[names[a]] * x[names[b]])[at] for a, b in products]
        head = [pa.array(np.full(len(at), table.column(c)[0].as_py()), pa.int32()) for c in ("i", "rep")]
        return pa.Table.from_arrays([*head, pa.array(at + low, pa.int32()), pa.array(n[at], pa.int64()), *map(pa.array, sums)], names=["i", "rep", "year", *columns])

    columns = ["_n", *[f"_s{a}" for a in range(k)], *[f"_q{a}_{b}" for a, b in products]]
    x = rows.select("year", *kept, *moved, *[c for i in used for c in (f"_p{i}", f"_s{i}", f"_n{i}")], *[_digest(seed, rep).alias(f"_d{rep}") for rep in reps])
    dealt = x.mapInArrow(deal, "i int, rep int, cell int, own boolean, data binary").groupBy("i", "rep", "cell")
    found = dealt.applyInArrow(pair, "i int, rep int, year int, _n long, " + ", ".join(f"{c} double" for c in columns[1:]))
    return found.groupBy("i", "rep", "year").agg(*[F.sum(c).alias(c) for c in columns]).collect()


def _errors(moments: DataFrame, by: list[str], least: int) -> DataFrame:
    """(by, n, sse): squared errors of each year's known rows under the fit of the years before, from the moments of both."""
    key = ", ".join(f"`{c}` {t}" for c, t in moments.dtypes if c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                b, mean, sd, level, _ = solved(r["n"], np.array(r["sums"], float), np.array(r["products"], float))
                w = np.append(-b / sd, 1.0)  # error = w'x + c with the target as the last x
                c = -(level - float((b / sd) @ mean))
                k, s = len(w), np.array(r["own_sums"], float)
                q = np.zeros((k, k))
                q[np.triu_indices(k)] = r["own_products"]
                q = q + np.triu(q, 1).T
                out.append((*(r[x] for x in by), r["own_n"], float(w @ q @ w + 2 * c * (w @ s) + c * c * r["own_n"])))
            yield pd.DataFrame(out, columns=[*by, "n", "sse"])

    return moments.filter((F.col("n") >= least) & (F.col("own_n") > 0)).mapInPandas(run, f"{key}, n long, sse double")


def refitted(rows: DataFrame, target: str, kept: list[str], shuffled: list[str], schemes: dict[str, list[str]], key: str = "id", replicates: int = 400, least: int = 50, seed: int = 7) -> DataFrame:
    """(scheme, rep, n, mse) of the yearly walk-forward fit of `target` on `kept` and `shuffled` features; rep -1 is the real order.

    Each scheme names the groups within which the `shuffled` features of a row are dealt anew together: the rows of a group by key get those of its rows by md5(seed|rep|key).
    A null in a grouping column counts as a value; rows that share a key are told apart by nothing, so any of them may come first. Rows take part if day, target and features are there.
    A year is predicted from all earlier ones if these hold `least` rows. Moments for each scheme, replicate and year reach the driver.
    """
    spark, names = rows.sparkSession, [*kept, *shuffled, target]
    groups = sorted({g for s in schemes.values() for g in s if g != "year"})
    x = {c: f"_x{i}" for i, c in enumerate(names)}
    base = rows.select(F.col(key).alias("_id"), F.year("d").alias("year"), *[F.col(g).alias(f"_by_{g}") for g in groups], *[F.col(c).cast("double").alias(n) for c, n in x.items()]).dropna(subset=["year", *x.values()])
    base = written(base, "placebo")
    used, cells = [base], []
    means = base.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in x.values()]).first()  # a number for each column
    base = base.withColumns({n: F.col(n) - means[n] for n in x.values()})
    for i, within in enumerate(schemes.values()):
        base, made, large = _placed(base, ["year" if g == "year" else f"_by_{g}" for g in within], "_id", i)
        released(*used)
        used = made
        cells.append(_Cells(large))
    base = written(base.drop(*[f"_by_{g}" for g in groups]), "placebo")
    released(*used)
    real = moments_of(base, ["year"], list(x.values()), F.lit(True)).collect()
    moments = [(name, -1, *r) for name in schemes for r in real]
    size, called = max(1, sum(r["_n"] for r in real)), list(schemes)
    for low in range(0, replicates, COUNTED):
        pairs = [(i, rep) for rep in range(low, min(low + COUNTED, replicates)) for i in range(len(schemes))]
        counts = _counts(base, pairs, cells, seed)
        at_once = max(1, ROUND // size)
        for a in range(0, len(pairs) if real else 0, at_once):
            now = pairs[a : a + at_once]
            of = {(i, rep): cells[i].counted(counts.get((i, rep), {})) for i, rep in now}
            moments += [(called[r["i"]], *r[1:]) for r in _round(base, now, of, [*[x[c] for c in kept], x[target]], [x[c] for c in shuffled], seed)]
            gc.collect()  # the round's shuffle files have no reader any more: Spark's cleaner drops what is unreachable
            spark._jvm.System.gc()
    released(base)
    k = len(names)
    kind = ", ".join(["scheme string, rep int, year int, _n long", *[f"_s{i} double" for i in range(k)], *[f"_q{i}_{j} double" for i in range(k) for j in range(i, k)]])
    each = spark.createDataFrame(moments, kind)
    errors = _errors(accumulated(each, ["scheme", "rep"], "year", k, own=True), ["scheme", "rep", "year"], least)
    return errors.groupBy("scheme", "rep").agg(F.sum("n").alias("n"), (F.sum("sse") / F.sum("n")).alias("mse"))


def shares(fits: DataFrame) -> DataFrame:
    """(scheme, n, real, placebo, share): the real error, the mean of the placebos', and the share of placebos that are at least as good."""
    real = fits.filter("rep < 0").select("scheme", "n", F.col("mse").alias("real"))
    joined = fits.filter("rep >= 0").select("scheme", "mse").join(real, "scheme")
    return joined.groupBy("scheme").agg(F.first("n").alias("n"), F.first("real").alias("real"), F.avg("mse").alias("placebo"), F.avg((F.col("mse") <= F.col("real")).cast("double")).alias("share"))
