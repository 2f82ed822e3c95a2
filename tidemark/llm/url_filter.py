"""URL filters with a cascade of Bloom filters.

Level 0 encodes the listed keys. Level 1 encodes those keys of the corpus that level 0 holds by
mistake, level 2 the listed keys that level 1 holds by mistake, and so on until no mistake is
left. For every key of the corpus the cascade answers exactly, without a join. Its size follows
the list: level 0's error rate falls with the number of corpus keys, so that level 1 is no larger
than the list. Everything is made of DataFrame functions; a level's bits travel as a literal of a
checked size.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The most bytes that a level may have; a larger list is refused rather than shipped to every task.
LEVEL_BYTES = 16 << 20
LEVELS = 64


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """A host and all domains above it: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


class Level:
    """One Bloom filter: its bits as an array literal of 64-bit words."""

    def __init__(self, keys: DataFrame, count: int, rate: float, seed: int):
        rate = min(0.5, max(rate, 1e-9))
        self.seed = seed
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = max(64, 64 * math.ceil(-count * math.log(rate) / math.log(2) ** 2 / 64))
        if self.bits / 8 > LEVEL_BYTES:
            raise ValueError(f"a level of {self.bits // 8} bytes is over LEVEL_BYTES")
        at = F.explode(F.array(*self._places(F.col("key"))))
        words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        got = {r["word"]: r["bits"] for r in words.collect()}  # bounded by LEVEL_BYTES
        self.words = F.split(F.lit(",".join(str(got.get(i, 0)) for i in range(self.bits // 64))), ",").cast("array<bigint>")

    def _places(self, key: Column) -> list[Column]:
        one, two = F.xxhash64(key, F.lit(2 * self.seed)), F.xxhash64(key, F.lit(2 * self.seed + 1)).bitwiseOR(F.lit(1))
        step = F.shiftright(two, 16)  # the sum below stays within 64 bits
        start = F.shiftright(one, 16)
        return [F.pmod(start + step * F.lit(k), F.lit(self.bits)).cast("bigint") for k in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.call_function("shiftright", F.get(self.words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1 for at in self._places(key)])


class Cascade:
    """Exact membership in `listed` for every key of `universe` (both have a column `key`)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        inside = written(listed.select("key").filter(F.col("key").isNotNull()).distinct(), "listed")
        outside = universe.select("key").filter(F.col("key").isNotNull()).distinct().join(F.broadcast(inside) if inside.count() < 100_000 else inside, "key", "left_anti")
        outside = written(outside, "universe")
        self.levels: list[Level] = []
        own, other = inside, outside
        n, against = own.count(), other.count()
        while n and len(self.levels) < LEVELS:
            rate = min(0.5, math.sqrt(0.5) * n / max(1, against)) if not self.levels else 0.5
            level = Level(own, n, rate, len(self.levels))
            self.levels.append(level)
            mistaken = written(other.filter(level.holds(F.col("key"))), "mistaken")
            own, other, n = mistaken, own, mistaken.count()
        if n:
            raise RuntimeError("the cascade did not end")

    def holds(self, key: Column) -> Column:
        """Listed if the first level that does not hold the key has an odd number, or none does and their number is odd."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[i].holds(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """Host, path, the rule that fits and the verdict of every url.

    `rules` are (host, path, verdict); a rule fits its host and all subdomains if the path starts
    with the rule's, and the longest wins. Other urls are blocked if the cascade holds the host or
    a domain above it, as listed in column `key`. A null url or one without `://` has an empty host
    and path and is allowed. Repeated rows are judged each; an empty table gives no rows.
    """
    parsed = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = parsed.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    cascade = Cascade(listed, keys)
    hit = F.exists(suffixes(F.col("host")), cascade.holds)
    rule, verdict = F.lit(None).cast("string"), F.when(hit, "block").otherwise("allow")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
