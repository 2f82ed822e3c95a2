"""I-Match fingerprints from randomised lexicon subsets, in DataFrame functions only.

Document counts of all terms over all texts give their inverse document frequencies. The lexicon
holds the terms within a band of them. It is bounded however large the corpus: a term in at least
a share `least` of all documents has at most (mean distinct terms) / least companions. It travels
as a cuckoo table of term hashes in a literal, so that membership takes two array reads.

A text's distinct lexicon terms are sorted; each of the randomised subsets of the lexicon keeps some
of them, and the hash of what a subset keeps is one part of the fingerprint. Subsets keep shares from
a half down, so that short and long texts both have subsets with few terms. Two fingerprints are as
alike as the share of subsets, among those that keep a term of either, whose hashes agree.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The band: shares of all documents that a term of the lexicon stands in, and the fewest documents.
LEAST, MOST, FEWEST = 0.01, 0.20, 2
#: The most terms of a lexicon; over it the band is refused rather than shipped to every task.
TERMS = 1 << 18
#: Subsets as (bits, salts): a subset keeps a term with chance 2**-bits.
SUBSETS = ((0, 1), (2, 3), (3, 3), (4, 3), (5, 3), (6, 4), (7, 4), (8, 4), (9, 4))
LAST = (1 << 63) - 1
#: Documents of a bucket when the next document is looked up.


def terms(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def lexicon(texts: DataFrame, least: float = LEAST, most: float = MOST) -> list[int]:
    """Hashes of the terms within the band, from counts over all rows of `texts` (column text)."""
    n = texts.count()
    each = texts.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    counted = each.groupBy(F.xxhash64("term").alias("term")).count()
    inside = counted.filter((F.col("count") >= max(FEWEST, least * n)) & (F.col("count") <= max(FEWEST, most * n)))
    got = [r["term"] for r in inside.select("term").limit(TERMS + 1).collect()]  # bounded by 1 / least, and checked
    if len(got) > TERMS:
        raise ValueError(f"the band holds over {TERMS} terms")
    return sorted(got)


class Lexicon:
    """Membership of term hashes in a cuckoo table."""

    def __init__(self, members: list[int]):
        self.bits = max(4, (2 * len(members)).bit_length())
        while not self._placed(members):
            self.bits += 1
        # A free place repeats a member, which is no mistake. The cast is folded into one literal.
        self.any = bool(members)
        self.literal = F.split(F.lit(",".join(str(members[0] if v is None else v) for v in self.table)), ",").cast("array<bigint>") if members else None

    def _at(self, h: int) -> tuple[int, int]:
        mask = (1 << self.bits) - 1
        return h & mask, (h >> 32) & mask

    def _placed(self, members: list[int]) -> bool:
        self.table: list[int | None] = [None] * (1 << self.bits)
        rng = random.Random(9)
        for h in members:
            for _ in range(500):
                a, b = self._at(h)
                at = a if self.table[a] is None else b if self.table[b] is None else rng.choice((a, b))
                self.table[at], h = h, self.table[at]
                if h is None:
                    break
            else:
                return False
        return True

    def holds(self, h: Column) -> Column:
        if not self.any:
            return F.lit(False)
        mask = (1 << self.bits) - 1
        one, two = h.bitwiseAND(mask).cast("int"), F.shiftright(h, 32).bitwiseAND(mask).cast("int")
        return (F.get(self.literal, one) == h) | (F.get(self.literal, two) == h)


def parts(text: Column, words: Lexicon) -> Column:
    """The hash of each subset's sorted terms, null where it keeps none; the last part is the hash of all terms if none is in the lexicon."""
    hashed = F.transform(terms(text), lambda t: F.xxhash64(t))
    kept = F.array_sort(F.array_distinct(F.filter(hashed, words.holds)))
    return F.transform(F.array(F.struct(kept.alias("kept"), hashed.alias("every"))), lambda s: F.array(*_subsets(s["kept"]), F.when(F.size(s["kept"]) == 0, F.xxhash64(F.array_sort(F.array_distinct(s["every"]))))))[0]


def _keeps(shift: int, bits: int):
    return lambda h: F.shiftright(h, shift).bitwiseAND((1 << bits) - 1) == 0


def _subsets(kept: Column) -> list[Column]:
    out, salt = [], 0
    for bits, count in SUBSETS:
        for _ in range(count):
            shift = (salt * 7) % 57
            chosen = F.filter(kept, _keeps(shift, bits))
            out.append(F.when(F.size(chosen) > 0, F.xxhash64(chosen, F.lit(salt))))
            salt += 1
    return out


def shown(p: Column) -> Column:
    return F.array_join(F.transform(p, lambda v: F.coalesce(F.lower(F.hex(v)), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of parts that agree, among those that either has; 1 if neither has any."""
    both = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"].isNotNull() | z["b"].isNotNull())
    same = F.size(F.filter(both, lambda z: z["a"].eqNullSafe(z["b"])))
    return F.when(F.size(both) > 0, same / F.size(both)).otherwise(F.lit(1.0))


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc, body, n, next_doc, next_body): the next document of each, by id and text hash; the first follows the last.

    Ranges of (doc, body) of about equal size are led through each by itself, whatever the ids are; the head of the next
    range follows a range's last document. Only the heads, one of each range, meet in one place.
    """
    narrow = docs.groupBy("doc", "body").agg(F.max(F.char_length("text")).alias("n"))
    narrow = written(narrow.repartitionByRange("doc", "body").withColumn("range", F.spark_partition_id()), "narrow")
    head = F.struct("doc", "body")
    heads = narrow.groupBy("range").agg(F.min(head).alias("head"))
    first = heads.agg(F.min("head")).first()[0]
    if first is None:
        return narrow.select("doc", "body", "n", F.col("doc").alias("next_doc"), F.col("body").alias("next_body"))
    whole = F.struct(F.lit(first["doc"]).cast("long").alias("doc"), F.lit(first["body"]).cast("long").alias("body"))
    after = heads.select("range", F.coalesce(F.lead("head").over(Window.orderBy("head")), whole).alias("after"))
    own = Window.partitionBy("range").orderBy("doc", "body")
    led = narrow.withColumn("next", F.lead(head).over(own)).join(F.broadcast(after), "range")  # a row for each partition
    follow = F.coalesce("next", "after")
    return led.select("doc", "body", "n", follow["doc"].alias("next_doc"), follow["body"].alias("next_body"))


def fingerprints(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    Takes `doc_id` and `text`; other columns are ignored, and a null text counts as empty. The edited
    text has its last quarter replaced by the first as many code points (or all) of the next document.
    Documents follow each other by doc_id, then by a hash of their text; a null doc_id comes last.
    Repeated rows count as one document, and each gives a row. The only document is its own next. An
    empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text.alias("text")).withColumn("body", F.xxhash64("text"))
    words = Lexicon(lexicon(base.select("text"), least, most))
    following = written(neighbours(base), "following")
    quarter = F.expr("cast(n div 4 as int)")
    # Both joins take the texts by the same columns without new names, so that they read one shuffle of them.
    pairs = following.select(F.col("doc").alias("own_doc"), F.col("body").alias("own_body"), "n", "next_doc", "next_body")
    joined = pairs.join(base, (F.col("next_doc") == F.col("doc")) & (F.col("next_body") == F.col("body")))
    grafts = joined.groupBy("own_doc", "own_body").agg(F.max("n").alias("n"), F.max("next_doc").alias("next_doc"), F.max("next_body").alias("next_body"), F.max(F.col("text").substr(F.lit(1), quarter)).alias("graft"))
    whole = base.join(grafts, (F.col("doc") == F.col("own_doc")) & (F.col("body") == F.col("own_body")))
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n").cast("int") - quarter), "graft")
    marked = whole.select("doc", "body", "next_doc", "next_body", F.col("n").cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), parts(F.col("text"), words).alias("own"), parts(edited, words).alias("changed"))
    marked = written(marked, "marked")
    of_next = marked.select(F.col("doc").alias("next_doc"), F.col("body").alias("next_body"), F.col("own").alias("next_own")).dropDuplicates(["next_doc", "next_body"])
    return marked.join(of_next, ["next_doc", "next_body"]).select(
        F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
