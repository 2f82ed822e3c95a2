"""Licence scans with a positional rare-token index.

Templates are word sequences with a mandatory phrase. Document counts of all template words over
the whole corpus give their inverse document frequencies. The index lists, for each word, the templates and the
word's places in their phrases. A file can hold a template only if all words of the phrase are among its
licence words. A file's words are looked up from the one with the highest idf on, until each template that it can hold has
two of its words among them; so which postings are read depends on the file. A word's places in the file minus its place in the
template are the relative positions at which the template would start; the positions that all looked-up words of the template
agree on are verified: the whole phrase must stand there, and a template counts by the idf share of its words that do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import ALNUM, Words, slices

#: Phrases and their labels; wherever a phrase's words stand consecutively counts.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices, the phrase that must stand in them, and the label.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "general public license version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "lesser general public license", "lgpl"),
    ("licensed under cc by 4 0", "cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by nc 4 0", "cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc by sa 4 0", "cc-by-sa-4.0"),
    ("released under the mit license", "the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms", "bsd-text"),
    ("subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl-2.0"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
        "purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        "permission is hereby granted free of charge", "mit-full",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability "
        "and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "with or without fee is hereby granted", "isc-full",
    ),
)


class Index:
    """Words of the templates with their ranks by idf, and for each template its words and the places of its phrase."""

    def __init__(self, idf: dict[str, float], least: float = 0.75, rare: int = 2):
        self.idf, self.least = idf, least
        self.words = sorted({w for t, _, _ in (*TEMPLATES, *((p, p, b) for p, b in BASE)) for w in t.split()})
        number = {w: i for i, w in enumerate(self.words)}
        weight = np.array([max(idf.get(w, 0.0), 1e-6) for w in self.words])
        self.templates = []
        for text, phrase, label in (*((p, p, b) for p, b in BASE), *TEMPLATES):
            ids, key = np.array([number[w] for w in text.split()]), np.array([number[w] for w in phrase.split()])
            must = next(i for i in range(len(ids)) if list(ids[i : i + len(key)]) == list(key))
            self.templates.append((label, ids, weight[ids] / weight[ids].sum(), must, len(key)))
        self.rare, self.rank = rare, np.empty(len(self.words), np.int64)
        self.rank[sorted(range(len(self.words)), key=lambda i: (-weight[i], self.words[i]))] = np.arange(len(self.words))

    def looked_up(self, has: np.ndarray) -> np.ndarray:
        """(file, word): the words that are looked up, given the licence words that each file has: those of the highest idf, as far down as the templates that it can hold ask for."""
        depth = np.full(len(has), -1)
        for _, ids, _, must, size in self.templates:
            ranks = np.sort(self.rank[np.unique(ids[must : must + size])])
            able = has[:, ids[must : must + size]].all(1)
            depth[able] = np.maximum(depth[able], ranks[min(self.rare, len(ranks)) - 1])
        return has & (self.rank[None, :] <= depth[:, None])

    def scan(self, licence: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each template, the fitting starts (word numbers) and their scores. licence: number of each word, or -1."""
        n = len(licence)
        known = np.flatnonzero(licence >= 0)
        has = np.zeros((int(text_of[-1]) + 1 if n else 0, len(self.words)), bool)  # the licence words of each file
        has[text_of[known], licence[known]] = True
        places = {int(w): known[licence[known] == w] for w in np.unique(licence[known])}
        looked = self.looked_up(has)
        for t, (_, ids, share, must, size) in enumerate(self.templates):
            phrase = ids[must : must + size]
            able = has[:, phrase].all(1)
            asked = looked[:, phrase] & able[:, None]  # the places of the phrase whose words are looked up, file by file
            starts = [known[:0]]
            for pattern in np.unique(asked[able], axis=0):
                files = able & (asked == pattern).all(1)
                found = [places[int(phrase[p])] - must - p for p in np.flatnonzero(pattern)]
                found = [x[files[text_of[x + must + p]]] for x, p in zip(found, np.flatnonzero(pattern), strict=True)]
                starts.append(reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), found))
            start = np.sort(np.concatenate(starts))
            at = start + must
            ok = (at >= 0) & (at + size <= n)
            start, at = start[ok], at[ok]
            fits = (licence[at[:, None] + np.arange(size)] == ids[must : must + size]).all(1) & (text_of[at] == text_of[at + size - 1])
            start, at = start[fits], at[fits]
            place = start[:, None] + np.arange(len(ids))
            inside = (place >= 0) & (place < n)
            place = np.clip(place, 0, max(n - 1, 0))
            same = inside & (text_of[place] == text_of[at][:, None]) & (licence[place] == ids) if len(start) else np.zeros(place.shape, bool)
            yield t, at, same @ share


def _licence_words(part: pa.Array, vocabulary: list[str]) -> tuple[Words, np.ndarray]:
    words = Words(part, ALNUM)
    coded = words.array().dictionary_encode()
    known = pc.index_in(coded.dictionary, value_set=pa.array(vocabulary)).fill_null(-1).to_numpy(zero_copy_only=False)
    return words, known[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)


def _counted(vocabulary: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, docs = np.zeros(len(vocabulary), np.int64), 0
        for part in slices(batches, "text"):
            words, known = _licence_words(part.column(0), vocabulary)
            at = known >= 0
            pairs = np.unique(words.text_of()[at] * len(vocabulary) + known[at])
            count += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            docs += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*vocabulary, ""]), pa.array([*count.tolist(), docs])], names=["word", "n"])

    return run


def _scanned(idf: dict[str, float]):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf)
        for part in slices(batches, "text"):
            words, licence = _licence_words(part.column(1), index.words)
            text, n = words.text_of(), part.num_rows
            count, score = np.zeros(n, np.int64), np.zeros(n)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base, own = [set() for _ in range(n)], [set() for _ in range(n)]
            for t, at, fit in index.scan(licence, text):
                doc, label = text[at], index.templates[t][0]
                if t < len(BASE):
                    np.add.at(count, doc, 1)
                    np.minimum.at(first, doc, at - words.off[doc])
                    np.maximum.at(last, doc, at - words.off[doc])
                else:
                    doc, fit = doc[fit >= index.least], fit[fit >= index.least]
                np.maximum.at(score, doc, fit)
                for d in np.unique(doc).tolist():
                    (base if t < len(BASE) else own)[d].add(label)
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(words.off)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none)]
                + [pa.array([",".join(sorted(x)) for x in sets], pa.string()) for sets in (base, [a | b for a, b in zip(base, own, strict=True)])]
                + [pa.array(np.minimum(score, 1.0))],
                schema=schema,
            )

    return run


def scan(docs: DataFrame) -> DataFrame:
    """Licence phrases, notices and a score of every whole text.

    Takes `doc_id` and `text`; other columns are ignored. A null or empty text has no words, no
    labels ("") and score 0. Rows are judged one by one, repeated ones too; an empty table gives no
    rows. Document counts cover all rows; only sums for the fixed template words reach the driver.
    """
    vocabulary = Index({}).words
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_counted(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r["word"]: r["n"] for r in counted.collect()}
    docs_n = got.get("", 0)
    idf = {w: math.log((1 + docs_n) / (1 + got.get(w, 0))) for w in vocabulary}
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _scanned(idf), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
