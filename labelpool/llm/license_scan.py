"""License scans with a positional index of rare words.

The templates are short notices. Their words are indexed: word to (template, position). One pass
counts in how many texts each licence word occurs; the inverse of that makes a word rare. In the
second pass the rarest licence words of a text are looked up, their postings give for each place
of the word the place at which a template would have to start, places that enough words agree on
are kept, and the template's mandatory phrase is verified there word by word.

Both passes hash all words of a batch at once and keep only those that are licence words, so cost
is that of reading the bytes. The counts are one row for each licence word and task; nothing else
is shuffled, and no key can be hot.

*Base labels.* Phrases are templates whose mandatory phrase is all of them, so their places are
found the same way. Since all words of a phrase have to be there, looking up its rarest word finds
every place. *Own labels* name the version or kind of license that a longer notice states.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Defined cases: NULL text
counts as empty: no words, no places, empty labels, score 0. Ties between equally rare words go to
the smaller word. Repeated rows each give a row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpool.llm.bytescan import LOWER, byte_class, flat, hash_word, words

OTHER = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

#: The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Fixed values: (label, notice, mandatory phrase within it).
NOTICES = [
    ("gpl-2.0", "licensed under the gnu general public license version 2", "public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("mit-notice", "released under the mit license", "under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this"
     " software", "hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are"
     " permitted", "source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]
#: Part of a notice's words that have to stand at their places.
AGREE = 0.6


@dataclass
class Index:
    """Templates and the postings of their words."""

    labels: list[str]
    base: np.ndarray
    texts: list[list[str]]
    #: Offset and words of the mandatory phrase.
    must: list[tuple[int, list[str]]]

    def __post_init__(self):
        self.vocabulary = sorted({w for t in self.texts for w in t})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        hashes = np.array([hash_word(w) for w in self.vocabulary], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.templates = [np.array([number[w] for w in t]) for t in self.texts]
        #: word -> template -> positions
        self.postings: list[dict[int, list[int]]] = [{} for _ in self.vocabulary]
        for t, template in enumerate(self.templates):
            for k, w in enumerate(template.tolist()):
                self.postings[w].setdefault(t, []).append(k)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The number of each hashed word in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)


def build_index(phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str, str]] = NOTICES) -> Index:
    labels, base, texts, must = [], [], [], []
    for phrase, label in phrases.items():
        labels.append(label)
        base.append(True)
        texts.append(phrase.split())
        must.append((0, phrase.split()))
    for label, notice, phrase in notices:
        body, key = notice.split(), phrase.split()
        at = next(i for i in range(len(body)) if body[i : i + len(key)] == key)
        labels.append(label)
        base.append(False)
        texts.append(body)
        must.append((at, key))
    return Index(labels, np.array(base), texts, must)


def _licence_words(batch: pa.RecordBatch, column: int, index: Index):
    """``(words per text, (doc, position, word number, start, end) of licence words, bytes)``."""
    data, offsets = flat(batch.column(column))
    h, lo, hi, doc = words(data, offsets, OTHER)
    n = len(offsets) - 1
    per = np.bincount(doc, minlength=n)
    number = index.lookup(h)
    at = np.flatnonzero(number >= 0)
    first = np.cumsum(per) - per
    return per, doc[at], at - first[doc[at]], number[at], lo[at], hi[at], data


def document_counts(docs: DataFrame, index: Index, text_col: str) -> tuple[int, dict[str, int]]:
    """Texts in all, and texts with each licence word; one row for each licence word is kept."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in batches:
            _, doc, _, number, *_ = _licence_words(batch, 0, index)
            pairs = np.unique(doc * len(seen) + number)
            seen += np.bincount(pairs % len(seen), minlength=len(seen))
            rows += batch.num_rows
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([""] + [index.vocabulary[i] for i in some.tolist()]),
                pa.array(np.r_[rows, seen[some]].astype(np.int64)),
            ],
            ["word", "n"],
        )

    counted = (
        docs.select(F.col(text_col).alias("text"))
        .mapInArrow(scan, "word string, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    found = {r["word"]: r["n"] for r in counted}
    return found.pop("", 0), found


def match_text(number: np.ndarray, position: np.ndarray, index: Index, idf: np.ndarray):
    """Verified ``(template, start, agreeing words)`` of one text's licence words."""
    out: list[tuple[int, int, int]] = []
    there = dict(zip(position.tolist(), number.tolist()))
    present = set(number.tolist())
    # The words of the text from the rarest on; a template is settled by its rarest word there.
    settled: set[int] = set()
    places: dict[int, list[int]] = {}
    for p, w in there.items():
        places.setdefault(w, []).append(p)
    for w in sorted(present, key=lambda w: (-idf[w], index.vocabulary[w])):
        for t, spots in index.postings[w].items():
            if t in settled:
                continue
            at, key = index.must[t]
            template = index.templates[t]
            mandatory = template[at : at + len(key)]
            if not present.issuperset(mandatory.tolist()):
                settled.add(t)
                continue
            if not any(at <= k < at + len(key) for k in spots):
                continue
            settled.add(t)
            # Relative positions: where the template would have to start.
            starts = {p - k for p in places[w] for k in spots if at <= k < at + len(key)}
            for s in sorted(starts):
                if any(there.get(s + at + k) != m for k, m in enumerate(mandatory.tolist())):
                    continue
                agree = sum(there.get(s + k) == m for k, m in enumerate(template.tolist()))
                if agree >= AGREE * len(template):
                    out.append((t, s, agree))
    return out


def scan_licenses(
    docs: DataFrame, keep: list[str], text_col: str = "text", index: Index | None = None
) -> DataFrame:
    """``keep`` and what was found, one row per row of ``docs``: ``n_words, n_base, first_word,
    last_word, base_labels, labels, score`` and the places ``array<struct<label, first, last>>``."""
    index = index or build_index()
    total, counts = document_counts(docs, index, text_col)
    idf = np.array([np.log((total + 1) / (counts.get(w, 0) + 1)) for w in index.vocabulary])
    shared = docs.sparkSession.sparkContext.broadcast((index, idf))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, idf = shared.value
        for batch in batches:
            per, doc, position, number, lo, hi, data = _licence_words(batch, len(keep), index)
            n = batch.num_rows
            bounds = np.searchsorted(doc, np.arange(n + 1)).tolist()
            n_base = np.zeros(n, np.int64)
            first: list[int | None] = [None] * n
            last: list[int | None] = [None] * n
            base_labels, labels, score = [""] * n, [""] * n, np.zeros(n)
            places: list[list[dict]] = [[] for _ in range(n)]
            for d in np.unique(doc).tolist():
                a, b = bounds[d], bounds[d + 1]
                found = match_text(number[a:b], position[a:b], index, idf)
                if not found:
                    continue
                spell = {
                    p: bytes(LOWER[data[x:y]]).decode()
                    for p, x, y in zip(position[a:b].tolist(), lo[a:b].tolist(), hi[a:b].tolist())
                }
                # Hashes found the places; the letters themselves confirm them.
                found = [
                    (t, s, agree)
                    for t, s, agree in found
                    if [spell[s + index.must[t][0] + k] for k in range(len(index.must[t][1]))]
                    == index.must[t][1]
                ]
                base = sorted(s for t, s, _ in found if index.base[t])
                n_base[d] = len(base)
                if base:
                    first[d], last[d] = base[0], base[-1]
                base_labels[d] = ",".join(sorted({index.labels[t] for t, _, _ in found if index.base[t]}))
                labels[d] = ",".join(sorted({index.labels[t] for t, _, _ in found}))
                weight = [
                    agree / len(index.texts[t]) * (0.5 if index.base[t] else 1.0)
                    for t, _, agree in found
                ]
                score[d] = max(weight, default=0.0)
                places[d] = [
                    {"label": index.labels[t], "first": s + index.must[t][0],
                     "last": s + index.must[t][0] + len(index.must[t][1]) - 1}
                    for t, s, _ in sorted(found)
                ]
            kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(keep)],
                    pa.array(per.astype(np.int64)),
                    pa.array(n_base),
                    pa.array(first, pa.int64()),
                    pa.array(last, pa.int64()),
                    pa.array(base_labels, pa.string()),
                    pa.array(labels, pa.string()),
                    pa.array(score),
                    pa.array(places, kind),
                ],
                [*keep, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"],
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema += (
        ", n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string,"
        " labels string, score double, places array<struct<label:string,first:bigint,last:bigint>>"
    )
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(scan, schema)
