"""Licence scan by a positional index of rare words.

Templates are licence notices as word sequences. The index holds, for each template, the
words of its mandatory key phrase that have the highest inverse document frequency
(counted over all documents), with their positions. A file's occurrences of indexed words
are looked up; each posting proposes a place for its template, the file position less the
template position, and a place that all of the template's indexed words agree on is
verified: the key phrase must stand there word by word, and enough of the other words.
So whatever differs outside the key phrase counts against that share only.

Defined results: NULL and empty texts have no words and no matches; each place of a
template is one match, places may overlap. Words are cut after lower-casing A-Z only.
Other columns pass through; a column named like an output is replaced. Empty tables give
empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WORD, appended, whole

RARE_WORDS = 3  # indexed words of a template's key phrase
ENOUGH = 0.8  # share of a template's words that must stand where it has them

# Phrases that are labels wherever their words stand consecutively.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Notices of public licences; the part in brackets is the mandatory key phrase.
NOTICES = (
    ("released under the [mit license]", "mit"),
    ("[permission is hereby granted free of charge] to any person obtaining a copy of this software", "mit"),
    ("licensed under the [apache license] version 2 0", "apache-2.0"),
    ("this work is licensed under the [gnu general public license] version 3", "gpl-3.0"),
    ("under the terms of the [gnu general public license] version 2", "gpl-2.0"),
    ("under the terms of the [gnu lesser general public license]", "lgpl"),
    ("under the terms of the [gnu affero general public license]", "agpl"),
    ("[redistribution and use in source and binary forms] with or without modification are permitted", "bsd"),
    ("subject to the terms of the [mozilla public license] v 2 0", "mpl-2.0"),
    ("licensed under [cc by nc] 4 0", "cc-by-nc"),
    ("licensed under [cc by sa] 4 0", "cc-by-sa"),
    ("licensed under [cc by nd] 4 0", "cc-by-nd"),
    ("[creative commons attribution] 4 0 international license", "cc-by"),
    ("[permission to use copy modify and or distribute this software] for any purpose", "isc"),
    ("this is free and unencumbered software [released into the public domain]", "unlicense"),
    (
        "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that [the above copyright notice and this permission notice appear in all copies]",
        "isc",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the "
        "[gnu general public license as published by the free software foundation] either version 3 of the license "
        "or at your option any later version",
        "gpl-3.0",
    ),
    (
        "[you may not use this file except in compliance with the license] you may obtain a copy of the license at "
        "http www apache org licenses license 2 0",
        "apache-2.0",
    ),
    (
        "this source code form is subject to the terms of the [mozilla public license] v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "mpl-2.0",
    ),
)

find_words = re.compile(WORD.encode()).findall


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    key: tuple[int, int]  # first word and end of the key phrase
    base: bool


def templates() -> list[Template]:
    out = [Template(label, w := tuple(p.encode().split()), (0, len(w)), True) for p, label in PHRASES]
    for notice, label in NOTICES:
        before, key, after = (part.encode().split() for part in re.split(r"[\[\]]", notice))
        out.append(Template(label, (*before, *key, *after), (len(before), len(before) + len(key)), False))
    return out


def document_frequencies(docs: DataFrame, words: Sequence[bytes], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """Documents that hold each of ``words``, and all documents. Folds a batch before it shuffles."""
    known = frozenset(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for text in batch.column(0).to_pylist():
                found.update(known.intersection(find_words(text.lower())))
            rows = [("", batch.num_rows), *((w.decode(), n) for w, n in found.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["w", "n"])

    parts = docs.select(whole(text_col).cast("binary")).mapInArrow(count, "w string, n bigint")
    total = {r["w"].encode(): r["n"] for r in parts.groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return {w: total.get(w, 0) for w in known}, total.get(b"", 0)


class Index:
    """Postings of the rarest words of each template."""

    def __init__(self, entries: Sequence[Template], idf: dict[bytes, float]):
        self.entries = list(entries)
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.needed = []
        for t, entry in enumerate(self.entries):
            rarest = sorted(range(*entry.key), key=lambda i: (-idf.get(entry.words[i], 0.0), i))[:RARE_WORDS]
            self.needed.append(len(rarest))
            for i in rarest:
                self.postings.setdefault(entry.words[i], []).append((t, i))

    def matches(self, words: Sequence[bytes]) -> list[tuple[str, int, int, float, bool]]:
        """(label, first word, words, share of the template found, base) of each verified place."""
        postings = self.postings
        hits = [(i, w) for i, w in enumerate(words) if w in postings]
        votes = Counter((t, i - at) for i, w in hits for t, at in postings[w])
        out = []
        for (t, start), n in votes.items():
            entry = self.entries[t]
            if n < self.needed[t] or start < 0:
                continue
            first, end = entry.key
            if tuple(words[start + first : start + end]) != entry.words[first:end]:
                continue
            same = sum(a == b for a, b in zip(entry.words, words[start : start + len(entry.words)], strict=False))
            share = same / len(entry.words)
            if share >= ENOUGH:
                out.append((entry.label, start, len(entry.words), share, entry.base))
        return sorted(out)


def build_index(docs: DataFrame, text_col: str = "text", entries: Sequence[Template] | None = None) -> Index:
    entries = templates() if entries is None else entries
    frequency, n = document_frequencies(docs, [w for e in entries for w in e.words], text_col)
    return Index(entries, {w: float(np.log((1 + n) / (1 + df))) for w, df in frequency.items()})


MATCH = "array<struct<label:string,start:bigint,words:bigint,share:double,base:boolean>>"
MATCH_ARROW = pa.list_(
    pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("share", pa.float64()), ("base", pa.bool_())])
)


def scanned(docs: DataFrame, index: Index, text_col: str = "text", keep=None) -> DataFrame:
    """Append n_words and the matches of every whole text."""

    def make():
        names = [f.name for f in MATCH_ARROW.value_type]

        def work(texts: pa.Array) -> list[pa.Array]:
            files = [find_words(t.lower()) for t in texts.to_pylist()]
            found = [[dict(zip(names, m, strict=True)) for m in index.matches(words)] for words in files]
            return [pa.array([len(w) for w in files], pa.int64()), pa.array(found, MATCH_ARROW)]

        return work

    return appended(docs, whole(text_col).cast("binary"), make, f"n_words bigint, matches {MATCH}", keep)
