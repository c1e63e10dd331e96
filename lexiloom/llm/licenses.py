"""Operator 8, licences: a positional index of the rare words of licence texts.

Words are lower case, without punctuation. Document frequencies of all words of the templates, counted over all
documents, give their weights (inverse document frequency). Of each template, the rarest words are indexed with their
positions: as many as it takes for the rest to weigh less than min_score of the whole, so that whatever reaches
min_score has one of them. A document's indexed words name, by their postings' relative positions, the places where a
template would begin. Those of one template within some words (slack) of the first of them are one place, as a word that is
put in or left out shifts what follows. There the template's words are compared with the document's, each at any of
the place's beginnings; a place counts if the weights of those that agree make min_score of the template's and each of
its mandatory phrases is there word for word.

Every place in every text is found, with its byte span from the first to the last word that agrees. Templates are
looked for one by one: where those of two agree with the same words, both have a place (so a text under GPL 3 has none
of GPL 2, whose mandatory phrase it lacks, but a short notice within a long one has its own). The templates are notices,
openings and bodies of common licences and their SPDX tags; a licence that isn't among them isn't found. Null and empty
texts have none. Texts are searched whole, whatever their length. Rows that repeat have their places each; a null
doc_id stays, others have to be numbers; other columns, of whatever names, are ignored. A word that no document has
weighs most; an empty table gives no places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import APART, LOWER, doc_words, pieces, ranges, span_hashes, table

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at"""
_GNU = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."

#: Name, text, mandatory phrases.
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("Apache-2.0", _APACHE, ("apache license version 2 0", "except in compliance")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license version 3",)),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license version 3",)),
    ("GPL-3.0", _GNU.format("This program", "General Public License", 3), ("gnu general public license", "either version 3")),
    ("GPL-2.0", _GNU.format("This program", "General Public License", 2), ("gnu general public license", "either version 2")),
    ("LGPL-3.0", _GNU.format("This library", "Lesser General Public License", 3), ("gnu lesser general public license", "either version 3")),
    ("LGPL-2.1", _GNU.format("This library", "Lesser General Public License", "2.1"), ("gnu lesser general public license", "either version 2 1")),
    ("AGPL-3.0", _GNU.format("This program", "Affero General Public License", 3), ("gnu affero general public license", "either version 3")),
    ("MIT", "Released under the MIT License", ("mit license",)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    ("MIT", _MIT, ("permission is hereby granted", "free of charge", "without restriction")),
    ("ISC", _ISC, ("permission to use copy modify", "with or without fee")),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License", ("bsd 3 clause license",)),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License", ("bsd 2 clause license",)),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms",)),
    ("BSD", _BSD, ("redistribution and use in source and binary forms", "must reproduce the above copyright notice")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0", ("eclipse public license v 2 0",)),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0 international",)),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright; CC0 1.0 Universal", ("cc0 1 0 universal",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    *((name, f"SPDX-License-Identifier: {tag}", (f"identifier {tag}",)) for name, tag in (
        ("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0"), ("EPL-2.0", "EPL-2.0"),
        ("GPL-2.0", "GPL-2.0"), ("GPL-3.0", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3.0"), ("AGPL-3.0", "AGPL-3.0"), ("CC0-1.0", "CC0-1.0"), ("Unlicense", "Unlicense"))),
)


@dataclass(frozen=True)
class Params:
    """min_score: least share of a template's weight that agrees. slack: words by which beginnings of one place may lie apart, in short templates an eighth of their words."""

    templates: tuple[tuple[str, str, tuple[str, ...]], ...] = TEMPLATES
    min_score: float = 0.75
    slack: int = 8


def word_hashes(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return span_hashes(data, *doc_words(data, np.array([0, len(data)]), APART)[:2])


class Index:
    """Templates with weights: total rows, and how many have each word of the templates (by hash)."""

    def __init__(self, p: Params, total: int, having: dict[int, int]):
        self.p = p
        self.words = [word_hashes(t) for _, t, _ in p.templates]
        self.weights = [np.array([np.log((total + 1) / (having.get(int(x), 0) + 1)) + 1e-9 for x in w.view(np.int64)]) for w in self.words]
        #: Where mandatory phrases begin and end.
        self.must: list[list[tuple[int, int]]] = []
        postings: list[tuple[int, int, int]] = []
        for k, (w, v) in enumerate(zip(self.words, self.weights)):
            need = []
            for phrase in p.templates[k][2]:
                x = word_hashes(phrase)
                at = [i for i in range(len(w) - len(x) + 1) if np.array_equal(w[i : i + len(x)], x)]
                if not at:
                    raise ValueError(f"template {k} lacks its phrase {phrase!r}")
                need.append((at[0], at[0] + len(x)))
            self.must.append(need)
            rest = v.sum()
            for i in np.argsort(-v, kind="stable"):  # the rarest first
                postings.append((int(w[i]), k, int(i)))
                rest -= v[i]
                if rest < p.min_score * v.sum():
                    break
        postings.sort()
        self.key = np.array([x for x, _, _ in postings], np.uint64)
        self.template = np.array([k for _, k, _ in postings], np.int64)
        self.offset = np.array([i for _, _, i in postings], np.int64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.key & np.uint64(0xFFFF)).astype(np.int64)] = True

    def places(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """Row, template, start, end, score of each place."""
        data = LOWER[data]
        starts, ends, first = doc_words(data, at, APART)
        h = span_hashes(data, starts, ends)
        seed = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        lo, hi = np.searchsorted(self.key, h[seed], "left"), np.searchsorted(self.key, h[seed], "right")
        post = ranges(lo, hi - lo)
        begin = np.repeat(seed, hi - lo) - self.offset[post]
        row = np.repeat(np.searchsorted(first, seed, "right") - 1, hi - lo)
        got = np.unique(np.stack([row, self.template[post], begin], 1), axis=0).tolist()
        i = 0
        while i < len(got):
            r, k, b = got[i]
            i += 1
            begins = [b]
            while i < len(got) and got[i][:2] == [r, k] and got[i][2] <= b + min(self.p.slack, len(self.words[k]) // 8):
                begins.append(got[i][2])
                i += 1
            w, v = self.words[k], self.weights[k]
            same = np.zeros((len(begins), len(w)), bool)
            for n, at_ in enumerate(begins):
                a, z = max(at_, int(first[r])), min(at_ + len(w), int(first[r + 1]))
                same[n, a - at_ : z - at_] = h[a:z] == w[a - at_ : z - at_]
            score = float(v[same.any(0)].sum() / v.sum())
            if score >= self.p.min_score and all(same[:, x:y].all(1).any() for x, y in self.must[k]):
                n, j = np.nonzero(same)
                spot = np.asarray(begins)[n] + j
                yield r, k, int(starts[spot.min()] - at[r]), int(ends[spot.max()] - at[r]), score


def frequencies(docs: DataFrame, p: Params = Params()) -> tuple[int, dict[int, int]]:
    """How many rows there are, and how many have each word of the templates."""
    names = np.unique(np.concatenate([word_hashes(t) for _, t, _ in p.templates]))
    maybe = np.zeros(1 << 16, bool)
    maybe[(names & np.uint64(0xFFFF)).astype(np.int64)] = True

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(names), np.int64), 0
        for b, data, at in pieces(it, "text"):
            data = LOWER[data]
            starts, ends, first = doc_words(data, at, APART)
            h = span_hashes(data, starts, ends)
            own = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
            k = np.minimum(np.searchsorted(names, h[own]), len(names) - 1)
            own, k = own[names[k] == h[own]], k[names[k] == h[own]]
            pair = np.unique((np.searchsorted(first, own, "right") - 1) * len(names) + k)
            n += np.bincount(pair % len(names), minlength=len(names))
            total += len(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(names.view(np.int64), 0)), pa.array(np.append(n, total)), pa.array([False] * len(names) + [True])], ["word", "n", "all"])

    got = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word long, n long, all boolean").groupBy("word", "all").agg(F.sum("n").alias("n")).collect()  # a row for each word of the templates
    return next((r.n for r in got if r["all"]), 0), {r.word: r.n for r in got if not r["all"]}


def licences(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, license, start, end (bytes), score, a row for each place."""
    index = Index(p, *frequencies(docs, p))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, at in pieces(it, "text"):
            got = list(index.places(data, at))
            ids = b.column(0).to_pylist()
            cols = [pa.array([ids[r] for r, *_ in got], pa.int64()), pa.array([p.templates[k][0] for _, k, *_ in got], pa.string()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.int32()), pa.array([g[4] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "license", "start", "end", "score"])

    src = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, license string, start int, end int, score double")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))
