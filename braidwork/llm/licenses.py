"""License scans with a positional index of rare words.

Each licence notice is a template of words. The inverse document frequency of every template word is counted over the whole corpus;
the index holds, with their positions, the RARE words of each template with the highest IDF. A file's words are looked
up in the index; every hit votes for where the notice would begin (position in the file minus position in the template).
Where enough different rare words agree, the first mandatory key phrase of the licence has to be there, word for word; around each place
where it stands, up to SLOP words of drift, the other key phrases and enough different rare words have to be in their places too; only then
is a notice reported.
"""

from __future__ import annotations

import math
from bisect import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import Words, column, hash_word, map_chunks, split_words


@dataclass(frozen=True)
class Template:
    """A notice; key phrases have to stand in it."""

    license: str
    text: str
    phrases: tuple[str, ...]


TEMPLATES = (
    Template("MIT", "Released under the MIT License.", ("MIT License",)),
    Template("MIT", "Licensed under the MIT license", ("MIT license",)),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("Permission is hereby granted free of charge", "associated documentation files")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License", "Version 2.0")),
    Template("GPL-3.0", "licensed under the GNU General Public License, version 3", ("GNU General Public License", "version 3")),
    Template("GPL-2.0", "licensed under the GNU General Public License, version 2", ("GNU General Public License", "version 2")),
    Template("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3", ("GNU Lesser General Public License", "version 3")),
    Template("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3", ("GNU Affero General Public License", "version 3")),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("CC BY-NC 4.0",)),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("CC BY-SA 4.0",)),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0", ("CC BY 4.0",)),
    Template("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution 4.0",)),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License", "v 2.0")),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("Redistribution and use in source and binary forms", "with or without modification")),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    *(Template(s, f"SPDX-License-Identifier: {s}", (f"License-Identifier {s}",)) for s in ("MIT", "Apache-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "ISC", "CC-BY-4.0", "CC-BY-NC-4.0")),
)
#: Rare words of each template that the index holds, and the share of them that has to agree on a place.
RARE = 4
AGREE = 0.5
#: Words that may be missing or added between the beginning of a notice and any of its words.
SLOP = 2


def _hashes(text: str) -> np.ndarray:
    return split_words(pa.array([text])).hash


def document_frequency(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[int, int]]:
    """Documents with a text, and in how many of them each template word is. As many numbers as templates have words."""
    vocabulary = np.unique(np.concatenate([_hashes(t.text) for t in templates]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = split_words(column(batch, "text"))
        at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
        hit = vocabulary[at] == w.hash
        pairs = np.unique(w.doc[hit].astype(np.int64) * len(vocabulary) + at[hit])
        n = np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        words = np.append(vocabulary.view(np.int64), 0)
        return pa.RecordBatch.from_arrays([pa.array(np.append(np.zeros(len(vocabulary), bool), True)), pa.array(words), pa.array(np.append(n, w.n).astype(np.int64))], names=["total", "word", "n"])

    counted = map_chunks(docs.select("text").where("text is not null"), "text", run, "total boolean, word long, n long").groupBy("total", "word").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in counted if r.total)
    return total, {int(np.int64(r.word).view(np.uint64)): r.n for r in counted if not r.total}


class Index:
    """The postings of rare words, and the words and key phrases of the templates."""

    def __init__(self, templates: tuple[Template, ...], total: int, df: dict[int, int]) -> None:
        self.templates = templates
        self.words = [_hashes(t.text) for t in templates]
        self.phrases = []
        postings: list[tuple[int, int, int]] = []
        self.need = np.zeros(len(templates), dtype=np.int64)
        for k, (template, words) in enumerate(zip(templates, self.words)):
            idf = {int(h): math.log((total + 1) / (df.get(int(h), 0) + 1)) for h in words}
            rare = sorted(idf, key=lambda h: (-idf[h], h))[:RARE]
            postings += [(int(h), k, p) for p, h in enumerate(words) if int(h) in rare]
            self.need[k] = max(1, math.ceil(AGREE * len(rare)))
            places = []
            for phrase in template.phrases:
                ph = _hashes(phrase)
                at = [p for p in range(len(words) - len(ph) + 1) if (words[p : p + len(ph)] == ph).all()]
                if not at:
                    raise ValueError(f"{phrase!r} is not in the template {template.text!r}")
                places.append((at[0], ph))
            self.phrases.append(places)
        postings.sort()
        self.key = np.array([p[0] for p in postings], dtype=np.uint64)
        self.template = np.array([p[1] for p in postings], dtype=np.int64)
        self.place = np.array([p[2] for p in postings], dtype=np.int64)
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[(self.key & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, w: Words) -> list[tuple[int, int, int, int]]:
        """(document, template, first word, matching words) of each notice in a chunk."""
        maybe = np.flatnonzero(self.bits[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
        lo, hi = np.searchsorted(self.key, w.hash[maybe], "left"), np.searchsorted(self.key, w.hash[maybe], "right")
        count = hi - lo
        at = np.repeat(maybe, count)
        post = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        template, begin = self.template[post], at - self.place[post]
        by = np.lexsort((at, begin, template, w.doc[at]))
        doc, template, begin, word = w.doc[at][by], template[by], begin[by], w.hash[at][by]
        found = []
        # beginnings at most SLOP apart are one candidate region
        new = np.ones(len(by), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (template[1:] != template[:-1]) | (begin[1:] - begin[:-1] > SLOP)
        edges = np.append(np.flatnonzero(new), len(by))
        enough = np.diff(edges) >= self.need[template[edges[:-1]]]
        for i in np.flatnonzero(enough):
            a, b = edges[i], edges[i + 1]
            k, d = int(template[a]), int(doc[a])
            if len(set(word[a:b].tolist())) >= self.need[k]:
                found += [(d, k, *hit) for hit in self._verify(w, d, k, begin[a:b], word[a:b])]
        return found

    def _spots(self, w: Words, phrase: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Words from lo to hi (inclusive) at which the phrase stands."""
        at = np.arange(lo, hi + 1)
        for j, h in enumerate(phrase):
            at = at[w.hash[at + j] == h]
        return at

    def _verify(self, w: Words, doc: int, k: int, begins: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
        """Where notices begin in a region of agreeing beginnings (sorted), and how many template words are in reach of each."""
        first, last = int(w.first[doc]), int(w.first[doc + 1])
        out = []
        place, phrase = self.phrases[k][0]
        for spot in self._spots(w, phrase, max(first, int(begins[0]) - SLOP + place), min(last - len(phrase), int(begins[-1]) + SLOP + place)):
            start = int(spot) - place
            lo, hi = np.searchsorted(begins, [start - SLOP, start + SLOP + 1])
            if len(set(words[lo:hi].tolist())) < self.need[k]:
                continue
            earliest = start
            for other, ph in self.phrases[k][1:]:
                spots = self._spots(w, ph, max(first, start - SLOP + other), min(last - len(ph), start + SLOP + other))
                if not len(spots):
                    break
                earliest = min(earliest, int(spots[0]) - other)
            else:
                begin = max(first, earliest)
                near = {int(h) for h in w.hash[begin : min(last, begin + len(self.words[k]) + SLOP)]}
                out.append((begin - first, sum(int(h) in near for h in self.words[k])))
        return out


def scan(docs: DataFrame, *, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, license, word, coverage, notice) of each licence notice of each row; word counts from 0.

    coverage is the share of the template's words that are there. Templates that agree on the licence and overlap give one
    row, the one with the greatest coverage, of equals the first, of these the longest. Repeated rows give repeated results; a null doc_id stays null; null and empty texts have none.
    Only doc_id and text are read. An empty table gives no rows. Texts are read twice: to count the
    document frequencies, and to look the words up.
    """
    total, df = document_frequency(docs, templates)
    index = Index(templates, total, df)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = split_words(column(batch, "text"))
        best: list[tuple[int, str, int, float, int]] = []
        taken: dict[tuple[int, str], list[tuple[int, int]]] = {}  # (begin, end) of the accepted ones, sorted, without overlap
        ranked = [(d, templates[k].license, at, n / len(index.words[k]), len(index.words[k])) for d, k, at, n in index.find(w)]
        for d, name, at, cover, size in sorted(ranked, key=lambda r: (r[0], r[1], -r[3], r[2], -r[4])):
            own = taken.setdefault((d, name), [])
            place = bisect(own, (at, at))
            if not (place and own[place - 1][1] > at) and not (place < len(own) and own[place][0] < at + size):
                own.insert(place, (at, at + size))
                best.append((d, name, at, cover, size))
        if not best:
            return None
        texts = [w.text(int(w.first[d]) + at, min(int(w.first[d]) + at + size, int(w.first[d + 1]))) for d, _, at, _, size in best]
        ids = column(batch, "doc_id").cast(pa.int64()).take(pa.array([b[0] for b in best]))
        arrays = [ids, pa.array([b[1] for b in best]), pa.array([b[2] for b in best], pa.int64()), pa.array([round(b[3], 6) for b in best]), pa.array(texts)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "license", "word", "coverage", "notice"])

    return map_chunks(docs.select("doc_id", "text"), "text", run, "doc_id long, license string, word long, coverage double, notice string")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_licenses": op4_licenses}
#: None: votes of word positions with drift aren't SQL that would finish. Tested against a scan of every position.
ORACLE_SQL: dict[str, str] = {}
