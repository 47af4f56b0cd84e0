"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

The fingerprints of a template are its words, winnowed: of each window of consecutive ones the rarest in the
templates is kept, the least hash among equals. An alignment that reaches the coverage misses m words at most, and so matches
a run of at least need / (m + 1) words of the template, whatever stands between them in the document; windows are
that long, so that such an alignment always has a kept fingerprint. All words of a document are looked up, and
runs that have too few of a template's words for its coverage are left out. The words of a template around
a hit are aligned with it inside a band, and as many disjoint alignments as there are give coverage and span
each. Documents are independent; nothing is shuffled.

Defined results: a null or empty text has no match; a template that occurs several times is reported each time, also
where one copy follows the other; rows of one template do not overlap;
repeated rows are scanned each; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAND, COVERAGE = 6, 0.8
#: Short notices and headers of common licenses (fixed texts).
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_word = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
MEMO = 1 << 20


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word.lower())
        return out


def winnowed(ranks: list, window: int) -> list[int]:
    """Places of the kept fingerprints: the rightmost least rank of every window; all windows of a short text count as one."""
    kept: list[int] = []
    for begin in range(max(1, len(ranks) - window + 1)):
        part = ranks[begin : begin + window]
        if part:
            at = begin + max(k for k, r in enumerate(part) if r == min(part))
            if not kept or kept[-1] != at:
                kept.append(at)
    return kept


class Index:
    def __init__(self, templates: dict[str, str], coverage: float):
        memo = _Hashes()
        words = {name: np.fromiter((memo[w] for w in _word.findall(text)), np.uint64) for name, text in templates.items()}
        need = {name: max(1, math.ceil(coverage * len(w) - 1e-9)) for name, w in words.items()}
        self.words = {name: w for name, w in words.items() if need[name] <= len(w)}
        self.names, self.need = list(self.words), need
        self.hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words.values()]))
        #: how often each template has each word, and which words are its kept fingerprints
        self.counts = np.array([np.bincount(np.searchsorted(self.hashes, w), minlength=len(self.hashes)) for w in self.words.values()]).reshape(len(self.names), len(self.hashes))
        self.kept = np.zeros(self.counts.shape, bool)
        self.least = np.array([need[name] for name in self.names])
        common = dict(zip(self.hashes.tolist(), self.counts.sum(axis=0).tolist(), strict=True))
        for k, (name, w) in enumerate(self.words.items()):
            # len - need words may be missing, so that some run of matched words is as long as this
            window = -(-need[name] // (len(w) - need[name] + 1))
            ranks = [(common[h], h) for h in w.tolist()]
            self.kept[k, np.searchsorted(self.hashes, w[winnowed(ranks, window)])] = True
        #: the inverted index: for each word, the templates that have it as a fingerprint
        self.postings = [np.flatnonzero(self.kept[:, h]) for h in range(len(self.hashes))]
        self.posted = self.kept.any(axis=0)

    def candidates(self, words: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """Template, and places of its words in the document that one or more alignments may use: a run with a fingerprint in it."""
        if not len(words) or not len(self.hashes):
            return
        near = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[near] == words)
        ids = near[places]
        own_words, held = np.unique(ids, return_counts=True)
        marks = own_words[self.posted[own_words]]
        if not len(marks):
            return
        # only templates that a fingerprint of the document is posted for are looked at
        found = np.unique(np.concatenate([self.postings[h] for h in marks]))
        enough = np.minimum(self.counts[np.ix_(found, own_words)], held).sum(axis=1) >= self.least[found]
        for k in found[enough].tolist():
            n, need = len(self.words[self.names[k]]), int(self.least[k])
            own = self.counts[k][ids] > 0
            at, word = places[own], ids[own]
            # two matched words in a row are at most so far apart
            cuts = np.flatnonzero(np.diff(at) > n - need + 1 + BAND) + 1
            for run, of in zip(np.split(at, cuts), np.split(word, cuts), strict=True):
                if len(run) >= need and self.kept[k][of].any() and np.minimum(self.counts[k], np.bincount(of, minlength=len(self.hashes))).sum() >= need:
                    yield self.names[k], run


def _ended(t: np.ndarray, j: np.ndarray, n: int, need: int) -> np.ndarray:
    """t, j: template and document places of pairs of equal words, in the order of j. For each pair, up to the first
    with ``need`` matches: matches of the longest alignment that ends there << 32 | the latest place where such a one begins."""
    key, d = np.zeros(len(j), np.int64), j - t
    low, high = np.searchsorted(j, j - (n - 1 + BAND)), np.searchsorted(j, j)
    for k, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        before = key[a:b][(t[a:b] < t[k]) & (d[a:b] >= d[k] - BAND)]
        key[k] = (before.max() if len(before) else int(j[k])) + (1 << 32)
        if key[k] >> 32 >= need:
            return key[: k + 1]
    return key


def occurrences(template: np.ndarray, words: np.ndarray, places: np.ndarray, need: int) -> list[tuple[int, int, int]]:
    """Matched words, first and last matched place of as many disjoint alignments with ``need`` matches as there are.

    An alignment matches words in the order of both sides; from one match to the next it skips any words of the
    template, and at most BAND words more of the document. Always the one that ends first, and of those the
    one that begins last, is a core; each core then gives way to the alignment with the most matches, of those the shortest
    and of those the first, between the alignment before it and the core after it.
    """
    n = len(template)
    at: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(template.tolist()):
        at[w].append(i)
    pairs = np.array([(i, j) for j in places.tolist() for i in at[int(words[j])]], np.int64).reshape(-1, 2)
    t, j = pairs[:, 0], pairs[:, 1]
    cores, begin = [], 0
    while begin < len(j):
        # no more of the rest than the next core needs, up to a constant factor
        size = 8 * n
        while True:
            key = _ended(t[begin : begin + size], j[begin : begin + size], n, need)
            if key[-1] >> 32 >= need or begin + size >= len(j):
                break
            size *= 4
        if key[-1] >> 32 < need:
            break
        last = j[begin + len(key) - 1]
        stop = int(np.searchsorted(j, last, "right"))
        back = _ended(n - 1 - t[begin:stop][::-1], last - j[begin:stop][::-1], n, need)
        cores.append(int(j[stop - len(back)]))
        begin = stop
    out: list[tuple[int, int, int]] = []
    for k in range(len(cores)):
        a = np.searchsorted(j, out[-1][2], "right") if out else 0
        b = np.searchsorted(j, cores[k + 1]) if k + 1 < len(cores) else len(j)
        key = _ended(t[a:b], j[a:b], n, n + 1)
        most = np.flatnonzero(key >> 32 == (key >> 32).max())
        first = key[most] & 0xFFFFFFFF
        best = int(np.argmin(j[a:b][most] - first))
        out.append((int(key[most[best]] >> 32), int(first[best]), int(j[a:b][most[best]])))
    return out


RESULT = "doc_id long, license string, coverage double, start long, end long, matched long"


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for each place where a template is matched by at least ``coverage`` of its words; places in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = Index(shared.value, coverage), _Hashes()
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            out: dict[str, list] = {c: [] for c in names}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _word.findall(text or "")
                words = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
                spots: list[re.Match] = []
                for name, run in index.candidates(words):
                    template = index.words[name]
                    for hit in occurrences(template, words, run, index.need[name]):
                        spots = spots or list(_word.finditer(text))
                        row = (doc, name, round(hit[0] / len(template), 6), spots[hit[1]].start(), spots[hit[2]].end(), hit[0])
                        for c, v in zip(names, row, strict=True):
                            out[c].append(v)
            kinds = {"license": pa.string(), "coverage": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds.get(c, pa.int64())) for c in names], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)
