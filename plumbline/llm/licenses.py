"""Licence scans: where a text holds a licence's words, in full or nearly.

Templates' k-grams of words are winnowed: of each window of neighbouring hashes the smallest stays. An inverted
index from hash to (template, place) finds where a text may hold a template; hits on nearby diagonals make
one candidate. A banded alignment of the template with the words around it then gives the share of the
template's words found in order, and the span in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._words import PUNCTUATION, pair, texts, words

#: Words of a k-gram, hashes of a window, half the band's width, share of a template's words that must be found.
GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8

#: Public licence texts and notices.
TEMPLATES = {
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "MIT-statement": "Released under the MIT License.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
}


def _hashes(w: np.ndarray, gram: int) -> np.ndarray:
    h = w[: max(0, len(w) - gram + 1)]
    for k in range(1, gram):
        h = pair(h, w[k : k + len(h)])
    return h


def winnowed(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window, the rightmost of equal ones; all are one window if there are fewer."""
    if not len(h):
        return np.zeros(0, np.int64)
    window = min(window, len(h))
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


def gram_and_window(n: int, coverage: float, gram: int, window: int) -> tuple[int, int]:
    """Words of a k-gram and hashes of a window for a template of ``n`` words.

    A text that lacks or changes up to (1 - coverage) of the words leaves a run of some length; winnowing keeps a k-gram of
    each run of k + window - 1 words, so both are made small enough for that.
    """
    lost = int((1 - coverage) * n + 1e-9)
    run = max(1, -(-(n - lost) // (lost + 1)))
    gram = min(gram, run)
    return gram, max(1, min(window, run - gram + 1))


class Index:
    """Inverted index of templates' winnowed hashes: for each length of k-grams sorted hashes, with templates and places."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, gram: int = GRAM, window: int = WINDOW):
        self.names, self.words = list(templates), []
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for k, text in enumerate(templates.values()):
            w = words(text.encode(), PUNCTUATION)[0]
            if not len(w):
                raise ValueError(f"template {self.names[k]} has no words")
            self.words.append(w)
            size, span = gram_and_window(len(w), coverage, gram, window)
            h = _hashes(w, size)
            entries.setdefault(size, []).extend((int(h[p]), k, int(p)) for p in winnowed(h, span))
        self.tables = []
        for size, rows in sorted(entries.items()):
            h, template, place = zip(*sorted(rows), strict=True)
            self.tables.append((size, np.array(h, np.uint64), np.array(template, np.int64), np.array(place, np.int64)))

    def band(self, template: int, most: int) -> int:
        """Short templates have narrow bands, so that neighbouring copies stay apart."""
        return max(1, min(most, len(self.words[template]) // 4))

    def candidates(self, w: np.ndarray, band: int = BAND) -> list[tuple[int, int]]:
        """(template, diagonal): where in the text's words the template's first word would be."""
        hits: set[tuple[int, int]] = set()
        for size, known, template, place in self.tables:
            h = _hashes(w, size)
            low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            at = np.flatnonzero(high > low)
            n = high[at] - low[at]
            entry = np.repeat(low[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hits.update(zip(template[entry].tolist(), (np.repeat(at, n) - place[entry]).tolist(), strict=True))
        out: list[tuple[int, int]] = []
        for k, d in sorted(hits):
            if not out or out[-1][0] != k or d - out[-1][1] > self.band(k, band):
                out.append((k, d))
        return out


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(words matched in order, first word, end) of the best alignment within ``band`` of the diagonal.

    Of alignments that match most words, one of the shortest spans. Words of the text may be skipped, and
    words of the template.
    """
    width = 2 * band + 1
    none = (0, 0, 0)  # matches, minus the span, first word
    row: list[tuple[int, int, int]] = [none] * (width + 1)
    for i, t in enumerate(template.tolist()):
        new = [none] * (width + 1)
        for j in range(width):
            at = diagonal + i + j - band
            best = max(row[j + 1], new[j - 1] if j else none)
            if 0 <= at < len(text) and int(text[at]) == t:
                m, _, first = row[j]
                best = max(best, (m + 1, -(at + 1 - first), first) if m else (1, -1, at))
            new[j] = best
        row = new
    matched, span, first = max(row)
    return matched, first, first - span


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, gram: int = GRAM, window: int = WINDOW, band: int = BAND) -> DataFrame:
    """(doc_id, license, coverage, matched, start, end): one row for each place where a text holds a template.

    ``start`` and ``end`` count code points of the text; ``coverage`` is the share of the template's words, of
    letters and digits, A-Z lower-cased, that is matched in order within the band. Matches of a template that
    overlap are one, the best. Null and empty texts have none. Whole texts; rows with null or repeated ids are scanned
    each for itself; other columns are left aside.
    """
    templates = TEMPLATES if templates is None else templates
    kind = "doc_id long, license string, coverage double, matched long, start long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, coverage, gram, window)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                w, first, last = words(text, PUNCTUATION)
                found = []
                for k, diagonal in index.candidates(w, band):
                    own = index.band(k, band)
                    matched, a, z = align(index.words[k], w, diagonal + own // 2, own)
                    share = matched / len(index.words[k])
                    if share >= coverage:
                        found.append((k, -share, a, z, matched))
                kept: list[tuple] = []
                for x in sorted(found):
                    if not any(x[0] == y[0] and x[2] < y[3] and y[2] < x[3] for y in kept):
                        kept.append(x)
                for k, share, a, z, matched in kept:
                    start = len(text[: first[a]].decode("utf-8", "replace"))
                    rows.append((key, index.names[k], -share, matched, start, start + len(text[first[a] : last[z - 1]].decode("utf-8", "replace"))))
            names = [x.split()[0] for x in kind.split(", ")]
            kinds = pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, kind)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
