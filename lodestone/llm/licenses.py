"""Licence texts in documents: winnowed fingerprints find candidates, banded alignment measures them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import NOT_WORD, Words, chunks, fold, freed, grams, table

#: Fingerprints: hashes of GRAM words, the least of each WINNOW in a row. Any GRAM + WINNOW - 1 words in common share one.
GRAM, WINNOW = 3, 2
#: Half the width of the band: how many words may be missing or added up to any place.
BAND = 12
#: The least matched share of a template that is reported, and its least number of matched words.
COVERAGE, LEAST = 0.75, 4
#: The templates' words together, for the index to be broadcast.
MOST_WORDS = 1_000_000
#: Words to a cell by which overlapping places are looked up.
CELL = 64

# Notices by which public licences are applied, as published with them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-line": "Released under the MIT License.",
    "mit-line-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


@dataclass
class Index:
    """Sorted fingerprints with the template and word place of each, and the templates' word hashes."""

    names: list[str]
    words: list[np.ndarray]
    hashes: np.ndarray
    template: np.ndarray
    place: np.ndarray


def winnow(w: Words) -> np.ndarray:
    """Places of the fingerprints: of each WINNOW word runs in a row in one text the last with the least hash, and the
    run of a text that has fewer."""
    g = grams(w.h, GRAM, 11)
    whole = w.doc[: len(g)] == w.doc[GRAM - 1 :] if len(g) else np.zeros(0, bool)
    pick = np.zeros(len(g), bool)
    if len(g) > 1:
        pair = whole[1:] & whole[:-1] & (w.doc[1 : len(g)] == w.doc[: len(g) - 1])
        later = g[1:] <= g[:-1]
        pick[1:] |= pair & later
        pick[:-1] |= pair & ~later
        lone = whole.copy()
        lone[1:] &= ~pair
        lone[:-1] &= ~pair
        pick |= lone
    else:
        pick |= whole
    return np.flatnonzero(pick)


def words_of(texts: pa.Array):
    for a, _, data, offsets in chunks(texts):
        yield a, offsets, Words(fold(data), offsets, NOT_WORD)


def build_index(templates: dict[str, str]) -> Index:
    """An index of templates; those with fewer than GRAM words have no fingerprint and are never found."""
    names = sorted(templates)
    words, hashes, template, place = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, name in enumerate(names):
        ((_, _, w),) = list(words_of(pa.array([templates[name]], pa.string())))
        at = winnow(w)
        words.append(w.h)
        hashes.append(grams(w.h, GRAM, 11)[at])
        template.append(np.full(len(at), i))
        place.append(at)
    if sum(map(len, words)) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words; search for them in parts")
    h, t, p = np.concatenate(hashes), np.concatenate(template), np.concatenate(place)
    order = np.argsort(h, kind="stable")
    return Index(names, words, h[order], t[order], p[order])


def align(template: np.ndarray, text: np.ndarray, diagonal: int, low: int = 0, high: int | None = None) -> tuple[int, int, int]:
    """(matched words, first, end): the best alignment of the template to a stretch of the text, word i of the template
    to word i + diagonal give or take BAND, within text[low:high]; among those with most matches the one with the
    fewest text words, then the earliest."""
    high = len(text) if high is None else high
    size = len(template)
    if low <= diagonal and diagonal + size <= high and (text[diagonal : diagonal + size] == template).all():
        return size, diagonal, diagonal + size
    width = 2 * BAND + 1
    zero = (0, 0, 0)  # matches, first, end; of as many matches the later first leaves the shorter span
    row = [zero] * width
    base = max(0, diagonal - BAND)
    near = text[base : diagonal + size + BAND].tolist()
    for i, x in enumerate(template.tolist()):
        now = [zero] * width
        for k in range(width):
            j = i + diagonal + k - BAND
            best = row[k + 1] if k + 1 < width else zero  # the template's word is missing
            if k and now[k - 1] > best:  # a word of the text is extra
                best = now[k - 1]
            if low <= j < high and near[j - base] == x:
                n, first, _ = row[k]
                met = (n + 1, first if n else j, j + 1)
                if met > best:
                    best = met
            now[k] = best
        row = now
    return max(row, key=lambda f: (f[0], f[1] - f[2], -f[1]))


def places(template: np.ndarray, text: np.ndarray, at: list[int], diagonal: list[int]) -> list[tuple[int, int, int]]:
    """(matched words, first, end) of every place of the template that a fingerprint hit anchors.

    Hits (text places in order, diagonals) are gone through from the left; a place that is found parts the text, and
    what lies to either side of it is searched on, so places next to each other are all found. A hit is aligned once in
    each part it is the first of, so work follows the hits."""
    out, parts = [], [(0, len(text), 0, len(at))]
    while parts:
        low, high, i, j = parts.pop()
        while i < j:
            n, first, end = align(template, text, diagonal[i], low, high)
            if n >= LEAST and n >= COVERAGE * len(template):
                out.append((n, first, end))
                if (k := bisect_right(at, first - GRAM, i, j)) > i:
                    parts.append((low, first, i, k))
                low, i = end, bisect_left(at, end, i, j)
            else:
                i += 1
    return out


def scan_words(w: Words, index: Index):
    """(text index, template, matched words, first, end) of every template found, by text, then place."""
    at = winnow(w)
    g = grams(w.h, GRAM, 11)[at]
    lo = np.searchsorted(index.hashes, g)
    hit = lo < len(index.hashes)
    hit[hit] = index.hashes[lo[hit]] == g[hit]
    groups: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    for p, a, h in zip(at[hit].tolist(), lo[hit].tolist(), g[hit], strict=True):
        doc = int(w.doc[p])
        p -= int(w.first[doc])
        while a < len(index.hashes) and index.hashes[a] == h:
            ats, diagonals = groups.setdefault((doc, int(index.template[a])), ([], []))
            ats.append(p)
            diagonals.append(p - int(index.place[a]))
            a += 1
    found = []
    for (doc, t), (ats, diagonals) in groups.items():
        text = w.h[w.first[doc] : w.first[doc + 1]]
        found += [(doc, t, *f) for f in places(index.words[t], text, ats, diagonals)]
    share = lambda f: f[2] / len(index.words[f[1]])
    kept: list[tuple] = []
    near: dict[tuple[int, int], list[tuple]] = defaultdict(list)  # kept places of each text by the cells they touch
    for f in sorted(found, key=lambda f: (f[0], -f[2], -share(f), f[3], f[1])):
        # f gives way where it overlaps what matches as many words or more, and no smaller share of its template
        cells = [(f[0], c) for c in range(f[3] // CELL, (f[4] - 1) // CELL + 1)]
        if not any(f[3] < k[4] and k[3] < f[4] and share(k) >= share(f) for c in cells for k in near[c]):
            kept.append(f)
            for c in cells:
                near[c].append(f)
    return sorted(kept, key=lambda f: (f[0], f[3], f[1]))


FOUND = "id long, license string, matched_words int, coverage double, first_word long, end_word long, start_byte long, end_byte long"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each place of each row of docs that has COVERAGE of a template: the template's name, how many of its
    words match in order and their share, and the place in words and in bytes of UTF-8.

    Words are what punctuation leaves, in small letters. Every word run of every text is winnowed; the templates'
    index is small and goes to all workers, so no row moves. Where places overlap, a template gives way to another one
    that matches as many words or more and no smaller share of itself.

    Null and empty texts give no row; repeated rows give theirs each, null ids stay null. Other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_index(templates))

    def run(batches):
        index = shared.value
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for a, offsets, w in words_of(b.column(1)):
                for doc, t, n, first, end in scan_words(w, index):
                    base, o = int(w.first[doc]), int(offsets[doc])
                    values = a + doc, index.names[t], n, n / len(index.words[t]), first, end, int(w.starts[base + first]) - o, int(w.ends[base + end - 1]) - o
                    for col, x in zip(out, values, strict=True):
                        col.append(x)
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            cols = [pa.array(c, k) for c, k in zip(out[1:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(out[0], pa.int64())), *cols], names=["id", "license", "matched_words", "coverage", "first_word", "end_word", "start_byte", "end_byte"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(freed(run), FOUND)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")
