"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

1. Templates and texts are runs of words (letters and digits; A-Z in lower case). Every ``GRAM`` words in a row are hashed. Of the hashes
   of a template only the smallest in each window of ``WINDOW`` is kept (winnowing), so any run of ``GRAM + WINDOW - 1`` words that
   a text shares with a template holds a kept fingerprint. An inverted index maps a fingerprint to its places in the templates. The
   templates are a fixed list, so the index is small and known; it travels with the tasks.
2. The hashes of a whole text are looked up. Hits of a template are cut into groups, where the text moves on by more than
   the template's length or the place in the template jumps.
   A group's hits lie on neighbouring diagonals (text position - template position).
3. Each group is aligned with its template by local alignment in a band of diagonals around its hits. The matched words, as a share
   of the template's, are the coverage; first and last matched word give the span. Matches of ``COVERAGE`` or more are kept; of
   overlapping ones the one with the highest score stays.

Defined cases: null and empty texts have no matches; rows without id are kept; repeated rows give repeated matches; ties of the score go to
the longer match, then to the template that comes first by name; long texts are read in parts that overlap by more than any template; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm import bytewords
from cleanloom.llm.common import ref

GRAM, WINDOW = 3, 2
BAND = 8
COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1
PART_BYTES, OVERLAP_BYTES = 1 << 20, 1 << 16
MATCHES = "id long, template string, start long, end long, matched int, coverage double, score int"

# Public license notices and texts.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "bsd-3-notice": "Licensed under the BSD 3-Clause License.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "This work is dedicated to the public domain under CC0 1.0.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."),
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software."),
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_BLANK = np.ones(256, bool)
_BLANK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def read_words(data: bytes):
    """(hash, first byte, byte after the last) of all words."""
    codes = np.frombuffer(data, np.uint8)
    first, last = bytewords.edges(codes, _BLANK)
    return bytewords.hashes(bytewords.LOWER[codes], first, last), first, last


def grams(words: np.ndarray) -> np.ndarray:
    """Hashes of every ``GRAM`` words in a row."""
    total = np.zeros(max(0, len(words) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        total = bytewords.mixed(total + words[i:len(words) - GRAM + 1 + i])
    return total


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Positions of the smallest hash of each window (the last of equal ones)."""
    if len(hashes) <= WINDOW:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    return np.unique(np.arange(len(windows)) + WINDOW - 1 - windows[:, ::-1].argmin(axis=1))


class Index:
    """The templates' words and the inverted index of their winnowed fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [read_words(templates[n].encode())[0] for n in self.names]
        if any(len(w) < GRAM for w in self.words):
            raise ValueError(f"a template has fewer than {GRAM} words")
        found = [(int(h), t, int(p)) for t, words in enumerate(self.words) for hashes in [grams(words)]
                 for p in winnowed(hashes) for h in [hashes[p]]]
        found.sort()
        self.keys = np.array([h for h, _, _ in found], np.uint64)
        self.templates, self.places = (np.array([f[i] for f in found], np.int64) for i in (1, 2))
        self.seen = np.zeros(1 << 16, bool)  # most hashes fail here
        self.seen[self.keys >> np.uint64(48)] = True

    def hits(self, hashes: np.ndarray):
        """(position in the text, template, position in the template) of all fingerprints found."""
        at = np.flatnonzero(self.seen[hashes >> np.uint64(48)])
        low = np.searchsorted(self.keys, hashes[at], "left")
        count = np.searchsorted(self.keys, hashes[at], "right") - low
        entry = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at, count), self.templates[entry], self.places[entry]

    def matches(self, words: np.ndarray, coverage: float) -> list[tuple]:
        """(template, first word, word after the last, matched, coverage, score) of the best matches, none overlapping."""
        position, template, place = self.hits(grams(words))
        found = []
        for t in np.unique(template):
            own = template == t
            target, band = self.words[t], min(BAND, len(self.words[t]) // 2)
            for low, high in _bands(position[own], position[own] - place[own], band, len(target)):
                aligned = align(target, words, low - band, high + band)
                if aligned and aligned[2] >= coverage * len(target):
                    first, last, matched, score = aligned
                    found.append((self.names[t], first, last, matched, matched / len(target), score))
        return best(found)


def _bands(position: np.ndarray, diagonal: np.ndarray, band: int, length: int):
    """Lowest and highest diagonal of each group of hits."""
    order = np.lexsort((position, diagonal))
    position, diagonal = position[order], diagonal[order]
    close = np.concatenate([[0], np.cumsum(np.diff(diagonal) > band)])
    order = np.lexsort((position, close))
    position, diagonal, close = position[order], diagonal[order], close[order]
    for group in np.split(diagonal, np.flatnonzero((np.diff(close) > 0) | (np.diff(position) > length)) + 1):
        yield int(group.min()), int(group.max())


def align(template: np.ndarray, words: np.ndarray, low: int, high: int):
    """Local alignment of a template with a text on the diagonals (text position - template position) from low to high.

    Returns (first word, word after the last, matched words, score) of the best alignment.
    """
    width = high - low + 1
    previous, top, end = [(0, 0, -1)] * (width + 2), (0, 0, -1), -1  # (score, matched, first word); neighbours beyond the band stay empty
    empty = (0, 0, -1)
    for i, word in enumerate(template):
        row = [empty] * (width + 2)
        start = max(0, i + low)
        equal = words[start:max(start, i + high + 1)] == word
        for j, same in enumerate(equal.tolist(), start):
            d = j - i - low + 1
            score, matched, first = previous[d]
            cell = (score + MATCH, matched + 1, j if first < 0 else first) if same else (score + MISMATCH, matched, first)
            for score, matched, first in (previous[d + 1], row[d - 1]):  # a template word or a text word is skipped
                if score + GAP > cell[0]:
                    cell = (score + GAP, matched, first)
            if cell[0] <= 0:
                cell = empty
            row[d] = cell
            if cell[0] > top[0]:
                top, end = cell, j + 1
        previous = row
    return (top[2], end, top[1], top[0]) if end >= 0 else None


def best(found: list[tuple]) -> list[tuple]:
    """Of overlapping matches the one with the highest score."""
    kept: list[tuple] = []
    for match in sorted(found, key=lambda m: (-m[5], m[1] - m[2], m[0], m[1])):
        if all(match[2] <= k[1] or match[1] >= k[2] for k in kept):
            kept.append(match)
    return sorted(kept, key=lambda m: m[1])


def _parts(data: bytes):
    """(first byte, bytes): parts of a long text that overlap, so that each template lies whole in one of them."""
    start = 0
    while True:
        end = start + PART_BYTES + OVERLAP_BYTES
        yield start, data[start:end]
        if end >= len(data):
            return
        start += PART_BYTES


def scan_text(index: Index, text: str | None, coverage: float = COVERAGE) -> list[tuple]:
    """Matches of one text with spans in characters."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = []
    for start, part in _parts(data):
        words, first, last = read_words(part)
        found += [(t, start + int(first[a]), start + int(last[b - 1]), m, c, s) for t, a, b, m, c, s in index.matches(words, coverage)]
    decoded = lambda at: len(data[:at].decode("utf-8", "surrogatepass"))
    return [(t, decoded(a), decoded(b), m, c, s) for t, a, b, m, c, s in best(found)]


def _candidates(index: Index, texts: list[str | None]) -> list[int]:
    """Which of some texts hold a fingerprint at all; all are read in one go."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begins = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
    words, first, _ = read_words(b"\n".join(raw))
    at = index.hits(grams(words))[0]
    return sorted(set((np.searchsorted(begins, first[at], side="right") - 1).tolist()))


def _groups(texts: pd.Series):
    """Places of texts that are read together, and of long ones alone."""
    held, size = [], 0
    for i, text in enumerate(texts):
        length = len(text or "")
        if length > PART_BYTES:
            yield [i], True
            continue
        held.append(i)
        size += length
        if size >= PART_BYTES:
            yield held, False
            held, size = [], 0
    if held:
        yield held, False


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id, template, start, end, matched, coverage, score): the license texts found in each document."""
    held = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))  # the fixed list of templates

    def run(batches):
        index = held.value
        for batch in batches:
            texts, rows = batch["text"].tolist(), []
            for places, long in _groups(batch["text"]):
                chosen = places if long else [places[i] for i in _candidates(index, [texts[p] for p in places])]
                rows += [(batch["id"].iloc[p], *match) for p in chosen for match in scan_text(index, texts[p], coverage)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MATCHES.split(", ")]).astype({"id": "Int64"})

    return docs.select(ref(id_col).cast("long").alias("id"), ref(text_col).alias("text")).mapInPandas(run, MATCHES)
