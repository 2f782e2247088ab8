"""Licence notices in texts: MinHash bands over overlapping windows find templates, exact containment decides.

1. A template is the set of its 5-word shingles. Templates of similar length share a stride, the longest one's words, and a
   window of three strides that starts at every stride: any stretch of twice a template's words lies in one window.
2. A stretch that holds 0.75 of a template's shingles gives its window a known least similarity to the template. As many bands of
   one minimum are taken as let such a window miss all of them with a chance of ``MISS`` at most.
3. Templates of up to ``SHORT`` shingles are far smaller than any window; all their shingles serve as their signature.
4. A text is compared with the templates that its windows found, at every place, by exact shingle containment.

Templates are few and fixed, so all work is one pass without a shuffle; a text's windows are the rows of numpy arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from propensia.llm.tokens import grams, words, blocks
from propensia.llm.winnowing import stream

SHINGLE = 5
LEAST = 0.75
#: templates of so few shingles are looked up by all of them
SHORT = 8
#: chance that a window with a stretch at ``LEAST`` shares no band with its template
MISS = 1e-6
#: templates share windows down to this share of the longest one's words
ALIKE = 0.8
SECTIONS = 3

# fixed values: the wording of common licence notices
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}


class Template(NamedTuple):
    name: str
    words: int
    shingles: np.ndarray


def templates(notices: dict[str, str]) -> list[Template]:
    """Shingles (of five words; the whole text if it has fewer); notices without words are left out."""
    out = []
    for name, text in sorted(notices.items()):
        (block,) = blocks(pa.array([text]))
        w = words(block, "alnum")
        m = len(w.hashes)
        if m:
            shingles = np.unique(grams(w.hashes, min(SHINGLE, m)))
            out.append(Template(name, m, shingles))
    return out


def best(at: np.ndarray, which: np.ndarray, t: Template) -> tuple[float, int, int]:
    """Most of the template in any 2m words, where it starts, and how many such stretches (apart) reach ``LEAST``.

    ``at`` are the sorted places of the template's shingles in a text, ``which`` the shingles' numbers.
    """
    span = 2 * t.words - min(SHINGLE, t.words) + 1
    most, start, found, free = 0, -1, 0, 0
    for i, p in enumerate(at.tolist()):
        n = len(np.unique(which[i : np.searchsorted(at, p + span)]))
        if n > most:
            most, start = n, p
        if p >= free and n >= LEAST * len(t.shingles):
            found, free = found + 1, p + t.words
    return most / len(t.shingles), start, found


class Lookup(NamedTuple):
    """Sorted values and the template each belongs to; a value may be there for several templates."""

    values: np.ndarray
    owners: np.ndarray

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``asked`` of known values, each with the number of every template that has it."""
        low = np.searchsorted(self.values, asked)
        at = np.flatnonzero(self.values[np.minimum(low, len(self.values) - 1)] == asked)
        low = low[at]
        count = np.searchsorted(self.values, asked[at], "right") - low
        entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(at, count), self.owners[entry]


def lookup(parts: list[tuple[int, np.ndarray]]) -> Lookup:
    values = np.concatenate([v for _, v in parts])
    owners = np.repeat([n for n, _ in parts], [len(v) for _, v in parts])
    order = np.argsort(values, kind="stable")
    return Lookup(values[order], owners[order])


class Windows(NamedTuple):
    """Windows of ``SECTIONS`` strides, and per band the templates' minima."""

    stride: int
    bands: list[Lookup]


def bands_needed(stride: int, shingles: int) -> int:
    """Bands of one minimum that a window with ``LEAST`` of a template's shingles misses with a chance of ``MISS`` at most."""
    held = math.ceil(LEAST * shingles)
    similarity = held / (SECTIONS * stride + shingles - held)
    return math.ceil(math.log(MISS) / math.log(1 - similarity))


def universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of n hash functions a*x + b mod 2**64."""
    draw = np.random.Generator(np.random.PCG64(2718))
    factors = draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, draw.integers(0, 2**63, n, dtype=np.uint64)


def windows_of(wanted: list[Template]) -> tuple[list[Windows], np.ndarray, np.ndarray]:
    """Templates of more than ``SHORT`` shingles by length, with the hash functions of their bands."""
    left = sorted((n for n, t in enumerate(wanted) if len(t.shingles) > SHORT), key=lambda n: -wanted[n].words)
    groups = []
    while left:
        stride = wanted[left[0]].words
        mine = [n for n in left if wanted[n].words >= ALIKE * stride]
        left = left[len(mine):]
        groups.append((stride, mine, max(bands_needed(stride, len(wanted[n].shingles)) for n in mine)))
    factors, shifts = universal(max((n for _, _, n in groups), default=0))

    def band(mine: list[int], h: int) -> Lookup:
        return lookup([(n, np.array([(wanted[n].shingles * factors[h] + shifts[h]).min()])) for n in mine])

    return [Windows(stride, [band(mine, h) for h in range(n)]) for stride, mine, n in groups], factors, shifts


class Sections(NamedTuple):
    """Strides of a block's rows: where to cut its shingles, which cuts begin a stride, and each stride's row."""

    cuts: np.ndarray
    begins: np.ndarray
    row: np.ndarray

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash of the window that starts at each stride; windows end with their row."""
        least = np.minimum.reduceat(hashes, self.cuts)[self.begins]
        out = least.copy()
        for d in range(1, SECTIONS):
            np.minimum(out[:-d], least[d:], out=out[:-d], where=self.row[d:] == self.row[:-d])
        return out


def sections(base: np.ndarray, count: np.ndarray, stride: int) -> Sections:
    """``base`` and ``count``: each row's first shingle and how many it has."""
    rows = np.flatnonzero(count > 0)
    n = -(-count[rows] // stride)
    row = np.repeat(rows, n)
    starts = base[row] + stride * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    cuts = np.concatenate([starts, base[rows] + count[rows]])  # what follows a row's end holds words of two rows
    order = np.argsort(cuts)
    return Sections(cuts[order], order < len(starts), row)


def _scan(wanted: list[Template]):
    groups, factors, shifts = windows_of(wanted)
    sizes = sorted({min(SHINGLE, t.words) for t in wanted})
    short = {k: [(n, t.shingles) for n, t in enumerate(wanted) if len(t.shingles) <= SHORT and min(SHINGLE, t.words) == k] for k in sizes}
    tables = {k: lookup(parts) for k, parts in short.items() if parts}

    def candidates(g: dict[int, np.ndarray], base: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
        """(row, template) pairs that share a band, or a shingle of a short template."""
        found = []
        for k, table in tables.items():
            at, owner = table.find(g[k])
            found.append((np.searchsorted(base, at, "right") - 1, owner))
        count = lengths - SHINGLE + 1
        if groups and (count > 0).any():
            cut = [sections(base, count, w.stride) for w in groups]
            hashes = np.empty_like(g[SHINGLE])
            for h in range(len(factors)):
                np.multiply(g[SHINGLE], factors[h], out=hashes)
                hashes += shifts[h]
                for w, s in zip(groups, cut):
                    if h < len(w.bands):
                        at, owner = w.bands[h].find(s.minima(hashes))
                        found.append((s.row[at], owner))
        pairs = np.unique(np.concatenate([r * len(wanted) + o for r, o in found])) if found else []
        return [divmod(int(p), len(wanted)) for p in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                w = words(block, "alnum")
                s = stream(w, 0x11CE)
                lengths = np.diff(w.bounds)
                base = w.bounds[:-1] + np.arange(block.rows) + 1
                g = {k: grams(s, k) for k in sizes}
                rows = []
                for r, n in candidates(g, base, lengths):
                    t = wanted[n]
                    k = min(SHINGLE, t.words)
                    mine = g[k][base[r] : base[r] + max(0, lengths[r] - k + 1)]
                    number = np.searchsorted(t.shingles, mine)
                    at = np.flatnonzero(t.shingles[np.minimum(number, len(t.shingles) - 1)] == mine)
                    if len(at) >= LEAST * len(t.shingles):
                        share, start, found = best(at, number[at], t)
                        if share >= LEAST:
                            rows.append((block.first + r, t.name, share, int(start), found))
                if rows:
                    row, *rest = zip(*rows)
                    ids = batch.column("id").take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in rest]], ["id", "license", "containment", "start_word", "n_found"])

    return run


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices found in each text.

    Returns the id, license, containment (the largest share of the template's shingles in any stretch of twice its
    words; 0.75 at least), start_word of the first such stretch and n_found (stretches apart). Lower-cases A-Z;
    words are runs of letters, digits and everything beyond ASCII.

    A stretch is missed with a chance of ``MISS`` at most. Null and empty texts have no notice. Repeated rows and rows without an id are reported like others. No rows or no
    notices give no rows. Other columns are ignored. Memory per task: one text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_scan(templates(notices)), f"id {kind}, license string, containment double, start_word long, n_found long")
    return found.withColumnRenamed("id", id_col)
