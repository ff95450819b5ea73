"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Templates are grouped into classes whose windows hold 1, 2, 4, .. shingles.  All windows of a template are banded, and
all windows of a text that start at a stride of a quarter of their length.  A template's class follows from how far a
text may depart from it and still be accepted (``intact_run``): the longest run of shingles that no alteration touches
holds a whole window, which is equal on both sides and so collides in every band for certain.  The bands, set by
``bands_for``, are for templates that repeat themselves, of which one altered word may count less than its places.
Candidates are verified on the full shingle sets at their place.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes_np import BYTE_CODES, WORD_BYTES, Spans, ascii_lower, mix64, pieces, text_bytes, words
from .common import column
from .neardup import permute32

#: License texts and the notices that licenses ask for or that name them, by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": [
        "GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "ARR": ["All rights reserved."],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": [
        "SPDX-License-Identifier: BSD-3-Clause",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": [
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}
#: A template held in a text: its first and last place, shingles in common, their share of the template's, and license.
Match = tuple[int, int, int, float, str]
ROWS = 2
#: Bits of the table that tells which bands no template has.
FILTER = 16


def bands_for(similarity: float, probability: float, rows: int = ROWS) -> int:
    """The bands of ``rows`` coordinates that make sets of this similarity collide with this probability."""
    return math.ceil(math.log(1 - probability) / math.log(1 - similarity**rows))


def intact_run(n: int, least: float, k: int) -> int:
    """Shingles that stand together untouched in any text that holds ``least`` of a template's ``n`` shingles.

    Of those that are missing, a break between two runs takes k - 1 at least (a word put in between; other changes take
    more), so there are no more than missing // (k - 1) breaks, and one run more than breaks.
    """
    missing = n - math.ceil(least * n - 1e-9)
    breaks = missing // max(1, k - 1)
    return max(1, -(-(n - missing) // (breaks + 1)))


def read_templates(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Templates from a folder of license texts named by SPDX identifier, NAME.txt; a few hundred whole texts."""
    found = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("name"), "value")
    return {r["name"]: [r["value"]] for r in found.where("name <> ''").orderBy("name").collect()}


def shingles(words_: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words from each word on; fewer words give none."""
    with np.errstate(over="ignore"):
        n = max(0, len(words_) - k + 1)
        out = np.full(n, np.uint64(k))
        for i in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words_[i : i + n])
        return out


def text_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows: the hashes of all words, and each row's first word (one number more than rows)."""
    codes, letters = BYTE_CODES[ascii_lower()], WORD_BYTES.copy()
    letters[65:91] = True
    data, offsets = text_bytes(column)
    for i, j in pieces(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, first = words(part, offsets[i : j + 1] - offsets[i], letters)
        yield Spans(codes[part])(starts, ends), first


class Index:
    """Banded windows of the templates, by class and band."""

    def __init__(self, templates: dict[str, list[str]], k: int, bands: int, least: float):
        self.k, self.bands = k, bands
        self.names, self.sets, self.first = [], [], []
        self.table: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = {}
        for name, texts in templates.items():
            for text in texts:
                ((w, _),) = text_words(pa.array([text]))
                s = shingles(w, k)
                if not len(s):
                    raise ValueError(f"a template of {name} has fewer than {k} words")
                t = len(self.names)
                self.names.append(name)
                self.sets.append(np.unique(s))
                self.first.append(len(s))
                size = self.window(intact_run(len(s), least, k))
                minima = self.minima(s, size)
                for band in range(bands):
                    for at, key in enumerate(self.keys(minima, band).tolist()):
                        self.table.setdefault((size, band), {}).setdefault(key, []).append((t, at))
        self.sizes = sorted({c for c, _ in self.table})
        self.filters = {}
        for place, keys in self.table.items():
            hit = np.zeros(1 << FILTER, bool)
            hit[[x & ((1 << FILTER) - 1) for x in keys]] = True
            self.filters[place] = hit

    @staticmethod
    def stride(size: int) -> int:
        return max(1, size // 4)

    def window(self, n: int) -> int:
        """The largest window, a power of two, that a run of n shingles holds wherever the strides fall."""
        size = 1
        while 2 * size + self.stride(2 * size) - 1 <= n:
            size *= 2
        return size

    def coordinates(self, s: np.ndarray) -> np.ndarray:
        """Circulant MinHash values of each shingle, coordinates x shingles."""
        low = (mix64(s) >> np.uint64(32)).astype(np.uint32)
        shift = (np.arange(1, self.bands * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B1)).astype(np.uint32)[:, None]
        out = low[None, :] + shift
        return permute32(out, np.empty_like(out))

    def minima(self, s: np.ndarray, size: int) -> np.ndarray:
        v, c = self.coordinates(s), 1
        while c < size:
            v, c = np.minimum(v[:, :-c], v[:, c:]), 2 * c
        return v

    def keys(self, minima: np.ndarray, band: int) -> np.ndarray:
        a, b = minima[ROWS * band].astype(np.uint64), minima[ROWS * band + 1].astype(np.uint64)
        return (a << np.uint64(32)) | (a * np.uint64(5) ^ b) & np.uint64(0xFFFFFFFF)

    def candidates(self, s: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, place of its first shingle, place of the window) that windows of the shingles ``s`` bring up."""
        v, c = self.coordinates(s), 1
        for size in self.sizes:
            while c < size:
                v, c = np.minimum(v[:, :-c], v[:, c:]) if v.shape[1] > c else v[:, :0], 2 * c
            step = self.stride(size)
            own = np.ascontiguousarray(v[:, ::step])
            for band in range(self.bands):
                keys = self.keys(own, band)
                for i in np.flatnonzero(self.filters[size, band][keys & np.uint64((1 << FILTER) - 1)]):
                    for t, offset in self.table[size, band].get(int(keys[i]), ()):
                        yield t, int(i) * step - offset, int(i) * step

    def scan(self, hashes: np.ndarray, first: np.ndarray, least: float, block: int = 1 << 14) -> list[dict[str, float]]:
        """For each of a run of texts (words' hashes, each text's first word): license -> best containment from ``least`` on.

        Shingles are taken over the whole run; those that cross from text to text are left out when a candidate is verified.
        """
        held: list[set[Match]] = [set() for _ in first[1:]]
        s = shingles(hashes, self.k)
        overlap = max(self.sizes)
        for start in range(0, len(s), block):
            found = {(t, start + at, int(np.searchsorted(first, start + window, "right")) - 1) for t, at, window in self.candidates(s[start : start + block + overlap])}
            for t, at, row in sorted(found):
                n = self.first[t]
                slack = n // 4 + 1
                near = s[max(first[row], at - slack) : max(0, min(first[row + 1] - self.k + 1, at + n + slack))]
                both = len(np.intersect1d(self.sets[t], near))
                if both >= least * len(self.sets[t]) - 1e-9:
                    held[row].add((at, at + n, both, both / len(self.sets[t]), self.names[t]))
        return [strongest(sorted(m)) for m in held]


def strongest(matches: list[Match]) -> dict[str, float]:
    """License -> best containment of sorted matches, without those that overlap one of another license with more shingles.

    Templates that differ by a version or a clause so give the license that is meant.
    """
    weak = set()
    for i, x in enumerate(matches):
        for y in itertools.takewhile(lambda y: y[0] < x[1], itertools.islice(matches, i + 1, None)):  # noqa: B023
            if x[4] != y[4] and x[2] != y[2]:
                weak.add(min(x, y, key=lambda m: m[2]))
    best: dict[str, float] = {}
    for m in matches:
        if m not in weak:
            best[m[4]] = max(m[3], best.get(m[4], 0.0))
    return best


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, k: int = 3, least: float = 0.8, similarity: float = 0.75, probability: float = 0.999) -> DataFrame:
    """(doc_id, licenses, containments) of each row: the licenses whose template the text holds, sorted, and how fully.

    A template is held if at least ``least`` of its distinct k-word shingles stand together at one place, and none of
    another license that overlaps it there has more of them.  Words are
    ASCII letters, in lower case, digits and all beyond ASCII.  Every template that is held so is retrieved, as long as
    its own shingles are different ones; windows of ``similarity`` collide with ``probability`` besides.  Null and empty
    texts hold none; rows and ids stay as given; other columns are not read.  One text must fit a task about 40 times.
    """
    index = Index(templates or TEMPLATES, k, bands_for(similarity, probability), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [b for hashes, first in text_words(batch.column(1)) for b in index.scan(hashes, first, least)]
            names = [sorted(b) for b in best]
            shares = [[b[n] for n in sorted(b)] for b in best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], ["doc_id", "licenses", "containments"])

    slim = docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, licenses array<string>, containments array<double>")
