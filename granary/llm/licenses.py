"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Words are runs of ASCII letters, digits and other non-ASCII characters, A-Z as a-z. A template of n words is looked for
in windows of twice its size class (the smallest power of two not below n, 8 at least) that overlap by half, so every
occurrence lies whole in one window. Each window and template has BANDS minhashes of its five-word shingles, one row a
band: a window that holds CONTAINMENT of a template's shingles has Jaccard similarity 0.75 * n / (2 * class + n) or
more, 0.15 at worst, so all bands miss it with probability 0.85 ** 96 = 2e-7. Retrieved templates are verified exactly:
CONTAINMENT of the template's distinct shingles must lie in the stretch of n (or up to 4/3 n) words around them.

A band of one row can only match where a window and a template share a shingle, so windows that share none are left
out before their minhashes are made, and so are windows with fewer known shingles than CONTAINMENT of the smallest
template of their class; that drops no candidate. Templates are a parameter that travels with the tasks: the notices and
headers below, and the full texts in the folder license_texts. A notice has five words or more; as one of up to seven
has three shingles at most, it must be there word for word, its version included.
One scan of whole texts without a shuffle. Null and empty texts have no licenses; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import by_bytes, mix, text_bytes
from granary.llm.shingles import LOWER, shingle_hashes, span_hash

CONTAINMENT = 0.75
BANDS = 96

# The notices that the scan knows, as their licenses word them.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-1.0-header": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "boost-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "boost-1.0-header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-style-header": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "wtfpl-2-text": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
}

# The names that notices give to each license.
_NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0 license"],
    "mit": ["MIT License", "MIT licence", "Expat License"],
    "bsd": ["BSD License", "BSD-style license", "3-Clause BSD License", "2-Clause BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "Modified BSD License", "Simplified BSD License"],
    "isc": ["ISC License"],
    "zlib": ["zlib License", "zlib/libpng license"],
    "unlicense": ["Unlicense license", "The Unlicense"],
    "boost-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License"],
    "gpl": ["GNU General Public License", "GNU GPL", "GPL license"],
    "gpl-2.0": ["GNU General Public License version 2", "GNU General Public License v2", "GNU GPL version 2", "GNU GPL v2", "GPL version 2", "GPLv2 license"],
    "gpl-3.0": ["GNU General Public License version 3", "GNU General Public License v3", "GNU GPL version 3", "GNU GPL v3", "GPL version 3", "GPLv3 license"],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL license"],
    "lgpl-2.1": ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL version 2.1", "GNU LGPL v2.1", "LGPL version 2.1"],
    "lgpl-3.0": ["GNU Lesser General Public License version 3", "GNU Lesser General Public License v3", "GNU LGPL version 3", "GNU LGPL v3", "LGPL version 3"],
    "agpl-3.0": ["GNU Affero General Public License", "GNU Affero General Public License version 3", "GNU Affero General Public License v3", "GNU AGPL", "GNU AGPL version 3", "GNU AGPL v3", "AGPLv3 license"],
    "mpl-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0 license"],
    "mpl-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"],
    "epl-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "epl-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"],
    "cddl-1.0": ["Common Development and Distribution License"],
    "gfdl": ["GNU Free Documentation License"],
    "artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
    "cc0-1.0": ["CC0 1.0 Universal", "CC0 1.0 license"],
    "cc-by-4.0": ["Creative Commons Attribution 4.0", "CC BY 4.0"],
    "cc-by-sa-4.0": ["Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0"],
    "cc-by-nc-4.0": ["Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0"],
    "cc-by-nd-4.0": ["Creative Commons Attribution-NoDerivatives 4.0", "CC BY-ND 4.0"],
    "cc-by-nc-sa-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "CC BY-NC-SA 4.0"],
    "cc-by-3.0": ["Creative Commons Attribution 3.0", "CC BY 3.0"],
    "cc-by-sa-3.0": ["Creative Commons Attribution-ShareAlike 3.0", "CC BY-SA 3.0"],
}
_VERBS = ("licensed", "released", "distributed", "available", "published", "provided", "licenced", "redistributed", "offered", "shared")


def _notices() -> dict[str, str]:
    """Wordings of five to seven words, so that each must be there word for word: "under", "under the" or "terms of the" and
    a name, with a verb before them or cut from the left as the name's length asks or allows."""
    out: dict[str, str] = {}
    seen = {" ".join(_split(t)) for t in TEMPLATES.values()}
    for name, called in _NAMES.items():
        k = 1
        for words in map(_split, called):
            leads = [["under"], ["under", "the"], ["under", "a"], ["terms", "of", "the"], ["subject", "to", "the"], ["covered", "by", "the"], ["governed", "by", "the"], ["license", "is", "the"]]
            short = [[v, *lead] for lead in leads[:3] if 4 <= len(lead) + 1 + len(words) and len(lead) + len(words) < 5 for v in _VERBS]
            for lead in [*leads, *short]:
                whole = [*lead, *words]
                whole = whole[max(0, len(whole) - 7) :]
                if len(whole) >= 5 and (text := " ".join(whole)) not in seen:
                    seen.add(text)
                    out[f"{name}-notice-{k}"] = text
                    k += 1
    return out


def _split(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


TEMPLATES |= _notices()


def all_templates() -> dict[str, str]:
    """The notices and headers, and the full texts (read by the driver)."""
    texts = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in resources.files("granary.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
    return TEMPLATES | {f"{k}-text": texts[k] for k in sorted(texts)}


_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_rng = np.random.default_rng(10)
_MULTIPLY = (_rng.integers(1, 2**63, BANDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_XOR = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)


def license_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of each word; none crosses a row."""
    low = LOWER[data]
    full = _WORD[low]
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = np.flatnonzero(full & (~np.concatenate([[False], full[:-1]]) | edge[:n]))
    end = np.flatnonzero(full & (~np.concatenate([full[1:], [False]]) | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1, span_hash(low, start, end)


def _signature(shingles: np.ndarray) -> np.ndarray:
    return ((shingles[None, :] ^ _XOR[:, None]) * _MULTIPLY[:, None]).min(axis=1)


class Index:
    """Templates with their shingles, by band value."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names, self.sizes, self.sets, self.classes = [], [], [], []
        self.bands: dict[tuple[int, int], list[int]] = {}
        for name, text in templates.items():
            data = np.frombuffer(text.encode(), np.uint8)
            _, _, row, hashes = license_words(data, np.array([0, len(data)]))
            shingles = np.unique(shingle_hashes(hashes, row, 1)[0])
            if not len(shingles):
                continue
            k = len(self.names)
            self.names.append(name)
            self.sizes.append(len(hashes))
            self.sets.append(shingles)
            self.classes.append(max(8, 1 << (len(hashes) - 1).bit_length()))
            for band, value in enumerate(_signature(shingles).tolist()):
                self.bands.setdefault((band, value), []).append(k)
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.used = sorted(set(self.classes))
        self.least = {c: CONTAINMENT * min(len(s) for s, own in zip(self.sets, self.classes) if own == c) for c in self.used}
        self.bloom = np.zeros(1 << 20, bool)
        self.bloom[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Positions of shingles that some template has."""
        maybe = np.flatnonzero(self.bloom[(shingles >> np.uint64(44)).astype(np.int64)])
        return maybe[np.isin(shingles[maybe], self.known)]


def scan_row(index: Index, shingles: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Template, first and last shingle position and containment of every verified occurrence in one text."""
    found: dict[tuple[int, int], tuple[int, int, float]] = {}
    for size in index.used:
        windows = np.unique(np.concatenate([hits // size, np.maximum(hits // size - 1, 0)]))
        for w in windows.tolist():
            a, b = w * size, min(len(shingles), w * size + 2 * size - 4 if size > 4 else 2 * size)
            inside = hits[(hits >= a) & (hits < b)]
            if not len(inside) or len(inside) < index.least[size]:
                continue
            asked = {k for band, value in enumerate(_signature(shingles[a:b]).tolist()) for k in index.bands.get((band, value), ()) if index.classes[k] == size}
            for k in asked:
                mine = inside[np.isin(shingles[inside], index.sets[k])]
                for first, last, share in occurrences(shingles, mine, len(index.sets[k])):
                    found[k, first] = (first, last, share)
    return sorted((first, last, k, share) for (k, _), (first, last, share) in found.items())


def occurrences(shingles: np.ndarray, mine: np.ndarray, n: int) -> list[tuple[int, int, float]]:
    """Disjoint stretches of up to 4/3 n shingles, leftmost first, that hold CONTAINMENT of a template's n shingles."""
    out, i = [], 0
    reach = max(1, (4 * n) // 3)
    while i < len(mine):
        j = int(np.searchsorted(mine, mine[i] + reach))
        share = len(np.unique(shingles[mine[i:j]])) / n
        if share >= CONTAINMENT:
            out.append((int(mine[i]), int(mine[j - 1]), share))
            i = j
        else:
            i += 1
    return out


def _scan(index: Index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])
        for batch in by_bytes(batches, "text"):
            data, at = text_bytes(batch.column("text"))
            n = batch.num_rows
            start, end, row, hashes = license_words(data, at)
            spans: list[list] = [[] for _ in range(n)]
            if len(row):
                shingles, of = shingle_hashes(hashes, row, n)
                cut = np.searchsorted(of, np.arange(n + 1))
                first_word = np.searchsorted(row, np.arange(n + 1))
                hits = index.hits(shingles)
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                for r in np.unique(of[hits]).tolist():
                    own = hits[(hits >= cut[r]) & (hits < cut[r + 1])] - cut[r]
                    for a, b, k, share in scan_row(index, shingles[cut[r] : cut[r + 1]], own):
                        w0 = first_word[r] + a
                        w1 = min(first_word[r] + b + 4, first_word[r + 1] - 1)
                        spans[r].append({"license": index.names[k], "start": int(point[start[w0]] - point[at[r]]), "end": int(point[end[w1]] - point[at[r]]), "containment": share})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(kind))], ["doc_id", "licenses"])

    return scan


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id and licenses: array of (license, start, end, containment), code points, end exclusive."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(Index(all_templates() if templates is None else templates)), "doc_id long, licenses array<struct<license: string, start: bigint, end: bigint, containment: double>>")
