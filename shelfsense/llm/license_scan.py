"""License scans by conditional compression.

Windows of words slide over the whole text, across ends of lines and paragraphs. Where they hold enough of a template's words, they form
candidate blocks. A block is compressed once alone and once with each template as raw zstandard dictionary; templates are ranked by the bytes
that they save. Down this ranking a template takes the passages that its exact wording differences confirm: few enough, no whole clause, and
none in a word that tells licences apart (names, versions). Words that a better template took are gone for the next.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shelfsense.llm.common import slices, small_batches, table

#: Wordings of public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-2-Clause notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "Proprietary": "All rights reserved.",
    "Public domain": "This is free and unencumbered software released into the public domain.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC0-1.0": "Released under CC0 1.0.",
}
#: Words by which licences are told apart.
NAMES = frozenset(
    "apache mit bsd 2-clause 3-clause isc gnu general lesser library affero public gpl lgpl agpl mozilla mpl eclipse boost zlib"
    " cc cc0 by-nc by-nd by-sa by-nc-sa by-nc-nd attribution noncommercial sharealike noderivatives domain unencumbered endorse promote not non".split()
)

_WORD = re.compile(r"[vV](?=\d)|[^\W_]+(?:[-.][^\W_]+)*")
#: Words that may be added, lost or changed, as a share of the template's words.
TOLERANCE = 0.25
#: Most neighbouring words that may be added, lost or changed; a longer run is a clause.
CLAUSE = 10
_NUMBERED = NAMES | {"version", "v", "license", "licence", "by"}

_KINDS = "doc_id long, line long, n_lines long, license string, saving double, saved_bytes long, n_differences long, exact boolean, differences array<string>, block string"


def telling(ws: list[str]) -> np.ndarray:
    """Which words are names or version numbers beside them."""
    return np.array([w in NAMES or (w == "by" and before == "cc") or (w[0].isdigit() and before in _NUMBERED) for before, w in zip(["", *ws], ws, strict=False)], dtype=bool)


class Scanner:
    """Templates, each with a compressor that has it as dictionary."""

    def __init__(self, templates: dict[str, str], tolerance: float) -> None:
        import zstandard as zstd

        words = {n: [w.lower() for w in _WORD.findall(templates[n])] for n in sorted(templates)}
        self.words = {n: own for n, own in words.items() if own}
        self.names = list(self.words)
        self.code = {w: k for k, w in enumerate(sorted({w for own in self.words.values() for w in own}))}
        self.coded = {n: np.array([self.code[w] for w in own]) for n, own in self.words.items()}
        self.telling = {n: telling(own) for n, own in self.words.items()}
        self.called = {n: NAMES.intersection(own) for n, own in self.words.items()}
        # Most words that may differ, and with them the longest passage.
        self.limit = {n: int(tolerance * len(own)) for n, own in self.words.items()}
        self.width = max((len(self.words[n]) + self.limit[n] for n in self.names), default=1)
        # By word code; the last column is for all other words.
        self.holds = {n: np.array([w in set(own) for w in self.code] + [False]) for n, own in self.words.items()}
        self.plain = zstd.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.with_template = {
            n: zstd.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, dict_data=zstd.ZstdCompressionDict(" ".join(own).encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT))
            for n, own in self.words.items()
        }

    def sizes(self, ws: list[str], names: list[str]) -> tuple[int, list[int]]:
        """Compressed bytes of the words alone, and the bytes that each template saves as dictionary."""
        raw = " ".join(ws).encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        return alone, [alone - len(self.with_template[n].compress(raw)) for n in names]

    def blocks(self, ws: list[str], codes: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(start, end, templates) of the candidate blocks; every passage within the tolerance lies in one of them whole.

        A passage has at most ``limit`` words more than its template, all but ``limit`` of its words, and all of its names.
        """
        present = set(ws)
        depth = np.zeros(len(ws) + 1, dtype=np.int64)
        held = {}
        for name in self.names:
            if not self.called[name] <= present:
                continue
            own = self.words[name]
            width = min(len(ws), len(own) + self.limit[name])
            before = np.concatenate([[0], np.cumsum(self.holds[name][codes])])
            starts = np.flatnonzero(before[width:] - before[:-width] >= len(own) - self.limit[name])
            if len(starts):
                held[name] = before
                np.add.at(depth, starts, 1)
                np.add.at(depth, starts + width, -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(depth[:-1]) > 0, [0]]).astype(np.int8)))
        for start, end in edges.reshape(-1, 2).tolist():
            # Long stretches are cut so that neighbours share the longest passage.
            for a in range(start, max(start + 1, end - self.width), self.width):
                b = min(end, a + 2 * self.width)
                yield a, b, [n for n, before in held.items() if before[b] - before[a] >= len(self.words[n]) - self.limit[n]]

    def passages(self, name: str, ws: list[str], codes: np.ndarray, marked: np.ndarray) -> list[tuple[int, int, int]]:
        """(differences, start, end) of the passages that exact wording differences confirm, fewest differences first, without overlaps.

        A difference in one of the words that tell licences apart (``marked``) costs more than the tolerance.
        """
        own, limit = self.words[name], self.limit[name]
        step = len(ws) + 1
        # Differences and start as one number, so that one minimum settles both.
        for row in _rows(self.coded[name], self.telling[name], codes, marked, limit + 1, np.arange(step), step):
            n, at = row // step, row % step
        kept: list[tuple[int, int, int]] = []
        for many, _, a, b in sorted((int(n[b]), abs(int(b - at[b]) - len(own)), int(at[b]), int(b)) for b in np.flatnonzero(n <= limit)):
            if a < b and all(b <= c or d <= a for _, c, d in kept):
                if all(max(j - i, m - k) <= CLAUSE for i, j, k, m in self.differences(name, ws[a:b], marked[a:b])):
                    kept.append((many, a, b))
        return kept

    def differences(self, name: str, ws: list[str], marked: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The cheapest edit from the template to ``ws``: (i, j, k, m) for each stretch ``own[i:j]`` that became ``ws[k:m]``."""
        own, heavy = self.words[name], self.limit[name] + 1
        add = np.where(marked, heavy, 1)
        cost = np.stack(list(_rows(np.array(own, dtype=object), self.telling[name], np.array(ws, dtype=object), marked, heavy, np.concatenate([[0], np.cumsum(add)]), 1)))
        found: list[tuple[int, int, int, int]] = []
        i, k = j, m = len(own), len(ws)
        while i or k:
            if i and k and own[i - 1] == ws[k - 1] and cost[i, k] == cost[i - 1, k - 1]:
                if (i, k) != (j, m):
                    found.append((i, j, k, m))
                i, k = j, m = i - 1, k - 1
            elif i and k and own[i - 1] != ws[k - 1] and cost[i, k] == cost[i - 1, k - 1] + (heavy if self.telling[name][i - 1] or marked[k - 1] else 1):
                i, k = i - 1, k - 1
            elif k and cost[i, k] == cost[i, k - 1] + add[k - 1]:
                k -= 1
            else:
                i -= 1
        if (i, k) != (j, m):
            found.append((i, j, k, m))
        return found[::-1]

    def find(self, ws: list[str]) -> list[tuple[int, int, str, int, int]]:
        """(start, end, licence, bytes saved, bytes alone) of the passages, in the order of the text.

        Within a block templates choose in the order of their saving over the block. Of passages of two blocks that overlap
        the one stays that its template saves more of.
        """
        other = len(self.code)
        codes = np.fromiter((self.code.get(w, other) for w in ws), np.int64, len(ws))
        hits = set()
        marked = None
        for start, end, names in self.blocks(ws, codes) if ws else ():
            marked = telling(ws) if marked is None else marked
            _, saved = self.sizes(ws[start:end], names)
            taken = np.zeros(end - start, dtype=bool)
            # A short notice may save nothing beside others of its kind: the ranking orders templates, it drops none.
            for _, name in sorted((-k, n) for k, n in zip(saved, names, strict=True)):
                for many, a, b in self.passages(name, ws[start:end], codes[start:end], marked[start:end]):
                    if not taken[a:b].any():
                        taken[a:b] = True
                        alone, (own,) = self.sizes(ws[start + a : start + b], [name])
                        hits.add((-own, many, name, start + a, start + b, alone))
        used = np.zeros(len(ws), dtype=bool)
        kept = []
        for less, _, name, a, b, alone in sorted(hits):
            if not used[a:b].any():
                used[a:b] = True
                kept.append((a, b, name, -less, alone))
        return sorted(kept)

    def scan(self, text: str | None) -> Iterator[tuple[int, int, str, float, int, list[str], str]]:
        """(first line, lines, licence, share saved, bytes saved, differences, passage), in the order of the text."""
        ws = [w.lower() for w in _WORD.findall(text or "")]
        found = self.find(ws)
        if not found:
            return
        marked = telling(ws)
        spans = [m.span() for m in _WORD.finditer(text)]
        ends = [m.start() for m in re.finditer("\n", text)]
        for a, b, name, saved, alone in found:
            start, end = spans[a][0], spans[b - 1][1]
            while start and not text[start - 1].isspace():
                start -= 1
            while end < len(text) and not text[end].isspace():
                end += 1
            own, block = self.words[name], text[start:end]
            changes = [f"{' '.join(own[i:j])} -> {' '.join(ws[a:b][k:m])}" for i, j, k, m in self.differences(name, ws[a:b], marked[a:b])]
            yield bisect_left(ends, start), block.count("\n") + 1, name, saved / alone, saved, changes, block


def _rows(own: np.ndarray, own_marked: np.ndarray, ws: np.ndarray, marked: np.ndarray, heavy: int, first: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Rows of the table of edit costs in units of ``step``: by words of ``own`` done, for every end in ``ws``."""
    along = np.concatenate([[0], np.cumsum(np.where(marked, heavy, 1))]) * step
    row = first
    yield row
    for word, is_marked in zip(own, own_marked, strict=True):
        new = row + step * (heavy if is_marked else 1)
        change = heavy if is_marked else np.where(marked, heavy, 1)
        new[1:] = np.minimum(new[1:], row[:-1] + step * change * (ws != word))
        row = np.minimum.accumulate(new - along) + along
        yield row


_loaded: dict[tuple, Scanner] = {}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per licence found: document, first line (from 0), name, saving, wording differences and the passage.

    Defined cases: a null or empty text holds none; of templates that a passage confirms the one that saves most bytes, then the
    smaller name, wins; repeated rows give repeated findings; long texts are cut into blocks, so the work grows with the words; a null doc_id stays null; an empty table gives none; further columns are not read.
    """
    templates = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tuple(sorted(templates.items())), tolerance)
        if key not in _loaded:
            _loaded[key] = Scanner(templates, tolerance)
        scanner = _loaded[key]
        schema = pa.schema(
            [("doc_id", pa.int64()), ("line", pa.int64()), ("n_lines", pa.int64()), ("license", pa.string()), ("saving", pa.float64()), ("saved_bytes", pa.int64()), ("n_differences", pa.int64()), ("exact", pa.bool_()), ("differences", pa.list_(pa.string())), ("block", pa.string())]
        )
        for batch, texts in slices(batches, "text"):
            rows = [
                (doc_id, line, n, name, saving, saved, len(changes), not changes, changes, block)
                for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True)
                for line, n, name, saving, saved, changes, block in scanner.scan(text)
            ]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, _KINDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
