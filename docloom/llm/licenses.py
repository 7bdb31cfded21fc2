"""Operator 3, license scans: MinHash bands over overlapping text windows, then exact shingle containment.

A template of n shingles of SHINGLE words belongs to the class S, the least power of two with n <= S. For each class a text is
seen through windows of 2 * S shingles that start every S shingles, so each occurrence of a template stands whole in
one window. A template with a share of at least CONTAINMENT in a window has a Jaccard similarity with it of 0.16 or more, of 0.25
when whole; with BANDS bands of one MinHash each, one of them collides with a probability above 0.9997, or 0.999998 when whole.
Every template retrieved is then compared with its window shingle by shingle. A template of fewer words than a shingle is one shingle
of its own length: its MinHash is that shingle's hash, so the lookup finds every occurrence.

The templates are an argument of the driver's or a table whose size is checked; they go to all tasks, texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import text_batches
from .substrings import gram_hashes

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 48
#: Shingles of several texts that are hashed at once.
BATCH_SHINGLES = 200_000
#: Characters of templates up to which a table of them is taken.
TEMPLATE_CHARS = 20_000_000

#: Wordings of public license notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "This project is licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: Identifiers of licenses in the tag of source files.
TAGGED = ["MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "Unlicense", "Zlib", "BSL-1.0"]
for _name in TAGGED:
    TEMPLATES.setdefault(_name, []).append(f"SPDX-License-Identifier: {_name}")

_KEEP = bytes(b if 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_MOST = np.uint64(2**64 - 1)


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits, in lower case."""
    return (text or "").encode().translate(_KEEP).split()


def shingles(own: list[bytes]) -> list[bytes]:
    """Runs of SHINGLE words; fewer words are one run."""
    return [b" ".join(own[i : i + SHINGLE]) for i in range(max(len(own) - SHINGLE + 1, min(len(own), 1)))]


class Index:
    """The templates' MinHashes by class and band, as sorted values."""

    def __init__(self, templates: dict[str, list[str]]):
        random = np.random.default_rng(42)
        self.factors = random.integers(0, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.terms = random.integers(0, 2**63, BANDS, dtype=np.uint64)
        self.templates = [(name, own) for name, texts in templates.items() for own in map(words, texts) if own]
        self.sets = [frozenset(shingles(own)) for _, own in self.templates]
        self.short = {}
        for k in sorted({len(own) for _, own in self.templates if len(own) < SHINGLE}):
            members = [i for i, (_, own) in enumerate(self.templates) if len(own) == k]
            self.short[k] = self.table(members, [gram_hashes(self.templates[i][1], k)[0] for i in members])
        classes = [1 << (len(own) - SHINGLE).bit_length() if len(own) >= SHINGLE else 0 for _, own in self.templates]
        self.largest = max(max(classes, default=1), 1)
        self.tables = {}
        for size in sorted(set(classes) - {0}):
            members = [i for i, s in enumerate(classes) if s == size]
            for band in range(BANDS):
                least = [self.permuted(gram_hashes(self.templates[i][1], SHINGLE), band).min() for i in members]
                self.tables[size, band] = self.table(members, least)

    @staticmethod
    def table(members: list[int], hashes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which low 16 bits there are, the sorted hashes and their templates."""
        order = np.argsort(hashes)
        known = np.zeros(1 << 16, dtype=bool)
        known[[int(h) & 0xFFFF for h in hashes]] = True
        return known, np.array(hashes)[order], np.array(members)[order]

    def permuted(self, hashes: np.ndarray, band: int) -> np.ndarray:
        h = hashes * self.factors[band] + self.terms[band]
        return h ^ (h >> np.uint64(32))

    def retrieve(self, texts: list[list[bytes]]) -> set[tuple[int, int, int]]:
        """(text, template, first shingle of the window) for every collision of a band."""
        sizes = [max(len(own) - SHINGLE + 1, 0) for own in texts]
        room = [-(-n // self.largest) * self.largest for n in sizes]
        starts = np.cumsum([0, *room])
        hashes, used = np.zeros(starts[-1], dtype=np.uint64), np.zeros(starts[-1], dtype=bool)
        for own, at, n in zip(texts, starts, sizes, strict=False):
            hashes[at : at + n] = gram_hashes(own, SHINGLE)
            used[at : at + n] = True
        found: set[tuple[int, int, int]] = set()
        for k, (known, values, members) in self.short.items():
            for text, own in enumerate(texts):
                h = gram_hashes(own, k)
                for at in np.flatnonzero(known[(h & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
                    found.update((text, int(members[j]), at) for j in range(np.searchsorted(values, h[at], "left"), np.searchsorted(values, h[at], "right")))
        for band in range(BANDS if len(hashes) else 0):
            least = np.where(used, self.permuted(hashes, band), _MOST)
            size = 1
            while size <= self.largest:
                if (size, band) in self.tables:
                    after = np.append(least[1:], _MOST)
                    after[starts[1:][np.array(room) > 0] // size - 1] = _MOST  # windows end with their text
                    window = np.minimum(least, after)
                    known, values, members = self.tables[size, band]
                    for i in np.flatnonzero(known[(window & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
                        for j in range(np.searchsorted(values, window[i], "left"), np.searchsorted(values, window[i], "right")):
                            text = int(np.searchsorted(starts, i * size, "right")) - 1
                            found.add((text, int(members[j]), i * size - int(starts[text])))
                least = np.minimum(least[::2], least[1::2]) if size < self.largest else least
                size *= 2
        return found

    def verify(self, own: list[bytes], template: int, at: int) -> tuple[str, int, int, float] | None:
        """(name, first word, end, containment) of a template in a window, if enough of its shingles are there."""
        name, text = self.templates[template]
        if len(text) < SHINGLE:
            return (name, at, at + len(text), 1.0) if own[at : at + len(text)] == text else None
        size = 1 << (len(text) - SHINGLE).bit_length()
        near, want = shingles(own[at : at + 2 * size + SHINGLE - 1]), self.sets[template]
        places = [i for i, s in enumerate(near) if s in want]
        share = len({near[i] for i in places}) / len(want)
        return (name, at + places[0], at + places[-1] + SHINGLE, share) if share >= CONTAINMENT else None


def template_table(rows: DataFrame) -> dict[str, list[str]]:
    """Templates from a table (license, text) of at most TEMPLATE_CHARS characters; null and blank texts are left out."""
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > TEMPLATE_CHARS:
        raise ValueError(f"templates of {size} characters are too many to send to every task")
    out: dict[str, list[str]] = {}
    for row in rows.select("license", "text").where("license is not null and trim(text) <> ''").orderBy("license", "text").collect():
        out.setdefault(row["license"], []).append(row["text"])
    return out


def scan(docs: DataFrame, templates: dict[str, list[str]] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, matches) for each row of ``docs``; matches: (license, first, end, containment), places in words, sorted.

    Of several windows that show one license at one place the fullest is kept. Null and empty texts have no matches,
    repeated rows stay separate, an empty table gives no rows, other columns are ignored. A very long text is worked on
    whole, one text at a time in a task.
    """
    if isinstance(templates, DataFrame):
        templates = template_table(templates)
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))

    def look(texts: list[str | None]) -> list[list[dict]]:
        own = [words(text) for text in texts]
        best: list[dict] = [{} for _ in own]
        for text, template, at in sorted(index.value.retrieve(own)):
            if match := index.value.verify(own[text], template, at):
                key = match[0], match[1]
                best[text][key] = max(best[text].get(key, match), match, key=lambda m: (m[3], -m[2]))
        return [[dict(zip(("license", "first", "end", "containment"), m, strict=True)) for m in sorted(found.values())] for found in best]

    kind = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, block, size = [], [], 0
            for text in batch.column(1):
                block.append(text.as_py())
                size += len(block[-1] or "") // 6
                if size > BATCH_SHINGLES:
                    out += look(block)
                    block, size = [], 0
            out += look(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["id", "matches"])

    text_batches(docs.sparkSession)
    own = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"id {own}, matches array<struct<license:string,first:int,end:int,containment:double>>").withColumnRenamed("id", id_col)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.col("matches.license")))
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))


def _sql() -> str:
    rows = []
    for i, (name, text) in enumerate((name, text) for name, texts in TEMPLATES.items() for text in texts):
        own = words(text)
        for shingle in sorted(set(shingles(own))):
            rows.append(f"({i}, '{name}', {1 << (len(own) - SHINGLE).bit_length() if len(own) >= SHINGLE else 1}, {len(set(shingles(own)))}, '{shingle.decode()}')")
    return f"""
WITH t(i, name, size, n, g) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 3)) - 1 AS p, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS g FROM d WHERE len(w) >= 5
  UNION ALL SELECT doc_id, unnest(range(1, len(w) - 2)) - 1, unnest(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k+3], ' '))) FROM d WHERE len(w) >= 4),
h AS (SELECT doc_id, i, name, n, t.g, p // size AS b FROM s JOIN t USING (g)),
v AS (SELECT * FROM h UNION ALL SELECT doc_id, i, name, n, g, b - 1 FROM h WHERE b > 0),
m AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, i, name, b FROM v GROUP BY doc_id, i, name, b, n HAVING count(DISTINCT g) >= {CONTAINMENT} * n)),
r AS (SELECT doc_id, count(*) AS c, string_agg(name, ',' ORDER BY name) AS names FROM m GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(c, 0) AS BIGINT) AS n_licenses, coalesce(names, '') AS licenses FROM d LEFT JOIN r USING (doc_id)"""


QUERIES = {"op3_licenses": op3_licenses}
ORACLE_SQL = {"op3_licenses": _sql()}
