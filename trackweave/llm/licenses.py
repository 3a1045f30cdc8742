"""License scans by MinHash bands over text windows.

Texts and templates are sequences of runs of a-z and 0-9, lower-cased, in shingles of five words.
Templates are put into classes by length: class s holds those of up to s distinct shingles
(a power of two, 4 at least). A text is cut into blocks of s shingles, and a window is two
neighbouring blocks, so a run of s shingles lies whole in some window. Each of ``bands``
one-row bands compares a window's least hash with a template's; sharing one retrieves the
template. A window of at most 2 s shingles that holds four fifths of a template of more than s/2
has similarity 0.17 or more, so it is missed with probability below 0.83^bands (3e-6 for 68);
templates of class 4 that hold fewer shingles are compared directly. Retrieved pairs are
verified by exact containment of the template's shingles in the window.

The templates are a parameter (at most ``MAX_TEMPLATES``) and are sent to each task; texts are not
shuffled. Null, empty and short texts match nothing. Repeated rows are scanned each; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.text import LOWER, blocks, minima, permutations, shingles, word_hashes

U = np.uint64
SHINGLE = 5
MAX_TEMPLATES = 10_000
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123)]] = True

#: fixed values: notices as their licenses word them
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Released under the MIT License",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
}


def alnum_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text and the end) of runs of letters a-z and digits."""
    low = LOWER[data]
    solid = _ALNUM[low]
    edge = np.empty(len(low) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(solid[1:], solid[:-1], out=edge[1:-1])
    edge[offs] = True
    cut = np.flatnonzero(edge)
    real = solid[cut[:-1]] if len(low) else np.zeros(0, bool)
    starts, size = cut[:-1][real], np.diff(cut)[real]
    return word_hashes(low[solid], np.concatenate(([0], np.cumsum(size)))), np.searchsorted(starts, offs)


def _shingled(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, first = alnum_words(data, offs)
    values, at = shingles(hashes, first, SHINGLE)
    short = np.flatnonzero(np.diff(first) < SHINGLE)  # fewer words than a shingle hold none
    keep = np.ones(len(values), bool)
    keep[at[short][np.diff(at)[short] > 0]] = False
    n = np.diff(at)
    n[short] = 0
    return values[keep], np.concatenate(([0], np.cumsum(n)))


def scan(
    docs: DataFrame, templates: Mapping[str, str], *, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8, bands: int = 68,
) -> DataFrame:
    """doc_id, license_id, windows (that hold the template), containment (the most of one) and start_word for each pair found."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    names, raw = list(templates), [t.encode() for t in templates.values()]
    values, at = _shingled(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64))
    sets = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]
    if any(len(s) == 0 for s in sets):
        raise ValueError(f"a template has at least {SHINGLE} words")
    a, b = permutations(bands, 5)
    classes: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        classes.setdefault(max(4, 1 << (len(s) - 1).bit_length()), []).append(i)
    least = {i: minima(s, np.array([0, len(s)]), a, b)[0] for i, s in enumerate(sets)}

    def retrieved(values: np.ndarray, block: np.ndarray, windows: np.ndarray, members: list[int], size: int) -> Iterator[tuple[int, np.ndarray]]:
        """(template, windows that share a band with it); ``block`` cuts the shingles, a window is blocks w and w + 1."""
        low = minima(values, block, a, b)
        pair = np.minimum(low[windows], low[windows + 1])
        for i in members:
            hit = (pair == least[i]).any(axis=1)
            if len(sets[i]) <= size // 2:  # too small for the bands' promise
                any_of = np.concatenate(([0], np.cumsum(np.isin(values, sets[i]))))
                hit |= any_of[block[windows + 2]] > any_of[block[windows]]
            yield i, windows[hit]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, text_col, 2 << 20):
            values, at = _shingled(data, offs)
            found: list[tuple[int, int, int, float, int]] = []
            for size, members in classes.items():
                per = -(-np.diff(at) // size)
                n = np.where(per > 0, per + 1, 0)  # an empty block ends each text, so its last block is a window too
                upto = np.concatenate(([0], np.cumsum(n)))
                doc = np.repeat(np.arange(len(per)), n)
                number = np.arange(upto[-1]) - upto[doc]
                block = np.append(np.minimum(at[doc] + number * size, at[doc + 1]), len(values))
                windows = np.flatnonzero(number < per[doc])
                for i, near in retrieved(values, block, windows, members, size):
                    best: dict[int, tuple[int, float, int]] = {}
                    for w in near.tolist():
                        inside = values[block[w] : block[w + 2]]
                        share = len(np.intersect1d(inside, sets[i])) / len(sets[i])
                        if share >= containment:
                            d = int(doc[w])
                            word = int(block[w] - at[d] + np.flatnonzero(np.isin(inside, sets[i]))[0])
                            k, most, start = best.get(d, (0, 0.0, word))
                            best[d] = (k + 1, max(most, share), start if most >= share else word)
                    found += [(d, i, k, most, start) for d, (k, most, start) in best.items()]
            if found:
                d, i, k, most, start = map(list, zip(*sorted(found)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).take(pa.array(d)), pa.array([names[x] for x in i]), pa.array(k, pa.int64()), pa.array(most), pa.array(start, pa.int64())],
                    names=["doc_id", "license_id", "windows", "containment", "start_word"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(work, f"doc_id {kind}, license_id string, windows long, containment double, start_word long")


def scan_sql(templates: Mapping[str, str] = TEMPLATES, containment: float = 0.8) -> str:
    """The same windows and containment by joins on shingles as text."""
    listed = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in templates.items())
    return f"""
WITH templates(license_id, body) AS (VALUES {listed}),
tw AS (SELECT license_id, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM templates),
ts AS (SELECT license_id, list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS s FROM tw),
tc AS (SELECT license_id, len(s) AS m, greatest(4, (2 ** ceil(log2(len(s))))::BIGINT) AS size, unnest(s) AS shingle FROM ts),
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
pos AS (SELECT r, doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM dw WHERE len(w) >= {SHINGLE}),
hits AS (SELECT r, doc_id, license_id, m, size, i - 1 AS p, shingle FROM pos JOIN tc ON shingle = array_to_string(w[i:i + {SHINGLE - 1}], ' ')),
both_of AS (SELECT *, p // size AS win FROM hits UNION ALL SELECT *, p // size - 1 AS win FROM hits WHERE p >= size),
found AS (SELECT r, doc_id, license_id, win, count(DISTINCT shingle) / any_value(m) AS share, min(p) AS start FROM both_of GROUP BY r, doc_id, license_id, win HAVING count(DISTINCT shingle) / any_value(m) >= {containment}),
best AS (SELECT *, row_number() OVER (PARTITION BY r, license_id ORDER BY share DESC, win) AS k, count(*) OVER (PARTITION BY r, license_id) AS windows FROM found)
SELECT doc_id, license_id, windows, round(share, 6) AS containment, start AS start_word FROM best WHERE k = 1"""
