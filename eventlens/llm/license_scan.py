"""License scans by conditional compression.

A candidate block is what lies within ``REACH`` words of a licensing word, over
lines, blank lines and comment marks. A template is looked for at each place of
its rarest telling word (name, version, conditions), and confirmed if a
word-by-word comparison finds all telling words unchanged, at most
``MAX_DIFFERENCE`` of its words different, and no telling words of another
license in between. Of the confirmed ones the one is taken whose use as a raw
zstandard dictionary saves most bytes of the notice found; the words before and
after it are scanned again. SPDX identifiers are read as they stand.

Null and empty texts have no blocks. Repeated rows get equal results; equal
reductions are taken in template order. Extra columns are ignored. A block is
bounded by its document, and documents are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import prepare

MAX_DIFFERENCE = 0.2
#: Words that make their surroundings a candidate; the same expression runs in the scan.
VOCABULARY = r"(?i)licen[sc]|copyright|copyleft|spdx|all rights reserved|public domain|permission is hereby|redistribut|warrant(y|ies)|merchantab|free software|creative ?commons|\bCC[ -](BY|0)|\b(A|L)?GPL\b"

#: License, telling words, notice. Public licence notices.
TEMPLATES = (
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "permission hereby granted charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2.0 compliance", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "gnu general version 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "gnu general version 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "gnu general version 3 later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "gnu general version 2 later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "gnu lesser version 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "gnu affero version 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "bsd 3-clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "bsd 2-clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "redistribution binary forms neither endorse", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "redistribution binary forms reproduce", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "isc", "Released under the ISC License."),
    ("CC0-1.0", "cc0 1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "cc by 4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc by-sa 4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "cc by-nc 4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "cc by-nd 4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "cc by-nc-sa 4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("Unlicense", "unencumbered public domain", "This is free and unencumbered software released into the public domain."),
)

_WORD = re.compile(r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*")
_HIT = re.compile(VOCABULARY)
_TAIL = re.compile(r"[^\sA-Za-z0-9]*")
_ID = r"(?:\([ \t]*)*[A-Za-z0-9](?:[A-Za-z0-9.+\-]*[A-Za-z0-9+])?(?:[ \t]*\))*"
_SPDX = re.compile(rf"(?i:SPDX-License-Identifier):[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)")
#: Words on both sides of a licensing word that can belong to its notice.
REACH = int((1 + 2 * MAX_DIFFERENCE) * max(len(_WORD.findall(notice)) for _, _, notice in TEMPLATES))


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def blocks_of(text: str) -> list[list[tuple[int, str]]]:
    """Candidate blocks, each as its (offset, text)."""
    spans = [m.span() for m in _WORD.finditer(text)]
    ends = [b for _, b in spans]
    runs: list[list[int]] = []
    for hit in _HIT.finditer(text):
        at = bisect_right(ends, hit.start())
        first, last = max(0, at - REACH), min(len(spans), at + REACH)
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    cuts = [(spans[a][0], _TAIL.match(text, spans[b - 1][1]).end()) for a, b in runs]
    return [[(a, text[a:b])] for a, b in cuts]


@lru_cache(maxsize=1)
def _prepared() -> list[tuple[str, frozenset, list[str], zstandard.ZstdCompressor]]:
    out = []
    for name, telling, notice in TEMPLATES:
        dictionary = zstandard.ZstdCompressionDict(notice.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((name, frozenset(telling.split()), words_of(notice), zstandard.ZstdCompressor(level=9, dict_data=dictionary)))
    return out


def reductions(block: str) -> list[tuple[float, int]]:
    """Share of the compressed size that each template saves, best first."""
    data = " ".join(block.lower().split()).encode()
    alone = len(zstandard.ZstdCompressor(level=9).compress(data))
    saved = [(1 - len(c.compress(data)) / alone, i) for i, (_, _, _, c) in enumerate(_prepared())]
    return sorted(saved, key=lambda x: (-x[0], x[1]))


def differences(notice: list[str], telling: frozenset, words: list[str]) -> tuple[int, int, int] | None:
    """Words of the notice that differ and the words it spans, without chance matches around it; None if a telling word differs."""
    runs = [m for m in SequenceMatcher(None, notice, words, autojunk=False).get_matching_blocks() if m.size]
    best = None
    for i in range(len(runs)):
        matched = 0
        for j in range(i, len(runs)):
            matched += runs[j].size
            first, last = runs[i].b, runs[j].b + runs[j].size
            found = (max(len(notice), last - first) - matched, first, last)
            if best is None or (found[0], last - first) < (best[0], best[2] - best[1]):
                if telling <= {notice[m.a + k] for m in runs[i : j + 1] for k in range(m.size)}:
                    best = found
    return best


def _places(i: int, words: list[str], at: dict[str, list[int]]) -> list[tuple[int, int, int]]:
    """Confirmed places of a template: differing words, first and last word."""
    _, telling, notice, _ = _prepared()[i]
    if not all(w in at for w in telling):
        return []
    rare = min(telling, key=lambda w: (len(at[w]) * notice.count(w), w))
    slack = int(MAX_DIFFERENCE * len(notice)) + 1
    out = []
    for start in sorted({b - a for b in at[rare] for a, w in enumerate(notice) if w == rare}):
        first = max(0, start - slack)
        found = differences(notice, telling, words[first : start + len(notice) + slack])
        if found is None or found[0] > MAX_DIFFERENCE * len(notice):
            continue
        span = set(words[first + found[1] : first + found[2]])
        # A longer name that contains this one, such as a version "2.0" of another license, tells more.
        if not any(telling < other and other <= span for _, other, _, _ in _prepared()):
            out.append((found[0], first + found[1], first + found[2]))
    return out


def _confirmed(text: str, words: list[tuple[str, int, int]]) -> list[tuple]:
    """Confirmed notices that do not overlap, those that save most bytes first: bytes, template, words, span, reduction, differing words."""
    plain = [w for w, _, _ in words]
    at: dict[str, list[int]] = {}
    for k, w in enumerate(plain):
        at.setdefault(w, []).append(k)
    found = []
    for i, (_, _, _, compressor) in enumerate(_prepared()):
        for differing, first, last in _places(i, plain, at):
            start, end = words[first][1], _TAIL.match(text, words[last - 1][2]).end()
            data = " ".join(text[start:end].lower().split()).encode()
            alone = len(zstandard.ZstdCompressor(level=9).compress(data))
            saved = alone - len(compressor.compress(data))
            if saved > 0:
                found.append((saved, i, first, last, start, end, saved / alone, differing))
    kept, taken = [], np.zeros(len(words), bool)
    for own in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        if not taken[own[2] : own[3]].any():
            taken[own[2] : own[3]] = True
            kept.append(own)
    return sorted(kept, key=lambda x: x[2])


def _scan(text: str, offset: int) -> list[dict]:
    """Confirmed notices of a text; what is between them is scanned again until nothing is left to find."""
    out = []
    parts = [[(m.group().lower(), *m.span()) for m in _WORD.finditer(text)]]
    while parts:
        words = parts.pop()
        kept = _confirmed(text, words)
        if not kept:
            continue
        last = 0
        for n, (_, i, first, end, start, stop, reduction, differing) in enumerate([*kept, (0, 0, len(words), 0, 0, 0, 0.0, 0)]):
            rest = words[last:first]
            if n and len(rest) > 1 and rest[0][0] in ("or", "and"):  # "under the MIT License or the ..."
                rest = [(w, rest[1][1], rest[1][1]) for w in ("licensed", "under")] + rest[1:]
            if rest:
                parts.append(rest)
            if end:
                own = {"license": _prepared()[i][0], "start": offset + start, "length": stop - start, "reduction": reduction, "differing_words": differing}
                out.append(own)
            last = end
    return out


def _identifiers(text: str, offset: int) -> list[dict]:
    """SPDX identifiers, as the licenses of an expression."""
    compressor = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(b"spdx-license-identifier: ", dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    out = []
    for m in _SPDX.finditer(text):
        data = m.group().lower().encode()
        alone = len(zstandard.ZstdCompressor(level=9).compress(data))
        reduction = 1 - len(compressor.compress(data)) / alone
        for name in re.findall(r"[A-Za-z0-9.+\-]+", re.sub(r"WITH[ \t]+[^ \t)]+|\b(AND|OR)\b", " ", m.group(1))):
            out.append({"license": name, "start": offset + m.start(), "length": len(m.group()), "reduction": reduction, "differing_words": 0})
    return out


def scan_block(block: list[tuple[int, str]]) -> list[dict]:
    """Confirmed notices of a block."""
    out = []
    for offset, text in block:
        out += _scan(text, offset) + _identifiers(text, offset)
    return sorted(out, key=lambda x: x["start"])


MATCH = "struct<license: string, start: bigint, length: bigint, reduction: double, differing_words: bigint>"


def license_column(text: Column) -> Column:
    """A struct ``n_blocks, matches`` of a text column."""

    @F.pandas_udf(f"struct<n_blocks: bigint, matches: array<{MATCH}>>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        found = [blocks_of(t) if t else [] for t in texts]
        return pd.DataFrame({"n_blocks": [len(b) for b in found], "matches": [[m for b in own for m in scan_block(b)] for own in found]})

    return scan(F.when(text.rlike(VOCABULARY), text))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_blocks, licenses`` (sorted, distinct)``, matches`` for each row of ``docs``."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), license_column(F.col(text_col)).alias("found"))
    return rows.select(
        "id",
        F.col("found.n_blocks").alias("n_blocks"),
        F.array_sort(F.array_distinct(F.transform("found.matches", lambda m: m["license"]))).alias("licenses"),
        F.col("found.matches").alias("matches"),
    )
