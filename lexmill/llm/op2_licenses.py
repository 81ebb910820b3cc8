"""License scan: winnowed fingerprints of templates pick candidates, banded alignment measures them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.common import per_batch, texts
from lexmill.llm.wordbuf import FOLDED, Members, Words, inside_docs, odd_weights, windows, words

# Notices and opening passages of public licenses, as they are published.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
MATCHES = "doc_id long, license string, coverage double, n_matched int, n_template int, start long, end long"
GRAM, WINDOW = 3, 3


def winnow(w: Words) -> np.ndarray:
    """Places of the smallest gram hash of every ``WINDOW`` neighbouring grams of a text (the leftmost of equals)."""
    h = windows(w.hash, odd_weights(GRAM, 21))
    at = np.flatnonzero(inside_docs(w, GRAM))
    if not len(at):
        return at
    own, doc = h[at], w.doc[at]
    keep = np.zeros(len(at), bool)
    n = len(at) - WINDOW + 1
    if n > 0:
        stacked = np.stack([own[i : i + n] for i in range(WINDOW)])
        low = np.arange(n) + stacked.argmin(axis=0)
        keep[low[doc[:n] == doc[WINDOW - 1 :]]] = True
    sizes = np.bincount(doc)
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))  # too short for a window: every gram
    keep |= np.isin(doc, short)
    return at[keep]


class Index:
    """Inverted index of template fingerprints: hash to (template, place)."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        w = words(pa.array(list(templates.values()), pa.string()), FOLDED)
        self.tokens = [w.hash[w.bounds[i] : w.bounds[i + 1]] for i in range(len(self.names))]
        at = winnow(w)
        hashes = windows(w.hash, odd_weights(GRAM, 21))[at]
        self.members = Members(hashes)
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for h, i in zip(hashes.tolist(), at.tolist()):
            d = int(w.doc[i])
            self.postings.setdefault(h, []).append((d, i - int(w.bounds[d])))


def align(
    template: np.ndarray, tokens: np.ndarray, offset: int, band: int, taken: list[tuple[int, int]] | None = None
) -> tuple[int, int, int]:
    """Local alignment within ``band`` of the diagonal ``offset``: ``(matched, from, to)`` in ``tokens``.

    Equal tokens score 2; an exchanged, missing or added token costs 1. No alignment enters the spans ``taken``.
    """
    best = (0, 0, 0, 0)
    row: dict[int, tuple[int, int, int]] = {}
    pattern, target = template.tolist(), tokens.tolist()
    for lo, hi in taken or []:
        target[lo:hi] = [None] * (hi - lo)
    for i, token in enumerate(pattern):
        new: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + offset - band), min(len(target), i + offset + band + 1)):
            if target[j] is None:
                continue
            score, matched, start = row.get(j - 1, (0, 0, j))
            if target[j] == token:
                cell = (score + 2, matched + 1, start if score else j)
            else:
                cell = max(((score - 1, matched, start), *((s - 1, m, f) for s, m, f in (row.get(j, (0, 0, j)), new.get(j - 1, (0, 0, j))))))
            if cell[0] > 0:
                new[j] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        row = new
    return best[1:]


def scan(column: pa.Array, index: Index, least: float, band: int) -> list[tuple]:
    """``(row, template, matched, first token, last token + 1)`` of accepted matches and the words they refer to."""
    w = words(column, FOLDED)
    grams = windows(w.hash, odd_weights(GRAM, 21))
    at = winnow(w)
    at = at[index.members.positions(grams[at])]
    lines: dict[tuple[int, int], set[int]] = {}
    for i, h in zip(at.tolist(), grams[at].tolist()):
        d = int(w.doc[i])
        for template, place in index.postings[h]:
            lines.setdefault((d, template), set()).add(i - place)
    found = []
    for (d, template), diagonals in lines.items():
        lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
        tokens, spans = index.tokens[template], set()
        for diagonal in sorted(diagonals):
            first = max(lo, diagonal - band)
            part = w.hash[first : min(hi, diagonal + len(tokens) + band)]
            taken: list[tuple[int, int]] = []
            while True:  # a band can hold several copies: each is masked for the next
                matched, a, b = align(tokens, part, diagonal - first, band, taken)
                if matched < least * len(tokens):
                    break
                taken.append((a, b))
                spans.add((d, template, matched, first + a, first + b))
        found += sorted(spans)
    return _undisputed(found, index, w)


def _undisputed(found: list[tuple], index: Index, w: Words) -> list[tuple]:
    """Of matches of a document that share tokens, the one with most; equal ones by template order."""
    kept: dict[int, list[tuple]] = {}
    for x in sorted(found, key=lambda x: (-x[2], -x[2] / len(index.tokens[x[1]]), x[1], x[3])):
        others = kept.setdefault(x[0], [])
        if all(x[4] <= y[3] or y[4] <= x[3] for y in others):
            others.append(x)
    out = []
    for x in (y for rows in kept.values() for y in rows):
        begin = int(w.origin[x[0]])
        text = w.buffer[begin : int(w.end[x[4] - 1])]
        letters = np.cumsum((text & 0xC0) != 0x80)  # code points up to and with each byte
        out.append((*x[:3], int(letters[int(w.start[x[3]]) - begin]) - 1, int(letters[-1])))
    return out


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, band: int = 8) -> DataFrame:
    """License passages of whole texts, one row each: matched share of the template and the span in code points.

    Tokens are lower-case runs of letters and digits. A text and a template that share five tokens in a row
    share a fingerprint, and with it become candidates; the alignment tolerates exchanged, missing and added
    tokens within ``band`` of the diagonal. Reported from a coverage of ``least``; of overlapping matches the
    largest. The templates are constants of a few KB, so the index goes to every task; nothing is shuffled.
    Null or empty texts give no row, repeated rows give theirs again, a null doc_id is carried along.
    """
    known = TEMPLATES if templates is None else templates

    def run(batches):
        index = Index(known)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(0).to_pylist()
            rows = []
            for d, t, matched, start, end in scan(batch.column(1), index, least, band):
                n = len(index.tokens[t])
                rows.append((ids[d], index.names[t], matched / n, matched, n, start, end))
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MATCHES.split(", ")])

        yield from per_batch(one)(batches)

    return texts(docs).mapInArrow(run, MATCHES)
