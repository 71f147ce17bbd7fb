"""Licence scan: Dice coefficient over word bigrams against licence templates.

A unit is a line of a text, or a whole text.  Units and templates are normalised:
lower case, each run of characters other than letters and digits one space.  A
unit's words make a set of bigrams.  Two sets of sizes a and b have a Dice
coefficient of 2i/(a+b) for i shared bigrams, at most 2 min(a, b)/(a+b); so a
template can reach ``threshold`` only for sizes within t/(2-t) and (2-t)/t of
its own.  These bounds prune templates before any bigram is compared.

Licences also stand inside lines and texts, wrapped over lines.  A passage is a run of a text's bigrams that begins
where a run of a template's bigrams begins (or behind an earlier passage), ends on one of them, and has at
most (2-t)/t times the template's bigrams, repeats counted.  For each template the best passage at or over the threshold is taken,
of equals the earliest and then the shortest, and again the best of those that overlap none taken.  A heap of each
beginning's best does that in one pass, so the work grows with the text.  Of overlapping passages of different templates
the one of most shared bigrams is reported, unless a line or whole text reported there shares as many.

Every unit with a coefficient of ``threshold`` or more against some template is
reported, with its best template; ties go to the template first by name.  Null
and empty texts and units of fewer than two words match nothing.  Repeated rows
give repeated results; an empty table gives none; a long text is read as a whole.  Templates are a bounded, documented list: they travel
with the task.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

THRESHOLD = 0.8
#: So that no size bound prunes what reaches the threshold exactly.
ROUNDING = 1e-9

#: Public licence notices and texts.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "MIT-notice": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "Proprietary-notice": "All rights reserved.",
}

#: Whole texts of standard licences, and headers of more of them.
TEXTS = {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))} | {
    "BSD-2-Clause-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Matcher:
    """Templates as sets of numbered bigrams; one per task."""

    def __init__(self, templates: Mapping[str, str], threshold: float):
        self.threshold = threshold
        self.names = sorted(templates)
        words = [words_of(templates[k]) for k in self.names]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        pairs = [[self.vocabulary[a] * len(self.vocabulary) + self.vocabulary[b] for a, b in zip(ws, ws[1:], strict=False)] for ws in words]
        self.keys = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(p, np.int64) for p in pairs)]))
        self.holds = np.zeros((len(self.keys) + 1, len(self.names)), bool)  # the last row is for bigrams of no template
        for k, p in enumerate(pairs):
            self.holds[np.searchsorted(self.keys, p), k] = True
        self.sizes = self.holds.sum(0)
        self.least, self.most = threshold / (2 - threshold) - ROUNDING, (2 - threshold) / threshold + ROUNDING
        self.needed = np.maximum(1, self.least * self.sizes)
        self.spans = [int(self.most * len(p)) for p in pairs]  # bigrams that a passage may have, repeats counted

    def scan(self, text: str) -> list[tuple[int, str, float, int]]:
        """(unit, template, coefficient, shared bigrams) of each reported unit and passage of a text, read once."""
        of_line = [_WORD.findall(x) for x in text.lower().split("\n")]
        words = [w for ws in of_line for w in ws]
        if len(words) < 2:
            return []
        number = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        key = np.where((number[:-1] >= 0) & (number[1:] >= 0), number[:-1] * len(self.vocabulary) + number[1:], -1)
        at = np.searchsorted(self.keys, key)
        at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] != key)] = len(self.keys)
        hits = np.concatenate([[0], np.cumsum(at < len(self.keys))])
        least = self.needed.min()
        if hits[-1] < least:
            return []
        ends = np.cumsum([len(ws) for ws in of_line])
        starts = np.minimum(ends - [len(ws) for ws in of_line], len(key))
        last = np.maximum(starts, ends - 1)  # behind the last bigram of a line
        told = [(no, int(starts[no]), int(last[no])) for no in np.flatnonzero(hits[last] - hits[starts] >= least).tolist()]
        told += [(-1, 0, len(key))] * (len(of_line) > 1)
        units, shared = [], np.zeros(len(key), np.int64)
        for no, a, b in told:
            if got := self._best(words, at, a, b):
                units.append((no, *got))
                shared[a:b] = np.maximum(shared[a:b], got[2])
        found = self._passages(words, at)
        taken = np.zeros(len(key), bool)
        out = []
        for i, dice, name, a, b in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            if shared[a:b].max() < i and not taken[a:b].any():
                taken[a:b] = True
                out.append((-2 - int(np.searchsorted(ends, a, side="right")), name, dice, i))
        return units + sorted(out)

    def _best(self, words: list[str], at: np.ndarray, a: int, b: int) -> tuple[str, float, int] | None:
        """(template, coefficient, shared bigrams) of the best template at or over the threshold for the bigrams from a to b."""
        shared = self.holds[np.unique(at[a:b])].sum(0)
        may = np.flatnonzero(shared >= self.needed)
        if not len(may):
            return None
        n = len(set(zip(words[a:b], words[a + 1 : b + 1], strict=True)))
        found = []
        for k in may.tolist():
            size = int(self.sizes[k])
            if self.least * size <= n <= self.most * size and (dice := 2.0 * int(shared[k]) / (n + size)) >= self.threshold:
                found.append((-dice, self.names[k], int(shared[k])))
        return (min(found)[1], -min(found)[0], min(found)[2]) if found else None

    def _passages(self, words: list[str], at: np.ndarray) -> list[tuple[int, float, str, int, int]]:
        """(shared, coefficient, template, first bigram, bigram behind the last) of each template's best passages."""
        shared = self.holds[np.unique(at)].sum(0)
        jobs = []
        for k in np.flatnonzero(shared >= self.needed).tolist():
            hit = self.holds[at, k]
            within = np.concatenate([[0], np.cumsum(hit)])
            before = np.concatenate([[False], hit[:-1]])
            starts = np.flatnonzero(hit & ~before)
            starts = starts[within[np.minimum(starts + self.spans[k], len(hit))] - within[starts] >= self.needed[k]]
            if len(starts):
                jobs.append((k, hit, within, starts.tolist()))
        if not jobs:
            return []
        number: dict[str, int] = {}
        code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        code = code[:-1] * len(number) + code[1:]
        order = np.argsort(code, kind="stable")
        earlier = np.full(len(code), -1)  # the same bigram's place before
        same = code[order[1:]] == code[order[:-1]]
        earlier[order[1:][same]] = order[:-1][same]
        return [x for job in jobs for x in self._best_runs(earlier, *job)]

    def _best_runs(self, earlier: np.ndarray, k: int, hit: np.ndarray, within: np.ndarray, starts: list[int]) -> list[tuple[int, float, str, int, int]]:
        """Best first, passages of one template that don't overlap."""
        size, span, need = int(self.sizes[k]), self.spans[k], self.needed[k]
        todo: list[tuple[float, int, int, int]] = []

        def offer(s: int, limit: int) -> None:
            """The best passage from s on that ends before the limit, the shortest of equals."""
            e = min(s + span, limit)
            if within[e] - within[s] < need:
                return
            fresh = earlier[s:e] < s
            i = np.cumsum(fresh & hit[s:e])
            dice = np.where(hit[s:e], 2.0 * i / (np.cumsum(fresh) + size), 0.0)
            best = int(np.argmax(dice))
            if dice[best] >= self.threshold:
                heappush(todo, (-float(dice[best]), s, s + best + 1, int(i[best])))

        for s in starts:
            offer(s, len(hit))
        taken, firsts, out = np.zeros(len(hit), bool), [], []
        while todo:
            negative, s, e, i = heappop(todo)
            if taken[s]:
                continue
            p = bisect_left(firsts, s)
            if p < len(firsts) and firsts[p] < e:
                offer(s, firsts[p])
                continue
            out.append((i, -negative, self.names[k], s, e))
            taken[s:e] = True
            insort(firsts, s)
            if e < len(hit) and hit[e] and not taken[e]:
                p = bisect_left(firsts, e)
                offer(e, firsts[p] if p < len(firsts) else len(hit))
        return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES | TEXTS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, unit (line number from 0, -1 for the whole text, -2 - n for a passage from line n on), license_id, dice, shared of each matching unit.

    A text of one line is reported as line 0 only.  A narrow pass: no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in batches:
            rows, ids = [], []
            for place, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                told = matcher.scan(text)
                rows += told
                ids += [place] * len(told)
            no, name, dice, shared = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(no, pa.int64()), pa.array(name, pa.string()), pa.array(dice, pa.float64()), pa.array(shared, pa.int64())],
                [id_col, "unit", "license_id", "dice", "shared"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, unit bigint, license_id string, dice double, shared bigint")
