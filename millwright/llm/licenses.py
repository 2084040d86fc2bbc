"""License scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Text is lower-cased and everything but letters and digits becomes a space. Units are the lines of a text, its
paragraphs (separated by blank lines) and the whole text, each reduced to its set of word bigrams. Two sets of a and b
bigrams have 2 * common / (a + b) >= t only if a lies in [t / (2 - t) * b, (2 - t) / t * b]; these bounds on the size
prune the templates for a unit before anything is compared. A unit of the longer kinds is looked at only where it
has more than one line.

Beside the units, words are read across lines: citations and headings of licences (``license_notices``) count whole,
and templates and grants of ``WINDOW_WORDS`` or more are held against all windows of their own length (unit ``window``,
the line of its first word). A name is refused where its version is missing, or where a word says another licence of
the family (Lesser, Affero; NC, SA, ND).

Every document gives one row, repeated rows too: its best template, score, unit and line, and all templates found
(null and empty where there is none). Null text counts as empty. Ties go to the first template by name, then the
first unit. Whole texts are read. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from millwright.llm.common import column, pick, slices, small_batches, split_words, strings
from millwright.llm.license_notices import FULL_TEXTS, GRANTS, cited_names, phrases, versions_only

THRESHOLD, WINDOW_WORDS = 0.8, 10
# Licence notices and grants as published by their authors (fixed values).
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}
for _name, _texts in FULL_TEXTS.items():
    TEMPLATES[_name] = [*TEMPLATES.get(_name, []), *_texts]


def normalise(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " ")


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes that can reach the threshold against n bigrams."""
    return int(np.ceil(threshold / (2 - threshold) * n - 1e-9)), int(np.floor((2 - threshold) / threshold * n + 1e-9))


KINDS = {
    "lesser": r"\blesser\b|\blibrary general\b",
    "affero": r"\baffero\b",
    "nc": r"\bnc\b|\bnon ?commercial\b",
    "sa": r"\bsa\b|\bshare ?alike\b",
    "nd": r"\bnd\b|\bno ?deriv",
    "endorse": r"\bendorse or promote\b",
}


def kinds(words: list[str], name: str) -> set[str]:
    """Which words of KINDS that tell licences of the name's family apart occur."""
    own = ("nc", "sa", "nd") if name.startswith("CC-") else ("lesser", "affero") if "GPL" in name else ("endorse",) if name.startswith("BSD-") else ()
    return {k for k in own if re.search(KINDS[k], " ".join(words))}


def versions(words: list[str]) -> set[tuple[str, ...]]:
    """Runs of numbers (2 0), and single numbers with the word before (version 3)."""
    out, i = set(), 0
    while i < len(words):
        j = i
        while j < len(words) and words[j].isdigit() and len(words[j]) < 3:
            j += 1
        if j > i:
            out.add(tuple(words[i:j]) if j - i > 1 else tuple(words[max(0, i - 1) : j]))
        i = max(j, i + 1)
    return out


def agrees(name: str, template: list[str], unit: list[str]) -> bool:
    """Whether the unit's version and distinguishing words are the template's."""
    pairs, need = bigrams(unit), versions(template)
    return all(all(p in pairs for p in zip(v, v[1:])) for v in need) and kinds(template, name) == kinds(unit, name)


class Matcher:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        texts = [(name, t) for name, ts in sorted(templates.items()) for t in ts]
        sets = [bigrams(t.split()) for t in normalise(pa.array([t for _, t in texts])).to_pylist()]
        split = [t.split() for t in normalise(pa.array([t for _, t in texts])).to_pylist()]
        # By size, so that the bounds on a unit's size name a slice of them.
        self.rows = sorted(((name, s, t) for (name, _), s, t in zip(texts, sets, split) if s), key=lambda r: len(r[1]))
        self.sizes = [len(s) for _, s, _ in self.rows]
        # A unit has at least as many words as distinct bigrams and one, so few words rule it out at once.
        self.least = size_bounds(self.sizes[0], threshold)[0] if self.sizes else 1
        self.vocabulary = pa.array(sorted({w for _, s, _ in self.rows for pair in s for w in pair}), pa.string())

    def best(self, words: list[str]) -> list[tuple[str, float]]:
        """Templates at or over the threshold, each with its best score."""
        unit, found = bigrams(words), {}
        lo, hi = size_bounds(len(unit), self.threshold)  # the bounds hold both ways
        for name, s, text in self.rows[bisect_left(self.sizes, lo) : bisect_right(self.sizes, hi)]:
            dice = 2 * len(unit & s) / (len(unit) + len(s))
            if dice >= self.threshold and agrees(name, text, words):
                found[name] = max(dice, found.get(name, 0.0))
        return list(found.items())

    def candidates(self, known: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Units in which at least ``least`` neighbouring pairs of words are known to some template."""
        pair = known[:-1] & known[1:] & (owner[:-1] == owner[1:]) if len(owner) > 1 else np.zeros(0, bool)
        return np.flatnonzero(np.bincount(owner[:-1][pair], minlength=n) >= max(1, self.least // 2))


class Windows:
    """Templates and grants within longer texts."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        texts = [(name, t) for table in (templates, GRANTS) for name, ts in sorted(table.items()) for t in ts]
        split = [t.split() for t in normalise(pa.array([t for _, t in texts], pa.string())).to_pylist()]
        self.rows = [(name, w, bigrams(w)) for (name, _), w in zip(texts, split) if len(w) >= WINDOW_WORDS]
        words = sorted({w for _, ws, _ in self.rows for w in ws})
        at = {w: i for i, w in enumerate(words)}
        self.vocabulary, self.width = pa.array(words, pa.string()), len(words)
        pairs = sorted({at[a] * self.width + at[b] for *_, s in self.rows for a, b in s})
        self.pairs = np.array(pairs, np.int64)
        place = {p: i for i, p in enumerate(pairs)}
        self.member = np.zeros((len(pairs), len(self.rows)), bool)
        for k, (*_, s) in enumerate(self.rows):
            self.member[[place[at[a] * self.width + at[b]] for a, b in s], k] = True
        # c common pairs of b and a >= c: the Dice coefficient reaches t only if c >= t / (2 - t) * b.
        self.need = np.array([size_bounds(len(s), threshold)[0] for *_, s in self.rows])

    def candidates(self, words: pa.Array, doc: np.ndarray) -> list[tuple[int, int]]:
        """Document and row of ``rows`` where enough pairs of the row occur anywhere in the document."""
        if len(words) < 2 or not self.rows:
            return []
        code = pc.fill_null(pc.index_in(words, self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (doc[:-1] == doc[1:]))
        pair = code[at] * self.width + code[at + 1]
        slot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        real = self.pairs[slot] == pair
        key = np.unique(doc[at[real]] * len(self.pairs) + slot[real])
        owner, slot = key // len(self.pairs), key % len(self.pairs)
        docs, first = np.unique(owner, return_index=True)
        enough = np.diff(np.append(first, len(owner))) >= self.need.min()
        out = []
        for d, lo, hi in zip(docs[enough], first[enough], np.append(first[1:], len(owner))[enough]):
            counts = self.member[slot[lo:hi]].sum(axis=0)
            out += [(int(d), int(k)) for k in np.flatnonzero(counts >= self.need)]
        return out

    def best(self, row: int, words: list[str]) -> tuple[str, float, int] | None:
        """Name, score and first word of the best window of the row's length; the first of equal ones."""
        name, template, s = self.rows[row]
        n, held, common, found = min(len(template), len(words)), Counter(), 0, None
        for i, pair in enumerate(zip(words, words[1:])):
            held[pair] += 1
            common += held[pair] == 1 and pair in s
            first = i - (n - 2)
            if first < 0:
                continue
            dice = 2 * common / (len(held) + len(s))
            if dice >= self.threshold and (found is None or dice > found[1]) and agrees(name, template, words[first : first + n]):
                found = name, dice, first
            old = words[first], words[first + 1]
            held[old] -= 1
            if not held[old]:
                del held[old]
                common -= old in s
        return found


# Every citation and heading holds one of these words, so that other documents are passed over.
ANCHORS = pa.array(sorted({w for table in phrases() for words in table for w in words if re.match(r"licen[cs]|creative|gnu$|[al]?gpl|gfdl|cc0?$|bsd$|m[p]l|epl$|eupl|cddl|ofl$|odbl|asl$|apache|unlicense|wtfpl|libpng|psf$|rights|domain$|attribution|publicdomain|bsd", w)} | {"licence", "licenced"}), pa.string())


def _spelling(words: list[str]) -> list[str]:
    return [{"licence": "license", "licenced": "licensed"}.get(w, w) for w in words]


def _scan(templates, threshold):
    def run(batches):
        match, windows = Matcher(templates, threshold), Windows(templates, threshold)
        for b in slices(batches, "text"):
            texts = strings(b, "text").cast(pa.string())
            parts = pc.split_pattern(texts, "\n")
            lines, doc = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)
            owner, words = split_words(normalise(lines))
            known = pc.is_in(words, match.vocabulary).to_numpy(zero_copy_only=False)
            begins = np.searchsorted(doc, np.arange(len(b) + 1))
            word_at = np.searchsorted(owner, np.arange(len(lines) + 1))
            take = lambda lo, hi: words[int(word_at[lo]) : int(word_at[hi])].to_pylist()
            found: dict[int, list] = {}
            for i in match.candidates(known, owner, len(lines)).tolist():
                for name, dice in match.best(take(i, i + 1)):
                    found.setdefault(int(doc[i]), []).append((-dice, name, "line", int(i - begins[doc[i]])))
            # Longer units: runs of lines between blank lines, and whole texts.
            blank = np.bincount(owner, minlength=len(lines)) == 0
            for d in match.candidates(known, doc[owner] if len(owner) else owner, len(b)).tolist():
                lo, hi = int(begins[d]), int(begins[d + 1])
                cuts = [lo - 1, *(lo + np.flatnonzero(blank[lo:hi])).tolist(), hi]
                units = [("paragraph", a + 1, z) for a, z in zip(cuts, cuts[1:]) if z - a > 2]
                units += [("text", lo, hi)] if hi - lo > 1 and (len(cuts) > 2 or not units) else []
                for kind, a, z in units:
                    for name, dice in match.best(take(a, z)):
                        found.setdefault(d, []).append((-dice, name, kind, a - lo))
            # Citations, and windows across lines.
            text_of = doc[owner] if len(owner) else owner
            for d in np.unique(text_of[pc.is_in(words, ANCHORS).to_numpy(zero_copy_only=False)]).tolist():
                lo, hi = int(begins[d]), int(begins[d + 1])
                line = owner[int(word_at[lo]) : int(word_at[hi])] - lo
                heads = {0, *(1 + np.flatnonzero(blank[lo:hi])).tolist()}
                for name, at in cited_names(_spelling(take(lo, hi)), line.tolist(), heads):
                    found.setdefault(d, []).append((-1.0, name, "window", int(line[at])))
            for d, k in windows.candidates(words, text_of):
                lo, hi = int(begins[d]), int(begins[d + 1])
                hit = windows.best(k, take(lo, hi))
                if hit:
                    found.setdefault(d, []).append((-hit[1], hit[0], "window", int(owner[int(word_at[lo]) + hit[2]]) - lo))
            for d, hits in found.items():
                names = versions_only({x[1] for x in hits})
                found[d] = [x for x in hits if x[1] in names]
            top = [min(found[i]) if i in found else None for i in range(len(b))]
            get = lambda f: [None if t is None else f(t) for t in top]
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id").cast(pa.int64()), pa.array(get(lambda t: t[1]), pa.string()), pa.array(get(lambda t: round(-t[0], 6)), pa.float64()), pa.array(get(lambda t: t[2]), pa.string()), pa.array(get(lambda t: t[3]), pa.int64()), pa.array([sorted({x[1] for x in found.get(i, [])}) for i in range(len(b))], pa.list_(pa.string()))],
                names=["doc_id", "license", "dice", "unit", "line_no", "licenses"],
            )

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, unit, line_no (from 0), licenses, for each document."""
    small_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInArrow(_scan(templates, threshold), "doc_id long, license string, dice double, unit string, line_no long, licenses array<string>")
