"""Licence notices: a trained paragraph classifier, confirmed against templates and names.

A paragraph is a line. Sparse logistic regression over counts of word n-grams (1 to 3 words) gives
every window of WINDOW words of every line a probability for each licence family and for "unknown";
the regression is fitted here on templates, shortened and embedded variants of them, names in the
frames of short notices, and lines that are no notice, and its temperature is set on variants that
it was not fitted on. Scores of all windows come from array lookups of n-gram hashes, so no line is
passed over before it is classified.

Where a window is a notice with probability LEAST or more, its families are those that a template
or a name confirms and that the classifier gives LEAST or more once the words that name the other
families are left out; a window, and a line, may have several.

Defined results: a null or empty text has no paragraphs and no families. Repeated rows are scanned
alike. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._words import LOWER_CODE, NOT_TERM, buffer_of, row_groups, window_hashes, words_of

#: Words of a window and between the starts of two: a notice of STRIDE words lies wholly in one, whatever the line's length.
WINDOW, STRIDE = 32, 16
GRAMS = (1, 2, 3)

UNKNOWN = "unknown"
LEAST, AGREEMENT, SEED = 0.5, 0.6, 5
#: Runs under which a window must lie wholly in a template.
FEW = 4

# Public licence notices by family.
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal, public domain dedication."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "You can redistribute this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission.", "This document is proprietary and confidential. All rights reserved."],
}
# Paragraphs that use such words without being a notice.
NO_NOTICE = [
    "The driver lost his license after the accident.",
    "She studied the public library and its terms for months.",
    "The general was released under the terms of the treaty.",
    "A license is required to sell food in public places.",
    "The Apache people lived in the region for centuries.",
    "He graduated from MIT and published his work in two volumes.",
    "The committee reserved all rooms for the second part of the meeting.",
    "Permission to enter the building is granted by the office.",
    "The source of the river is subject to change with the season.",
    "This work is described in the version of the paper that appeared later.",
    "You may use this file to write a letter to the foundation.",
    "The software is free and the documentation is associated with it.",
]

# Names of the families. Those of PLAIN_NAMES count beside a word of licences only, as they mean other things too.
NAMES = {
    "agpl": ["AGPL", "AGPLv3", "AGPL 3.0", "GNU AGPL", "GNU AGPLv3", "Affero General Public License", "GNU Affero General Public License"],
    "apache": ["Apache", "ASL", "ASL 2.0", "Apache 2.0", "Apache License", "Apache License 2.0", "Apache Software License"],
    "bsd": ["BSD", "BSD 2 Clause", "BSD 3 Clause", "BSD style"],
    "cc-by": ["CC BY", "CC BY 4.0", "Creative Commons Attribution"],
    "cc-by-nc": ["CC BY NC", "CC BY NC 4.0", "Creative Commons Attribution NonCommercial"],
    "cc-by-sa": ["CC BY SA", "CC BY SA 4.0", "Creative Commons Attribution ShareAlike"],
    "cc0": ["CC0", "CC0 1.0", "public domain dedication"],
    "gpl": ["GPL", "GPLv2", "GPLv3", "GPL 3.0", "GNU GPL", "GNU GPLv2", "GNU GPLv3", "GNU General Public License"],
    "lgpl": ["LGPL", "LGPLv2", "LGPLv3", "LGPL 2.1", "GNU LGPL", "GNU Lesser General Public License", "Lesser General Public License"],
    "mit": ["MIT", "Expat"],
    "mpl": ["MPL", "MPL 2.0", "Mozilla Public License"],
    "proprietary": ["rights reserved", "proprietary", "proprietary and confidential"],
}
PLAIN_NAMES = {"Apache", "ASL", "BSD", "BSD style", "MIT", "Expat", "MPL", "proprietary", "public domain dedication"}
# Names that hold one of those above and are of no family here.
OTHER_NAMES = ["CC BY ND", "CC BY NC ND", "CC BY NC SA", "Creative Commons Attribution NoDerivatives", "Creative Commons Attribution NonCommercial ShareAlike", "Creative Commons Attribution NonCommercial NoDerivatives"]
LICENCE_WORDS = frozenset("license licence licensed licenced licenses licences licensing relicensed lizenz lizenziert licencia licenciado rights spdx dedication".split())
# Frames of short notices.
FRAMES = ("{} license", "{} licence", "{} lizenz", "{} lizenz", "{} lizenz siehe", "license {}", "license: {}", "licence: {}", "licensed under {}", "licensed under the {} license", "released under {}", "released under the {} licence", "distributed under the terms of the {} licence", "distributed under {}", "available under the {} license", "the code is under the {} license", "dual licensed under {}", "dual licensed under {} and", "spdx license identifier {}", "copyright 2020 {} license", "see the {} license", "unter der {} lizenz", "bajo licencia {}", "sous licence {}", "the files are available under the {} license and docs under")
#: Frames that a name needs no word of licences for.
BARE_FRAMES = ("{}", "the {}", "{} only", "under {}", "docs under {}", "and {}", "der {}", "la {}")

_TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")


def terms(text: str) -> list[str]:
    return [x.lower() for x in _TERM.findall(text)]


def grams(words: list[str]) -> list[str]:
    """The n-grams of a window, each as often as it occurs."""
    return [" ".join(words[k : k + n]) for n in GRAMS for k in range(len(words) - n + 1)]


def trigrams(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + 3]) for k in range(len(words) - 2)}


_NAMES = sorted(((tuple(terms(n)), f, n in PLAIN_NAMES) for f, names in [*NAMES.items(), (UNKNOWN, OTHER_NAMES)] for n in names), key=lambda x: (-len(x[0]), x))


def named(words: list[str], raw: list[str]) -> dict[str, set[int]]:
    """The families that are named, and at which words; longer names hide shorter ones. raw: the words as they are written."""
    licence, taken, found = not LICENCE_WORDS.isdisjoint(words), set(), {}
    for name, family, plain in _NAMES:
        for k in range(len(words) - len(name) + 1):
            spot = set(range(k, k + len(name)))
            if tuple(words[k : k + len(name)]) != name or spot & taken:
                continue
            taken |= spot
            german = name == ("mit",) and raw[k] != "MIT" and any(w.startswith("lizen") for w in words)  # "mit Lizenz": with a licence
            if family != UNKNOWN and not german and (licence or not plain):
                found.setdefault(family, set()).update(spot)
    return found


def _variants(text: str, rng: random.Random, n: int) -> list[str]:
    """The notice with words lost at its ends or within, or inside other words."""
    # Neutral words to embed notices in.
    around = "note see the of and file page this text below above project le la der die el los con pour und".split()
    out = []
    for _ in range(n):
        w = text.split()
        if rng.random() < 0.5 and len(w) > 6:
            del w[rng.randrange(len(w))]
        if rng.random() < 0.3 and len(w) > 12:
            w = w[: rng.randrange(8, len(w))]
        if rng.random() < 0.5:
            w = [rng.choice(around) for _ in range(rng.randrange(1, 9))] + w + [rng.choice(around) for _ in range(rng.randrange(0, 9))]
        out.append(" ".join(w))
    return out


class Classifier:
    """Weights by n-gram; families in order, "unknown" last."""

    def __init__(self, families: list[str], weights: dict[str, np.ndarray], bias: np.ndarray, temperature: float):
        self.families, self.weights, self.bias, self.temperature = families, weights, bias, temperature
        self.templates = {f: [trigrams(terms(t)) for t in TEMPLATES[f]] for f in families if f != UNKNOWN}
        self.tables = []
        for n in GRAMS:
            some = sorted(g for g in weights if g.count(" ") == n - 1)
            column = pa.array(some, pa.string())
            hashes = window_hashes(words_of(buffer_of(column), slice(0, len(some)), LOWER_CODE, NOT_TERM), n)[1]
            order = np.argsort(hashes)
            maybe = np.zeros(1 << 20, dtype=bool)
            maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables.append((hashes[order], np.stack([weights[g] for g in some])[order], maybe))

    def probabilities(self, words: list[str]) -> np.ndarray:
        z = self.bias.copy()
        for g in grams(words):
            if (w := self.weights.get(g)) is not None:
                z += w
        return self._share(z[None])[0]

    def _share(self, z: np.ndarray) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / self.temperature)
        return p / p.sum(1, keepdims=True)

    def window_probabilities(self, w, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of each window, words begin to stop of w, the families' probabilities: `probabilities` for all at once."""
        z = np.repeat(self.bias[None], len(begin), axis=0)
        for n, (hashes, rows, maybe) in zip(GRAMS, self.tables, strict=True):
            size = len(w) - n + 1
            if size <= 0 or not len(hashes):
                continue
            whole = w.row[:size] == w.row[n - 1 :]
            place = np.flatnonzero(whole)
            code = window_hashes(w, n)[1]
            near = np.flatnonzero(maybe[(code & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.searchsorted(hashes, code[near])
            at[at == len(hashes)] = 0
            hit = hashes[at] == code[near]
            place, at = place[near[hit]], at[hit]
            sums = np.zeros((len(place) + 1, len(self.families)))
            np.cumsum(rows[at], axis=0, out=sums[1:])
            z += sums[np.searchsorted(place, np.maximum(stop - n + 1, begin))] - sums[np.searchsorted(place, begin)]
        return self._share(z)

    def notices(self, line: str) -> dict[str, float]:
        """The confirmed families of a window and their probabilities without the words that name the others."""
        raw = _TERM.findall(line)
        words = [x.lower() for x in raw]
        spots, runs, licence = named(words, raw), trigrams(words), not LICENCE_WORDS.isdisjoint(words)
        for family, templates in self.templates.items():
            for t in templates:
                shared = len(t & runs)
                if shared and (shared >= AGREEMENT * len(t) or len(runs) >= FEW and shared >= AGREEMENT * len(runs) or licence and shared == len(runs)):
                    spots.setdefault(family, set())
        found = {}
        for family, own in spots.items():
            others = set().union(*(v for f, v in spots.items() if f != family)) - own
            p = float(self.probabilities([x for k, x in enumerate(words) if k not in others])[self.families.index(family)])
            if p >= LEAST:
                found[family] = p
        return found


def train_classifier(seed: int = SEED, epochs: int = 250) -> Classifier:
    rng = random.Random(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    fit, check = [], []
    for k, f in enumerate(families):
        for t in TEMPLATES.get(f, NO_NOTICE):
            fit += [(x, k) for x in [t, *_variants(t, rng, 14)]]
            check += [(x, k) for x in _variants(t, rng, 6)]
        for n in NAMES.get(f, []):
            frames = FRAMES if n in PLAIN_NAMES else FRAMES + BARE_FRAMES
            fit += [(x.format(n), k) for x in frames]
            check += [(v, k) for x in rng.sample(frames, 4) for v in _variants(x.format(n), rng, 1)]
    for name in (*OTHER_NAMES, "", "", *("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 9))) for _ in range(12))):  # frames alone are no notice
        fit += [(x.format(name), len(families) - 1) for x in FRAMES]
    for name in sorted(PLAIN_NAMES):  # nor are words with other meanings
        fit += [(x.format(name), len(families) - 1) for x in (*BARE_FRAMES, "he went to {} and published", "the {} people", "a {} system", "{} is", "the {} helicopter flew over the city under license", "a {} engineer with a license to practice", "work at {} under a research license")]
    usual = "the of and to in is that for with was his on at by are from this have not le la les des et dans que pour der die und das mit von ein el los con por una version may use work file under any all public general part".split()
    for n in range(600):
        line = " ".join(rng.choice(usual) for _ in range(rng.randrange(0, 50)))
        (fit if n % 4 else check).append((line, len(families) - 1))
    index: dict[str, int] = {}
    rows, cols = [], []
    for n, (text, _) in enumerate(fit):
        for g in grams(terms(text)):
            rows.append(n)
            cols.append(index.setdefault(g, len(index)))
    rows, cols = np.array(rows), np.array(cols)
    often = np.bincount(cols, minlength=len(index)) >= 2
    place = np.cumsum(often) - 1
    keep = often[cols]
    rows, cols = rows[keep], place[cols[keep]]
    index = {g: int(place[k]) for g, k in index.items() if often[k]}
    y = np.eye(len(families), dtype=np.float32)[[k for _, k in fit]]
    by_col, by_row = np.argsort(cols, kind="stable"), np.argsort(rows, kind="stable")
    col_first, row_ids, row_first = np.searchsorted(cols[by_col], np.arange(len(index))), *np.unique(rows[by_row], return_index=True)
    w, b = np.zeros((len(index), len(families)), np.float32), np.zeros(len(families), np.float32)
    for _ in range(epochs):
        z = np.repeat(b[None], len(fit), axis=0)
        z[row_ids] += np.add.reduceat(w[cols[by_row]], row_first, axis=0)
        p = np.exp(z - z.max(1, keepdims=True))
        gap = (p / p.sum(1, keepdims=True) - y) / len(fit)
        w -= 2.0 * (np.add.reduceat(gap[rows[by_col]], col_first, axis=0) + 1e-4 * w)
        b -= 2.0 * gap.sum(0)
    model = Classifier(families, {g: w[k].astype(float) for g, k in index.items()}, b.astype(float), 1.0)

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return -sum(float(np.log(max(model.probabilities(terms(t))[k], 1e-12))) for t, k in check)

    model.temperature = min((0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    return model


def scan_column(column: pa.Array, model: Classifier) -> tuple[np.ndarray, list[list[tuple[int, str, float]]]]:
    """Paragraphs of each text, and (line, family, probability) of those with a notice."""
    buf = buffer_of(column)
    count = np.zeros(len(buf.start), np.int64)
    found: list[list[tuple[int, str, float]]] = [[] for _ in count]
    for rows in row_groups(buf):
        lo, hi = int(buf.start[rows.start]), int(buf.end[rows.stop - 1])
        breaks = np.flatnonzero(buf.data[lo:hi] == 10) + lo
        w = words_of(buf, rows, LOWER_CODE, NOT_TERM)
        if not len(w):
            continue
        line = np.searchsorted(breaks, w.start)  # counts through the run's texts
        new = np.ones(len(w), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (w.row[1:] != w.row[:-1])
        count[rows] = np.bincount(w.row[new] - rows.start, minlength=rows.stop - rows.start)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(w))
        windows = 1 + np.maximum(0, -(-(last - first - WINDOW) // STRIDE))
        nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = np.repeat(first, windows) + nth * STRIDE
        stop = np.minimum(begin + WINDOW, np.repeat(last, windows))
        p = model.window_probabilities(w, begin, stop)
        best: dict[tuple[int, int, str], float] = {}
        for k in np.flatnonzero(p[:, -1] <= 1 - LEAST).tolist():
            row, a, b = int(w.row[begin[k]]), int(w.start[begin[k]]), int(w.end[stop[k] - 1])
            at = int(line[begin[k]] - np.searchsorted(breaks, buf.start[row]))
            for family, sure in model.notices(buf.data[a:b].tobytes().decode("utf-8", "replace")).items():
                best[row, at, family] = max(sure, best.get((row, at, family), 0.0))
        for (row, at, family), sure in best.items():
            found[row].append((at, family, sure))
    return count, found


def license_notices(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_notices, families, notices (line:family, comma-joined), confidence."""
    model = model or train_classifier()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, found = scan_column(b.column("text"), model)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id"),
                    "n_paragraphs": pa.array(count),
                    "n_notices": pa.array([len(x) for x in found], pa.int64()),
                    "families": pa.array([",".join(sorted({f for _, f, _ in x})) for x in found], pa.string()),
                    "notices": pa.array([",".join(f"{n}:{f}" for n, f, _ in sorted(x)) for x in found], pa.string()),
                    "confidence": pa.array([round(max((p for _, _, p in x), default=0.0), 6) for x in found], pa.float64()),
                }
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(scan, "doc_id long, n_paragraphs long, n_notices long, families string, notices string, confidence double")
