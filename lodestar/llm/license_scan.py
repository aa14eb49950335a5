"""Licence scan with a trained paragraph classifier (operator 8).

A multinomial logistic regression over sparse word 1-grams and 2-grams tells the licence
families of a paragraph, with two more classes: prose, learned from a bounded sample of the
corpus, and ``unknown``, licence talk of no known family. It learns from the templates and from
other wording (``WORDING``); its temperature is calibrated, and its accuracy measured, on
wording that it never saw (``HELD_OUT``) and on held-out prose. A family below ``sure`` counts as unknown. A predicted family is confirmed
only if the text covers a template of it, or a template covers the text and that has ``LEAST``
different words or more; words count by how few families have them, so that neither common
licence talk nor a mere name is enough. What isn't confirmed is ``unknown`` if it covers a
template's words as such, and prose otherwise.

A paragraph is the lines between lines without words. Its lines are read each, and if there
are several, all together; text of over ``WIDE`` words is read in windows that overlap by half.
Null text has no paragraphs. Every paragraph of every document is scored. Rows that repeat are
each answered, alike; of classes that tie the first one wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Blocks, slices, utf8
from .decontaminate import folded_words

WIDE, LEAST = 64, 8
UNKNOWN, PROSE = "unknown", "prose"

# fixed values: public wording by which works name their licence
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This software is released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU GPL version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal, dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"),
    "All-Rights-Reserved": ("All rights reserved.", "No part of this publication may be reproduced without written permission of the copyright holder."),
    UNKNOWN: (
        "Licensed under the terms of our proprietary agreement.",
        "This work is licensed under a custom license, see the publisher for its terms.",
        "Released under the Example Community License.",
        "Use is subject to license terms.",
        "Licensed to subscribers only under the site terms.",
    ),
}


# fixed values: other sentences in which works name their licence, to learn from
WORDING = {
    "MIT": ("Distributed under the MIT licence; see the file LICENSE.", "MIT licensed.", "The code is available under the MIT license.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "Apache-2.0": ("Distributed under the Apache 2.0 licence.", "Apache License, Version 2.0, January 2004", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "GPL-3.0": ("Licensed under the GPLv3.", "You should have received a copy of the GNU General Public License version 3 along with this program.", "This is free software under the GNU GPL v3 or later."),
    "GPL-2.0": ("Licensed under the GPLv2.", "This file is under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation.", "Distributed under the GNU GPL version 2."),
    "LGPL": ("Licensed under the LGPL.", "Distributed under the GNU LGPL version 2.1.", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    "AGPL-3.0": ("Licensed under the AGPLv3.", "You should have received a copy of the GNU Affero General Public License along with this program.", "Released under the GNU AGPL version 3."),
    "BSD": ("BSD licensed.", "Use of this source code is governed by a BSD-style license.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "MPL-2.0": ("Distributed under the MPL 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Covered by the Mozilla Public License, version 2.0."),
    "CC-BY": ("Published under Creative Commons Attribution 4.0.", "Text available under the Creative Commons Attribution license.", "CC BY 4.0"),
    "CC-BY-SA": ("Published under Creative Commons Attribution-ShareAlike 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "CC BY-SA 4.0"),
    "CC-BY-NC": ("Published under Creative Commons Attribution-NonCommercial 4.0.", "Available under the Creative Commons Attribution-NonCommercial license.", "CC BY-NC 4.0"),
    "CC0": ("Published under Creative Commons Zero.", "CC0 1.0 Universal Public Domain Dedication", "The author has dedicated the work to the public domain by waiving all rights under CC0."),
    "ISC": ("Distributed under the ISC licence.", "ISC licensed.", "Provided under the terms of the ISC License."),
    "Unlicense": ("Distributed under the Unlicense.", "For more information, please refer to http://unlicense.org", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose."),
    "All-Rights-Reserved": ("Copyright by the author, all rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "All content is protected by copyright; all rights reserved."),
    UNKNOWN: ("See the license agreement for the terms.", "This content is licensed under the terms of the vendor agreement.", "Licensed for internal evaluation use only.", "Free for personal use under the site license."),
}

# fixed values: sentences that are never learned from
HELD_OUT = {
    "MIT": ("This package is MIT licensed, see LICENSE.", "Provided under the terms of the MIT License."),
    "Apache-2.0": ("The project is licensed under Apache License 2.0.", "This file is distributed under the Apache License, Version 2.0."),
    "GPL-3.0": ("This software is licensed under the GNU General Public License version 3.", "Available under GPLv3 or later."),
    "GPL-2.0": ("This driver is licensed under the GNU General Public License version 2.", "Available under GPLv2."),
    "LGPL": ("The library is released under the GNU Lesser General Public License.", "Available under the LGPL."),
    "AGPL-3.0": ("This server is released under the GNU Affero General Public License version 3.", "Available under the AGPLv3."),
    "BSD": ("This tool is released under the BSD license.", "Licensed under the 3-clause BSD License."),
    "MPL-2.0": ("The add-on is released under the Mozilla Public License, version 2.0.", "Available under the MPL 2.0."),
    "CC-BY": ("The images are licensed under a Creative Commons Attribution 4.0 license.", "Licensed CC BY 4.0."),
    "CC-BY-SA": ("Articles are licensed under a Creative Commons Attribution-ShareAlike 4.0 license.", "Licensed CC BY-SA 4.0."),
    "CC-BY-NC": ("Photos are licensed under a Creative Commons Attribution-NonCommercial 4.0 license.", "Licensed CC BY-NC 4.0."),
    "CC0": ("The data are released under CC0 1.0 Universal.", "To the extent possible under law, all copyright is waived under CC0."),
    "ISC": ("This module is ISC licensed.", "Available under the ISC License."),
    "Unlicense": ("This script is released into the public domain under the Unlicense.", "Free and unencumbered software, see the Unlicense."),
    "All-Rights-Reserved": ("Copyright 2019 the publisher. All rights reserved.", "No part of this work may be copied without written permission of the publisher."),
    UNKNOWN: ("Use is governed by the vendor license agreement.", "Licensed under the terms of the community agreement of the site."),
}


def _features(words: np.ndarray, bounds: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, is a 1-gram) of the known 1-grams and 2-grams of rows given by bounds in words."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    two = Blocks(words).every(2)
    same = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    rows, codes, single = np.r_[row, row[:-1][same]] if len(row) else row, np.r_[words, two[same]] if len(row) else words, np.r_[np.ones(len(words), bool), np.zeros(int(same.sum()), bool)]
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    ok = known[at] == codes
    return rows[ok], at[ok], single[ok]


class Classifier:
    """Weights by feature and class, a temperature, and the templates' words."""

    def __init__(self, prose: list[str], sure: float = 0.6, seed: int = 5):
        self.sure = sure
        self.classes = [*TEMPLATES, PROSE]
        rng = np.random.default_rng(seed)
        texts, labels, held = [], [], []

        def add(text: str, label: int, unseen: bool) -> None:
            texts.append(text)
            labels.append(label)
            held.append(unseen)

        # every fifth line of prose is held out, and so are its words as filler
        learned = [p for k, p in enumerate(prose) if k % 5]
        filler = [w for p in learned for w in p.split()] or ["lorem", "ipsum"]
        for k, name in enumerate(self.classes[:-1]):
            for sentence in (*TEMPLATES[name], *WORDING[name]):
                own = sentence.split()
                for copy in range(24):
                    w = [x for x in own if copy == 0 or rng.random() > 0.08]
                    if copy % 3 == 1:
                        w = [*rng.choice(filler, 4), *w]
                    if copy % 3 == 2:
                        w = [*w, *rng.choice(filler, 4)]
                    add(" ".join(w), k, False)
            for sentence in HELD_OUT[name]:
                add(sentence, k, True)
        for k, p in enumerate(prose):
            add(p, len(self.classes) - 1, not k % 5)
        y, held = np.array(labels), np.array(held)
        words, bounds = folded_words(*utf8(pa.array(texts, pa.string())))
        known_as = [(k, t) for k, name in enumerate(TEMPLATES) for t in (*TEMPLATES[name], *WORDING[name])]
        template_words, template_bounds = folded_words(*utf8(pa.array([t for _, t in known_as], pa.string())))
        two = Blocks(template_words).every(2)
        # features: what the templates hold
        self.known = np.unique(np.r_[template_words, two])
        self.templates = [set(template_words[a:b].tolist()) for a, b in zip(template_bounds[:-1], template_bounds[1:], strict=True)]
        self.family = [k for k, _ in known_as]
        having: dict[int, set[int]] = {}
        for k, t in zip(self.family, self.templates, strict=True):
            for w in t:
                having.setdefault(w, set()).add(k)
        self.rarest = float(np.log(len(TEMPLATES) + 1))
        self.rarity = {w: float(np.log((len(TEMPLATES) + 1) / len(f))) for w, f in having.items()}
        row, col, _ = _features(words, bounds, self.known)
        x = np.zeros((len(texts), len(self.known) + 1))
        x[row, col] = 1
        x[:, -1] = 1
        x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        w = np.zeros((x.shape[1], len(self.classes)))
        goal = np.eye(len(self.classes))[y]
        weight = 1 / np.bincount(y, minlength=len(self.classes))[y]
        weight /= weight[~held].sum()
        speed = np.zeros_like(w)
        for _ in range(300):
            p = _softmax(x[~held] @ w)
            speed = 0.9 * speed - 30.0 * (x[~held].T @ ((p - goal[~held]) * weight[~held, None]) + 1e-5 * w)
            w = w + speed
        logits = x[held] @ w
        truth = y[held]
        temperatures = np.geomspace(0.02, 4, 60)
        # each class counts alike, however many held-out lines it has
        share = 1 / np.bincount(truth, minlength=len(self.classes))[truth]
        loss = [-(share * np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12))).sum() for t in temperatures]
        self.temperature = float(temperatures[int(np.argmin(loss))])
        self.accuracy = float((share * (logits.argmax(axis=1) == truth)).sum() / share.sum())
        self.weights = w

    def predict(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and calibrated probability of each row; prose where nothing is known of it."""
        row, col, _ = _features(words, bounds, self.known)
        key = np.unique(row * len(self.weights) + col)
        row, col = key // len(self.weights), key % len(self.weights)
        used, at = np.unique(row, return_inverse=True)
        label, sure = np.full(len(bounds) - 1, len(self.classes) - 1), np.ones(len(bounds) - 1)
        if len(used):
            logits = np.tile(self.weights[-1], (len(used), 1))
            np.add.at(logits, at, self.weights[col])
            p = _softmax(logits / np.sqrt(np.bincount(at) + 1)[:, None] / self.temperature)
            label[used], sure[used] = p.argmax(axis=1), p.max(axis=1)
        return label, sure

    def confirmed(self, family: int, words: np.ndarray) -> float:
        """The best cover of a template of the family by the text's words, or of a longer text's by the template's, rare words counting more."""
        own = set(words.tolist())
        size = lambda some: sum(self.rarity.get(w, self.rarest) for w in some)
        weight = size(own)
        return max(size(own & t) / (min(size(t), weight) if len(own) >= LEAST else size(t)) for t, k in zip(self.templates, self.family, strict=True) if k == family)

    def licence_talk(self, family: int, words: np.ndarray) -> float:
        """The best cover of a template of the family, or of the unknown one, by the text's words, all alike."""
        own = set(words.tolist())
        return max(len(own & t) / len(t) for t, k in zip(self.templates, self.family, strict=True) if k in (family, self.classes.index(UNKNOWN)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def paragraphs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, bounds of the lines in words, each one's document and its paragraph; every document has a line at least."""
    cut = np.unique(np.r_[np.nonzero(data == 10)[0], off])
    words, bounds = folded_words(data, cut.astype(np.int64))
    doc = np.searchsorted(off, cut[:-1], side="right") - 1
    empty = np.diff(bounds) == 0
    new = empty.copy()
    new[:1] = True
    new[1:] |= empty[:-1] | (doc[1:] != doc[:-1])
    return words, bounds, doc, np.cumsum(new) - 1


def _windows(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which text, first word and end of the windows over texts."""
    pieces = np.maximum(1, -(-(hi - lo - WIDE // 2) // (WIDE // 2)))
    which = np.repeat(np.arange(len(lo)), pieces)
    at = lo[which] + (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * (WIDE // 2)
    return which, at, np.minimum(at + WIDE, hi[which])


def train(docs: DataFrame, prose_rows: int = 2000, sure: float = 0.6) -> Classifier:
    """Prose comes from the first lines of about ``prose_rows`` documents, chosen by a hash of their id."""
    usable = docs.filter(F.col("text").isNotNull())
    share = min(1.0, prose_rows / max(usable.count(), 1))
    sample = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).select("doc_id", F.substring_index("text", "\n", 1).alias("text")).collect()
    lines = [" ".join(r.text.split()[:WIDE]) for r in sorted(sample, key=lambda r: (r.doc_id is None, r.doc_id, r.text))]
    return Classifier([x for x in lines if x and not any(w in x.lower() for w in ("licen", "copyright", "spdx", "permission"))], sure)


def scan(docs: DataFrame, model: Classifier, cover: float = 0.75) -> DataFrame:
    """doc_id, licences (families, sorted, comma-joined; empty: none), n_paragraphs that name one, and found:
    array of (paragraph, family, probability, cover)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("cover", pa.float64())]))
        for batch in batches:
            data, off = utf8(batch.column(1))
            for a, b in slices(off):
                words, bounds, doc, group = paragraphs(data[off[a] : off[b]], off[a : b + 1] - off[a])
                found: list[list] = [[] for _ in range(b - a)]
                head = np.nonzero(np.r_[True, group[1:] != group[:-1]])[0] if len(group) else np.zeros(0, np.int64)
                last = np.r_[head[1:], len(group)] if len(group) else head
                many = np.nonzero(last - head > 1)[0]
                # lines first, then the paragraphs of several
                which, lo, hi = _windows(np.r_[bounds[:-1], bounds[head[many]]], np.r_[bounds[1:], bounds[last[many]]])
                part = np.r_[group, many][which]
                joined = which >= len(group)
                count = np.maximum(hi - lo, 0)
                at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                label, p = model.predict(words[at], np.r_[0, np.cumsum(count)])
                first = group[np.minimum(np.searchsorted(doc, np.arange(b - a)), len(group) - 1)] if len(group) else group
                named: set[int] = set()
                for k in np.nonzero(label != len(model.classes) - 1)[0]:
                    own = words[lo[k] : hi[k]]
                    family = int(label[k])
                    name = model.classes[family] if p[k] >= model.sure else UNKNOWN
                    got = model.confirmed(family, own) if name != UNKNOWN else 0.0
                    if got < cover:
                        name, got = UNKNOWN, model.licence_talk(family, own)
                    if got >= cover:
                        # a paragraph of known families isn't of an unknown one because its lines are mixed
                        if joined[k] and name == UNKNOWN and int(part[k]) in named:
                            continue
                        if name != UNKNOWN:
                            named.add(int(part[k]))
                        d = int(doc[head[part[k]]])
                        entry = {"paragraph": int(part[k] - first[d]), "family": name, "probability": float(p[k]), "cover": float(got)}
                        if all((e["paragraph"], e["family"]) != (entry["paragraph"], name) for e in found[d]):
                            found[d].append(entry)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([",".join(sorted({e["family"] for e in f})) for f in found], pa.string()), pa.array([len({e["paragraph"] for e in f}) for f in found], pa.int64()), pa.array(found, kind)], ["doc_id", "licences", "n_paragraphs", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, licences string, n_paragraphs long, found array<struct<paragraph:int,family:string,probability:double,cover:double>>")
