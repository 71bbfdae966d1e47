"""Licence scans by a trained paragraph classifier (op3).

A paragraph is a line of text with a word. Paragraphs that hold a cue (a word that some licence template has and prose
of the corpus hardly has) go to a sparse logistic regression over word n-grams (one to three words), one family
against the rest, trained here on the templates under noise, against paragraphs of the corpus and sentences that only
sound like licences. Limits are calibrated on held-out samples of the same kinds, made with other noise and other
paragraphs: each family's is the least probability above which WRONG of its predictions at most are wrong, that of the
unknown class the least probability of any licence that WRONG of the samples without one at most reach. A cued
paragraph whose best family stays below its limit is `unknown` if it reaches the latter, else no licence. A predicted family is confirmed
by comparing the paragraph with the family's templates: it must contain most word pairs of one of them.

Notices are often wrapped, so a cued line that is not confirmed by itself is also scanned with the lines after it, up to
a line without words or one confirmed by itself, or until twice the words of the longest template are reached. The
shortest run of lines that is confirmed is one hit.

The prose for training is a bounded sample: SAMPLE_DOCS rows of at most SAMPLE_CHARS characters, in hash order of
their ids. Every paragraph of every row is then scanned.

Defined results: a null or empty text has no paragraphs and no licences. Families are listed once each, by name.
Rows are scanned on their own; repeated rows get equal results; ties of probability go to the first family by name.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import bounded_sample, slices, table, texts

SAMPLE_DOCS, SAMPLE_CHARS = 300, 20_000
CONFIRM, WRONG, LEAST = 0.6, 0.01, 0.3
#: Noisy copies of each template for training, and for calibration.
NOISE_COPIES, HELD_COPIES = 60, 20
NGRAMS = (1, 2, 3)

#: Usual wordings of licence notices, by family.
TEMPLATES = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License', "SPDX-License-Identifier: Apache-2.0", "released under the Apache 2.0 license"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License", "released under the BSD license", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 2-Clause License"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work", "Released under CC0 1.0 Universal", "dedicated to the public domain under CC0", "SPDX-License-Identifier: CC0-1.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-3.0-or-later", "released under the GPL"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "LGPL": ["licensed under the GNU Lesser General Public License, version 2.1", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "MIT": ["Released under the MIT License", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', "Licensed under the MIT license", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
}
#: Licence notices of no listed family, and sentences that merely sound alike.
OTHER = ["Licensed under the terms of the enclosed license agreement", "distributed under the Artistic License 2.0", "This data is made available under the Open Database License", "released under a custom license, see the license file", "use is governed by the license that comes with the product"]
ALIKE = ["the driver must hold a valid license", "the city issued a business license to the shop", "she wrote a version of the public report", "the general public may use the work", "students at mit published the work", "apache helicopters are used", "the software was released in the source form", "copying the file is free of charge", "the rights of the public", "a license plate was found on the road"]

WORDS = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*").findall


def words(paragraph: str) -> list[str]:
    return WORDS(paragraph.lower())


def features(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + n]) for n in NGRAMS for i in range(len(ws) - n + 1)}


def pairs(ws: list[str]) -> set[tuple[str, ...]]:
    return set(zip(ws, ws[1:], strict=False)) or {tuple(ws)}


class Scanner:
    """The classifier, its limits and the templates to compare with."""

    def __init__(self, prose: list[str]):
        rng = np.random.default_rng(3)
        self.families = sorted(TEMPLATES)
        filler = [w for p in prose[:2000] for w in words(p)] or ["the", "of", "work", "text"]
        common = Counter(w for p in prose for w in set(words(p)))
        cued = {w for ts in [*TEMPLATES.values(), OTHER] for t in ts for w in words(t)}
        often = max(3, 0.002 * len(prose))
        self.cues = frozenset(w for w in cued if len(w) > 2 and common[w] < often and not w.isdigit())
        samples: list[tuple[set[str], str]] = []
        held: list[tuple[set[str], str]] = []
        for label, notes in [*TEMPLATES.items(), ("unknown", OTHER), ("none", ALIKE)]:
            for note in notes:
                ws = words(note)
                for copy in range(NOISE_COPIES + HELD_COPIES):
                    kept = [w for w in ws if rng.random() > 0.08] or ws
                    pad = [[filler[k] for k in rng.integers(0, len(filler), rng.integers(0, 9))] for _ in range(2)]
                    (samples if copy < NOISE_COPIES else held).append((features([*pad[0], *kept, *pad[1]]), label))
        samples += [(features(words(p)), "none") for p in prose[:1500] if words(p)]
        held += [(features(words(p)), "none") for p in prose[1500:3000] if words(p)]
        df = Counter(f for fs, _ in samples for f in fs)
        place = {f: i for i, f in enumerate(sorted(f for f, k in df.items() if k >= 4))}
        self.labels = [*self.families, "unknown", "none"]
        self.weights, self.bias = self._train([[place[f] for f in fs if f in place] for fs, _ in samples], np.array([self.labels.index(y) for _, y in samples]), len(place), rng)
        used = np.flatnonzero(np.abs(self.weights).max(axis=1) > 0.02)  # sparse: small weights go
        names = sorted(place)
        self.place = {names[i]: k for k, i in enumerate(used)}
        self.weights = self.weights[used]
        self._calibrate(held)
        self.reach = 2 * max(len(words(t)) for ts in TEMPLATES.values() for t in ts)
        self.known = {f: [pairs(words(t)) for t in TEMPLATES[f]] for f in self.families}

    def _train(self, rows: list[list[int]], y: np.ndarray, size: int, rng) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.labels)
        w, b, past = np.zeros((size, k)), np.zeros(k), np.full((size, k), 1e-8)
        for _ in range(6):
            for i in rng.permutation(len(rows)):
                at = rows[i]
                z = b + w[at].sum(axis=0) / max(1, len(at)) ** 0.5
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                g = np.repeat(p[None] / max(1, len(at)) ** 0.5, len(at), axis=0)
                past[at] += g * g
                step = 0.5 / np.sqrt(past[at])
                new = w[at] - step * g
                w[at] = np.sign(new) * np.maximum(np.abs(new) - 1e-4 * step, 0)
                b -= 0.05 * p
        return w, b

    def probabilities(self, found: Iterable[str]) -> np.ndarray:
        at = [self.place[f] for f in found if f in self.place]
        z = self.bias + self.weights[at].sum(axis=0) / max(1, len(at)) ** 0.5
        p = np.exp(z - z.max())
        return p / p.sum()

    def _calibrate(self, held: list[tuple[set[str], str]]) -> None:
        """Sets limits, by family, and the limit of the unknown class."""
        p = np.array([self.probabilities(fs) for fs, _ in held])
        best = p[:, :-2].argmax(axis=1)
        top = p[np.arange(len(p)), best]
        right = np.array([y == self.families[b] for (_, y), b in zip(held, best.tolist(), strict=True)])
        self.limits = {}
        for k, family in enumerate(self.families):
            own = best == k
            order = np.argsort(-top[own], kind="stable")
            wrong = np.cumsum(~right[own][order])
            fine = np.flatnonzero(wrong <= WRONG * np.arange(1, len(order) + 1))
            self.limits[family] = max(LEAST, float(top[own][order][fine[-1]])) if len(fine) else 1.0
        none = np.array([y == "none" for _, y in held])
        self.unknown = max(0.5, float(np.quantile(1 - p[none, -1], 1 - WRONG, method="higher"))) if none.any() else 0.9

    def scan(self, paragraph: str) -> tuple[str, float, float] | None:
        """Family or `unknown`, probability, and likeness to the best template; None for no licence."""
        return self.judge(words(paragraph))

    def judge(self, ws: list[str]) -> tuple[str, float, float] | None:
        if self.cues.isdisjoint(ws):
            return None
        # Only the words around cues can belong to a notice.
        hits = [i for i, w in enumerate(ws) if w in self.cues]
        near = ws[max(0, hits[0] - 6) : hits[-1] + 30]
        p = self.probabilities(features(near))
        own = pairs(near)
        best = int(p[:-2].argmax())
        like = max(len(t & own) / len(t) for t in self.known[self.families[best]])
        if p[best] >= self.limits[self.families[best]] and like >= CONFIRM:
            return self.families[best], float(p[best]), like
        if 1 - p[-1] > self.unknown and len(set(hits)) >= 2:
            return "unknown", float(1 - p[-1]), like
        return None

    def notices(self, lines: list[str], cue) -> list[tuple[int, int, str, float, float]]:
        """First and last line, and what scan gives, of each notice; only lines in which cue finds something can begin one."""
        cued = {i: ws for i, line in enumerate(lines) if len(line) >= 3 and cue(line.lower()) and not self.cues.isdisjoint(ws := words(line))}
        single = {i: self.judge(ws) for i, ws in cued.items()}
        sure = {i for i, got in single.items() if got and got[0] != "unknown"}
        hits, done = {i: (i, i, *single[i]) for i in sure}, -1
        for i in cued:
            if i <= done or i in sure:
                continue
            run, last = [cued[i]], i
            while last + 1 < len(lines) and last + 1 not in sure and sum(map(len, run)) < self.reach and (ws := words(lines[last + 1])):
                run.append(ws)
                last += 1
            if (found := self._wrapped(run)) is not None:
                a, b, got = found
                done = i + b
                hits[i + a] = (i + a, i + b, *got)
                for k in range(i, i + a):
                    if single.get(k):
                        hits[k] = (k, k, *single[k])
            elif single[i]:
                hits[i] = (i, i, *single[i])
        return [hits[i] for i in sorted(hits)]

    def _wrapped(self, run: list[list[str]]) -> tuple[int, int, tuple[str, float, float]] | None:
        """The first confirmed run of two lines or more, from its last line that can begin it to the first that can end it."""
        every = pairs([w for ws in run for w in ws])
        if len(run) < 2 or not any(len(t & every) >= CONFIRM * len(t) for ts in self.known.values() for t in ts):
            return None
        for b in range(1, len(run)):
            got = self.judge([w for ws in run[: b + 1] for w in ws])
            if got and got[0] != "unknown":
                for a in range(b - 1, 0, -1):
                    less = self.judge([w for ws in run[a : b + 1] for w in ws])
                    if less and less[0] == got[0] and less[2] >= got[2]:
                        return a, b, less
                return 0, b, got
        return None


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scanner:
    """Fit with prose from a bounded sample of docs."""
    rows = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS)).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    found = bounded_sample(rows, None, ["key", "text"], SAMPLE_DOCS).collect()
    lines = [p for r in sorted(found, key=lambda r: (str(r.key), r.text)) for p in r.text.split("\n")]
    return Scanner([p for p in lines if p.strip() and not re.search(r"licen[sc]e|copyright", p, re.I)])


def scan_licences(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_paragraphs, found: array of (start, end, family, probability, likeness), offsets in code points."""
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    shared = source.sparkSession.sparkContext.broadcast(scanner)  # bounded by the templates and the sample
    hit = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cue = re.compile("|".join(sorted({c[:3] for c in own.cues}))).search
        for part in slices(batches, "text"):
            counts, found = [], []
            for t in texts(part, "text"):
                lines = t.split("\n")
                at = [0, *itertools.accumulate(len(line) + 1 for line in lines)]
                hits = [{"start": at[i], "end": at[j + 1] - 1, "family": f, "probability": p, "likeness": like} for i, j, f, p, like in own.notices(lines, cue)]
                counts.append(sum(bool(line.strip()) for line in lines))
                found.append(hits)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(hit))], ["key", "n_paragraphs", "found"])

    kind = source.schema["key"].dataType.simpleString()
    out = source.mapInArrow(run, f"key {kind}, n_paragraphs long, found array<struct<start:int,end:int,family:string,probability:double,likeness:double>>")
    return out.withColumnRenamed("key", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_licences(docs, fit(docs))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda h: h["family"])))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("long").alias("n_licence_paragraphs"),
        F.array_join(families, ",").alias("families"),
        F.coalesce(F.array_max(F.transform("found", lambda h: h["probability"])), F.lit(0.0)).alias("score"),
    )
