"""Licence scan: a trained paragraph classifier names licence families; template comparison confirms them.

Features are the word n-grams (one to three words) of the templates. A multinomial logistic regression with
classes for unknown licences and for ordinary text learns from the templates, from variants made of them by rule
(cut, with words left out, set in ordinary text), for ``unknown`` from variants whose telling words are replaced by
invented ones, and from paragraphs of the corpus (a bounded number of documents by the order of a hash of their
ids). Two further sets of variants, of known and of unknown licences, calibrate it: the first sets the temperature
of its probabilities, the second the bound under which a family is called ``unknown`` too. A named family must
also agree with one of its templates: the share of the template's word pairs that the paragraph holds is
``confirm`` or more, else it is ``unknown``.

Paragraphs are lines, as the documents break lines between paragraphs, and runs of adjacent lines (blank ones
too), as licences are often wrapped: a run is named if it agrees with a template within twice the template's
words. Every paragraph that could be confirmed is looked at. Those that cannot be are ``unknown`` only if they are
lines with one of the fixed anchor words, which are looked for among the words, whatever marks stand between.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternfield.llm.common import small_batches

#: Fixed texts: short notices, and clauses that tell a family apart.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "SPDX-License-Identifier: MIT",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-nc-sa": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc-nd": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc0": [
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.",
    ],
}
FAMILIES = tuple(TEMPLATES)
UNKNOWN = "unknown"
#: The classes beside the families.
CLASSES = (*FAMILIES, UNKNOWN, "none")
#: Fixed words, one of which stands in every template and in every licence notice.
ANCHORS = ("licen", "copyright", "permission", "redistribut", "public domain", "warranty", "unlicense", "creative commons", "cc by", "cc0", "all rights reserved")
#: Words by which a family is named; variants for the bound have invented ones instead.
TELLING = frozenset("mit apache gnu general lesser bsd clause mozilla cc cc0 by nc sa attribution noncommercial sharealike noderivatives nd isc agpl gpl lgpl mpl affero unlicense unencumbered creative commons free foundation hereby granted redistribution binary waived domain".split())
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(w: list[str], sizes: tuple[int, ...] = (1, 2, 3)) -> set[str]:
    return {" ".join(w[i : i + n]) for n in sizes for i in range(len(w) - n + 1)}


def variants(rng: np.random.Generator, text: list[str], ordinary: list[list[str]], n: int) -> list[list[str]]:
    """n texts made from a template's words."""
    out = []
    for _ in range(n):
        w = list(text)
        if len(w) > 8 and rng.random() < 0.5:
            size = int(rng.integers(max(6, len(w) // 2), len(w) + 1))
            at = int(rng.integers(0, len(w) - size + 1))
            w = w[at : at + size]
        if rng.random() < 0.4:
            w = [x for x in w if x in TELLING or rng.random() > 0.1]
        if ordinary and rng.random() < 0.5:
            o = ordinary[int(rng.integers(len(ordinary)))]
            cut = int(rng.integers(0, min(len(o), 40) + 1))
            w = o[:cut] + w + o[cut : cut + int(rng.integers(0, 20))]
        out.append(w)
    return out


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray  # [feature and bias, class]
    temperature: float
    bound: float

    def probabilities(self, texts: list[list[str]]) -> np.ndarray:
        z = np.tile(self.weights[-1], (len(texts), 1))
        for i, w in enumerate(texts):
            at = [self.vocabulary[g] for g in grams(w) if g in self.vocabulary]
            if at:
                z[i] += self.weights[at].sum(0) / np.sqrt(len(at))
        z /= self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _dense(texts: list[list[str]], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(vocabulary) + 1))
    for i, w in enumerate(texts):
        at = [vocabulary[g] for g in grams(w) if g in vocabulary]
        x[i, at] = 1 / np.sqrt(max(len(at), 1))
    x[:, -1] = 1
    return x


def invent(rng: np.random.Generator, w: list[str]) -> list[str]:
    """The words with each telling one replaced by a word of random letters, the same one each time."""
    fake: dict[str, str] = {}
    for x in w:
        if x in TELLING and x not in fake:
            fake[x] = "".join(chr(97 + int(i)) for i in rng.integers(0, 26, rng.integers(3, 9)))
    return [fake.get(x, x) for x in w]


def train(ordinary: list[str], *, per_template: int = 24, per_check: int = 10, rounds: int = 150, rate: float = 2.0, seed: int = 0) -> Model:
    """The classifier; ``ordinary``: paragraphs that are no licences (those near a template are left out)."""
    rng = np.random.default_rng(seed)
    plain = [w for w in map(words, ordinary) if w and not near_template(w)]
    each = [(k, words(t)) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f]]
    vocabulary = {g: i for i, g in enumerate(sorted({g for _, t in each for g in grams(t)}))}
    made = lambda n: [(v, k) for k, t in each for v in variants(rng, t, plain, n)]
    unknown = lambda n: [invent(rng, v) for _, t in each for v in variants(rng, t, plain, n)]
    sets = [(t, k) for k, t in each for _ in range(3)] + made(per_template) + [(w, len(FAMILIES)) for w in unknown(per_template // 2)] + [(w, len(FAMILIES) + 1) for w in [*plain, *[[]] * 20]]
    x, y = _dense([v for v, _ in sets], vocabulary), np.array([k for _, k in sets])
    w = np.zeros((x.shape[1], len(CLASSES)))
    share = 1 / np.bincount(y, minlength=w.shape[1])[y] / w.shape[1]
    speed = np.zeros_like(w)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        speed = 0.9 * speed - rate * (x.T @ (p * share[:, None]) + 1e-5 * w)
        w += speed
    model = Model(vocabulary, w, 1.0, 0.0)
    first = made(per_check) + [(v, len(FAMILIES)) for v in unknown(per_check)]
    texts, truth = [v for v, _ in first], np.array([k for _, k in first])
    losses = []
    for t in np.geomspace(0.25, 4, 17):
        model.temperature = float(t)
        losses.append((-np.log(model.probabilities(texts)[np.arange(len(truth)), truth] + 1e-12).mean(), t))
    model.temperature = float(min(losses)[1])
    top = lambda ts: model.probabilities(ts)[:, : len(FAMILIES)].max(1)
    known, other = top([v for v, _ in made(per_check)]), top(unknown(per_check))
    errors = [(float((known < c).mean() + (other >= c).mean()), c) for c in np.linspace(0.2, 0.95, 76)]
    model.bound = float(min(errors)[1])
    return model


PAIRS = {f: [(k, grams(words(t), (2,))) for k, t in enumerate(ts)] for f, ts in TEMPLATES.items()}
#: Each template as (family, its word pairs, most words of a run), and the templates of each pair of words.
SHAPES = [(f, {tuple(g.split()) for g in pairs}, 2 * len(words(TEMPLATES[f][k]))) for f, ts in PAIRS.items() for k, pairs in ts]
BY_PAIR = {p: [t for t, (_, pairs, _) in enumerate(SHAPES) if p in pairs] for p in set().union(*(pairs for _, pairs, _ in SHAPES))}


def near_template(w: list[str], share: float = 0.3) -> bool:
    """Whether the words hold that share of the pairs of a template."""
    held = {p for p in zip(w, w[1:], strict=False) if p in BY_PAIR}
    return bool(held) and any(len(held & pairs) >= share * len(pairs) for _, pairs, _ in SHAPES)


def anchored(w: list[str]) -> bool:
    joined = " ".join(w)
    return any(a in joined for a in ANCHORS)


def dense(hits: list[tuple[int, tuple[str, str]]], need: float, most: int) -> list[tuple[int, int]]:
    """(first, last word) of stretches of at most ``most`` words that hold ``need`` or more distinct pairs, best first, none overlapping."""
    found, left, counts = [], 0, Counter()
    for at, pair in hits:
        counts[pair] += 1
        while at + 2 - hits[left][0] > most or counts[hits[left][1]] > 1:
            counts[hits[left][1]] -= 1
            if not counts[hits[left][1]]:
                del counts[hits[left][1]]
            left += 1
        if len(counts) >= need:
            found.append((-len(counts), at + 1 - hits[left][0], hits[left][0], at + 1))
    taken: list[tuple[int, int]] = []
    for _, _, first, last in sorted(found):
        # Stretches overlap only near each other, so the taken ones beside this one decide.
        i = bisect.bisect(taken, (first, last))
        if (i == 0 or taken[i - 1][1] < first) and (i == len(taken) or taken[i][0] > last):
            taken.insert(i, (first, last))
    return taken


def candidates(rows: list[list[str]], confirm: float) -> tuple[set[int], set[tuple[int, int, str]]]:
    """(lines that agree with a template, (first line, last line, family) of runs that do)."""
    w = [x for row in rows for x in row]
    hits: dict[int, list[tuple[int, tuple[str, str]]]] = {}
    for i, p in enumerate(zip(w, w[1:], strict=False)):
        if p in BY_PAIR:
            for t in BY_PAIR[p]:
                hits.setdefault(t, []).append((i, p))
    single, runs, starts = set(), set(), None
    for t, found in hits.items():
        family, pairs, most = SHAPES[t]
        need = confirm * len(pairs)
        if len({p for _, p in found}) < need:
            continue
        if starts is None:
            starts = list(itertools.accumulate(map(len, rows), initial=0))
        by_line: dict[int, set[tuple[str, str]]] = {}
        for i, p in found:
            line = bisect.bisect_right(starts, i) - 1
            if i + 1 < starts[line + 1]:
                by_line.setdefault(line, set()).add(p)
        single |= {line for line, held in by_line.items() if len(held) >= need}
        for first, last in dense(found, need, most):
            a, b = (bisect.bisect_right(starts, i) - 1 for i in (first, last))
            if a < b:
                runs.add((a, b, family))
    return single, runs


def scan(text: str | None, model: Model, *, confirm: float = 0.6) -> list[dict]:
    """The licence paragraphs of a text: first line, family or ``unknown``, probability, closest template of the family, share of it, number of lines."""
    if not text:
        return []
    rows = [words(line) for line in text.split("\n")]
    single, runs = candidates(rows, confirm)
    marked = {i for i, w in enumerate(rows) if anchored(w)} if anchored([x for w in rows for x in w]) else set()
    asked = [(i, i, None) for i in sorted(single | marked)] + sorted(runs)
    if not asked:
        return []
    texts = [[x for w in rows[a : b + 1] for x in w] for a, b, _ in asked]
    lines, joined = [], []
    for (a, b, family), w, p in zip(asked, texts, model.probabilities(texts), strict=True):
        if p[-1] >= 0.5:
            continue
        best = int(p[: len(FAMILIES)].argmax())
        pairs = grams(w, (2,))
        share, k = max((len(pairs & t) / len(t), -k) for k, t in PAIRS[FAMILIES[best]])
        named = bool(p[best] >= model.bound and p[best] >= p[len(FAMILIES)] and share >= confirm)
        row = {"paragraph": a, "family": FAMILIES[best] if named else UNKNOWN, "probability": round(float(p[best]), 6), "template": -k, "share": round(share, 6), "lines": b - a + 1}
        if family is None and (named or a in marked):
            lines.append(row)
        elif named and family == row["family"]:
            joined.append(row)
    out = lines
    taken: set[int] = set()
    for r in sorted(joined, key=lambda r: (-r["share"], r["lines"], r["paragraph"])):
        span = range(r["paragraph"], r["paragraph"] + r["lines"])
        if taken.isdisjoint(span) and not any(x["paragraph"] in span and x["family"] == r["family"] and x["share"] >= r["share"] for x in lines):
            taken.update(span)
            out = [x for x in out if x["paragraph"] not in span or x["lines"] > 1 or x["family"] not in (UNKNOWN, r["family"])] + [r]
    return sorted(out, key=lambda x: (x["paragraph"], x["lines"]))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_documents: int = 400, seed: int = 0) -> Model:
    """The classifier, with ordinary paragraphs, whole ones, from at most ``max_documents`` documents: at most ten times as many, of at most 20,000 characters."""
    order = [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)]
    picked = docs.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(*order).limit(max_documents)
    lines = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).select(F.explode(F.split(text_col, "\n")).alias("t"))
    texts = lines.where((F.trim("t") != "") & (F.length("t") <= 20_000)).orderBy(F.xxhash64("t", F.lit(seed)), "t").limit(10 * max_documents).collect()  # bounded
    return train([r["t"] for r in texts], seed=seed)


SCAN = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("template", pa.int64()), ("share", pa.float64()), ("lines", pa.int64())]))
SCAN_SQL = "array<struct<paragraph:bigint,family:string,probability:double,template:bigint,share:double,lines:bigint>>"


def licences(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "licences", confirm: float = 0.6) -> DataFrame:
    """docs with ``licences``: what scan() finds in each whole text. Null and empty texts have an empty array.

    Every row stays, repeated ones too; a column named like the result is replaced.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != out_col]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t, model, confirm=confirm) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(found, SCAN)], [*rest, out_col])

    return docs.select(*rest).mapInArrow(each, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), f"`{out_col}` {SCAN_SQL}"]))
