"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Notices are often hard-wrapped, so what is judged is every run of neighbouring lines, up
to one and a half times the length of the longest template, that no blank line (or line
without words, as in a comment) interrupts. Lines are cut into pieces of 12 words for
this, so a notice is found within a long line as well; a line longer than a run is also
judged as a whole. A sparse logistic regression over word n-grams (words and word pairs)
gives each run the probability of each licence family or of none; it is trained on
variations of the templates below and on prose that only resembles them, and calibrated
on templates and prose held out whole. A run is of a family when its calibrated
probability reaches the level at which no held-out prose is taken for a licence, and when
it shares enough words with a template of that family; otherwise it is unknown. Of
families of the same probability the first by name is taken.

The model is small and made on the driver from the fixed texts below, so it is the same
for all data. Texts are judged by Column expressions alone, without a shuffle. As a
prediction must be confirmed by a template, a run that holds too little of every template
is unknown without being scored, and so is one without any of `marks`, as the share of a
template that confirms must hold one of them. Whole texts are read, whatever their length. Null and empty texts
have no licence; null ids and repeated rows are carried; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence families and short notices of each, as they are commonly written.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Released under the Creative Commons CC0 1.0 Universal public domain dedication.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright 2020 Example Company. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Prose with the words of licences that grants or reserves nothing.
PROSE = [
    "He renewed the driving license at the office under the bridge.",
    "The license plate of the car was hard to read in the dark.",
    "All people are born free and equal in dignity and rights.",
    "The general public was invited to the version of the play that was released in May.",
    "Seats in the first row are reserved for guests of the foundation.",
    "The software was tested by the public and the source of the error was found.",
    "She studied at MIT before she moved to the Apache reservation.",
    "A permission slip is needed to use the library without restriction of time.",
    "The creative commons of the village is open to all, free of charge.",
    "The terms of the agreement were published as a work in progress.",
    "Version two of the plan was licensed to nobody and released by no one.",
    "This work is the best of the year and the following conditions are rare.",
    "The wildebeest, or gnu, moves in a general direction with the herd.",
    "No rights were mentioned and all copies were provided with a cover.",
    "They may redistribute the food to any person in the house.",
]
#: Frequent words, which `marks` takes last. They decide how many runs are looked at, not the result.
COMMON = set("a all and any are as at be by can code copy deal except file files for form forms free following found general in is it later may not of only or person program provided public published released software source style subject terms that the this to under use v version via with without work you".split())
PIECE = 12
UNKNOWN = "unknown"
FAMILIES = sorted(TEMPLATES)
_BREAK, _NO_WORD = "\r\n|\n|\r", "[^a-z0-9]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams_of(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def marks(confirm: float) -> list[str]:
    """Words of which any share `confirm` of the words of any template holds one."""
    found = set()
    for t in (t for f in FAMILIES for t in TEMPLATES[f]):
        words = sorted(set(words_of(t)), key=lambda w: (w.isdigit(), w in COMMON, -len(w), w))
        found |= set(words[: len(words) - math.ceil(confirm * len(words) - 1e-9) + 1])
    return sorted(found)


#: Words after which a run is not made longer.
LONGEST = max(len(words_of(t)) for ts in TEMPLATES.values() for t in ts) * 3 // 2


def _fit(samples: list[tuple[int, list[str]]], steps: int, rate: float, decay: float) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Vocabulary, weights and biases of the logistic regression; the l1 step keeps the weights sparse."""
    seen = Counter(g for _, w in samples for g in grams_of(w))
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 3))}
    x, y = _matrix(samples, vocabulary), np.eye(len(FAMILIES) + 1, dtype=np.float32)[[k for k, _ in samples]]
    theta, bias = np.zeros((len(vocabulary), y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    for _ in range(steps):
        slope = (_softmax(x @ theta + bias) - y) / np.float32(len(y))
        theta -= rate * 4 * (x.T @ slope)
        theta = np.sign(theta) * np.maximum(np.abs(theta) - rate * decay, 0)
        bias -= rate * 4 * slope.sum(axis=0)
    return vocabulary, theta, bias


def _matrix(samples: list[tuple[int, list[str]]], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(samples), len(vocabulary)), np.float32)
    for row, (_, w) in enumerate(samples):
        for g in grams_of(w):
            if g in vocabulary:
                x[row, vocabulary[g]] = 1
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@functools.cache
def model(seed: int = 5, variations: int = 60, steps: int = 300, rate: float = 0.5, decay: float = 2e-3, folds: int = 3) -> tuple[dict[str, list[float]], list[float], float]:
    """n-gram -> weights per class (families, then unknown); biases; the calibrated level.

    Calibration holds out whole templates and whole lines of prose, with all their
    variations: what the model of the other folds says of them gives the temperature by
    which scores are divided, and the level that no held-out prose reaches.
    """
    rng = np.random.default_rng(seed)
    filler = [w for p in PROSE for w in words_of(p)]

    def varied(text: str) -> list[str]:
        words = [w for w in words_of(text) if rng.random() > 0.06]
        around = [filler[i] for i in rng.integers(len(filler), size=rng.integers(0, 5))]
        return around + words if rng.random() < 0.5 else words + around

    sources = [(FAMILIES.index(f), t, variations // len(TEMPLATES[f])) for f in FAMILIES for t in TEMPLATES[f]]
    sources += [(len(FAMILIES), p, variations * len(FAMILIES) // len(PROSE)) for p in PROSE]
    samples = [[(k, varied(t)) for _ in range(n)] for k, t, n in sources]
    logits, truth = [], []
    for fold in range(folds):
        held = [s for i, group in enumerate(samples) if i % folds == fold for s in group]
        vocabulary, theta, bias = _fit([s for i, group in enumerate(samples) if i % folds != fold for s in group], steps, rate, decay)
        logits.append(_matrix(held, vocabulary) @ theta + bias)
        truth += [k for k, _ in held]
    z, truth = np.concatenate(logits), np.array(truth)
    heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), truth] + 1e-12).sum())
    prose = _softmax(z / heat)[truth == len(FAMILIES), :-1].max(axis=1)
    level = float(min(max(0.5, round(float(prose.max()), 4)), 0.9))
    vocabulary, theta, bias = _fit([s for group in samples for s in group], steps, rate, decay)
    weights = {g: [round(float(v), 4) for v in theta[i] / heat] for g, i in vocabulary.items() if np.abs(theta[i]).max() > 0.05}
    return weights, [round(float(b), 4) for b in bias / heat], level


def _shared(words: Column, family: str) -> Column:
    """The largest share of a template's words that the paragraph has, over the family's templates."""
    shares = []
    for t in TEMPLATES[family]:
        wanted = sorted(set(words_of(t)))
        shares.append(F.size(F.array_intersect(words, F.array(*map(F.lit, wanted)))) / F.lit(float(len(wanted))))
    return shares[0] if len(shares) == 1 else F.greatest(*shares)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value; as a lambda's variable it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _judged(words: Column, confirm: float) -> Column:
    """A struct of family, probability and share of the template for a run of words."""
    weights, biases, level = model()
    table = F.create_map(*[v for g, w in weights.items() for v in (F.lit(g), F.array(*map(F.lit, w)))])
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    grams = F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.contains(" "))))
    start = F.array(*map(F.lit, biases))
    found = F.filter(F.transform(grams, lambda g: F.try_element_at(table, g)), lambda w: w.isNotNull())
    logits = F.aggregate(found, start, lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b))

    def decided(z: Column) -> Column:
        top = F.array_max(z)
        p = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        family = F.element_at(F.array(*map(F.lit, [*FAMILIES, UNKNOWN])), F.array_position(z, top).cast("int"))
        return F.struct(family.alias("family"), p.alias("probability"))

    def confirmed(shares: Column) -> Column:
        def one(d: Column) -> Column:
            share = functools.reduce(lambda rest, k: F.when(d["family"] == FAMILIES[k], F.element_at(shares, k + 1)).otherwise(rest), range(len(FAMILIES)), F.lit(0.0))
            sure = (d["family"] != UNKNOWN) & (d["probability"] >= level) & (share >= confirm)
            return F.struct(F.when(sure, d["family"]).otherwise(F.lit(UNKNOWN)).alias("family"), d["probability"].alias("probability"), share.alias("share"))

        nothing = F.struct(F.lit(UNKNOWN).alias("family"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("share"))
        return F.when(F.array_max(shares) >= confirm, _let(_let(logits, decided), one)).otherwise(nothing)

    return _let(F.array(*[_shared(words, f) for f in FAMILIES]), confirmed)


def _runs(lines: Column, wanted: Column) -> Column:
    """Of lines of words, the runs that hold a wanted word: structs of first and last line and the words."""

    def piece(line: Column, words: Column) -> Column:
        return F.struct(line.alias("line"), words.alias("words"), F.size(words).alias("n"), F.arrays_overlap(words, wanted).alias("mark"))

    def cut(ws: Column, line: Column) -> Column:
        last = F.floor(F.greatest(F.size(ws) - 1, F.lit(0)) / PIECE).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: _let(F.slice(ws, k * PIECE + 1, PIECE), lambda words: piece(line, words)))

    def grown(s: Column) -> Column:
        """All runs from the first piece of s on."""
        # How many pieces come before a blank one, and before the words are enough.
        more = lambda acc, p: F.when(acc["open"] & (acc["n"] < LONGEST) & (p["n"] > 0), F.struct((acc["k"] + 1).alias("k"), (acc["n"] + p["n"]).alias("n"), F.lit(True).alias("open"), (acc["mark"] | p["mark"]).alias("mark"))).otherwise(F.when(acc["open"], F.struct(acc["k"].alias("k"), acc["n"].alias("n"), F.lit(False).alias("open"), acc["mark"].alias("mark"))).otherwise(acc))
        none = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(True).alias("open"), F.lit(False).alias("mark"))
        run = lambda t: F.struct(F.element_at(t, 1)["line"].alias("first"), F.element_at(t, -1)["line"].alias("last"), F.flatten(F.transform(t, lambda p: p["words"])).alias("words"))
        marked = lambda k: F.when(F.exists(F.slice(s, 1, k), lambda p: p["mark"]), run(F.slice(s, 1, k)))
        return _let(F.aggregate(s, none, more), lambda end: F.when(end["mark"], F.filter(F.transform(F.sequence(F.lit(1), end["k"]), marked), lambda r: r.isNotNull())))

    def of(pieces: Column) -> Column:
        near = lambda s: F.when(F.exists(s, lambda p: p["mark"]), grown(s))
        starts = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: _let(F.slice(pieces, i, LONGEST), near))
        return F.flatten(F.filter(starts, lambda r: r.isNotNull()))

    long = F.filter(F.transform(lines, lambda ws, i: F.struct(i.alias("first"), i.alias("last"), ws.alias("words"))), lambda r: (F.size(r["words"]) > LONGEST) & F.arrays_overlap(r["words"], wanted))
    return F.concat(_let(F.flatten(F.transform(lines, cut)), of), long)


def _disjoint(found: Column) -> Column:
    """How many of the runs found share no line with another of their family, at most."""

    def step(acc: Column, r: Column) -> Column:
        free = (r["family"] != acc["family"]) | (r["first"] > acc["last"])
        return F.when(free, F.struct(r["family"].alias("family"), r["last"].alias("last"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    by_end = F.array_sort(F.transform(found, lambda j: F.struct(j["family"].alias("family"), j["last"].alias("last"), j["first"].alias("first"))))
    none = F.struct(F.lit("").alias("family"), F.lit(-1).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(by_end, none, step, lambda acc: acc["n"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confirm: float = 0.7) -> DataFrame:
    """One row per row of docs: doc_id, licence (its families, comma-separated, or null), n_paragraphs (disjoint runs found), probability (the highest)."""
    any_mark = f"(?<![a-z0-9])(?:{'|'.join(marks(confirm))})(?![a-z0-9])"
    wanted = F.array(*map(F.lit, marks(confirm)))
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = F.transform(F.split(text, _BREAK), lambda p: F.filter(F.split(p, _NO_WORD), lambda w: w != ""))

    def named(r: Column) -> Column:
        place = [r["first"].alias("first"), r["last"].alias("last")]
        return _let(_judged(r["words"], confirm), lambda j: F.struct(j["family"].alias("family"), j["probability"].alias("probability"), *place))

    judged = F.filter(F.transform(_let(words, lambda lines: _runs(lines, wanted)), named), lambda j: j["family"] != UNKNOWN)
    nothing = F.array().cast("array<struct<family: string, probability: double, first: int, last: int>>")
    rows = docs.select(docs[id_col].alias("doc_id"), F.when(text.rlike(any_mark), judged).otherwise(nothing).alias("found"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda j: j["family"]))), ",")
    return rows.select(
        "doc_id",
        F.when(F.size("found") > 0, names).alias("licence"),
        _disjoint(F.col("found")).cast("long").alias("n_paragraphs"),
        F.round(F.array_max(F.transform("found", lambda j: j["probability"])), 6).alias("probability"),
    )
