"""Licence scan: a trained paragraph classifier in DataFrame functions only.

Paragraphs are lines, and for notices that are wrapped over lines also windows of words over the lines between blank ones:
each of twice the words of the longest template, beginning at every such number of words, so that some window holds all of
any notice whatever the lines' lengths. A multinomial logistic regression over word 1- and 2-grams, trained here on licence notices written
out from a small grammar and on other lines, gives each paragraph a probability for every family and for `unknown`; the
temperature and the offset of `unknown` are calibrated on notices and lines that training did not see. A family is reported
only where the paragraph also holds most of the word pairs of one of its templates. Scoring is one row-local expression:
no shuffle, no join, no Python on the executors.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.llm.common import table

UNKNOWN = "unknown"
#: Rows whose lines are drawn on as examples of `unknown`, at most, and the share of a template's word pairs that confirms.
SAMPLE_ROWS, CONFIRM = 400, 0.75
#: Probability from which a family is reported.
LEAST = 0.5

# Names of licences by family, as notices give them.
NAMES = {
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL version 3", "AGPL-3.0"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"],
    "bsd-2-clause": ["BSD 2-Clause License", "2-clause BSD license", "simplified BSD license", "BSD-2-Clause"],
    "bsd-3-clause": ["BSD 3-Clause License", "3-clause BSD license", "new BSD license", "BSD-3-Clause"],
    "cc-by-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "cc-by-nc-sa-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "cc0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0 Universal", "CC0-1.0"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPL-2.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPL-3.0"],
    "isc": ["ISC License", "ISC license"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL version 3", "LGPL-3.0"],
    "mit": ["MIT License", "MIT license", "MIT/X11 license"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "unlicense": ["Unlicense", "The Unlicense"],
}
# How notices begin, and openings of full licence texts.
OPENINGS = ["Licensed under the {}", "Licensed under {}", "Released under the {}", "This work is licensed under the {}", "This work is licensed under a {}", "This project is released under the {}", "Distributed under the terms of the {}", "This program is made available under the {}", "License: {}", "SPDX-License-Identifier: {}", "{}", "The code is under the {}", "Available under the {}", "This document is published under {}"]
OPENING_TEXTS = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "http://www.apache.org/licenses/LICENSE-2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "bsd-3-clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "gpl-3.0": ["it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "gpl-2.0": ["it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "lgpl-3.0": ["it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "agpl-3.0": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "cc0-1.0": ["has waived all copyright and related or neighboring rights to this work"],
}
# Lines that share words with notices and are none.
OTHERS = ["He has a driving license and a fishing license.", "The license fee was released last year.", "A general public library under the new act", "The album was released under the title", "She was licensed to practise in 2004.", "Version 2.0 of the program is available", "Version 3 was distributed in March", "The Apache people of the plains", "Apache helicopters, version 2", "The gnu is a large antelope", "MIT students won the prize", "Mozilla Firefox is a browser", "Creative work is common in schools", "Commons sat until four", "All rights reserved.", "Copyright 2019 by the authors", "the international attribution of the painting", "this software and the public", "license", "under the terms of the treaty", "the source code of the program", "Proprietary license, all rights reserved", "Licensed under a commercial license agreement", "this work is under review", "BSD systems and others", "free of charge to any person"]


#: Words that mark most notices, and words of notices that prose has often.
FIRST = "license licence licensed licenses licenced gpl lgpl agpl apache bsd mit mpl mozilla isc cc cc0 creative commons gnu unlicense spdx".split()
COMMON = "the this of to and or a in for any with under is you may not use all by it".split()


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams(own: list[str]) -> set[str]:
    return {*own, *(f"{a} {b}" for a, b in itertools.pairwise(own))}


def pairs(own: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in itertools.pairwise(own)} or set(own)


@dataclass
class Model:
    """Families with `unknown` first, the n-grams and their weights (n-grams, families), biases, and templates' word pairs."""

    families: list[str]
    vocabulary: list[str]
    weights: np.ndarray
    bias: np.ndarray
    templates: list[tuple[str, list[str]]]
    anchors: list[str]


def anchor_words(templates: list[list[str]]) -> list[str]:
    """Words without one of which no template can be confirmed: of every template more than the share of pairs that may be
    missing holds one. So paragraphs without them can be passed over and no result changes.

    FIRST comes first; then, for a template that is still open, its longest words that are not among the COMMON.
    """
    found = set(FIRST)
    for own in templates:
        for w in sorted({w for p in own for w in p.split()}, key=lambda w: (w in COMMON or w.isdigit(), -len(w), w)):
            if sum(not found.isdisjoint(p.split()) for p in own) > (1 - CONFIRM) * len(own):
                break
            found.add(w)
    return sorted(found)


def _notices() -> list[tuple[str, str]]:
    out = [(f, o.format(n)) for f, names in NAMES.items() for n in names for o in OPENINGS]
    return out + [(f, t) for f, texts in OPENING_TEXTS.items() for t in texts for _ in range(len(OPENINGS))]


def train(lines: list[str], rounds: int = 400, rate: float = 1.0, penalty: float = 1e-4) -> Model:
    """Fit on the notices and on lines, which are taken as no notices unless they name a licence or come near to it."""
    notices = _notices()
    families = [UNKNOWN, *sorted(NAMES)]
    templates = [(f, sorted(pairs(words(n)))) for own in (NAMES, OPENING_TEXTS) for f, texts in own.items() for n in texts]
    anchors = anchor_words([own for _, own in templates])
    names = [re.sub(r"[^a-z0-9]+", " ", n.lower()) for own in NAMES.values() for n in own]
    plain = [x for x in lines if x.strip() and not any(n in re.sub(r"[^a-z0-9]+", " ", x.lower()) for n in names)]
    examples = [(families.index(f), grams(words(t))) for f, t in notices] + [(0, grams(words(t))) for t in [*OTHERS * 12, *plain]]
    vocabulary = sorted({g for f, own in examples if f for g in own})
    place = {g: i for i, g in enumerate(vocabulary)}
    counted = Counter((f, tuple(sorted(place[g] for g in own if g in place))) for f, own in examples)
    x = np.zeros((len(counted), len(vocabulary)))
    for i, (_, at) in enumerate(counted):
        x[i, list(at)] = 1
    y, times = np.asarray([f for f, _ in counted]), np.asarray(list(counted.values()), float)
    openings = {tuple(sorted(place[g] for g in grams(words(t)))) for own in OPENING_TEXTS.values() for t in own}
    seen = (np.random.default_rng(0).random(len(y)) < 0.8) | np.asarray([at in openings for _, at in counted])  # each is the only one of its kind
    target = np.eye(len(families))[y]
    share = np.where(y == 0, times / times[y == 0].sum(), times / times[y != 0].sum()) * len(y) / 2
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    momentum_w, momentum_b = np.zeros_like(w), np.zeros_like(b)
    own_x, own_t, own_s = x[seen], target[seen], share[seen][:, None]
    for _ in range(rounds):
        z = own_x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        gap = (p / p.sum(axis=1, keepdims=True) - own_t) * own_s / len(own_t)
        momentum_w = 0.9 * momentum_w + own_x.T @ gap + penalty * w
        momentum_b = 0.9 * momentum_b + gap.sum(axis=0)
        w, b = w - rate * momentum_w, b - rate * momentum_b
    z, t, m = x[~seen] @ w + b, y[~seen], share[~seen]

    def loss(scale: float, offset: float) -> float:
        zz = z * scale
        zz[:, 0] += offset
        zz -= zz.max(axis=1, keepdims=True)
        return float(((np.log(np.exp(zz).sum(axis=1)) - zz[np.arange(len(t)), t]) * m).sum())

    scale, offset = min(itertools.product((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), (-2.0, -1.0, 0.0, 1.0, 2.0)), key=lambda c: (loss(*c), c))
    w, b = w * scale, b * scale
    b[0] += offset
    return Model(families, vocabulary, np.round(w, 4), np.round(b, 4), templates, anchors)


def classify(text: Column, model: Model) -> Column:
    """array<struct<paragraph int, family, probability, confirmed>> of the lines and windows of text that hold a word of licences.

    Only native functions. A null text gives an empty array. Lines without such a word can be confirmed as no family
    (anchor_words) and are left out. Windows
    come after all lines and are numbered on from them; what fits in one line has no window.
    """
    strings = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    anchors, vocabulary = strings(model.anchors), strings(model.vocabulary)
    weights = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in model.weights))
    bias = F.array(*(F.lit(float(v)) for v in model.bias))
    names = strings(model.families)
    templates = F.array(*(F.struct(F.lit(f).alias("family"), strings(p).alias("pairs")) for f, p in model.templates))
    body = F.coalesce(text, F.lit(""))
    lines = F.transform(F.split(body, "\n"), lambda line, i: F.struct(i.alias("i"), F.split(F.lower(line), "[^a-z0-9]+").alias("w")))
    step = max(len(p) + 1 for _, p in model.templates)
    blocks = F.filter(F.split(body, r"\n(?:[^\p{L}\p{N}\n]*\n)+"), lambda b: F.trim(b).contains("\n"))
    blocks = F.filter(F.transform(blocks, lambda b: F.split(F.lower(b), "[^a-z0-9]+")), lambda w: F.arrays_overlap(w, anchors))
    windows = F.flatten(F.transform(blocks, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - step), F.lit(step)), lambda at: F.slice(w, at, 2 * step))))
    windows = F.transform(windows, lambda w, i: F.struct((i + F.size(F.split(body, "\n"))).cast("int").alias("i"), w.alias("w")))
    found = F.filter(F.concat(lines, windows), lambda x: F.arrays_overlap(x["w"], anchors))

    def scored(x: Column) -> Column:
        own = F.filter(x["w"], lambda w: w != "")
        twos = F.zip_with(own, F.slice(own, 2, F.greatest(F.size(own), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        twos = F.filter(twos, lambda g: g.isNotNull())
        return F.struct(x["i"].alias("i"), F.array_distinct(F.concat(own, twos)).alias("grams"))

    def logits(x: Column) -> Column:
        known = F.array_intersect(x["grams"], vocabulary)
        z = F.aggregate(known, bias, lambda acc, g: F.zip_with(acc, F.element_at(weights, F.array_position(vocabulary, g).cast("int")), lambda a, b: a + b))
        return F.struct(x["i"].alias("i"), x["grams"].alias("grams"), z.alias("z"))

    def decided(x: Column) -> Column:
        top = F.array_max(x["z"])
        total = F.aggregate(x["z"], F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        family = F.element_at(names, F.array_position(x["z"], top).cast("int"))
        return F.struct(x["i"].alias("i"), x["grams"].alias("grams"), family.alias("family"), (F.lit(1.0) / total).alias("p"))

    def confirmed(x: Column) -> Column:
        own = F.filter(templates, lambda t: t["family"] == x["family"])
        shares = F.transform(own, lambda t: F.size(F.array_intersect(t["pairs"], x["grams"])) / F.size(t["pairs"]))
        sure = F.coalesce(F.array_max(shares) >= CONFIRM, F.lit(False))
        return F.struct(x["i"].alias("paragraph"), x["family"].alias("family"), x["p"].alias("probability"), sure.alias("confirmed"))

    return F.transform(F.transform(F.transform(F.transform(found, scored), logits), decided), confirmed)


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `paragraphs`, what classify() finds, and `licences`, the distinct families that are confirmed, ascending."""
    rows = docs.withColumn("paragraphs", classify(F.col(text), model))
    sure = F.filter("paragraphs", lambda p: p["confirmed"] & (p["probability"] >= LEAST) & (p["family"] != UNKNOWN))
    return rows.withColumn("licences", F.array_sort(F.array_distinct(F.transform(sure, lambda p: p["family"]))))


def sample_lines(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """The first 20 lines of up to 400 characters of `rows` different texts at most, those of the least hashes; a bounded
    sample for `unknown`. Only hashes are ranked, so that no text but those of the sample leaves its executor."""
    hashed = F.xxhash64(text)
    cut = docs.select(hashed.alias("h")).distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if cut is None:
        return []
    head = F.slice(F.split(F.left(F.col(text), F.lit(4000)), "\n"), 1, 20)
    got = docs.where(hashed <= cut).groupBy(hashed.alias("h")).agg(F.first(head).alias("lines")).orderBy("h").collect()
    return [x[:400] for r in got for x in r["lines"] or []]


def op4_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, family, all_families, n_candidates, probability) of every row of documents.

    family is that of the most probable confirmed paragraph (ties: the first), `unknown` without one; all_families are all
    that are confirmed, ascending. Null and empty texts are `unknown`; repeated rows and ids stay; further columns are not
    read; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, train(sample_lines(docs)))
    sure = F.filter("paragraphs", lambda p: F.array_contains(F.col("licences"), p["family"]) & p["confirmed"])
    # of equal probabilities the first paragraph's, which the largest negative place makes
    out = out.withColumn("best", F.array_max(F.transform(sure, lambda p: F.struct(p["probability"].alias("probability"), (-p["paragraph"]).alias("at"), p["family"].alias("family")))))
    return out.select(
        "doc_id",
        F.coalesce("best.family", F.lit(UNKNOWN)).alias("family"),
        F.array_join("licences", ",").alias("all_families"),
        F.size("paragraphs").cast("long").alias("n_candidates"),
        F.coalesce("best.probability", F.lit(0.0)).alias("probability"),
    )
