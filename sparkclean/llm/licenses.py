"""Licence families of paragraphs by a trained n-gram classifier.

A multinomial logistic regression on word n-grams (one to three words) is fitted on the driver: its rows are short
variants of the licence notices below and, as the class ``unknown``, a bounded sample of paragraphs of the corpus
without any word of the notices' own. On the corpus everything is DataFrame functions: the n-grams of all paragraphs
meet the table of weights (one row per n-gram that the notices use, a fixed size), sums and a softmax give calibrated
probabilities, and a prediction counts when a notice of that family is contained in the paragraph to a given share.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclean.llm.common import literal_rows

UNKNOWN = "unknown"
SAMPLE = 2000  # paragraphs of the corpus that stand for the class unknown, at most
SAMPLE_LENGTH = 2000
PROBABILITY = 0.5
CONTAINED = 0.6
# Usual wordings of licence notices.
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http www apache org licenses LICENSE 2.0",
        "SPDX-License-Identifier Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier MIT",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License",
        "You should have received a copy of the GNU General Public License along with this program",
        "SPDX-License-Identifier GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier LGPL-2.1-or-later",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier MPL-2.0",
    ],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0": ["CC0 1.0 Universal Public Domain Dedication", "To the extent possible under law the author has waived all copyright and related rights to this work"],
    "proprietary": ["All rights reserved", "Copyright all rights reserved", "No part of this work may be reproduced without written permission"],
}
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """Lower-cased words; everything in ASCII but letters and digits divides them."""
    return F.filter(F.split(F.lower(text), _BETWEEN), lambda w: w != "")


def _grams(words: Column) -> Column:
    """All distinct n-grams of one to three words."""
    n = F.size(words)

    def of(size: int) -> Column:
        some = F.slice(words, 1, F.greatest(n - (size - 1), F.lit(0)))
        return F.transform(some, lambda w, i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def _grams_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)))


def _words_of(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


@dataclass(frozen=True)
class LicenseModel:
    families: list[str]  # the last one is the class unknown
    grams: list[str]
    weights: np.ndarray  # grams x families
    bias: np.ndarray
    temperature: float
    anchors: list[str]


def _variants(words: list[str]) -> list[list[str]]:
    """A notice, its parts, and both among other words, so that the classifier does not depend on whole notices."""
    n = len(words)
    cuts = [words, words[: max(3, 2 * n // 3)], words[n // 3 :], words[: max(3, n - 1)], words[1:] if n > 3 else words]
    around = [f"filler{k}" for k in range(6)]
    return cuts + [around[:3] + c + around[3:] for c in cuts[:3]]


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, steps: int = 300) -> LicenseModel:
    """Fit on variants of the notices and at most ``sample`` paragraphs of documents, the first by a hash of id and
    text, of at most ``SAMPLE_LENGTH`` characters each. Paragraphs that hold a three-word sequence of a notice are not
    used as unknown."""
    own = {f: [_words_of(t) for t in texts] for f, texts in NOTICES.items()}
    families = [*own, UNKNOWN]
    strong = {" ".join(w[i : i + 3]) for ws in own.values() for w in ws for i in range(len(w) - 2)}
    rows = [(set(_grams_of(v)), k) for k, f in enumerate(own) for w in own[f] for v in _variants(w)]
    other = paragraphs(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    other = other.filter(F.length("_text") <= SAMPLE_LENGTH).orderBy(F.xxhash64("_id", "paragraph", "_text"), "paragraph")
    other = other.limit(sample).select(tokens(F.col("_text")).alias("w"))
    unknown = [set(g) for r in other.collect() if not strong.intersection(g := _grams_of(r["w"]))]
    usual = Counter(w for g in unknown for w in g if " " not in w)
    # texts about licences that name no family
    vague = ["see the license", "the terms of use", "under the terms of this agreement", "free software", "public version", "the work is released", "rights and work", "version 2 0 of the file"]
    unknown += [set(_grams_of(_words_of(t))) for t in vague for _ in range(3)] + [set()] * 5
    rows += [(g, len(own)) for g in unknown]
    grams = sorted({g for s, k in rows if k < len(own) for g in s if "filler" not in g})
    place = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams)), np.float32)
    y = np.array([k for _, k in rows])
    for r, (s, _) in enumerate(rows):
        x[r, [place[g] for g in s if g in place]] = 1
    many = np.bincount(y, minlength=len(families))
    weight = (len(rows) / len(families) / np.maximum(many, 1))[y]
    fold = np.arange(len(rows)) % 5 == 0  # held out for the temperature
    w, b = np.zeros((len(grams), len(families))), np.zeros(len(families))
    target = np.eye(len(families))[y]
    seen = np.flatnonzero(~fold)
    for step in range(steps):
        z = x[seen] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - target[seen]) * weight[seen, None] / len(seen)
        rate = 8.0 / (1 + step / 150)
        w -= rate * (x[seen].T @ d + 1e-4 * w)
        b -= rate * d.sum(0)
    z = x[fold] @ w + b
    best, temperature = math.inf, 1.0
    for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0):
        s = z / t - (z / t).max(1, keepdims=True)
        loss = -((s - np.log(np.exp(s).sum(1, keepdims=True)))[np.arange(len(s)), y[fold]] * weight[fold]).mean()
        if loss < best:
            best, temperature = loss, t
    return LicenseModel(families, grams, w, b, temperature, _anchors(usual))


def _anchors(usual: Counter) -> list[str]:
    """Words, rare ones first, of which every paragraph that contains a notice to ``CONTAINED`` has at least one."""
    out: set[str] = set()
    for texts in NOTICES.values():
        for words in map(_words_of, texts):
            grams = _grams_of(words)
            for w in sorted(set(words), key=lambda w: (w not in out, usual[w], w)):
                if sum(not out.intersection(g.split(" ")) for g in grams) < CONTAINED * len(grams):
                    break
                out.add(w)
    return sorted(out)


def paragraphs(own: DataFrame, divide: str = "\n") -> DataFrame:
    """_id, ``paragraph`` (its number, from 0), _text of every paragraph that is not blank; ``divide`` is a pattern."""
    lines = F.posexplode(F.split(F.coalesce(F.col("_text"), F.lit("")), divide))
    return own.select("_id", lines.alias("paragraph", "_text")).filter(F.trim("_text") != "")


def weight_table(spark: SparkSession, model: LicenseModel) -> DataFrame:
    """gram, ``w`` (weight by family) and ``notices`` (numbers of the notices that hold it)."""
    notices = [(f, _words_of(t)) for f in NOTICES for t in NOTICES[f]]
    holders: dict[str, list[int]] = {}
    for k, (_, words) in enumerate(notices):
        for g in _grams_of(words):
            holders.setdefault(g, []).append(k)
    rows = [{"gram": g, "w": [round(float(v), 6) for v in model.weights[i]], "notices": holders.get(g, [])} for i, g in enumerate(model.grams)]
    return literal_rows(spark, rows, "gram: string, w: array<double>, notices: array<int>")


def scan(
    docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text",
    probability: float = PROBABILITY, contained: float = CONTAINED, divide: str = "\n",
) -> DataFrame:
    """One row per paragraph with a licence: id, ``paragraph`` (number from 0; a line unless ``divide`` is another pattern), ``family``, ``probability``,
    ``contained`` (share of the n-grams of the best notice of the family).

    A paragraph counts when the most probable class is not unknown, reaches ``probability``, and a notice of the same
    family is contained to ``contained`` (not below ``CONTAINED``, for which the anchor words hold); a paragraph without any n-gram of a notice is unknown. Null, empty and blank
    texts have no paragraphs; repeated rows give their rows each; a null id is kept; ties go to the first family.
    """
    if contained < CONTAINED:
        raise ValueError(f"contained must be at least {CONTAINED}")
    spark = docs.sparkSession
    own = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")
    )
    lines = paragraphs(own.select(F.struct("_row", "_id").alias("_id"), "_text"), divide)
    table = F.broadcast(weight_table(spark, model))
    sizes = [len(_grams_of(_words_of(t))) for f in NOTICES for t in NOTICES[f]]
    owner = [k for k, f in enumerate(NOTICES) for _ in NOTICES[f]]
    lines = lines.select("_id", "paragraph", tokens(F.col("_text")).alias("_words"))
    lines = lines.filter(F.arrays_overlap("_words", F.array(*map(F.lit, model.anchors))))
    hits = lines.select("_id", "paragraph", F.explode(_grams(F.col("_words"))).alias("gram")).join(table, "gram")
    k = len(model.families)
    sums = hits.groupBy("_id", "paragraph").agg(
        *(F.sum(F.col("w")[i]).alias(f"_w{i}") for i in range(k)),
        *(F.sum(F.array_contains("notices", i).cast("int")).alias(f"_n{i}") for i in range(len(sizes))),
    )
    z = F.array(*[(F.col(f"_w{i}") + float(model.bias[i])) / model.temperature for i in range(k)])
    top = F.array_max("_z")
    share = F.array(*[
        F.greatest(*[F.col(f"_n{i}") / F.lit(float(sizes[i])) for i in range(len(sizes)) if owner[i] == f] * 2) for f in range(k - 1)
    ])
    names = F.array(*map(F.lit, model.families))
    found = (
        sums.withColumn("_z", z)
        .withColumn("_share", share)
        .withColumn("_best", F.array_position("_z", top).cast("int"))
        .withColumn("probability", 1 / F.aggregate("_z", F.lit(0.0), lambda a, v: a + F.exp(v - top)))
        .filter((F.col("_best") < k) & (F.col("probability") >= probability))
        .withColumn("contained", F.element_at("_share", F.col("_best")))
        .filter(F.col("contained") >= contained)
        .select("_id", "paragraph", F.element_at(names, F.col("_best")).alias("family"), "probability", "contained")
    )
    return found.select(F.col("_id._id").alias(id_col), "paragraph", "family", "probability", "contained")
