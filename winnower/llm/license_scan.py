"""Licence notices by a trained paragraph classifier, with DataFrame functions only.

A multinomial logistic regression over word 1- to 3-grams, trained on the driver from the templates below (a fixed,
bounded set), gives each paragraph a licence family or ``unknown``.  The unknown class has training text of its own and
its probability is calibrated: a temperature is fitted on perturbed copies of the training paragraphs that training
did not see.  A prediction is confirmed if the paragraph holds most of the 3-grams of one of the family's templates.

On the executors everything is joins with the table of learned weights (one row per n-gram of the templates, so bounded) and
sums.  Paragraphs are lines.  A paragraph that holds no word of any template, plain words like "the" aside, is unknown by
definition, and such lines are left out before any n-gram is made.

Edge cases: null or empty text has no paragraphs to score and gives no row; rows of equal id and text give their results once;
rows without an id are told apart by their texts; a very long line is one paragraph; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.llm import common

UNKNOWN = "unknown"

#: Short notices by family, in the usual public wordings.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}

#: Text of the unknown class, some of it near licences.
OTHER_TEXT = (
    "The driver must carry a valid driving license at all times.",
    "A fishing license can be obtained from the town office under the usual terms.",
    "The license of the restaurant was renewed without conditions last year.",
    "This work is the result of many years of study and the public was free to attend.",
    "The following conditions are described in the first part of the source.",
    "Version 3 of the program was published in May and is free of charge.",
    "She asked for permission to copy the file to any person in the office.",
    "The general public may use the form to modify or to file a complaint.",
    "Attribution of the painting to the master is not certain.",
    "International law and the rights of the author were discussed in the library.",
    "The foundation of the house is made of stone and the software was installed later.",
    "Under the terms of the agreement the material may be used by the other party.",
    "La licence est valable pour une durée de deux ans.",
    "Die Lizenz wurde von der Stadt erteilt und ist öffentlich.",
    "La licencia fue concedida por el ayuntamiento.",
)


#: Words that say nothing of a licence.
PLAIN = (
    "a", "about", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "do", "each", "for", "from", "had", "has", "have", "he", "her",
    "his", "if", "in", "into", "is", "it", "its", "may", "more", "must", "no", "not", "of", "on", "one", "only", "or", "other", "our", "out", "she", "so", "such", "than",
    "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "under", "up", "was", "we", "were", "what", "when", "which", "who", "will",
    "with", "would", "you", "your",
)


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams(words: list[str], sizes: tuple[int, ...] = (1, 2, 3)) -> set[str]:
    return {" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


class Model:
    """Weights per n-gram and family, biases, temperature and the templates' 3-grams."""

    def __init__(self, rounds: int = 400, rate: float = 0.5, decay: float = 2e-3, seed: int = 5):
        self.families = [*TEMPLATES, UNKNOWN]
        rng = np.random.default_rng(seed)
        whole = [(tokens(t), k) for k, f in enumerate(TEMPLATES) for t in TEMPLATES[f]] + [(tokens(t), len(TEMPLATES)) for t in OTHER_TEXT]
        #: every word of a template but the plain ones: a paragraph that holds none of them is not about a licence
        self.anchors = sorted({w for t in TEMPLATES.values() for x in t for w in tokens(x) if len(w) > 1} - set(PLAIN))

        def altered(words: list[str]) -> list[str]:
            return [w for w in words if rng.random() > 0.15] + ["filler"] * int(rng.integers(0, 3))

        train = [*whole, *((altered(w), k) for w, k in whole for _ in range(4))]
        # what notices of many families share says nothing of a family
        plain = [w for w, k in whole if k < len(TEMPLATES)]
        spread = {g: len({k for w, k in whole if g in w and k < len(TEMPLATES)}) for g in set().union(*map(set, plain))}
        train += [([x for x in w if spread[x] >= 4], len(TEMPLATES)) for w in plain]
        held = [(altered(w), k) for w, k in whole for _ in range(4)]
        vocabulary = sorted(set().union(*(grams(w) for w, _ in whole)))
        self.index = {g: i for i, g in enumerate(vocabulary)}
        x, y = self._matrix([w for w, _ in train]), np.array([k for _, k in train])
        K = len(self.families)
        self.weights, self.bias = np.zeros((len(vocabulary), K)), np.zeros(K)
        self.bias[-1] = 2.0  # nothing known: unknown
        gold = np.eye(K)[y]
        for _ in range(rounds):
            p = self._softmax(x @ self.weights + self.bias)
            g = (gold - p) / len(y)
            self.weights += rate * len(y) / 8 * (x.T @ g - decay / 8 * self.weights)
        hx, hy = self._matrix([w for w, _ in held]), np.array([k for _, k in held])
        z = hx @ self.weights + self.bias
        losses = {t: -np.log(self._softmax(z / t)[np.arange(len(hy)), hy] + 1e-12).mean() for t in np.linspace(0.3, 3, 28)}
        self.temperature = float(min(losses, key=losses.get))
        self.held_accuracy = float((z.argmax(1) == hy).mean())
        self.template_rows = [(f"{f}#{i}", f, g) for f in TEMPLATES for i, t in enumerate(TEMPLATES[f]) for g in self._trigrams(t)]

    @staticmethod
    def _trigrams(text: str) -> set[str]:
        words = tokens(text)
        return grams(words, (3,)) or grams(words, (len(words),))

    def _matrix(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.index)))
        for i, words in enumerate(rows):
            for g in grams(words):
                if g in self.index:
                    out[i, self.index[g]] = 1
        return out

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


_MODEL: list[Model] = []


def trained() -> Model:
    if not _MODEL:
        _MODEL.append(Model())
    return _MODEL[0]


def _grams(words: Column, n: int) -> Column:
    """The n-grams of an array of words."""
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None, confirm: float = 0.6) -> DataFrame:
    """A row per paragraph that holds a word of some template: ``doc_id, paragraph, family, probability, template, similarity,
    confirmed, text``.

    ``paragraph`` counts lines from 0.  ``similarity`` is the share of the nearest template's 3-grams (of the predicted
    family) that the paragraph holds; ``confirmed`` means at least ``confirm``.  The paragraphs to score, a small part of the
    texts, are written once.
    """
    model = model or trained()
    spark = docs.sparkSession
    anchor = rf"(?i)\b(?:{'|'.join(model.anchors)})\b"
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).where(F.col("_text").rlike(anchor))
    own = F.xxhash64(F.lit(1), "_text").alias("_own2")
    rows = rows.select(F.coalesce("_id", F.lit(0)).alias("_id"), F.col("_id").isNull().alias("_none"), F.xxhash64("_text").alias("_own"), own, F.posexplode(F.split("_text", "\n", -1)).alias("paragraph", "_line"))
    key = ["_id", "_none", "_own", "_own2", "paragraph"]
    rows = common.spool(rows.where(F.col("_line").rlike(anchor)).dropDuplicates(key), "licence-lines")
    words = F.filter(F.split(F.regexp_replace(F.lower("_line"), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    rows = rows.withColumn("_words", words)
    every = F.array_distinct(F.concat(*(_grams(F.col("_words"), n) for n in (1, 2, 3))))
    own = rows.select(*key, F.explode(every).alias("gram"))

    K = len(model.families)
    weights = spark.createDataFrame([(g, *map(float, model.weights[i])) for g, i in model.index.items()], "gram string, " + ", ".join(f"w{k} double" for k in range(K)))
    hits = own.join(F.broadcast(weights), "gram").groupBy(*key).agg(*(F.sum(f"w{k}").alias(f"w{k}") for k in range(K)))
    z = [(F.col(f"w{k}") + float(model.bias[k])) / model.temperature for k in range(K)]
    hits = hits.select(*key, *(c.alias(f"z{k}") for k, c in enumerate(z)))
    top = F.greatest(*(F.col(f"z{k}") for k in range(K)))
    total = sum((F.exp(F.col(f"z{k}") - top) for k in range(1, K)), F.exp(F.col("z0") - top))
    family = F.lit(None).cast("string")
    for k in range(K):
        family = F.when(F.col(f"z{k}") == top, F.lit(model.families[k])).otherwise(family)
    hits = hits.select(*key, family.alias("family"), (1 / total).alias("probability"))

    templates = spark.createDataFrame(model.template_rows, "template string, family string, gram string")
    sizes = templates.groupBy("template", "family").agg(F.count("*").alias("size"))
    near = own.join(F.broadcast(templates), "gram").groupBy(*key, "template", "family").agg(F.count("*").alias("n"))
    near = near.join(F.broadcast(sizes), ["template", "family"]).withColumn("similarity", F.col("n") / F.col("size"))
    near = near.groupBy(*key, "family").agg(F.max(F.struct("similarity", "template")).alias("best"))
    out = hits.join(near, [*key, "family"], "left")
    out = out.select(*key, "family", "probability", F.col("best.template").alias("template"), F.coalesce("best.similarity", F.lit(0.0)).alias("similarity"))
    out = out.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("similarity") >= confirm))
    # a paragraph none of whose n-grams was learned keeps the biases alone
    out = rows.select(*key, F.col("_line").alias("text")).join(out, key, "left")
    e = np.exp((model.bias - model.bias.max()) / model.temperature)
    plain = {"family": model.families[int(model.bias.argmax())], "probability": float((e / e.sum()).max()), "similarity": 0.0, "confirmed": False}
    out = out.fillna(plain)
    return out.select(F.when(~F.col("_none"), F.col("_id")).alias("doc_id"), "paragraph", "family", "probability", "template", "similarity", "confirmed", "text")
