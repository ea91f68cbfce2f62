"""Licence scan: a paragraph classifier over word n-grams, with an unknown class and confirmation by templates.

A multinomial logistic regression on words and word pairs is fitted to the templates below and to ordinary sentences, both varied by
seeded edits. Its probabilities are calibrated on held-out variants (one temperature), which also give the probability below which a
paragraph is unknown. A prediction counts only if enough of a template of the family is found in the paragraph.

Scanning is one expression per document, without a shuffle. A paragraph must have one of a few words to be scored: they are chosen so
that without them no template can be confirmed, so this skips work and no licence.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import text_or_empty

# Notices and typical sentences of licence families.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "You should have received a copy of the GNU General Public License along with this program",
        "Licensed under the GPL version 2",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "licensed under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Creative Commons Attribution NonCommercial ShareAlike 4.0 International License",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain",
        "dedicated to the public domain under CC0 1.0 Universal",
        "dedicated to the public domain",
        "released into the public domain",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Licensed under the ISC License",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited",
    ),
}
# Sentences without a licence, some of which use its words.
ORDINARY = (
    "She renewed her driver's license at the office on the corner before the rain began.",
    "The poet took some license with the dates, as poets do.",
    "A fishing license costs twelve dollars and is valid for a year.",
    "The council granted permission for the new bridge after a long public debate.",
    "General public opinion turned against the war in the spring.",
    "The museum keeps a copy of the letter in its source collection.",
    "The software update will be distributed to all users next week.",
    "Apache helicopters flew over the valley in the morning.",
    "Students at MIT built a small robot that climbs stairs.",
    "The domain of the function is the set of all real numbers.",
    "No part of the journey was easy, and the conditions were bad.",
    "The warranty of the washing machine ended in May.",
    "Their common creative work was shown in the attic of the town hall.",
    "The terms of the contract were published by the foundation last year.",
    "He used this file to smooth the edge of the binary clock's case.",
    "We met the following day in the library to read the program.",
    "The following conditions hold for every integer greater than two.",
    "Version 3 of the draft was sent to the editor on Monday.",
    "Any person over the age of twelve pays the full fare.",
    "The river rose above the notice that was painted on the wall.",
)
TOKEN = "[a-z0-9]+(?:\\.[0-9]+)*"
#: Words that mark a line as a comment; signs are no tokens anyway.
MARK = "(?mi)^[ \\t]*(?:dnl|rem)[ \\t]+"
STOP = frozenset("a an and any are as at be been by can for form from have if in into is it its kind may no not of on one or other part shall should that the this to under via was were with you your all either following must used use work free name terms file copy along between over later".split())


@dataclass(frozen=True)
class LicenseConfig:
    """``variants``: training rows made per template or sentence; ``confirm``: share of a template's word triples to be found."""

    variants: int = 24
    seed: int = 17
    epochs: int = 250
    decay: float = 1e-3
    confirm: float = 0.6
    miss_rate: float = 0.002


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: np.ndarray  # [class, feature], divided by the temperature; the last class is unknown
    bias: np.ndarray
    threshold: float
    gate: tuple[str, ...]
    triples: tuple[tuple[tuple[str, ...], ...], ...]  # by family and template


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower().replace("licence", "license"))


def grams(words: list[str]) -> list[str]:
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


def triples(words: list[str]) -> list[str]:
    """Three words each; a shorter text is one."""
    return [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]


def _varied(words: list[str], others: list[str], rnd: random.Random) -> list[str]:
    """Some words lost or changed, some strange ones around."""
    rate = rnd.choice((0, 0, 0.05, 0.12))
    out = [w if rnd.random() > rate / 2 else rnd.choice(others) for w in words if rnd.random() > rate]
    before, after = (rnd.choices(others, k=rnd.choice((0, 0, 3, 10))) for _ in "ab")
    return [*before, *out, *after]


def _gate(config: LicenseConfig) -> tuple[str, ...]:
    """Words without which less than ``confirm`` of every template's triples can be found."""
    chosen: list[str] = []
    sets = [triples(tokens(t)) for ts in TEMPLATES.values() for t in ts]
    while True:
        open_ = [[x for x in s if not set(x.split()) & set(chosen)] for s in sets]
        short = [o for o, s in zip(open_, sets) if len(o) >= config.confirm * len(s)]
        if not short:
            return tuple(sorted(chosen))
        count = Counter(w for o in short for x in o for w in set(x.split()) if w not in STOP and not w[0].isdigit())
        if not count:
            raise ValueError(f"only common words cover {short[0]}")
        chosen.append(max(count, key=lambda w: (count[w], w)))


@functools.cache
def fit(config: LicenseConfig = LicenseConfig()) -> Model:
    """Fitted on the driver to the fixed texts above: the same model everywhere, whatever the corpus."""
    rnd = random.Random(config.seed)
    families = tuple(TEMPLATES)
    others = sorted({w for s in ORDINARY for w in tokens(s)})
    rows = [(k, _varied(tokens(t), others, rnd)) for k, f in enumerate(families) for t in TEMPLATES[f] for _ in range(config.variants)]
    unknown = len(families)
    rows += [(unknown, _varied(tokens(s), others, rnd)) for s in ORDINARY for _ in range(config.variants)]
    rows += [(unknown, rnd.choices(others, k=rnd.randint(1, 40))) for _ in range(len(ORDINARY) * config.variants)]
    pieces = [w for ts in TEMPLATES.values() for t in ts for w in tokens(t)]  # licences' words in no order are no licence
    rows += [(unknown, rnd.choices(pieces + others, k=rnd.randint(1, 25))) for _ in range(len(ORDINARY) * config.variants)]
    rnd.shuffle(rows)
    held = len(rows) // 4
    counts = Counter(g for _, w in rows[held:] for g in set(grams(w)))
    vocabulary = tuple(sorted(g for g, n in counts.items() if n >= 4))
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for i, (_, w) in enumerate(rows):
        x[i, [place[g] for g in set(grams(w)) if g in place]] = 1
    y = np.array([k for k, _ in rows])
    one = np.eye(unknown + 1, dtype=np.float32)[y]
    weights, bias = np.zeros((len(vocabulary), unknown + 1), dtype=np.float32), np.zeros(unknown + 1, dtype=np.float32)
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    xt, ot = x[held:], one[held:]
    for _ in range(config.epochs):  # descent with momentum
        p = xt @ weights + bias
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True) - ot
        speed_w = 0.9 * speed_w - 0.5 * (xt.T @ p / len(xt) + config.decay * weights)
        speed_b = 0.9 * speed_b - 0.5 * p.mean(axis=0)
        weights, bias = weights + speed_w, bias + speed_b

    def probabilities(scale: float) -> np.ndarray:
        z = (x[:held] @ weights + bias) / scale
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    scales = np.geomspace(0.2, 5, 40)
    scale = float(min(scales, key=lambda s: -np.log(probabilities(s)[np.arange(held), y[:held]] + 1e-12).mean()))
    p = probabilities(scale)[:, :unknown].max(axis=1)
    threshold = float(np.clip(np.quantile(p[y[:held] == unknown], 1 - config.miss_rate), 0.3, 0.9))
    kept = np.abs(weights).max(axis=1) > 0.02
    return Model(families, tuple(g for g, k in zip(vocabulary, kept) if k), (weights[kept].T / scale).round(5), (bias / scale).round(5), round(threshold, 4), _gate(config), tuple(tuple(tuple(dict.fromkeys(triples(tokens(t)))) for t in TEMPLATES[f]) for f in families))


def classify(paragraph: str, config: LicenseConfig = LicenseConfig()) -> tuple[str, float] | None:
    """The plain form of the scan for one paragraph."""
    m, words = fit(config), tokens(paragraph)
    if not set(words) & set(m.gate):
        return None
    place = {g: i for i, g in enumerate(m.vocabulary)}
    z = m.bias + m.weights[:, sorted({place[g] for g in grams(words) if g in place})].sum(axis=1)
    p = np.exp(z - z.max())
    p /= p.sum()
    k = int(p[:-1].argmax())
    own = set(triples(words))
    share = max(len(own & set(t)) / len(t) for t in m.triples[k])
    return (m.families[k], float(p[k])) if p[k] >= m.threshold and p[k] >= p[-1] and share >= config.confirm - 1e-9 else None


def _strings(values) -> Column:
    """A constant array; folded once, as one literal."""
    return F.split(F.lit("\n".join(values)), "\n")


def _doubles(values) -> Column:
    return _strings(map(repr, map(float, values))).cast("array<double>")


def _score(places: Column, bias: float, weights: np.ndarray) -> Column:
    return F.aggregate(places, F.lit(float(bias)), lambda s, i: s + F.element_at(_doubles(weights), i))


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(line), F.lit("licence"), F.lit("license")), F.lit(TOKEN), F.lit(0))


def _joined(words: Column, n: int) -> Column:
    """All runs of n words, each as one string."""
    none = F.expr("cast(array() as array<string>)")
    return F.when(F.size(words) < n, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))


def _features(words: Column, m: Model) -> Column:
    found = F.array_intersect(_strings(m.vocabulary), F.concat(words, _joined(words, 2)))
    return F.transform(found, lambda g: F.array_position(_strings(m.vocabulary), g).cast("int"))


def _decided(state: Column, config: LicenseConfig) -> Column:
    """``struct<family,probability>``, null where no licence is confirmed."""
    m = fit(config)
    n = len(m.families)
    z, top = state["z"], F.array_max(F.slice(state["z"], 1, n))
    p = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - state["top"]))
    share = F.lit(0.0)
    for i, family in enumerate(m.triples):
        best = F.greatest(*(F.size(F.array_intersect(_strings(t), state["three"])) / len(t) for t in family), F.lit(0.0))
        share = F.when(state["k"] == i + 1, best).otherwise(share)
    sure = (p >= m.threshold) & (top >= F.element_at(z, n + 1)) & (share >= config.confirm - 1e-9)
    return F.when(sure, F.struct(F.element_at(_strings(m.families), state["k"].cast("int")).alias("family"), p.alias("probability")))


def licence_of(lines: Column, config: LicenseConfig) -> Column:
    """``array<struct<start,stop,line>>`` with each line's decision ``d``. Each step is an array, so that nothing is worked out twice."""
    m = fit(config)
    at = lambda x: (x["start"].alias("start"), x["stop"].alias("stop"))
    worded = F.transform(lines, lambda x: F.struct(*at(x), _words(x["line"]).alias("words")))
    placed = F.transform(worded, lambda x: F.struct(*at(x), _features(x["words"], m).alias("places"), F.when(F.size(x["words"]) < 3, F.array(F.array_join(x["words"], " "))).otherwise(_joined(x["words"], 3)).alias("three")))
    scored = F.transform(placed, lambda x: F.struct(*at(x), x["three"].alias("three"), F.array(*(_score(x["places"], m.bias[k], m.weights[k]) for k in range(len(m.bias)))).alias("z")))
    n = len(m.families)
    ranked = F.transform(scored, lambda x: F.struct(*at(x), x["three"].alias("three"), x["z"].alias("z"), F.array_max(F.slice(x["z"], 1, n)).alias("top"), F.array_position(F.slice(x["z"], 1, n), F.array_max(F.slice(x["z"], 1, n))).alias("k")))
    return F.transform(ranked, lambda x: F.struct(*at(x), _decided(x, config).alias("d")))


def scan_licenses(df: DataFrame, text: str = "text", config: LicenseConfig = LicenseConfig()) -> DataFrame:
    """``df`` with ``licenses``: ``array<struct<start,stop,family,probability>>`` of the paragraphs with a licence.

    A paragraph is a line, or all lines up to a blank one, without comment marks, where none of them has the licence alone.
    Positions are code points. Null and empty texts have none; repeated rows have their own; a column of that name is replaced.
    """
    t = text_or_empty(text)
    gate = "(?i)\\b(?:" + "|".join(re.escape(w).replace("license", "licen[cs]e") for w in fit(config).gate) + ")\\b"
    lines = F.concat(F.split(t, "\n"), F.array(F.lit("")))  # an empty line ends the last paragraph
    start = F.expr("struct(cast(0 as bigint) as at, 1 as n, 0 as first, cast(0 as bigint) as begin, cast(0 as bigint) as end, false as asked, cast(array() as array<struct<start:bigint,stop:bigint,line:string>>) as found)")

    def step(s: Column, line: Column) -> Column:
        stop, asked, inside = s["at"] + F.length(line), line.rlike(gate), s["first"] > 0
        hit = F.struct(s["at"].alias("start"), stop.alias("stop"), line.alias("line"))
        whole = F.struct(s["begin"].alias("start"), s["end"].alias("stop"), F.array_join(F.slice(lines, F.greatest(s["first"], F.lit(1)), F.greatest(s["n"] - s["first"], F.lit(0))), "\n").alias("line"))
        blank = ~line.rlike("[\\p{L}\\p{N}]")  # comment marks alone too
        found = F.when(blank & s["asked"] & (s["n"] - s["first"] > 1), F.array_append(s["found"], whole)).when(~blank & asked, F.array_append(s["found"], hit)).otherwise(s["found"])
        return F.struct(
            (stop + 1).alias("at"),
            (s["n"] + 1).alias("n"),
            F.when(blank, F.lit(0)).when(inside, s["first"]).otherwise(s["n"]).alias("first"),
            F.when(inside, s["begin"]).otherwise(s["at"]).alias("begin"),
            stop.alias("end"),
            (~blank & (asked | s["asked"])).alias("asked"),
            found.alias("found"),
        )

    asked = F.when(t.rlike(gate), F.aggregate(lines, start, step, lambda s: s["found"])).otherwise(F.expr("cast(array() as array<struct<start:bigint,stop:bigint,line:string>>)"))
    unmarked = F.transform(asked, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.regexp_replace(x["line"], MARK, "").alias("line")))
    named = licence_of(unmarked, config)
    found = F.transform(F.filter(named, lambda x: x["d"].isNotNull()), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["d"]["family"].alias("family"), x["d"]["probability"].alias("probability")))
    out = df.withColumn("licenses", found)
    within = lambda x, y: (x["start"] <= y["start"]) & (y["stop"] <= x["stop"]) & (y["stop"] - y["start"] < x["stop"] - x["start"]) & (x["family"] == y["family"])
    alone = F.filter("licenses", lambda x: ~F.exists("licenses", lambda y: within(x, y)))
    return out.withColumn("licenses", F.when(F.size("licenses") > 1, F.array_sort(alone)).otherwise(F.col("licenses")))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Per document the families found, the number of such paragraphs, their spans and the least probability among them."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["stop"].cast("string")))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"]))), ",").alias("families"),
        F.size("licenses").cast("long").alias("n_paragraphs"),
        F.array_join(spans, ",").alias("spans"),
        F.round(F.array_min(F.transform("licenses", lambda x: x["probability"])), 6).alias("least_probability"),
    )
