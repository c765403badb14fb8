"""Licence scans: a trained paragraph classifier in native expressions.

Paragraphs are lines, and, since notices are often wrapped, also the lines around one up to the next blank ones
(``REACH`` lines to either side). A sparse softmax regression over word 1-grams and 2-grams, trained here on template
texts, their variants and sentences that only sound alike, gives each paragraph a licence family or the unknown class; a
temperature, fitted on templates and sentences that training never saw, calibrates its probabilities. A prediction counts
only if a template of the family confirms it: enough of the template's 2-grams must be in the paragraph.

Training sees fixed texts only and runs where the query is built; its weights are literals in the query. Scoring is one
projection: no join, shuffle or Python. A paragraph that holds enough 2-grams of some template to be confirmed holds one
of the words in cues() for certain: these are chosen so that the 2-grams without any are too few, for every template. Only
paragraphs with such a word are scored, which loses none that could be confirmed.

Defined results: null and empty texts are one empty paragraph without a licence. Of equal probabilities the first family
in ``FAMILIES`` wins, of equal similarities the first template. Repeated rows are scanned each. Columns named like an
output column are replaced, others stay, whatever their names.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import table

MIN_PROBABILITY, MIN_SIMILARITY = 0.5, 0.75
#: Lines before and after one that may belong to its notice.
REACH = 8
# By family, names of the licence, its SPDX identifiers, and sentences by which it is granted.
LICENSES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "apache": (
        ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License"],
        ["Apache-2.0"],
        [
            "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ],
    ),
    "mit": (
        ["MIT License", "MIT Licence", "Expat License"],
        ["MIT"],
        [
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
            "The MIT License (MIT)",
        ],
    ),
    "bsd": (
        ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "New BSD License"],
        ["BSD-2-Clause", "BSD-3-Clause"],
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        ],
    ),
    "gpl": (
        ["GNU General Public License", "GNU General Public License, version 2", "GNU General Public License, version 3", "GNU General Public License v2 or later", "GNU General Public License v3", "GNU GPL", "GPL v3"],
        ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"],
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU General Public License along with this program.",
        ],
    ),
    "lgpl": (
        ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v3", "GNU LGPL"],
        ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
        ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    ),
    "agpl": (
        ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL"],
        ["AGPL-3.0-only", "AGPL-3.0-or-later"],
        ["You should have received a copy of the GNU Affero General Public License along with this program."],
    ),
    "mpl": (
        ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License"],
        ["MPL-2.0"],
        ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    ),
    "cc-by": (["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"], ["CC-BY-4.0", "CC-BY-3.0"], []),
    "cc-by-sa": (["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"], ["CC-BY-SA-4.0", "CC-BY-SA-3.0"], []),
    "cc-by-nc": (["CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"], ["CC-BY-NC-4.0", "CC-BY-NC-3.0"], []),
    "cc-by-nd": (["CC BY-ND 4.0", "CC BY-ND 3.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivatives License"], ["CC-BY-ND-4.0", "CC-BY-ND-3.0"], []),
    "cc0": (
        ["CC0 1.0 Universal license", "CC0 license", "CC0 1.0"],
        ["CC0-1.0"],
        ["Released into the public domain under the CC0 1.0 Universal license.", "To the extent possible under law, the author has waived all copyright and related rights to this work and placed it in the public domain."],
    ),
    "isc": (["ISC License", "ISC Licence"], ["ISC"], ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."]),
    "unlicense": (["Unlicense license", "Unlicense"], ["Unlicense"], ["This is free and unencumbered software released into the public domain."]),
    "proprietary": (
        [],
        ["LicenseRef-Proprietary"],
        [
            "All rights reserved.",
            "Copyright Example Corporation. All rights reserved.",
            "Unauthorized copying of this file, via any medium, is strictly prohibited. All rights reserved.",
            "This software is proprietary and may only be used under the terms of a commercial license agreement.",
        ],
    ),
}
# How sentences grant a licence by its name or identifier.
GRANTS = ["Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "Available under the {}."]
SPDX = "SPDX-License-Identifier: {}"
# More words that texts without a licence have, too, and that make poor cues.
COMMON = "a an any available copy copying code distribute file form later of or released released that this to under use used version with work you your"


# Sentences that share words with licences and grant nothing.
OTHERS = [
    "She renewed her driving license at the town office before the holiday.",
    "The council granted the restaurant a license to serve beer and wine.",
    "A fishing licence costs twelve euros for the season.",
    "The book explains what a license is and why projects choose one.",
    "Please ask the owner for permission to use the hall on Sunday.",
    "The painting entered the public domain long ago, said the curator.",
    "All seats are reserved for members of the club.",
    "The rights of the workers were discussed in the general assembly.",
    "He studied free software and its history at MIT in Boston.",
    "The Apache helicopter landed near the general store.",
    "The warranty covers the binary clock for two years.",
    "Poets take license with facts, and nobody minds.",
    "The public library has a version of the map from 1820.",
    "Copying the key without notice is not allowed in this building.",
    "The police checked the license plate of every car on the bridge.",
    "Distribution of the prizes follows under the big tree at noon.",
    "The commission published the terms of the general agreement.",
    "Which licence fits our data is still an open question.",
    "Common creative attribution errors in commercial files.",
    "The software works, the documentation is short, the source is long.",
    "He asked which version of the public license the library used, and nobody knew.",
    "Our guide compares the terms of creative and commercial work without taking sides.",
    "Under the new law the mayor may grant a general permission free of charge.",
    "The foundation published a report on free software in schools.",
    "Redistribution of the land was the purpose of the reform.",
    "All copies of the notice were left in the office of the attorney.",
]
_WORD = "[a-z0-9]+"


def grams(text: str) -> list[str]:
    """Distinct word 1-grams and 2-grams; only A-Z count as upper case."""
    ws = re.findall(_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return list(dict.fromkeys([*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))]))


def templates(family: str) -> list[str]:
    names, ids, sentences = LICENSES[family]
    bare = [re.sub("^the ", "", g.format(n).replace("the CC BY", "CC BY")) for n in names for g in GRANTS]
    return list(dict.fromkeys([*sentences, *bare, *(SPDX.format(i) for i in ids)]))


TEMPLATES = {f: templates(f) for f in LICENSES}
FAMILIES = list(TEMPLATES)


def pairs_of(text: str) -> list[str]:
    return [g for g in grams(text) if " " in g]


@lru_cache(1)
def cues() -> list[str]:
    """Words one of which is in every paragraph that holds MIN_SIMILARITY of some template's 2-grams."""
    need = {}
    for t in dict.fromkeys(t for ts in TEMPLATES.values() for t in ts):
        own = pairs_of(t)
        need[t] = (own, int((1 - MIN_SIMILARITY) * len(own)) + 1)  # so many 2-grams can't all be missing
    common = {w for t in [*OTHERS, COMMON] for w in re.findall(_WORD, t.lower())} - {"license", "licence"}
    words = sorted({w for own, _ in need.values() for g in own for w in g.split() if len(w) > 2})
    out: list[str] = []

    def lacking(cues_: list[str]) -> list[str]:
        return [t for t, (own, n) in need.items() if sum(any(c in g for c in cues_) for g in own) < n]

    while short := lacking(out):
        gain = {w: sum(any(w in g and not any(c in g for c in out) for g in need[t][0]) for t in short) * (1e-3 if w in common else 1) for w in words}
        out.append(max(words, key=lambda w: (gain[w], len(w), w)))
    for c in sorted(out, key=lambda w: (w not in common, len(w), w)):  # poor ones first
        if not lacking([o for o in out if o != c]):
            out.remove(c)
    return out


def _variants(part: str) -> list[tuple[str, int]]:
    """Texts and classes to train on, or to calibrate with: of other templates and sentences. Class 0 is unknown."""
    out = []
    ours = lambda k: (k % 7 == 5) == (part == "calibrate")
    others = [t for k, t in enumerate(OTHERS) if ours(k)]
    for c, f in enumerate(FAMILIES, 1):
        own = [t for k, t in enumerate(TEMPLATES[f]) if ours(k) or len(TEMPLATES[f]) < 5]
        for k, t in enumerate(own):
            ws = t.split()
            a, b = (others[(3 * c + k + j) % len(others)].split() for j in (0, 1))
            out += [(t, c), (" ".join(a[:6] + ws), c), (" ".join(ws + a[-5:]), c), (" ".join(["Copyright", "2019", "Jane", "Doe."] + ws), c), (" ".join(a + ws + b), c)]
            if len(ws) > 6:
                out += [(" ".join(ws[:i] + ws[i + 1 :]), c) for i in range(0, len(ws), 4)]
    for k, t in enumerate(others):
        ws = t.split()
        out += [(t, 0), (" ".join(ws[len(ws) // 2 :]), 0), (" ".join(ws[: len(ws) // 2]), 0), (" ".join(ws[3:] + others[k - 1].split()), 0)]
    return out + [("", 0)] * 10


@lru_cache(1)
def model() -> tuple[dict[str, list[float]], list[float], float]:
    """Weights by gram, intercepts and temperature; class 0 is unknown."""
    data = _variants("train")
    vocab = {g: i for i, g in enumerate(dict.fromkeys(g for t, _ in data for g in grams(t)))}
    n = len(FAMILIES) + 1

    def matrix(rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(vocab)), np.float32)
        for r, (t, _) in enumerate(rows):
            x[r, [vocab[g] for g in grams(t) if g in vocab]] = 1
        return x, np.array([c for _, c in rows])

    x, y = matrix(data)
    weight = ((1 / np.bincount(y, minlength=n))[y] * len(y) / n).astype(np.float32)
    onehot = np.eye(n, dtype=np.float32)[y]
    w, b = np.zeros((len(vocab), n), np.float32), np.zeros(n, np.float32)
    dw, db = np.zeros_like(w), np.zeros_like(b)
    for step in range(400):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - onehot) * weight[:, None] / len(y)
        rate = 1.0 / (1 + step / 100)
        dw = 0.9 * dw - rate * (x.T @ g + 2e-5 * w)
        db = 0.9 * db - rate * g.sum(0)
        w, b = w + dw, b + db
    held, truth = matrix(_variants("calibrate"))
    z = (held @ w + b).astype(float)
    loss = {}
    for k in range(1, 41):
        s = z * (k / 10)
        s = s - s.max(1, keepdims=True)
        loss[k / 10] = -float((s[np.arange(len(s)), truth] - np.log(np.exp(s).sum(1))).mean())
    w, b = np.round(w.astype(float), 4), np.round(b.astype(float), 4)
    return {g: w[i].tolist() for g, i in vocab.items() if np.abs(w[i]).max() >= 0.01}, b.tolist(), min(loss, key=loss.__getitem__)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_WORD), F.lit(0))


def _grams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))))


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def scan_paragraph(text: Column) -> Column:
    """Struct: family (null if unknown or not confirmed), probability, predicted (before confirmation), template, similarity."""
    weights, bias, heat = model()
    names = _literal(["", *FAMILIES], "array<string>")
    known, table_ = _literal(list(weights), "array<string>"), _literal(list(weights.values()), "array<array<double>>")
    shapes = [{"family": f, "template": t, "grams": pairs_of(t)} for f in FAMILIES for t in TEMPLATES[f]]
    shapes_ = _literal(shapes, "array<struct<family:string,template:string,grams:array<string>>>")

    def scored(own: Column) -> Column:
        rows = F.transform(F.array_intersect(own, known), lambda g: F.get(table_, F.array_position(known, g).cast("int") - 1))
        logits = F.aggregate(rows, _literal(bias, "array<double>"), lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b))
        return _bound(logits, lambda z: F.struct(F.transform(z, lambda x: F.exp((x - F.array_max(z)) * heat)).alias("p"), own.alias("grams")))

    def headed(s: Column) -> Column:
        best = F.array_position(s["p"], F.array_max(s["p"])).cast("int")
        total = F.aggregate(s["p"], F.lit(0.0), lambda a, b: a + b)
        return F.struct(F.element_at(names, best).alias("predicted"), (F.array_max(s["p"]) / total).alias("probability"), s["grams"].alias("grams"))

    def confirmed(head: Column) -> Column:
        own = F.filter(shapes_, lambda s: s["family"] == head["predicted"])
        rated = F.transform(own, lambda s: F.struct((F.size(F.array_intersect(s["grams"], head["grams"])) / F.size(s["grams"])).alias("similarity"), s["template"].alias("template")))
        top = F.aggregate(rated, F.struct(F.lit(0.0).alias("similarity"), F.lit("").alias("template")), lambda a, b: F.when(b["similarity"] > a["similarity"], b).otherwise(a))
        good = (head["predicted"] != "") & (head["probability"] >= MIN_PROBABILITY)
        return _bound(
            top,
            lambda x: F.struct(
                F.when(good & (x["similarity"] >= MIN_SIMILARITY), head["predicted"]).alias("family"),
                F.round(head["probability"], 6).alias("probability"),
                head["predicted"].alias("predicted"),
                x["template"].alias("template"),
                F.round(x["similarity"], 6).alias("similarity"),
            ),
        )

    return _bound(_bound(_bound(_grams(_words(text)), scored), headed), confirmed)


def cued(text: Column) -> Column:
    """Whether the text has a cue word. lower() changes more than A-Z, so this may only find more."""
    return _bound(F.lower(text), lambda low: F.exists(F.array(*map(F.lit, cues())), lambda c: low.contains(c)))


def around(lines: Column, i: Column) -> Column:
    """The line numbered i with its neighbours, up to blank lines or REACH lines away."""
    before = F.concat(F.array_join(F.slice(lines, F.greatest(i + 1 - REACH, F.lit(1)), F.least(i, F.lit(REACH))), "\n"), F.lit("\n"))
    after = F.concat(F.lit("\n"), F.array_join(F.slice(lines, i + 2, F.lit(REACH)), "\n"))
    blank = "[ \\t\\x0B\\f\\r]*"
    before = F.regexp_replace(F.concat(F.lit("\n"), before), rf"(?s)^.*\n{blank}\n", "")
    after = F.regexp_replace(F.concat(after, F.lit("\n")), rf"(?s)\n{blank}\n.*$", "")
    return F.concat(before, F.get(lines, i), after)


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_paragraphs (lines), n_scored, licenses (one struct for each confirmed line, with its number from 0, and for
    each template that only a line with those around it confirms, with the first such) and families (distinct, sorted)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = "array<struct<paragraph:int,lines:array<string>>>"
    out = ["family", "probability", "template", "similarity"]

    def found(rows: Column) -> Column:
        scanned = F.transform(rows, lambda s: F.struct(s["paragraph"].alias("paragraph"), scan_paragraph(s["text"]).alias("scan")))
        kept = F.filter(scanned, lambda s: s["scan"]["family"].isNotNull())
        return F.transform(kept, lambda s: F.struct(s["paragraph"].alias("paragraph"), *(s["scan"][k].alias(k) for k in out)))

    def scan(lines: Column) -> Column:
        numbered = F.transform(lines, lambda p, i: F.struct(i.alias("paragraph"), p.alias("text")))
        some = F.filter(numbered, lambda s: cued(s["text"]))
        wide = F.transform(some, lambda s: F.struct(s["paragraph"].alias("paragraph"), around(lines, s["paragraph"]).alias("text")))
        wide = F.filter(wide, lambda s: F.length(s["text"]) > F.length(F.get(lines, s["paragraph"])) + 2)
        both = F.struct(F.size(some).alias("n"), found(some).alias("single"), found(wide).alias("wide"))
        return _bound(both, lambda b: F.struct(b["n"].cast("long").alias("n"), F.concat(b["single"], F.filter(b["wide"], lambda x, i: ~F.exists(b["single"], lambda y: y["family"] == x["family"]) & (F.array_position(F.transform(b["wide"], lambda z: z["template"]), x["template"]) == i + 1))).alias("licenses")))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<paragraph:int,family:string,probability:double,template:string,similarity:double>>").alias("licenses"))
    result = F.when(cued(text), _bound(F.split(text, "\n"), scan)).otherwise(none)
    names = [c for c in docs.columns if c.lower() not in ("n_paragraphs", "n_scored", "licenses", "families")]
    scan_col = "_scan"
    while scan_col.lower() in {c.lower() for c in docs.columns}:
        scan_col += "_"
    kept = docs.select(*(F.col(f"`{c}`") for c in names), F.size(F.split(text, "\n")).cast("long").alias("n_paragraphs"), result.alias(scan_col))
    families = F.array_sort(F.array_distinct(F.transform(F.col(scan_col)["licenses"], lambda s: s["family"])))
    return kept.select(*(F.col(f"`{c}`") for c in names), "n_paragraphs", F.col(scan_col)["n"].alias("n_scored"), F.col(scan_col)["licenses"].alias("licenses"), families.alias("families"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
