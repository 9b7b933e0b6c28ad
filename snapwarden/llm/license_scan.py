"""Licence scan: a trained paragraph classifier in DataFrame operations.

A paragraph is a run of lines without a blank line; lines of comment marks alone are blank. Every paragraph is classified,
long ones in overlapping windows of words. Features are the word n-grams (1 to 3 words) of the training notices that hold a
word other than the most common ones. A multinomial logistic regression, trained on the driver on varied notices, on texts
of other licences and on prose, gives a probability for each family and for "unknown"; a temperature calibrates it, fitted
on notices of which the calibrated fit has seen none. A predicted family is confirmed by comparison with its templates:
enough of the n-grams of a notice, or of a piece of a long one, must be in the window.

The model is sparse: an n-gram that isn't in the vocabulary has no weight, so a paragraph's row carries its known n-grams
only, and one without any gets the bias, which says "unknown". The weights are a table of one row for each n-gram of the
notices below, whose size doesn't depend on the corpus; it is broadcast.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapwarden.llm.storage import materialise

UNKNOWN = "unknown"
#: Words of a window, and from one window's begin to the next one's.
WINDOW, STRIDE = 64, 32
#: A long notice is compared in pieces of so many words, which always lie whole in some window.
PIECE = 24
#: Between paragraphs: a line of blanks and comment marks.
BREAK = r"\n[ \t\r/*#;%<>!\"'=_|-]*(?=\n)"

#: Notices by which works name their licence, and the opening paragraphs of the licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Distributed under the MIT License. See LICENSE for more information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache License 2.0",
        "This software is distributed under the terms of the Apache 2.0 license",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL license version 2",
        "Licensed under the terms of the GNU GPL v2 or later",
        "Distributed under the GNU General Public License v3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Released under the LGPL",
        "Licensed under the terms of the GNU LGPL v2.1 or later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the terms of the AGPL v3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "Released under the MPL 2.0 license",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD license",
        "Distributed under the terms of the Modified BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Licensed under the ISC license",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Text is available under the Creative Commons Attribution License",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Text is available under the Creative Commons Attribution-NonCommercial License",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal",
        "Released under CC0 1.0",
        "SPDX-License-Identifier: CC0-1.0",
        "Dedicated to the public domain under the Creative Commons Zero license",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        "SPDX-License-Identifier: Unlicense",
        "Released into the public domain under the Unlicense",
    ),
    "Proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the copyright owner.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}
#: Prose that has words of licences and is none, and licences of no family above.
OTHERS = (
    "The driver must carry a valid license and the insurance papers of the car.",
    "She was granted permission to enter the building after hours.",
    "The general public was invited to the free concert in the park.",
    "The new version of the software will be released next spring under a new name.",
    "A fishing licence costs ten pounds and is valid for one year.",
    "Students work under the terms of the agreement with the university.",
    "The source of the river and the form of the valley are shown on the map.",
    "The author has written the following chapters without the help of others.",
    "It is common to copy the file to another disk and to use it there.",
    "The warranty covers parts and labour for two years.",
    "Creative writing courses are common at public libraries.",
    "He studied at MIT and later moved to the Mozilla office.",
    "The Apache helicopter was built under license in another country.",
    "The foundation published a free copy of the program for the general public.",
    "Civil rights were reserved to citizens, and all property rights with them.",
    "The library will copy and distribute the documentation to any person without charge.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the Eclipse Public License v2.0",
    "Do what the fuck you want to public license, version 2",
    "Licensed under the Boost Software License, Version 1.0.",
    "This package is distributed under the Artistic License 2.0",
    "Licensed under the EUPL, the European Union Public Licence",
    "Made available under the Open Database License",
    "This software is governed by the CeCILL license under French law",
)
#: Words too common to make a feature by themselves.
COMMON = frozenset("a all an and any are as at be by can for from has have if in is it its may new no not of on one or other part see that the their there they this to was were which will with you your".split())


def words_of(text: str) -> list[str]:
    """Runs of a-z and 0-9 of the text in lower case; both spellings of licence are one."""
    return [w for w in "".join(c if "a" <= c <= "z" or "0" <= c <= "9" else " " for c in text.lower().replace("licence", "license")).split(" ") if w]


def grams(words: list[str]) -> set[str]:
    """n-grams of 1 to 3 words with a word that isn't common."""
    spans = (words[i : i + n] for n in (1, 2, 3) for i in range(len(words) - n + 1))
    return {" ".join(x) for x in spans if not COMMON.issuperset(x)}


def _varied(rng: random.Random, notices: list[tuple[str, str]], filler: list[str], copies: int) -> list[tuple[set[str], str]]:
    """Each notice as it is and with words lost, numbers changed and prose around it; long ones piece by piece too."""
    out = []
    for family, text in notices:
        words = words_of(text)
        parts = [words, *[words[i : i + PIECE] for i in range(0, len(words), PIECE) if len(words) > PIECE]]
        for part in parts:
            out.append((grams(part), family))
            for _ in range(copies):
                kept = [w if not w.isdigit() or rng.random() < 0.7 else str(rng.randint(1, 5)) for w in part if rng.random() > 0.05]
                out.append((grams(rng.choices(filler, k=rng.randint(0, 25)) + kept + rng.choices(filler, k=rng.randint(0, 25))), family))
    return out


def _prose(rng: random.Random, vocabulary: list[str], filler: list[str]) -> list[tuple[set[str], str]]:
    """Prose alone, and words of notices in any order: single words are no licence."""
    out = [(grams(rng.choices(filler, k=rng.randint(4, 60))), UNKNOWN) for _ in range(200)]
    return out + [(grams(rng.choices(filler, k=rng.randint(4, 40)) + rng.sample(vocabulary, rng.randint(1, 12))), UNKNOWN) for _ in range(400)]


class Classifier:
    """Softmax regression on sets of n-grams. Weights below 0.01 are dropped."""

    def __init__(self, rows: list[tuple[set[str], str]], names: tuple[str, ...], vocabulary: list[str], rounds: int = 250, rate: float = 0.3, decay: float = 1e-5):
        self.names, self.vocabulary = names, {g: i for i, g in enumerate(vocabulary)}
        x, y = self.matrix(rows)
        w, b = np.zeros((len(self.vocabulary), len(names)), np.float32), np.zeros(len(names))
        hot, seen_w, seen_b = np.eye(len(names), dtype=np.float32)[y], np.full_like(w, 1e-8), 1e-8
        for _ in range(rounds):
            z = x @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            err = (p / p.sum(axis=1, keepdims=True) - hot).astype(np.float32) / len(y)
            gw, gb = x.T @ err + decay * w, err.sum(axis=0)
            seen_w, seen_b = seen_w + gw**2, seen_b + gb**2
            w, b = w - rate * gw / np.sqrt(seen_w), b - rate * gb / np.sqrt(seen_b)
        w[np.abs(w) < 0.01] = 0
        self.weights, self.bias = w.astype(float), b

    def matrix(self, rows: list[tuple[set[str], str]]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.zeros((len(rows), len(self.vocabulary)), np.float32), np.zeros(len(rows), int)
        for i, (found, family) in enumerate(rows):
            x[i, [self.vocabulary[g] for g in found if g in self.vocabulary]] = 1
            y[i] = self.names.index(family)
        return x, y

    def loss(self, rows: list[tuple[set[str], str]], heat: float) -> float:
        x, y = self.matrix(rows)
        z = (x @ self.weights + self.bias) / heat
        z -= z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean())


def _notices() -> list[tuple[str, str]]:
    return [*[(family, text) for family, texts in TEMPLATES.items() for text in texts], *[(UNKNOWN, text) for text in OTHERS]]


@cache
def model(seed: int = 5) -> tuple[tuple[str, ...], dict[str, tuple[float, ...]], tuple[float, ...], float]:
    """Families, weights by n-gram, biases and temperature.

    The temperature comes from a fit without every third notice, tried on those; the weights from a fit on all notices.
    """
    names = (*TEMPLATES, UNKNOWN)
    filler = [w for t in OTHERS[:16] for w in words_of(t)] + [f"w{i}" for i in range(60)]
    telling = sorted({w for _, t in _notices() for w in words_of(t)} - COMMON)

    def rows(notices: list[tuple[str, str]], copies: int, start: int) -> list[tuple[set[str], str]]:
        rng = random.Random(start)
        return _varied(rng, notices, filler, copies) + _prose(rng, telling, filler)

    def fitted(notices: list[tuple[str, str]], copies: int, start: int) -> Classifier:
        return Classifier(rows(notices, copies, start), names, sorted({g for _, t in notices for g in grams(words_of(t))}))

    every = _notices()
    held = [x for i, x in enumerate(every) if i % 3 == 1 and len(words_of(x[1])) <= PIECE]  # the only texts of long notices are needed in training
    trial, tried = fitted([x for x in every if x not in held], 4, seed), rows(held, 4, seed + 1)
    heat = min((0.5 + 0.1 * i for i in range(36)), key=lambda t: trial.loss(tried, t))
    best = fitted(every, 6, seed + 2)
    weights = {g: tuple(round(float(v), 6) for v in best.weights[i]) for g, i in best.vocabulary.items() if best.weights[i].any()}
    return names, weights, tuple(round(float(v), 6) for v in best.bias), round(heat, 6)


@cache
def templates() -> tuple[tuple[int, str, str, int], ...]:
    """Rows (piece, family, n-gram, number of the piece's n-grams)."""
    out, k = [], 0
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = words_of(text)
            for i in range(0, len(words), PIECE):
                piece = words[i : i + PIECE] if len(words) - i >= PIECE // 2 or not i else words[-PIECE:]
                found = grams(piece)
                out += [(k, family, g, len(found)) for g in sorted(found)]
                k += 1
    return tuple(out)


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def known_grams(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A table (row, id, paragraph, found): one row for each paragraph with words, and one with a null paragraph for a text without any.

    found: "window n-gram" of the paragraph's n-grams that the model or a template knows. All that follows reads this table,
    so the numbers of rows are drawn once, and the texts are read once.
    """
    _, weights, _, _ = model()
    known = sorted({*weights, *(g for _, _, g, _ in templates())})
    telling = sorted({w for g in known for w in g.split()} - COMMON)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    bare = F.transform(F.split(text, BREAK), lambda p: F.trim(F.regexp_replace(F.replace(F.lower(p), F.lit("licence"), F.lit("license")), "[^a-z0-9]+", " ")))
    paragraphs = F.filter(bare, lambda p: p != "")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), paragraphs.alias("ps"))
    one = base.select("row", "id", F.posexplode_outer("ps").alias("paragraph", "body")).select("row", "id", "paragraph", F.split(F.coalesce("body", F.lit("")), " ").alias("words"))
    at = F.expr(f"filter(sequence(0, size(words) - 1), i -> words[i] in ({_listed(telling)}))")
    marked = one.select("row", "id", "paragraph", "words", at.alias("at"))
    # the six n-grams that hold the word at i; out-of-range ones are dropped
    spans = "flatten(transform(at, i -> array(struct(i as s, 1 as n), struct(i - 1 as s, 2 as n), struct(i as s, 2 as n), struct(i - 2 as s, 3 as n), struct(i - 1 as s, 3 as n), struct(i as s, 3 as n))))"
    inside = f"filter({spans}, x -> x.s >= 0 and x.s + x.n <= size(words))"
    named = f"transform({inside}, x -> struct(x.s as s, x.n as n, array_join(slice(words, x.s + 1, x.n), ' ') as g))"
    kept = f"filter({named}, x -> x.g in ({_listed(known)}))"
    first, last = f"greatest(0, cast(ceil((x.s + x.n - {WINDOW}) / {STRIDE}) as int))", f"least(x.s div {STRIDE}, greatest(0, cast(ceil((size(words) - {WINDOW}) / {STRIDE}) as int)))"
    placed = f"array_distinct(flatten(transform({kept}, x -> transform(sequence({first}, cast({last} as int)), k -> concat(k, ' ', x.g)))))"
    return materialise(marked.select("row", "id", "paragraph", F.expr(placed).alias("found")), "licence-grams")


def scan_licenses(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5, overlap: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """docs → (windows, rows).

    windows: row, paragraph, window, family, probability, template_overlap, confirmed of each window with a known n-gram;
    a window without one is unknown by the bias. rows: row, id, n_paragraphs of all input rows. A family is confirmed where
    its probability reaches ``threshold`` and ``overlap`` of the n-grams of one of its templates' pieces are there. A null,
    empty or blank text has no paragraphs. Null and repeated ids and repeated rows stay apart, as rows are numbered; other
    columns don't matter, whatever their names; an empty table gives empty tables. Windows are short, so no group grows
    with a text's length, with copies of a text or with frequent words.
    """
    spark = docs.sparkSession
    names, weights, bias, heat = model()
    table = known_grams(docs, id_column, text_column)
    found = table.select("row", "paragraph", F.explode("found").alias("x")).select("row", "paragraph", F.substring_index("x", " ", 1).cast("int").alias("window"), F.expr("substring(x, instr(x, ' ') + 1)").alias("gram"))
    place = ["row", "paragraph", "window"]

    columns = ", ".join(f"w{i} double" for i in range(len(names)))
    weighed = F.broadcast(spark.createDataFrame([(g, *v) for g, v in weights.items()], f"gram string, {columns}"))
    marks = F.broadcast(spark.createDataFrame([*templates()], "piece int, family string, gram string, n int"))
    sums = found.join(weighed, "gram", "left").groupBy(*place).agg(*[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"z{i}") for i in range(len(names))])
    logit = [(F.col(f"z{i}") + F.lit(b)) / F.lit(heat) for i, b in enumerate(bias)]
    top = F.greatest(*logit)
    scored = sums.select(*place, F.array(*[F.exp(z - top) for z in logit]).alias("e")).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    best = F.array_max("e")
    scored = scored.select(*place, F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position("e", best).cast("int")).alias("family"), (best / F.col("total")).alias("probability"))
    compared = found.join(marks, "gram").groupBy(*place, "family", "piece").agg((F.count(F.lit(1)) / F.first("n")).alias("part")).groupBy(*place, "family").agg(F.max("part").alias("template_overlap"))
    judged = scored.join(compared, [*place, "family"], "left").select(*place, "family", "probability", F.coalesce("template_overlap", F.lit(0.0)).alias("template_overlap"))
    judged = judged.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("probability") >= threshold) & (F.col("template_overlap") >= overlap))
    rows = table.groupBy("row").agg(F.first("id").alias("id"), F.count("paragraph").alias("n_paragraphs"))
    return judged, rows


def document_licenses(docs: DataFrame, *, id_column: str = "doc_id", **options) -> DataFrame:
    """Per input row: id, families (sorted confirmed ones), n_paragraphs, n_licensed (paragraphs with a confirmed family),
    n_unknown (the others), probability (the largest of the confirmed, null without).

    "All rights reserved" counts only where no other family is confirmed, as open licences say it too. Null and empty texts
    have no paragraphs and no family; the rest is as in scan_licenses.
    """
    windows, rows = scan_licenses(docs, id_column=id_column, **options)
    hits = windows.where("confirmed").groupBy("row", "paragraph").agg(F.collect_set("family").alias("f"), F.max("probability").alias("p"))
    hits = hits.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("f"))).alias("f"), F.count(F.lit(1)).alias("n"), F.max("p").alias("p"))
    open_ = F.filter("f", lambda x: x != "Proprietary")
    named = F.array_join(F.array_sort(F.when(F.size(open_) > 0, open_).otherwise(F.col("f"))), ",")
    per = hits.select(F.col("row").alias("r"), named.alias("families"), F.col("n").alias("n_licensed"), F.col("p").alias("probability"))
    licensed = F.coalesce("n_licensed", F.lit(0))
    return rows.join(per, F.col("row") == F.col("r"), "left").select(F.col("id").alias(id_column), F.coalesce("families", F.lit("")).alias("families"), "n_paragraphs", licensed.alias("n_licensed"), (F.col("n_paragraphs") - licensed).alias("n_unknown"), F.round("probability", 6).alias("probability"))
