"""Licence notices in paragraphs: a trained classifier, confirmed by templates.

Paragraphs are the blocks between blank lines; each is read in windows, its sentences, or pieces of
sentences longer than ``WINDOW`` words. Features are all runs of one, two and three words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, NGram, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudspark.llm.common import numbered

UNKNOWN = "unknown"
NONE = "none"
#: Licence families and how notices name them.
FAMILIES = {
    "AGPL": ["GNU Affero General Public License", "AGPL 3.0", "AGPL v3", "AGPLv3", "Affero General Public License"],
    "Apache": [
        "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache Licence",
        "Apache-2.0", "www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD": [
        "BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD-style license",
        "BSD-3-Clause", "BSD-2-Clause", "BSD licence",
    ],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 License"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero"],
    "GPL": [
        "GNU General Public License, version 3", "GNU General Public License", "GPL v3", "GPL 2.0", "GPL-3.0",
        "GPL v2", "GPLv2", "GPLv3",
    ],
    "ISC": ["ISC License", "ISC licence"],
    "LGPL": [
        "GNU Lesser General Public License", "GNU Library General Public License", "LGPL 2.1", "LGPL v3", "LGPLv3",
    ],
    "MIT": ["MIT License", "MIT Licence", "terms of the MIT license", "MIT-style license", "Identifier: MIT"],
    "MPL": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL 2.0"],
    UNKNOWN: [
        "Eclipse Public License 2.0", "EPL 2.0", "Unlicense", "zlib License", "zlib/libpng License",
        "Boost Software License 1.0", "Artistic License 2.0", "European Union Public Licence 1.2", "WTFPL",
        "Microsoft Public License", "SIL Open Font License 1.1", "PostgreSQL License",
        "Python Software Foundation License", "Common Development and Distribution License",
        "Universal Permissive License", "Academic Free License 3.0", "Open Software License 3.0",
        "Open Database License", "Server Side Public License", "Business Source License 1.1",
        "Elastic License 2.0", "Example Software License 1.0", "Public License", "Software License",
        "Open Source License",
    ],
}
LEADS = (
    "Released under the", "Licensed under", "Licensed under the", "This work is licensed under the",
    "This project is licensed under the", "Distributed under the", "Available under the",
    "SPDX-License-Identifier:", "This file is part of a program under the", "", "The", "Governed by a",
    "Use of this source code is governed by the", "Published under the terms of the", "License:",
    "It is free software, covered by the",
)
#: Bodies and headers of the licences, as far as they tell one from another.
BODIES = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
        "See the GNU Affero General Public License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "CC-BY": [
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ],
    "CC-BY-NC": [
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
    ],
    "CC-BY-SA": [
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
    ],
    "CC0": [
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights "
        "to this work to the public domain worldwide under the CC0 1.0 Universal Public Domain Dedication.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
        "See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
        "See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ],
    UNKNOWN: [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This software is provided 'as-is', without any express or implied warranty.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
        "to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and "
        "changing it is allowed as long as the name is changed.",
    ],
}
#: Families whose bodies do not name them: there a sentence of the body is a template too.
UNNAMED = ("BSD", "ISC", "MIT", UNKNOWN)
#: What speaks of licences without granting one.
OTHERS = (
    "The driver's license was renewed", "All rights reserved", "Copyright by the authors",
    "Licensed under the terms of our agreement", "This work is licensed", "a licensed plumber came",
    "Released under the bridge", "see the license for details", "public domain",
    "the general public", "version 2.0 of the program", "a creative mind", "under the license",
    "Distributed under the table", "Available under the counter", "This project is licensed", "",
    "the software", "the use of the software", "a copy of the book", "in the public domain", "you may use it",
    "the terms of the contract", "subject to the following conditions", "my driver's license",
    "a software license costs money", "a public license office",
)
DENIALS = (
    "not licensed under the", "This is not licensed under the", "not released under the", "not distributed under the",
    "no longer licensed under the", "It was never released under the", "not available under the",
    "is not covered by the",
)
MIN_PROBABILITY, MIN_FAMILY, MIN_SHARED = 0.5, 0.1, 0.5
#: Words of a window, and how many of them the next window of the same sentence shares.
WINDOW, OVERLAP = 60, 20
#: Documents and windows of the corpus that the fit takes as examples of what is no notice.
SAMPLE_DOCS, SAMPLE_WINDOWS = 300, 2000
_BLANK_LINE = r"\n\s*\n"
_SENTENCE_END = r"[.!?]\s+|\n[ \t]*(?:[-•]|[0-9]+[.)])[ \t]"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _runs(words: Column, k: int) -> Column:
    last = F.size(words) - F.lit(k - 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))


def _parts(words: Column) -> Column:
    """What a template is compared by: its runs of two and three words, or its only word."""
    runs = F.array_distinct(F.concat(_runs(words, 2), _runs(words, 3)))
    return F.when(F.size(words) == 1, words).otherwise(runs)


def windows(rows: DataFrame, text: str, *kept: str) -> DataFrame:
    """Columns ``kept``, paragraph, sentence (both from 0) and the words of each window."""
    blocks = rows.select(*kept, F.posexplode(F.split(F.col(text), _BLANK_LINE)).alias("paragraph", "block"))
    sentences = blocks.select(
        *kept, "paragraph", F.posexplode(F.split("block", _SENTENCE_END)).alias("sentence", "part")
    ).select(*kept, "paragraph", "sentence", _words(F.col("part")).alias("words"))
    starts = F.sequence(F.lit(1), F.size("words") - OVERLAP, F.lit(WINDOW - OVERLAP))
    cut = F.transform(starts, lambda i: F.slice("words", i, F.lit(WINDOW)))
    pieces = (
        F.when(F.size("words") > WINDOW, cut)
        .when(F.size("words") > 0, F.array("words"))
        .otherwise(F.array().cast("array<array<string>>"))
    )
    return sentences.select(*kept, "paragraph", "sentence", F.explode(pieces).alias("words"))


def notices(spark: SparkSession) -> DataFrame:
    """Training texts: each lead with each name of a family, the bodies, names in pairs (one row
    for each of the two, of half the weight), and what is not a notice. ``fold`` 1 is held back
    where the temperature is chosen."""
    rows = [
        (f"{lead} {name}.", family, 1.0, i % 3)
        for family, names in FAMILIES.items()
        for name in names
        for i, lead in enumerate(LEADS)
    ]
    rows += [(body, family, 4.0, 0) for family, bodies in BODIES.items() for body in bodies]
    for n, (a, b) in enumerate(combinations(FAMILIES, 2)):
        for i in range(2):
            x, y = FAMILIES[a][i % len(FAMILIES[a])], FAMILIES[b][i % len(FAMILIES[b])]
            texts = [f"{x} or the {y}.", f"Licensed under the {y} or the {x}.", f"Dual licensed under {x} and {y}."]
            rows += [(t, f, 0.5, n % 3) for t in texts for f in (a, b)]
    rows += [(f"{x}{end}", NONE, 1.0, i % 3) for i, x in enumerate(OTHERS) for end in (".", " today", " and so on")]
    rows += [
        (f"{lead} {name}.", NONE, 1.0, i % 3)
        for names in FAMILIES.values()
        for name in names
        for i, lead in enumerate(DENIALS)
    ]
    return spark.createDataFrame(rows, "text string, family string, weight double, fold int")


def templates(spark: SparkSession) -> DataFrame:
    """Templates of each family: the runs of words of a name or of a body's window."""
    rows = [(f, n, False) for f, names in FAMILIES.items() for n in names]
    rows += [(f, b, True) for f in UNNAMED for b in BODIES[f]]
    texts = spark.createDataFrame(rows, "family string, text string, body boolean")
    names = texts.where("NOT body").select("family", _words(F.col("text")).alias("words"))
    bodies = windows(texts.where("body"), "text", "family").select("family", "words")
    return names.union(bodies).select("family", _parts(F.col("words")).alias("template"))


def _shared(grams: str, template: str) -> Column:
    """The share of a template's runs that the window has."""
    return F.size(F.array_intersect(template, grams)) / F.size(template)


def _grams() -> PipelineModel:
    return PipelineModel([
        NGram(n=2, inputCol="words", outputCol="two"),
        NGram(n=3, inputCol="words", outputCol="three"),
        SQLTransformer(statement="SELECT *, concat(words, two, three) AS grams FROM __THIS__"),
    ])


def _negatives(docs: DataFrame, text_col: str) -> DataFrame:
    """Windows of the documents with the least text hashes, as examples of what is no notice: those
    that no template confirms, which could not be reported anyway."""
    spark = docs.sparkSession
    texts = docs.select(docs[text_col].cast("string").alias("text")).where("text IS NOT NULL")
    hashed = texts.withColumn("h", F.xxhash64("text"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).collect()]
    sample = hashed.where(F.col("h") <= (max(least) if least else 0))
    found = windows(sample, "text").select("words").distinct().orderBy(F.xxhash64("words"), "words").limit(SAMPLE_WINDOWS)
    return (
        _grams().transform(found)
        .join(F.broadcast(templates(spark)), _shared("grams", "template") >= MIN_SHARED, "left_anti")
        .select("words", F.lit(NONE).alias("family"), F.lit(1.0).alias("weight"), F.pmod(F.xxhash64("words"), F.lit(3)).cast("int").alias("fold"))
    )


@dataclass
class Model:
    """Runs of words, their numbers, the fit, its classes, and the temperature that calibrates the
    probabilities on texts that a first fit has not seen."""

    grams: PipelineModel
    vectors: CountVectorizerModel
    fit: LogisticRegressionModel
    classes: list[str]
    temperature: float

    def scores(self, rows: DataFrame) -> DataFrame:
        """Adds ``raw``: the intercept of each class plus the weights of the window's runs, by the
        temperature. The array is exploded so that it is made once a window."""
        found = self.fit.transform(self.vectors.transform(self.grams.transform(rows)))
        raw = F.transform(vector_to_array("rawPrediction"), lambda x: x / self.temperature)
        return found.select(*rows.columns, F.explode(F.array(raw)).alias("raw"))


def train(docs: DataFrame, text_col: str = "text", regularization: float = 0.0003) -> Model:
    """Fits the notices and a bounded sample of windows of ``docs`` that are none. The numbered
    runs are those of the notices, so the model's size does not grow with the documents."""
    spark = docs.sparkSession
    classes = sorted([*FAMILIES, NONE])
    grams = _grams()
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("family")).cast("double") - 1
    made = windows(notices(spark), "text", "family", "weight", "fold").select("words", "family", "weight", "fold")
    vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=1 << 20).fit(
        grams.transform(made)
    )
    rows = made.union(_negatives(docs, text_col)).withColumn("label", label).coalesce(1)
    rows = vectors.transform(grams.transform(rows)).select("label", "weight", "fold", "features").cache()
    fit = LogisticRegression(
        regParam=regularization, elasticNetParam=0.5, family="multinomial", maxIter=100, tol=1e-3,
        standardization=False, weightCol="weight", probabilityCol="", predictionCol="",
    ).fit
    tried = fit(rows.where("fold <> 1")).transform(rows.where("fold = 1"))
    tried = [(int(r.label), r.weight, r.rawPrediction.toArray()) for r in tried.select("label", "weight", "rawPrediction").collect()]

    def loss(t: float) -> float:
        out = 0.0
        for own, weight, raw in tried:
            raw = raw / t
            top = max(raw)
            out -= weight * (raw[own] - top - math.log(sum(math.exp(x - top) for x in raw)))
        return out

    temperature = min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0), key=loss)
    model = Model(grams, vectors, fit(rows), classes, temperature)
    rows.unpersist()
    return model


def license_paragraphs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None
) -> DataFrame:
    """Licence notices of each text: id, paragraph and sentence (from 0), family, probability, and
    the share of its template.

    Every window of every paragraph is scored. It is a notice when the class ``none`` has at most
    ``1 - MIN_PROBABILITY`` after calibration, and then gives each family with ``MIN_FAMILY`` or
    more of which some template has at least ``MIN_SHARED`` of its runs of words in the window: so
    one window may name several. Notices of other licences are of the family ``unknown``. Null and
    empty texts have no windows. Rows that repeat an id should not share it: their notices would
    be taken for one. Only notices are shuffled; templates are a small table of fixed size.
    Without a ``model`` one is fitted, its examples of no notice from ``docs``.
    """
    model = model or train(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))
    scored = model.scores(windows(rows, "t", "id"))
    none = model.classes.index(NONE)
    odds = F.aggregate("raw", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("raw")[none]))
    likely = scored.where((1 - MIN_PROBABILITY) * odds >= 1)
    top = F.array_max("raw")
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    families = F.transform(
        F.array(*map(F.lit, model.classes)),
        lambda c, i: F.struct(c.alias("family"), (F.exp(F.get("raw", i) - top) / total).alias("probability")),
    )
    each = (
        model.grams.transform(likely)
        .select("id", "paragraph", "sentence", "grams", F.inline(families))
        .where((F.col("family") != NONE) & (F.col("probability") >= MIN_FAMILY))
    )
    return (
        each.join(F.broadcast(templates(docs.sparkSession)), "family")
        .withColumn("shared", _shared("grams", "template"))
        .where(F.col("shared") >= MIN_SHARED)
        .groupBy("id", "paragraph", "sentence", "family")
        .agg(F.max("probability").alias("probability"), F.max("shared").alias("shared"))
        .withColumnRenamed("id", id_col)
    )


def license_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None
) -> DataFrame:
    """Notices and families of each document; all documents, also those without. Rows that repeat
    an id, or have none, are documents of their own."""
    rows, key = numbered(docs, id_col)
    found = (
        license_paragraphs(rows, key, text_col, model)
        .groupBy(F.col(key).alias("k"))
        .agg(
            F.count("*").alias("n"),
            F.array_join(F.sort_array(F.collect_set("family")), ",").alias("f"),
            F.round(F.min("probability"), 6).alias("p"),
        )
    )
    ids = rows.select(rows[id_col].alias("id"), rows[key].alias("k"))
    return ids.join(found, "k", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("f", F.lit("")).alias("families"),
        F.col("p").alias("least_probability"),
    )
