"""License scans: a trained paragraph classifier, confirmed by template comparison. DataFrame functions only.

A paragraph is a line, or a run of non-blank lines joined by blanks (a wrapped notice). A run is reported in place
of its lines of the same family, with the number of its first line, if it confirms more templates than they do.

Features are all word 1- to 3-grams of the templates below that are rare in the corpus (in fewer than ``COMMON`` of a
bounded sample of its paragraphs) and hold a word that is: what stands in every other paragraph tells no licence. Multinomial logistic
regression (Spark ML, L1 and L2 terms, sparse weights) is trained on the templates, on variations of them
(a word left out, words of the corpus around them) and, for the class 'unknown', on sentences that speak of licences
without being any and on sampled paragraphs of the corpus that resemble no template. A temperature calibrates the
probabilities: it is fitted on templates, variations and corpus paragraphs that a first model did not see; the
final model is trained on all. Below ``MIN_PROB`` a paragraph is unknown. A prediction is confirmed if enough of a template's word
pairs stand in the paragraph.

Every paragraph is scored. One that holds no weighted n-gram has the intercepts alone for a score, which is
checked to be 'unknown'; so only paragraphs with a word of some weighted n-gram (:meth:`LicenseModel.words`, taken from
the trained weights) are taken apart. Scoring joins their n-grams to the broadcast weight table (its size is that of the
templates) and sums per distinct paragraph; equal paragraphs are scored once.

Defined results: null and blank texts have no paragraphs and no rows; repeated rows give repeated
rows; null ids are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialize

# Typical notices of each family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "either version 2 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU General Public License along with this program",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GPL-2.0-only",
        "LGPL-2.1",
        "AGPL-3.0-or-later",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
        "under the terms of the GNU Affero General Public License",
    ],
    "creative_commons": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Creative Commons Attribution 4.0 International",
        "CC BY-SA 4.0",
        "CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    ],
    "mozilla": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "eclipse": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License - Version 1.0",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "For more information, please refer to unlicense.org",
        "SPDX-License-Identifier: Unlicense",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "proprietary": [
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This software is proprietary and confidential; it is licensed, not sold.",
    ],
    "unknown": [
        "You need a driving license to rent a car here.",
        "The license plate was found near the river.",
        "Copyright law was debated in parliament last week.",
        "She asked for permission to leave the room early.",
        "The warranty on this device covers two years of use.",
        "A fishing licence costs twenty dollars a year.",
        "He was reserved and quiet, and his warrant was never served.",
        "The wealth was redistributed among the villages.",
        "Apache helicopters flew over the desert.",
        "Mozilla announced a new browser yesterday.",
        "A gnu is a large antelope of the plains.",
        "Permission denied while opening the file.",
        "The bar lost its liquor license after the incident.",
        "They argued about the copyright of the old song.",
    ],
}
FAMILIES = list(TEMPLATES)
UNKNOWN = FAMILIES.index("unknown")
MIN_PROB = 0.5
#: Share of a template's word pairs that confirms a prediction.
CONFIRM = 0.6
#: Texts of the corpus, picked by a hash, and paragraphs of them that train and calibrate 'unknown', at most.
SAMPLE_TEXTS, SAMPLE_PARAGRAPHS = 400, 1500
#: A sampled paragraph with this share of a template's word pairs is left out of 'unknown'.
RESEMBLES = 0.3
#: An n-gram in at least this share of the sampled paragraphs is no feature.
COMMON = 0.01
#: Words of the corpus that surround templates in training, at most.
BACKGROUND_WORDS = 400


def words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(w: Column, n: int) -> Column:
    """The n-grams of an array of words, each joined by blanks (no lambda reads ``w``: it would be made anew for each)."""
    out = w
    for k in range(1, n):
        size = F.greatest(F.size(w) - k, F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), size), F.slice(w, F.lit(k + 1), size), lambda x, y: F.concat(x, F.lit(" "), y))
    return out


def features(line: Column) -> Column:
    w = words(line)
    return F.array_distinct(F.concat(ngrams(w, 1), ngrams(w, 2), ngrams(w, 3)))


def _rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A table of literals (bounded by the templates)."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def templates(spark: SparkSession) -> DataFrame:
    return _rows(spark, [{"family": k, "tid": 100 * k + i, "t": t} for k, f in enumerate(FAMILIES) for i, t in enumerate(TEMPLATES[f])],
                 "family int, tid int, t string")


def _pairs(spark: SparkSession) -> DataFrame:
    """(family, tid, n, g): the distinct word pairs of each licence template; n of them."""
    t = templates(spark).where(F.col("family") != UNKNOWN).select("family", "tid", F.array_distinct(ngrams(words(F.col("t")), 2)).alias("g"))
    return t.select("family", "tid", F.size("g").alias("n"), F.explode("g").alias("g"))


def _sample(docs: DataFrame, text_col: str) -> DataFrame:
    """(line): at most SAMPLE_PARAGRAPHS different lines of at most SAMPLE_TEXTS texts, picked by hashes, that resemble no template."""
    text = F.col(text_col).cast("string")
    few = docs.where(text.isNotNull()).select(text.alias("t")).distinct().orderBy(F.xxhash64("t"), "t").limit(SAMPLE_TEXTS)
    lines = few.select(F.explode(F.split("t", "\n")).alias("line")).where(F.size(words(F.col("line"))) > 0).distinct()
    lines = lines.select("line", F.md5("line").alias("lid")).orderBy("lid").limit(4 * SAMPLE_PARAGRAPHS)
    lines = materialize(lines)
    g = lines.select("lid", F.explode(F.array_distinct(ngrams(words(F.col("line")), 2))).alias("g"))
    like = g.join(F.broadcast(_pairs(docs.sparkSession)), "g").groupBy("lid", "tid", "n").agg(F.count(F.lit(1)).alias("c"))
    like = like.where(F.col("c") >= RESEMBLES * F.col("n")).select("lid").distinct()
    return materialize(lines.join(like, "lid", "left_anti").orderBy("lid").limit(SAMPLE_PARAGRAPHS).select("line", "lid"))


def _training(spark: SparkSession, sample: DataFrame) -> DataFrame:
    """(family, held, line): templates, each with a word left out, and inside words of the corpus; sampled paragraphs.

    ``held``: every fourth template of a family, a third of the variations of the others, and every fourth sampled paragraph."""
    t = templates(spark).withColumn("w", F.split("t", " "))
    n = F.size("w")
    cut = t.select("family", "tid", F.explode(F.sequence(F.lit(0), n)).alias("i"), "w", n.alias("n"))
    cut = cut.where((F.col("i") == 0) | (F.col("n") > 3)).select(
        "family", "tid", "i", F.array_join(F.concat(F.slice("w", 1, F.greatest(F.col("i") - 1, F.lit(0))),
                                                    F.slice("w", F.col("i") + 1, F.col("n"))), " ").alias("line"))
    some = sample.select(F.explode(words(F.col("line"))).alias("w")).distinct().orderBy(F.md5("w")).limit(BACKGROUND_WORDS)
    noise = some.agg(F.array_sort(F.collect_list("w")).alias("noise"))  # at most BACKGROUND_WORDS
    around = cut.select("family", "tid", "i", "line", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).withColumn("one", F.lit(1))
    around = around.join(F.broadcast(noise.withColumn("one", F.lit(1))), "one")
    size = F.greatest(F.size("noise") - 8, F.lit(1))
    some = lambda seed: F.array_join(F.slice("noise", F.pmod(F.xxhash64("tid", "i", "k", F.lit(seed)), size).cast("int") + 1, 6), " ")
    unseen = (F.pmod("tid", F.lit(100)) % 4 == 3) | (F.pmod(F.xxhash64("tid", "i", "k"), F.lit(3)) == 0)
    made = around.select("family", unseen.alias("held"), F.when(F.col("k") == 0, F.col("line"))
                         .when(F.col("k") == 1, F.concat_ws(" ", some(1), "line"))
                         .otherwise(F.concat_ws(" ", some(2), "line", some(3))).alias("line"))
    return made.unionByName(sample.select(F.lit(UNKNOWN).alias("family"), (F.pmod(F.xxhash64("lid"), F.lit(4)) == 0).alias("held"), "line"))


class LicenseModel:
    """Sparse weights of n-grams for each family, intercepts, and the temperature."""

    def __init__(self, vocabulary: list[str], weights, intercepts, temperature: float = 1.0):
        on = [j for j in range(len(vocabulary)) if abs(weights[:, j]).max() > 1e-6]
        self.vocabulary, self.weights = [vocabulary[j] for j in on], weights[:, on]
        self.intercepts, self.temperature = [float(x) for x in intercepts], temperature
        # a paragraph without any of them
        top = max(self.intercepts)
        rest = {k: math.exp((x - top) / temperature) for k, x in enumerate(self.intercepts)}
        if max((p for k, p in rest.items() if k != UNKNOWN), default=0) / sum(rest.values()) >= MIN_PROB:
            raise ValueError("without any feature a paragraph would be a licence")

    def words(self) -> list[str]:
        """Words of which a paragraph with a weighted n-gram holds at least one: single ones, and for longer n-grams without
        these their longest word."""
        alone = {g for g in self.vocabulary if " " not in g}
        more = {max(g.split(" "), key=lambda w: (len(w), w)) for g in self.vocabulary if not alone & set(g.split(" "))}
        return sorted(alone | more)

    def table(self, spark: SparkSession) -> DataFrame:
        w = [{"g": g, "w": [round(float(x), 6) for x in self.weights[:, j]]} for j, g in enumerate(self.vocabulary)]
        return _rows(spark, w, "g string, w array<double>")

    def probabilities(self, lines: DataFrame) -> DataFrame:
        """(lid, p): calibrated probabilities of the families for lines (lid, line)."""
        grams = lines.select("lid", F.explode(features(F.col("line"))).alias("g"))
        hit = grams.join(F.broadcast(self.table(lines.sparkSession)), "g")  # as many rows as the templates have n-grams
        sums = hit.groupBy("lid").agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(FAMILIES))])
        all_ = lines.select("lid").join(sums, "lid", "left")
        z = F.array(*[(F.coalesce(f"s{k}", F.lit(0.0)) + self.intercepts[k]) / self.temperature for k in range(len(FAMILIES))])
        scored = all_.select("lid", z.alias("z")).withColumn("top", F.array_max("z"))
        scored = scored.select("lid", F.transform("z", lambda x: F.exp(x - F.col("top"))).alias("e"))
        scored = scored.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
        return scored.select("lid", F.transform("e", lambda x: F.try_divide(x, F.col("total"))).alias("p"))


def fit(docs: DataFrame, text_col: str = "text") -> LicenseModel:
    """Train on the templates and a bounded sample of the paragraphs of ``docs``."""
    spark = docs.sparkSession
    sample = _sample(docs, text_col)
    made = materialize(_training(spark, sample).withColumn("f", features(F.col("line"))))
    # n-grams of the templates that are rare in the corpus
    often = sample.select("lid", F.explode(features(F.col("line"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    often = often.where(F.col("n") >= F.lit(max(2, math.ceil(COMMON * sample.count())))).select("g")
    own = templates(spark).where(F.col("family") != UNKNOWN).select(F.explode(features(F.col("t"))).alias("g")).distinct()
    own = own.join(often.select("g", F.lit(True).alias("often")), "g", "left").collect()  # of the templates
    common = {r["g"] for r in own if r["often"]}
    vocabulary = sorted(r["g"] for r in own if r["g"] not in common and set(r["g"].split(" ")) - common)
    cv = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="f", outputCol="x")
    cv.setBinary(True)
    seen = materialize(cv.transform(made).select("x", "held", F.col("family").cast("double").alias("label"), "family"))
    lr = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=0.0005, elasticNetParam=0.1,
                            standardization=False, maxIter=60)
    first = lr.fit(seen.where("not held"))
    raw = first.transform(seen.where("held")).select("family", vector_to_array("rawPrediction").alias("z")).where("family < size(z)")
    # negative log likelihood of what the first model did not see, for a few temperatures; a family counts alike however many rows it has
    grid = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]

    def loss(t: float) -> Column:
        top = F.array_max("z")
        total = F.aggregate(F.transform("z", lambda x: F.exp((x - top) / t)), F.lit(0.0), lambda a, x: a + x)
        return F.avg(F.log(total) - (F.expr("z[family]") - top) / t)
    r = raw.groupBy("family").agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(grid)]).agg(*[F.avg(f"t{i}").alias(f"t{i}") for i in range(len(grid))]).first()
    best = min(range(len(grid)), key=lambda i: r[i] if r[i] is not None else math.inf)
    final = lr.fit(seen)
    return LicenseModel(vocabulary, final.coefficientMatrix.toArray(), final.interceptVector.toArray(), grid[best])


def _paragraphs(docs: DataFrame, gate: list[str], id_col: str, text_col: str) -> DataFrame:
    """(__id, __doc, paragraph, last, line, lid): lines, and runs of several non-blank ones, that hold a word of ``gate``."""
    some = F.array(*[F.lit(w) for w in gate])
    text = docs.select(F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__doc"), F.col(text_col).cast("string").alias("t"))
    text = text.where(F.arrays_overlap(words(F.col("t")), some)).select("__id", "__doc", F.split("t", "\n").alias("ls"))
    blank = F.transform("ls", lambda x: F.rlike(x, F.lit(r"^\s*$")))
    edge = F.array(F.lit(True))
    # a line and its neighbour: where runs of non-blank lines begin and end
    first = F.zip_with("blank", F.concat(edge, F.slice("blank", F.lit(1), F.size("blank") - 1)), lambda x, y: ~x & y)
    final = F.zip_with("blank", F.concat(F.slice("blank", F.lit(2), F.size("blank")), edge), lambda x, y: ~x & y)
    at = lambda c: F.filter(F.transform(c, lambda x, i: F.when(x, i)), lambda x: x.isNotNull())
    text = text.withColumn("blank", blank).select("*", F.arrays_zip(at(first).alias("a"), at(final).alias("z")).alias("runs"))
    one = F.transform("ls", lambda x, i: F.struct(i.cast("int").alias("paragraph"), i.cast("int").alias("last")))
    several = F.transform(F.filter("runs", lambda r: r["a"] < r["z"]), lambda r: F.struct(
        r["a"].cast("int").alias("paragraph"), r["z"].cast("int").alias("last")))
    p = text.select("__id", "__doc", "ls", F.explode(F.concat(one, several)).alias("p")).select("__id", "__doc", "p.*", "ls")
    p = p.withColumn("line", F.when(F.col("paragraph") == F.col("last"), F.get("ls", F.col("paragraph"))).otherwise(
        F.array_join(F.slice("ls", F.col("paragraph") + 1, F.col("last") - F.col("paragraph") + 1), " "))).drop("ls")
    p = p.where(F.arrays_overlap(words(F.col("line")), some))
    return materialize(p.withColumn("lid", F.md5("line")))


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, family, prob, template, similarity, confirmed, line): paragraphs whose family is not unknown."""
    spark = docs.sparkSession
    hit = _paragraphs(docs, model.words(), id_col, text_col)
    lines = materialize(hit.groupBy("lid").agg(F.min("line").alias("line")))  # equal ones once
    p = model.probabilities(lines)
    top = F.array_max("p")
    p = p.select("lid", top.alias("prob"), (F.array_position("p", top) - 1).cast("int").alias("family"))
    p = materialize(p.where((F.col("prob") >= MIN_PROB) & (F.col("family") != UNKNOWN)))

    grams = lines.join(p, "lid").select("lid", "family", F.explode(F.array_distinct(ngrams(words(F.col("line")), 2))).alias("g"))
    like = grams.join(F.broadcast(_pairs(spark)), ["family", "g"]).groupBy("lid", "tid", "n").agg(F.count(F.lit(1)).alias("c"))
    like = like.select("lid", "tid", (F.col("c") / F.col("n")).alias("sim")).groupBy("lid").agg(
        F.max(F.struct("sim", (-F.col("tid")).alias("t"))).alias("b"), F.sum((F.col("sim") >= CONFIRM).cast("int")).alias("n"))
    name = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family") + 1)
    found = p.join(like, "lid", "left").select(
        "lid", name.alias("family"), "prob", (-F.col("b.t")).cast("int").alias("template"), F.coalesce("b.sim", F.lit(0.0)).alias("similarity"),
        F.coalesce("n", F.lit(0)).alias("__n"))
    found, _ = bounded_broadcast(materialize(found))
    out = materialize(hit.join(found, "lid").drop("lid"))
    alone, run = out.where("paragraph = last"), out.where("paragraph < last and __n > 0")
    r = run.select("__doc", "family", F.col("paragraph").alias("__a"), F.col("last").alias("__z"), "__n")
    parts = alone.select("__doc", "family", "paragraph", F.col("__n").alias("__m")).join(r, ["__doc", "family"]).where("paragraph between __a and __z")
    fewer = parts.groupBy("__doc", "family", "__a").agg(F.sum("__m").alias("__m"))
    run = run.join(fewer, (run["__doc"] == fewer["__doc"]) & (run["family"] == fewer["family"]) & (run["paragraph"] == fewer["__a"]), "left") \
        .where("__n > coalesce(__m, 0)").select(*[run[c] for c in out.columns])
    run = materialize(run)
    r = run.select(F.col("__doc").alias("__d"), F.col("family").alias("__f"), F.col("paragraph").alias("__a"), F.col("last").alias("__z"))
    alone = alone.join(r, (F.col("__doc") == F.col("__d")) & (F.col("family") == F.col("__f"))
                       & (F.col("paragraph") >= F.col("__a")) & (F.col("paragraph") <= F.col("__z")), "left_anti")
    return alone.unionByName(run).select(F.col("__id").alias(id_col), "paragraph", "family", "prob", "template", "similarity",
                                         (F.col("similarity") >= CONFIRM).alias("confirmed"), "line")
