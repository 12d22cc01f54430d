"""Licence notices by a trained paragraph classifier, in DataFrame operations only.

A paragraph (a line of a text) is the set of its words and word pairs. A
multinomial logistic regression over the n-grams of known notices tells families
apart, with a class of its own for everything else; it is trained on pieces of
the templates and on a bounded sample of the corpus' own paragraphs. Its margin
between the best family and the unknown class is calibrated on rows held back from
training: each half of the templates of a family is judged by a model that has seen
the other half only. A prediction is confirmed when enough of the paragraph, or of
one of the family's templates, is shared between them. Lines of a wrapped notice are
judged with the lines around them: one that shares enough of itself with a template
is confirmed if the lines from 6 before to 6 after hold enough of that template.

N-grams outside the model have weight 0, so the score of a paragraph is the sum
over those it shares with the model: one join with a table of bounded size, after
which only paragraphs with such an n-gram are left.

Null and empty texts have no paragraphs. Repeated rows are scored each, repeated
lines too. With no rows to sample, the unknown class rests on made-up paragraphs
of common words. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwise.llm.common import col, scratch

UNKNOWN = "unknown"
SAMPLE_DOCUMENTS = 400
SAMPLE_PARAGRAPHS = 3_000
MOST_NGRAMS = 5_000
COMMON_SHARE = 0.01
HELD_BACK = 3
FOLDS = 2
CONFIRMED = 0.6
OWN_SHARE = 0.6
AROUND = 6
WRAPPED_SHARE = 0.5

# Notices of each family as they are commonly written.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the terms of the Apache License 2.0.",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "This software is distributed under the MIT license.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the 3-Clause BSD License.",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Distributed under the GNU GPL v2 or later.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is licensed under the terms of the GNU AGPL v3.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "This work is dedicated to the public domain under the CC0 license.",
    ],
    "all-rights-reserved": [
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
FAMILIES = [UNKNOWN, *TEMPLATES]
PLAIN = [
    "The report was read by all of them and then put away for the year.",
    "Under the bridge there is a place where the water is free of ice.",
    "A version of the story is told to every child at school.",
    "Work on the house went on until the end of the day.",
]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _grams(df: DataFrame, paragraph: str) -> DataFrame:
    """The frame with `grams`: distinct words and pairs of neighbours."""
    listed = df.withColumn("w", words(F.col(paragraph)))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    # the last word has no neighbour, so it gives itself again
    return listed.withColumn("grams", F.array_distinct(F.concat("w", pairs))).drop("w")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(row, doc_id, place, paragraph) for every line with a letter or digit."""
    rows = docs.select(col("doc_id").cast("bigint").alias("doc_id"), col("text").alias("text")).withColumn("row", F.monotonically_increasing_id())
    lines = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("place", "paragraph"))
    return lines.where(F.length(F.trim("paragraph")) > 0)


def _pieces() -> list[tuple[str, str, int]]:
    """Training paragraphs of the families, with the fold of their template: templates, their halves, and templates
    between other words. The templates of a family are dealt to the folds in turn."""
    out = []
    for family, texts in TEMPLATES.items():
        for i, text in enumerate(texts):
            w = text.split()
            cut = max(4, 2 * len(w) // 3)
            made = [text, " ".join(w[:cut]), " ".join(w[-cut:])]
            made += [f"{a} {text} {b}" for a, b in itertools.product(("", "Notice:", "This document:"), ("", "See the file for more."))]
            out += [(family, piece, i % FOLDS) for piece in made]
    return out


def _sample(docs: DataFrame) -> DataFrame:
    """At most 3,000 paragraphs of at most 400 documents, picked by hashes."""
    ids = docs.select(col("doc_id").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    texts = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"))
    # at most 400 ids
    lines = paragraphs(texts.join(F.broadcast(ids), "doc_id"))
    return lines.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place", "paragraph").limit(SAMPLE_PARAGRAPHS).select("paragraph")


class Model:
    """Weights by n-gram and class, intercepts, calibration, and the templates' n-grams."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        known = spark.createDataFrame(_pieces(), "family string, paragraph string, fold int")
        other = _sample(docs).unionByName(spark.createDataFrame([(p,) for p in PLAIN], "paragraph string"))
        other = _grams(other.select(F.lit(UNKNOWN).alias("family"), "paragraph"), "paragraph")
        known = _grams(known, "paragraph")
        templates = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(self._templates())], "template int, family string, paragraph string")
        templates = scratch(_grams(templates, "paragraph"), "templates")
        # paragraphs of the sample that are notices themselves don't belong to the unknown class
        notice = F.lit(False)
        self.template_grams = {r.template: (r.family, set(r.grams)) for r in templates.collect()}
        for _, grams in self.template_grams.values():
            pairs = sorted(g for g in grams if " " in g)
            shared = F.size(F.array_intersect("grams", F.array(*map(F.lit, pairs))))
            own = F.size(F.filter("grams", lambda g: g.contains(" ")))
            # a line of a wrapped notice holds little of the template, but little else
            notice = notice | (shared >= 0.5 * len(pairs)) | ((shared >= 2) & (shared >= OWN_SHARE * own))
        other = scratch(other.where(~notice), "plain")
        # n-grams of ordinary text say nothing and would match everywhere
        n = other.count()
        common = other.select(F.explode("grams").alias("gram")).groupBy("gram").count().where(F.col("count") > max(COMMON_SHARE * n, 1)).select("gram")
        common = {r.gram for r in common.collect()}
        label = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("double") - 1
        lexicon = sorted({g for _, gs in self.template_grams.values() for g in gs} - common)[:MOST_NGRAMS]
        rows = known.unionByName(other, allowMissingColumns=True).withColumn("label", label)
        # of the unknown class a third is held back; notices are held back by the fold of their template
        place = F.pmod(F.xxhash64("paragraph"), F.lit(HELD_BACK * FOLDS))
        rows = rows.withColumn("held", (F.col("label") == 0) & (place < FOLDS)).withColumn("fold", F.coalesce("fold", F.when(F.col("held"), place)))
        in_lexicon = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(
            spark.createDataFrame([(lexicon,)], "grams array<string>")
        )
        rows = scratch(in_lexicon.transform(rows).select("label", "held", "fold", "features"), "training")
        learner = LogisticRegression(family="multinomial", regParam=1e-3, elasticNetParam=0.1, maxIter=60)
        seen = rows.where(~F.col("held"))
        fitted = learner.fit(seen)
        self.vocabulary, self.matrix, self.bias = self._weights(fitted, in_lexicon.vocabulary)
        apart = [(learner.fit(seen.where((F.col("label") == 0) | (F.col("fold") != f))), rows.where(F.col("fold") == f)) for f in range(FOLDS)]
        self.scale, self.shift, self.held_back = self._calibrate(apart)
        self.lexicon = set(lexicon)

    @staticmethod
    def _templates() -> list[tuple[str, str]]:
        return [(f, t) for f, ts in TEMPLATES.items() for t in ts]

    @staticmethod
    def _weights(fitted: LogisticRegressionModel, vocabulary: list[str]) -> tuple[list[str], list[list[float]], list[float]]:
        w = fitted.coefficientMatrix.toArray()
        return list(vocabulary), [[float(x) for x in w[:, i]] for i in range(len(vocabulary))], [float(b) for b in fitted.interceptVector]

    @staticmethod
    def _calibrate(apart: list[tuple[LogisticRegressionModel, DataFrame]]) -> tuple[float, float, dict[str, float]]:
        """Scale and shift of the margin between the best family and the unknown class, from rows that each model has
        not seen; and on them, the share of notices in their family and the share of others called unknown."""
        from pyspark.ml.functions import vector_to_array

        raw = vector_to_array("rawPrediction")
        best = F.array_max(F.slice(raw, 2, len(FAMILIES) - 1))
        judged = [
            model.transform(rows).select("label", (best - raw[0]).alias("m"), (raw[F.col("label").cast("int")] == best).alias("right"))
            for model, rows in apart
        ]
        held = scratch(reduce(DataFrame.unionByName, judged), "held-back")
        marked = held.withColumn("notice", (F.col("label") > 0).cast("double"))
        marked = VectorAssembler(inputCols=["m"], outputCol="features").transform(marked)
        curve = LogisticRegression(regParam=1e-2, maxIter=50, labelCol="notice").fit(marked.select("features", "notice"))
        scale, shift = float(curve.coefficients[0]), float(curve.intercept)
        called = (F.col("m") >= 0) & (F.col("m") * scale + shift >= 0)
        notice = F.col("label") > 0
        quality = held.agg(
            F.avg(F.when(notice, (called & F.col("right")).cast("double"))).alias("notices"),
            F.avg(F.when(~notice, (~called).cast("double"))).alias("others"),
        ).first()
        return scale, shift, quality.asDict()

    def frame(self, spark: SparkSession) -> DataFrame:
        """(gram, w, templates): at most MOST_NGRAMS rows."""
        weight = dict(zip(self.vocabulary, self.matrix))
        zero = [0.0] * len(FAMILIES)
        rows = [(g, weight.get(g, zero), [t for t, (_, gs) in self.template_grams.items() if g in gs]) for g in sorted(self.lexicon)]
        return spark.createDataFrame(rows, "gram string, w array<double>, templates array<int>")


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Licence notices: doc_id, paragraph (its line), family, probability, similarity, confirmed."""
    spark = docs.sparkSession
    found = _grams(paragraphs(docs), "paragraph").select("row", "doc_id", "place", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    # the model has a bounded number of n-grams
    matched = found.join(F.broadcast(model.frame(spark)), "gram")
    sums = [F.sum(F.col("w")[c]).alias(f"w{c}") for c in range(len(FAMILIES))]
    shared = [F.sum(F.array_contains("templates", t).cast("int")).alias(f"t{t}") for t in model.template_grams]
    scored = matched.groupBy("row", "doc_id", "place", "size").agg(*sums, *shared)
    around = Window.partitionBy("row").orderBy("place").rangeBetween(-AROUND, AROUND)
    near = [F.sum(f"t{t}").over(around).alias(f"n{t}") for t in model.template_grams]
    scored = scored.select("*", *near)
    raw = [F.col(f"w{c}") + F.lit(b) for c, b in enumerate(model.bias)]
    best = F.greatest(*raw[1:])
    family = F.coalesce(*[F.when(r == best, F.lit(f)) for r, f in zip(raw[1:], FAMILIES[1:])])
    probability = 1 / (1 + F.exp(-(F.lit(model.scale) * (best - raw[0]) + F.lit(model.shift))))
    # the family must win over the unknown class, and be likely as calibrated
    known = (best >= raw[0]) & (probability >= 0.5)
    of_family: dict[str, list[Column]] = {}
    # coverage and family of the wrapped templates that the line is part of; the fullest one counts
    wrapped = []
    for t, (f, grams) in model.template_grams.items():
        size = len(grams & model.lexicon)
        most = F.least(F.lit(size), F.col("size"))
        of_family.setdefault(f, []).append(F.col(f"t{t}") / F.greatest(most, F.lit(1)))
        part = (F.col(f"t{t}") >= WRAPPED_SHARE * F.col("size")) & (F.col(f"n{t}") >= CONFIRMED * size) & (F.col(f"n{t}") > F.col(f"t{t}"))
        wrapped.append(F.when(part & F.lit(size > 0), F.struct((F.col(f"n{t}") / F.lit(max(size, 1))).alias("similarity"), F.lit(f).alias("family"))))
    judged = scored.select("doc_id", "place", "size", *[f"t{t}" for t in model.template_grams], family.alias("own"), probability.alias("probability"), known.alias("known"), F.greatest(*wrapped).alias("wrapped"))
    own = F.coalesce(*[F.when(F.col("own") == f, F.greatest(*cs, F.lit(0.0))) for f, cs in of_family.items()])
    judged = judged.where(F.col("known") | F.col("wrapped").isNotNull()).withColumn("similarity", own)
    # a line that is confirmed by itself keeps its family
    alone = F.col("known") & (F.col("similarity") >= CONFIRMED)
    by_lines = F.col("wrapped").isNotNull() & ~alone
    similarity = F.when(by_lines, F.col("wrapped.similarity")).otherwise(F.col("similarity"))
    return judged.select(
        "doc_id",
        F.col("place").alias("paragraph"),
        F.when(by_lines, F.col("wrapped.family")).otherwise(F.col("own")).alias("family"),
        F.round("probability", 6).alias("probability"),
        F.round(F.least(similarity, F.lit(1.0)), 6).alias("similarity"),
        (similarity >= CONFIRMED).alias("confirmed"),
    )


def license_notices(docs: DataFrame) -> DataFrame:
    """Train on the corpus' sample and scan all its paragraphs."""
    return scan(docs, Model(docs))
