"""Licence statements in documents: a trained paragraph classifier, confirmed by templates."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleargrain.llm.common import ascii_lower, softmax
from cleargrain.session import stage

UNKNOWN = "unknown"
MAX_PLAIN = 4_000  # ordinary paragraphs of the corpus that the classifier is fitted on, at most
NGRAM = 2
SURE = 0.5  # posterior, after calibration, from which a family is reported
ALIKE = 0.6  # share of a template's word pairs that a paragraph has to hold

# Statements of each family in common use.
TEMPLATES = {
    "MIT": ["the MIT License", "MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["the BSD 3-Clause License", "the BSD 2-Clause License", "BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "GPL": ["the GNU General Public License, version 3", "the GNU General Public License, version 2", "GNU GPL", "SPDX-License-Identifier: GPL-3.0", "the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL": ["the GNU Lesser General Public License, version 3", "GNU LGPL", "SPDX-License-Identifier: LGPL-3.0"],
    "AGPL": ["the GNU Affero General Public License, version 3", "GNU AGPL", "SPDX-License-Identifier: AGPL-3.0"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0", "MPL 2.0"],
    "CC-BY": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC BY 3.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 3.0"],
    "CC0": ["CC0 1.0", "the Creative Commons CC0 1.0 Universal Public Domain Dedication"],
}
# Frames in which a name of a licence is put, and names of licences outside the families.
FRAMES = ["{}", "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under the terms of {}.", "This software is available under {}."]
OTHERS = ["a commercial license", "the terms of your agreement", "an individual license, version 1.0", "all rights reserved", "the usual terms, version 3", "a public notice", "the general terms of use", "the house rules 4.0"]


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _grams(of: str) -> Column:
    """Words and pairs of adjacent words of the array column ``of``."""
    pairs = f"if(size({of}) < {NGRAM}, array(), transform(sequence(0, size({of}) - {NGRAM}), i -> concat({of}[i], ' ', {of}[i + 1])))"
    return F.expr(f"concat({of}, {pairs})")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, paragraph (its number from 0) and w (its words), for each line that has words."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("paragraph", "line"))
    return lines.select("doc_id", "text_key", "paragraph", words(F.col("line")).alias("w")).filter(F.size("w") > 0)


def _statements(spark: SparkSession) -> DataFrame:
    rows = [(family, frame.format(t)) for family, own in [*TEMPLATES.items(), (UNKNOWN, OTHERS)] for t in own for frame in FRAMES]
    return spark.createDataFrame(rows, "family string, line string").select("family", words(F.col("line")).alias("w"))


class LicenceModel:
    """Weights (gram, v: one per class) as a stored table, intercepts, and the temperature of the posteriors."""

    def __init__(self, classes: list[str], weights: DataFrame, bias: list[float], temperature: float = 1.0):
        self.classes, self.weights, self.bias, self.temperature = classes, weights, bias, temperature

    def scores(self, paras: DataFrame, *key: str) -> DataFrame:
        """``key``, w and z (class scores) of the paragraphs with at least one gram that has weights.

        The weights are broadcast: they belong to the grams of the templates, whatever the size of the corpus.
        """
        each = paras.select(*key, "w", F.explode(F.array_distinct(_grams("w"))).alias("gram")).join(F.broadcast(self.weights), "gram")
        return each.groupBy(*key).agg(
            F.first("w").alias("w"), F.array(*[F.sum(F.col("v")[i]) + b for i, b in enumerate(self.bias)]).alias("z")
        )

    def posterior(self, temperature: float | None = None) -> Column:
        t = float(temperature or self.temperature)
        return softmax(F.transform("z", lambda v: v / t))


def fit_licences(docs: DataFrame, most: int = MAX_PLAIN) -> LicenceModel:
    """Multinomial logistic regression over presence of word n-grams, with an L1 penalty.

    Positive rows are the templates in their frames. The unknown class has licence-like statements of no family and at most
    ``most`` ordinary paragraphs of the corpus, drawn by hash among those without the stem of "license". A quarter of all
    rows sets the temperature of the posteriors by likelihood, so that "unknown" is a calibrated class.
    """
    spark = docs.sparkSession
    classes = [*TEMPLATES, UNKNOWN]
    said = _statements(spark).select("family", "w")
    plain = paragraphs(docs).filter(~F.expr("exists(w, x -> x like 'licen%')"))
    total = docs.count()
    # one paragraph in (documents x 4 / most) on average, then the smallest hashes: a top-k of fixed size
    few = plain.select("w", F.xxhash64("doc_id", "text_key", "paragraph").alias("h")).filter(F.pmod("h", F.lit(max(1, total // most))) == 0).orderBy("h").limit(most)
    rows = stage(said.unionByName(few.select(F.lit(UNKNOWN).alias("family"), "w")).withColumn("g", F.array_distinct(_grams("w"))), "licence-rows")
    grams = sorted(r[0] for r in said.select(F.explode(_grams("w")).alias("g")).distinct().collect())  # of the templates alone
    held = F.pmod(F.xxhash64(F.array_join("w", " ")), F.lit(4)) == 0
    vectors = rows.select(
        (F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1).cast("double").alias("label"), "w", "g", held.alias("held"),
        F.transform(F.split(F.lit("\n".join(grams)), "\n"), lambda x: F.array_contains(F.col("g"), x).cast("double")).alias("x"),
    ).withColumn("features", array_to_vector("x")).drop("x")
    vectors = stage(vectors, "licence-vectors")
    fitted = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=1.0, maxIter=120, standardization=False).fit(vectors)
    matrix, bias = fitted.coefficientMatrix.toArray(), [float(b) for b in fitted.interceptVector]
    if len(bias) < len(classes):
        raise ValueError("a class has no training rows")
    kept = [(g, [float(x) for x in matrix[:, i]]) for i, g in enumerate(grams) if abs(matrix[:, i]).max() > 1e-6]
    weights = stage(spark.createDataFrame(kept, "gram string, v array<double>"), "licence-weights")
    model = LicenceModel(classes, weights, bias)
    judged = stage(model.scores(vectors.filter("held").withColumn("row", F.monotonically_increasing_id()), "row", "label"), "licence-held")
    choices = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
    losses = judged.agg(*[F.sum(-F.log(F.greatest(model.posterior(t)[F.col("label").cast("int")], F.lit(1e-12)))) for t in choices]).first()
    if losses[0] is not None:
        model.temperature = min(zip(losses, choices))[1]
    return model


def _templates(spark: SparkSession) -> DataFrame:
    """(family, templates): the word pairs of each template, or its one word."""
    said = spark.createDataFrame([(f, t) for f, own in TEMPLATES.items() for t in own], "family string, line string").withColumn("w", words(F.col("line")))
    pairs = said.select("family", F.when(F.size("w") < NGRAM, F.col("w")).otherwise(F.filter(_grams("w"), lambda g: F.contains(g, F.lit(" ")))).alias("t"))
    return pairs.groupBy("family").agg(F.collect_list(F.array_distinct("t")).alias("templates"))


def licence_paragraphs(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """doc_id, text_key, paragraph, family, probability, likeness, confirmed of each paragraph with a family above SURE.

    likeness is the largest share of one of the family's templates that the paragraph holds.
    """
    scored = model.scores(paragraphs(docs), "doc_id", "text_key", "paragraph").withColumn("p", model.posterior())
    best = scored.withColumn("probability", F.array_max("p")).withColumn("family", F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("p", F.col("probability")).cast("int")))
    found = best.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= SURE)).withColumn("g", _grams("w"))
    found = found.join(F.broadcast(_templates(docs.sparkSession)), "family").withColumn(
        "likeness", F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("g"))) / F.size(t)))
    )
    return found.select("doc_id", "text_key", "paragraph", "family", "probability", "likeness", (F.col("likeness") >= ALIKE).alias("confirmed"))


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, families (confirmed, sorted, joined by commas), n_paragraphs that state them, and
    n_unconfirmed paragraphs that the classifier alone took for a licence.

    Null texts have no paragraphs; rows that are equal in doc_id and text give equal rows; other columns are not read; an
    empty table gives no rows.
    """
    found = licence_paragraphs(docs, fit_licences(docs))
    text = F.coalesce("text", F.lit(""))
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.lit(1).alias("row"), F.lit(None).cast("string").alias("family"), F.lit(False).alias("confirmed"), F.lit(None).cast("int").alias("paragraph"))
    hits = found.select("doc_id", "text_key", F.lit(0).alias("row"), "family", "confirmed", "paragraph").distinct()
    sure = F.col("confirmed") & F.col("paragraph").isNotNull()
    each = every.unionByName(hits).groupBy("doc_id", "text_key").agg(
        F.sum("row").cast("bigint").alias("rows"),
        F.array_join(F.array_sort(F.collect_set(F.when(sure, F.col("family")))), ",").alias("families"),
        F.sum(sure.cast("bigint")).alias("n_paragraphs"),
        F.sum((~F.col("confirmed") & F.col("paragraph").isNotNull()).cast("bigint")).alias("n_unconfirmed"),
    )
    return each.withColumn("c", F.explode(F.expr("sequence(1L, rows)"))).select("doc_id", "families", "n_paragraphs", "n_unconfirmed")
