"""License scans: a sparse n-gram classifier of paragraphs, calibrated and confirmed by templates.

Paragraphs (lines) become word n-grams of up to three words; the features are the n-grams of the
training notices that hold a word seldom seen in the corpus, so a paragraph without such a word has
no feature and is of the unknown class whatever the weights. A multinomial logistic regression
with an L1 penalty is trained, a temperature calibrates its probabilities on held-out paragraphs,
and a predicted family stands only if the paragraph holds enough of one of its notices. Scoring uses
built-in functions and Spark ML's own transformers only.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import let, text_sample
from marketloom.session import materialize

UNKNOWN = "unknown"
# Names and customary notice sentences of public licenses.
FAMILIES = {
    "MIT": ["the MIT License", "MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "Apache": ["the Apache License, Version 2.0", "Apache-2.0", "you may not use this file except in compliance with the License",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL": ["the GNU General Public License, version 3", "the GNU General Public License, version 2", "GPL-3.0", "GPLv2",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL": ["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License", "LGPL-2.1"],
    "AGPL": ["the GNU Affero General Public License, version 3", "the GNU Affero General Public License", "AGPL-3.0"],
    "BSD": ["the BSD 3-Clause License", "the BSD 2-Clause License", "the BSD License",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License, Version 2.0", "MPL-2.0"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC 3.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0": ["CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"],
    "ISC": ["the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["the Unlicense", "This is free and unencumbered software released into the public domain"],
    "proprietary": ["All rights reserved", "All rights reserved. Unauthorized copying is prohibited", "Proprietary and confidential"],
}
CARRIERS = ["{}", "{}.", "Licensed under {}.", "Released under {}.", "This work is licensed under {}.",
            "Distributed under the terms of {}.", "This program is free software, available under {}.",
            "Code in this repository is covered by {}, see LICENSE.", "License: {}", "Published under {} by the authors."]
OTHERS = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "License: {}",
          "Published under {} by the authors."]
NO_FAMILY = ["separate terms", "the terms of your contract", "conditions of the vendor", "a driving license",
             "a fishing license", "the license of the plumber", "the house rules", "pressure"]


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; one version dot and hyphens inside a word split it."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def grams(w: Column, n: int) -> Column:
    return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))),
        lambda i: F.array_join(F.slice(w, i, n), " ")))


def all_grams(w: Column) -> Column:
    return let(w, lambda v: F.concat(v, grams(v, 2), grams(v, 3)))


def notices(spark: SparkSession) -> DataFrame:
    """(text, family) of the training notices, license-like sentences of no family included."""
    rows = [(c.format(n), f) for f, known in FAMILIES.items() for n in known for c in CARRIERS]
    rows += [(c.format(n), UNKNOWN) for n, c in itertools.product(NO_FAMILY, OTHERS)]
    return spark.createDataFrame(rows, "text string, family string")


def softmax(z: Column, temperature: float) -> Column:
    return let(z, lambda v: let(F.array_max(v), lambda top: let(
        F.transform(v, lambda x: F.exp((x - top) / temperature)), lambda e: let(
            F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))))


@dataclass
class LicenseModel:
    vocabulary: list[str]
    anchors: list[str]
    families: list[str]
    regression: LogisticRegressionModel
    temperature: float

    def probabilities(self, rows: DataFrame, gram_column: str) -> DataFrame:
        vector = CountVectorizerModel.from_vocabulary(
            self.vocabulary, inputCol=gram_column, outputCol="_v", minTF=1.0)
        vector.setBinary(True)
        out = PipelineModel([vector, self.regression]).transform(rows)
        return out.withColumn("probabilities", softmax(vector_to_array("_raw"), self.temperature)).drop(
            "_v", "_raw", "_p", "_k")


def paragraphs(docs: DataFrame, anchors: list[str] | None = None) -> DataFrame:
    """(doc_id, paragraph, text): the lines of whole texts, those with an anchor word if given."""
    text = F.coalesce("text", F.lit(""))
    rows = docs
    if anchors is not None:
        rows = rows.where(F.arrays_overlap(words(text), F.lit(anchors)))
    rows = rows.select("doc_id", F.posexplode(F.split(text, "\n")).alias("paragraph", "text"))
    if anchors is not None:
        rows = rows.where(F.arrays_overlap(words(F.col("text")), F.lit(anchors)))
    return rows.where(F.trim("text") != "")


def fit(docs: DataFrame, bound: int = 4_000, common: float = 0.002, penalty: float = 0.0005) -> LicenseModel:
    """Train on the notices and the first 20 lines of about ``bound`` texts (chosen by hash) that no license family name occurs in, as unknown paragraphs. A word in more than
    ``common`` of those lines is no anchor."""
    spark = docs.sparkSession
    own = notices(spark).withColumn("w", words(F.col("text")))
    names = ["license", "licensed", "licence", "licenses", "copyright", "rights", "cc", "gnu", "apache", "mit",
             "bsd", "mozilla", "gpl", "creative", "permission", "redistribution", "unlicense"]
    some = (text_sample(docs, bound).repartition(6, F.xxhash64("text"))
            .select(F.explode(F.slice(F.split("text", "\n"), 1, 20)).alias("text"))
            .where(F.trim("text") != "").withColumn("w", words(F.col("text")))
            .where(~F.arrays_overlap("w", F.lit(names))).distinct())
    other = materialize(some.withColumn("family", F.lit(UNKNOWN)), "paragraphs")
    total = max(1, other.count())
    listed = [r[0] for r in own.select(F.explode("w").alias("w")).distinct().collect()]  # of the notices
    often = {r[0] for r in other.select(F.explode(F.array_distinct("w")).alias("w"))
             .where(F.col("w").isin(listed)).groupBy("w").count()
             .where(F.col("count") > common * total).select("w").collect()}
    plain = {"a", "an", "and", "at", "as", "by", "in", "is", "it", "of", "on", "or", "the", "this", "to", "you", "see",
             "any", "all", "are", "be", "for", "with", "that", "may", "no", "not", "your", "work", "use"}
    anchors = sorted(w for w in listed if w not in often | plain and not w.isdigit())
    found = own.select(F.explode(F.array_distinct(all_grams(F.col("w")))).alias("g")).distinct()
    vocabulary = sorted(r[0] for r in found.where(
        F.arrays_overlap(F.split("g", " "), F.lit(anchors))).collect())
    families = [UNKNOWN, *FAMILIES]
    label = F.array_position(F.lit(families), F.col("family")).cast("double") - 1
    rows = own.unionByName(other).withColumn("label", label).withColumn("g", all_grams(F.col("w")))
    vector = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="g", outputCol="_v", minTF=1.0)
    vector.setBinary(True)
    rows = materialize(rows.select("label", "g", (F.crc32(F.col("text").cast("binary")) % 5 == 0).alias("kept_out")), "training")
    made = vector.transform(rows).repartition(2).cache()
    regression = LogisticRegression(
        featuresCol="_v", labelCol="label", elasticNetParam=1.0, regParam=penalty, family="multinomial",
        standardization=False, maxIter=60, rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_k",
    ).fit(made.where(~F.col("kept_out")))
    held = vector_to_array("_raw")
    z = regression.transform(made.where("kept_out")).select("label", held.alias("z"))

    def loss(t: float) -> Column:
        p = F.element_at(softmax(F.col("z"), t), F.col("label").cast("int") + 1)
        return F.avg(-F.log(F.greatest(p, F.lit(1e-12))))

    grid = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8]
    values = z.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(grid)]).first()
    made.unpersist()
    best = min(range(len(grid)), key=lambda i: (values[i] if values[i] is not None else 0.0, i))
    return LicenseModel(vocabulary, anchors, families, regression, grid[best])


def scan(docs: DataFrame, model: LicenseModel, least: float = 0.5, share: float = 0.7) -> DataFrame:
    """(doc_id, paragraph, family, probability, template_share, confirmed) of every paragraph that
    is not of the unknown class: its family's probability is at least ``least``.

    ``template_share`` is the largest share of a notice's word pairs that the paragraph holds, among
    the family's notices; ``confirmed`` from ``share`` on. Null and empty texts have no paragraph;
    rows that repeat a document report each row's paragraphs; other columns are ignored."""
    rows = paragraphs(docs, model.anchors).withColumn("w", words(F.col("text"))).withColumn("g", all_grams(F.col("w")))
    scored = model.probabilities(rows, "g")
    best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
    scored = scored.select("doc_id", "paragraph", "w", F.element_at(F.lit(model.families), best).alias("family"),
                           F.array_max("probabilities").alias("probability"))
    scored = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
    spark = docs.sparkSession
    known = spark.createDataFrame([(f, n) for f, all_ in FAMILIES.items() for n in all_], "family string, notice string")
    pair = let(words(F.col("notice")), lambda w: F.array_distinct(
        F.when(F.size(w) < 2, w).otherwise(grams(w, 2))))
    known = known.groupBy("family").agg(F.collect_list(pair).alias("pairs"))  # of the fixed table above
    held = let(F.col("w"), lambda v: F.array_distinct(F.concat(v, grams(v, 2))))
    best_share = F.array_max(F.transform("pairs", lambda p: F.size(F.array_intersect(p, F.col("held"))) / F.size(p)))
    return (scored.withColumn("held", held).join(F.broadcast(known), "family")
            .select("doc_id", "paragraph", "family", "probability", best_share.alias("template_share"))
            .withColumn("confirmed", F.col("template_share") >= share))
