"""Licence scan: a trained paragraph classifier confirmed by templates, in
DataFrame and Spark ML functions only (no Python in tasks).

Paragraphs (lines) are sparse counts of word one- and two-grams, hashed and
scaled to unit length.  A multinomial logistic regression is trained on the
template paragraphs below, whole and in parts, against an ``unknown`` class:
the ``SAMPLE`` distinct paragraphs of the corpus with the smallest hash that
share no word triple with a template (a bounded, deterministic sample, in which
a paragraph counts once however many copies it has), and one empty paragraph,
so that the class exists where the corpus has no such paragraph.  A second,
one-dimensional logistic regression calibrates the margin between the best
family and ``unknown`` to the probability that the paragraph is a licence
notice at all; its corpus paragraphs are held out from the first, its template
parts are not, since a family has few.  Predictions are
confirmed by comparing word triples with the templates of the family.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logsleuth.llm import common

UNKNOWN = "unknown"
SAMPLE = 2_000          # corpus paragraphs in the training sample
DIMS = 1 << 14
MIN_PROBABILITY = 0.5
MIN_CONTAINMENT = 0.5
PARTS = (4, 8)          # training windows of a template, in words

# FIXED VALUES: phrases of public licence notices, by family.
TEMPLATES = {
    "agpl": ["this program is licensed under the gnu affero general public license version 3",
             "you can redistribute it under the terms of the gnu affero general public license"],
    "apache": ["licensed under the apache license, version 2.0",
               "you may not use this file except in compliance with the license",
               "released under the terms of the apache license 2.0"],
    "bsd": ["redistribution and use in source and binary forms, with or without modification, are permitted",
            "this software is distributed under the bsd license",
            "neither the name of the copyright holder nor the names of its contributors may be used to endorse"],
    "cc": ["licensed under cc by 4.0.", "licensed under cc by-sa 4.0.", "licensed under cc by-nc 4.0.",
           "licensed under cc by-nc-nd 4.0.",
           "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc0": ["this work has been dedicated to the public domain under cc0 1.0 universal",
            "to the extent possible under law the author has waived all copyright and related rights"],
    "gpl": ["this work is licensed under the gnu general public license, version 3.",
            "this program is free software: you can redistribute it under the terms of the gnu general public license",
            "licensed under the gnu general public license, version 2"],
    "lgpl": ["this library is licensed under the gnu lesser general public license version 2.1",
             "under the terms of the gnu lesser general public license as published by the free software foundation"],
    "mit": ["released under the mit license.",
            "permission is hereby granted, free of charge, to any person obtaining a copy of this software",
            "the above copyright notice and this permission notice shall be included in all copies"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license, v. 2.0"],
    "proprietary": ["all rights reserved.", "copyright all rights reserved",
                    "no part of this publication may be reproduced without the prior written permission of the publisher"],
}


def _tokens(text: Column) -> Column:
    """Lower-cased words without surrounding punctuation."""
    clean = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.+-]+|[.](?=\s|$)", " "), F.lit(common.BLANKS))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"\s+"))


def _triples(words: Column) -> Column:
    """Distinct word triples; the whole sequence if there are fewer words."""
    n = F.size(words)
    return F.when(n < 3, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 3), " "))))


def _templates(spark: SparkSession) -> DataFrame:
    """(family, words) of the template paragraphs."""
    rows = F.array(*[F.struct(F.lit(k).alias("family"), F.lit(t).alias("text"))
                     for k in sorted(TEMPLATES) for t in TEMPLATES[k]])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.family", _tokens(F.col("r.text")).alias("words"))


def raw_paragraphs(docs: DataFrame) -> DataFrame:
    """(id, mark, pos, line) of the non-blank lines; ``mark`` tells rows apart
    that share a doc_id but not the text."""
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"),
                       F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(F.btrim("line", F.lit(common.BLANKS)) != "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(id, mark, pos, words) of the non-blank lines."""
    return raw_paragraphs(docs).select("id", "mark", "pos", _tokens(F.col("line")).alias("words"))


def _unknown(raw: DataFrame, seen: list[str]) -> DataFrame:
    """Words of the ``SAMPLE`` distinct lines with the smallest hash that hold
    none of the triples ``seen``; of all such lines if there are fewer.

    Only lines below a bound on the hash are made distinct.  The bound is set
    from the estimated number of distinct lines and raised until enough lines
    are left, so it does not change the sample."""
    lines = raw.select(F.xxhash64("line").alias("hash"), "line")
    distinct = lines.agg(F.approx_count_distinct("hash")).first()[0]
    share = 2 * SAMPLE / max(distinct, 1)
    while True:
        near = lines if share >= 1 else lines.where(F.col("hash") < F.lit(int(share * 2 ** 64) - 2 ** 63))
        # stored before the filter: inside it the words would be cut anew for every triple of a line
        near = near.distinct().select("hash", "line", _tokens(F.col("line")).alias("words")).checkpoint()
        near = near.where(~F.arrays_overlap(_triples(F.col("words")), F.array(*[F.lit(x) for x in seen])))
        sample = near.orderBy("hash", "line").limit(SAMPLE).select("words").checkpoint()
        if share >= 1 or sample.count() == SAMPLE:
            return sample
        share *= 4


def _training(raw: DataFrame) -> DataFrame:
    """(family, words, held): template paragraphs, whole and in windows, and
    the corpus sample and the empty paragraph of the unknown class."""
    templates = _templates(raw.sparkSession)
    whole = templates.select("family", "words")
    parts = whole
    for n in PARTS:
        at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1))))
        parts = parts.union(whole.select("family", "words", at.alias("i")).select("family", F.slice("words", F.col("i"), n)))
    seen = templates.select(F.explode(_triples(F.col("words"))).alias("t")).agg(F.collect_set("t").alias("seen"))
    seen = [r for r in seen.first()[0]]  # the fixed templates' triples
    sample = _unknown(raw, seen).select(F.lit(UNKNOWN).alias("family"), "words")
    nothing = raw.sparkSession.range(1).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("words"),
                                               F.lit(1.0).alias("weight"))
    # the families weigh as much as the sample
    rows = parts.withColumn("weight", F.lit(4.0)).union(sample.withColumn("weight", F.lit(1.0)))
    rows = rows.withColumn("held", F.pmod(F.xxhash64("words", F.lit(11)), F.lit(4)) == 0)
    for held in (False, True):
        rows = rows.union(nothing.withColumn("held", F.lit(held)))
    return rows


def _features() -> list:
    return [NGram(n=2, inputCol="words", outputCol="pairs"),
            HashingTF(numFeatures=DIMS, inputCol="words", outputCol="f1"),
            HashingTF(numFeatures=DIMS, inputCol="pairs", outputCol="f2"),
            VectorAssembler(inputCols=["f1", "f2"], outputCol="raw_features"),
            Normalizer(inputCol="raw_features", outputCol="features")]


class Scanner:
    """The fitted classifier and its calibration."""

    def __init__(self, raw: DataFrame):
        self.labels = sorted(TEMPLATES) + [UNKNOWN]
        label = F.array_position(F.array(*[F.lit(x) for x in self.labels]), F.col("family")).cast("double") - 1
        # a few thousand rows at most: in few tasks, since each sends its gradient in every iteration
        rows = _training(raw).withColumn("label", label).coalesce(4).checkpoint()
        classifier = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=40,
                                        regParam=1e-4, family="multinomial", rawPredictionCol="raw",
                                        probabilityCol="prob", predictionCol="pred")
        # windows of every template stay in training, so that no family loses its words
        train = rows.where(f"NOT held OR family <> '{UNKNOWN}'").drop("held")
        self.model: PipelineModel = Pipeline(stages=[*_features(), classifier]).fit(train)
        scored = self._scored(rows).select("margin", (F.col("family") != UNKNOWN).cast("double").alias("label"),
                                           "held", "weight").where("held")
        scored = VectorAssembler(inputCols=["margin"], outputCol="m").transform(scored)
        fit = LogisticRegression(featuresCol="m", labelCol="label", regParam=1e-3).fit(scored)
        self.calibration = (float(fit.coefficients[0]), float(fit.intercept))

    def _scored(self, rows: DataFrame) -> DataFrame:
        raw = self.model.transform(rows).withColumn("_r", vector_to_array("raw")).drop(
            "pairs", "f1", "f2", "raw_features", "features", "raw", "prob", "pred")
        raw = raw.withColumn("_k", F.slice("_r", 1, len(self.labels) - 1)).withColumn("_b", F.array_max("_k"))
        return raw.withColumn("margin", F.col("_b") - F.element_at("_r", len(self.labels))).withColumn(
            "family_found", F.element_at(F.array(*[F.lit(x) for x in self.labels]),
                                         F.array_position("_k", F.col("_b")).cast("int"))).drop("_r", "_k", "_b")

    def predict(self, lines: DataFrame) -> DataFrame:
        """Lines predicted to be licence notices: id, mark, pos, family,
        probability, containment, confirmed."""
        a, b = self.calibration
        found = self._scored(lines).withColumn("probability", 1 / (1 + F.exp(-(F.col("margin") * a + b)))).where(
            F.col("probability") >= MIN_PROBABILITY)
        own = _triples(F.col("words"))
        known = _templates(lines.sparkSession).select(F.col("family").alias("t_family"), _triples(F.col("words")).alias("t"))
        known = known.groupBy("t_family").agg(F.collect_list("t").alias("sets"))
        found = found.select("id", "mark", "pos", F.col("family_found").alias("family"), "probability", own.alias("own"))
        joined = found.join(F.broadcast(known), F.col("family") == F.col("t_family"))
        share = F.array_max(F.transform("sets", lambda t: F.size(F.array_intersect(t, F.col("own")))
                                        / F.least(F.size(t), F.size("own"))))
        return joined.select("id", "mark", "pos", "family", "probability", share.alias("containment"),
                             (share >= MIN_CONTAINMENT).alias("confirmed"))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_paragraphs, n_predicted,
    n_confirmed (licence notices), family and probability of the most probable
    confirmed notice, families (all confirmed, sorted, comma-joined).

    Null and blank texts have no paragraphs; family and probability are null
    and families empty without a confirmed notice; ties go to the family first
    by name.  Repeated rows are judged alike; an empty table gives an empty
    one; columns other than doc_id and text are not read."""
    common.prepare(docs.sparkSession)
    lines = paragraphs(docs)
    found = Scanner(raw_paragraphs(docs)).predict(lines).dropDuplicates(["id", "mark", "pos"])
    sure = F.col("confirmed")
    by = found.groupBy("id", "mark").agg(
        F.count(F.lit(1)).alias("n_predicted"), F.count_if(sure).alias("n_confirmed"),
        F.min(F.when(sure, F.struct((-F.col("probability")).alias("p"), "family"))).alias("best"),
        F.array_join(F.sort_array(F.collect_set(F.when(sure, F.col("family")))), ",").alias("families"))
    full = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(common.BLANKS)) != "")
    base = docs.select("doc_id", F.xxhash64("text").alias("m"), F.size(full).cast("long").alias("n_paragraphs"))
    return base.join(by, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("m") == F.col("mark")), "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"),
        F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.col("best.family").alias("family"),
        (-F.col("best.p")).alias("probability"), F.coalesce("families", F.lit("")).alias("families"))
