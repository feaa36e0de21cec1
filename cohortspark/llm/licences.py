"""Licence scan: a trained paragraph classifier whose findings templates confirm. DataFrame functions only."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import cut, hash_filter, passes, row_keys

#: What the corpus paragraphs of the unknown class weigh together at most; a template in one surrounding weighs 1.
PLAIN_WEIGHT = 2000.0
#: Steps of the probabilities by which the least one is chosen.
STEPS = 10_000
#: Share of unknown paragraphs that may pass for a family, and the least probability and template share of a finding.
FALSE_SHARE, LEAST_PROBABILITY, CONFIRM = 0.001, 0.5, 0.6
UNKNOWN = "unknown"
WORD = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"

# The wording of public licences and of the notices that name them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain under CC0 1.0 Universal."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Paragraphs that speak of licences and grant none.
PLAIN = [
    "The driver showed the officer a licence and the car's papers.", "A fishing license is sold at the harbour office.",
    "The new version was released to the public on Monday.", "General terms apply to the work of all members.",
    "Her poetic license went too far for the committee.", "The university granted permission to copy the notes free of charge.",
    "This file was modified by the author and is the third version.", "The source of the river lies in the public park.",
    "The software is sold by a company that shall not be named.", "All conditions of the contract were met without restriction.",
]
_LEADS = ["", "Copyright (c) 2021 the authors. ", "Note: ", "All of this text: ", "This file. "]
_TAILS = ["", " See the LICENSE file.", " All rights reserved otherwise.", " The authors thank their readers."]


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def grams(ws: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    pairs = F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.concat_ws(
        " ", F.get(ws, i), F.get(ws, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(ws, pairs))


def _with_grams(rows: DataFrame, text: str) -> DataFrame:
    # The words are a column of their own: inside a lambda the expression would run for each element.
    return rows.withColumn("_ws", words(text)).withColumn("grams", grams(F.col("_ws"))).drop("_ws")


def _table(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    """A small constant table."""
    names = [f.split()[0] for f in fields.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    schema = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), schema)))


def paragraphs(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, k1, k2, pos, paragraph): the lines of each text that hold a word."""
    k1, k2 = row_keys(id_column, text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.posexplode(F.split(text_column, "\n")).alias(
        "pos", "paragraph"))
    return rows.where(F.length(F.trim("paragraph")) > 0)


def _vocabulary(spark: SparkSession):
    """All n-grams of the constants."""
    return CountVectorizer(inputCol="grams", outputCol="x", binary=True, vocabSize=1 << 14).fit(
        _with_grams(_table(spark, [(t,) for _, t in TEMPLATES] + [(t,) for t in PLAIN], "text string"), "text").select("grams"))


def marked_paragraphs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, k1, k2, pos, teaches, marks) of each paragraph: ``marks`` the sorted hashes of its n-grams of the vocabulary.

    Training and finding need no more of a paragraph, so that each text is read once for both. ``teaches`` is
    null where a licence or copyright is named. A pair is made only of two words of the vocabulary.
    """
    flags = hash_filter(_table(docs.sparkSession, [(g,) for g in _vocabulary(docs.sparkSession).vocabulary], "gram string").select(
        F.xxhash64("gram").alias("h")))
    low = F.lower("paragraph")
    named = low.contains("licenc") | low.contains("licens") | low.contains("copyright")
    rows = paragraphs(docs, id_column, text_column).select(
        "doc_id", "k1", "k2", "pos", F.when(~named, F.xxhash64("paragraph") % 2 == 0).alias("teaches"), words("paragraph").alias("_ws"))
    rows = rows.withColumn("_known", F.transform("_ws", lambda w: passes(flags, F.xxhash64(w))))
    at = F.when(F.size("_ws") > 0, F.sequence(F.lit(0), F.size("_ws") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_at", F.filter(at, lambda i: F.get("_known", i)))
    single = F.transform("_at", lambda i: F.xxhash64(F.get("_ws", i)))
    pairs = F.transform(F.filter("_at", lambda i: F.coalesce(F.get("_known", i + 1), F.lit(False))), lambda i: F.xxhash64(
        F.concat_ws(" ", F.get("_ws", i), F.get("_ws", i + 1))))
    marks = F.array_sort(F.array_distinct(F.concat(single, F.filter(pairs, lambda h: passes(flags, h)))))
    return rows.select("doc_id", "k1", "k2", "pos", "teaches", marks.alias("marks"))


def _unmarked(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``grams`` of the vocabulary that their ``marks`` stand for."""
    names = _vocabulary(rows.sparkSession).vocabulary
    known, hashes = F.array(*map(F.lit, names)), F.array(*[F.xxhash64(F.lit(g)) for g in names])
    found = F.transform("marks", lambda h: F.get(known, F.array_position(hashes, h).cast("int") - 1))
    return rows.withColumn("grams", F.filter(found, lambda g: g.isNotNull())).drop("marks")


def _families() -> list[str]:
    return [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]


def necessary_grams(names: list[str], matrix: np.ndarray, intercepts: np.ndarray, seen: dict[str, int]) -> list[str]:
    """N-grams of which a paragraph has one at least, or else stays unknown with a probability of one half or more.

    The others, the most frequent in unknown paragraphs first, can together lift no family from its
    intercept to the unknown one's, less the logarithm of the number of families.
    """
    gain = np.maximum(matrix[1:] - matrix[0], 0)
    room = intercepts[0] - intercepts[1:] - np.log(len(intercepts) - 1)
    needed = []
    for j in sorted(range(len(names)), key=lambda j: (-seen.get(names[j], 0), gain[:, j].max())):
        if (gain[:, j] < room).all():
            room = room - gain[:, j]
        else:
            needed.append(names[j])
    return needed


class Model:
    """Weights of the n-grams that have any, (gram, w) with an array over families; intercepts; n-grams of
    which one is necessary for a finding; the calibrated least probability."""

    def __init__(self, weights: DataFrame, intercepts: list[float], needed: list[str], least: float):
        self.weights, self.intercepts, self.needed, self.least = weights, intercepts, needed, least
        self.families = _families()

    def probabilities(self, found: DataFrame, *keys: str) -> DataFrame:
        """(keys, p): family probabilities of the rows whose ``grams`` hold a weighted n-gram."""
        hits = found.select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(self.weights), "gram")
        n = len(self.families)
        sums = hits.groupBy(*keys).agg(*[F.sum(F.get("w", i)).alias(f"s{i}") for i in range(n)])
        logits = F.array(*[F.col(f"s{i}") + self.intercepts[i] for i in range(n)])
        exps = F.transform(logits, lambda z: F.exp(z - F.array_max(logits)))
        return sums.select(*keys, exps.alias("e")).select(*keys, F.transform(
            "e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def train(docs: DataFrame, text_column: str = "text", weight: float = PLAIN_WEIGHT, marked: DataFrame | None = None) -> Model:
    """Multinomial regression with an L1 penalty: templates in varied surroundings against all paragraphs of the corpus.

    Vocabulary and families come from the templates, so the model's size does not depend on the
    corpus. Half of the paragraphs, chosen by a hash, teach the unknown class, which weighs ``weight`` at
    most beside the templates; paragraphs with the same n-grams of the vocabulary are one row with their
    number. On the other half the least probability of a finding is set so that FALSE_SHARE of them would
    pass at most. Paragraphs that name a licence or copyright do not count as unknown. Without any
    paragraph, the constants alone teach it. ``marked`` are the texts' ``marked_paragraphs``, if they are at hand.
    """
    spark = docs.sparkSession
    families = _families()
    vocabulary = _vocabulary(spark)
    positive = _table(spark, [(families.index(f), t) for f, t in TEMPLATES], "label double, text string")
    sides = F.array(*[F.struct(F.lit(a).alias("lead"), F.lit(b).alias("tail")) for a in _LEADS for b in _TAILS])
    positive = positive.withColumn("side", F.explode(sides))
    constants = positive.select("label", F.concat("side.lead", "text", "side.tail").alias("text")).union(
        _table(spark, [(0.0, t) for t in PLAIN], "label double, text string"))
    constants = vocabulary.transform(_with_grams(constants, "text")).select("label", "x", F.lit(1.0).alias("weight"))
    if marked is None:
        marked = marked_paragraphs(docs.withColumn("_none", F.lit(0)), "_none", text_column)
    plain = marked.where("teaches is not null").groupBy("teaches", "marks").agg(F.count(F.lit(1)).alias("n"))
    plain = cut(vocabulary.transform(_unmarked(plain)).select("teaches", "x", "n"))
    totals = {r["teaches"]: r["n"] for r in plain.groupBy("teaches").agg(F.sum("n").alias("n")).collect()}  # two rows
    share = min(1.0, weight / max(totals.get(True, 0), 1))
    rows = cut(constants.union(plain.where("teaches").select(F.lit(0.0), "x", F.col("n") * share)))
    fitted = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=0.002,
                                elasticNetParam=0.7, standardization=False, maxIter=40).fit(rows)
    matrix, names = fitted.coefficientMatrix.toArray(), vocabulary.vocabulary
    weights = [(names[j], [float(v) for v in matrix[:, j]]) for j in range(len(names)) if matrix[:, j].any()]
    table = cut(_table(spark, weights, "gram string, w array<double>"))
    known = rows.where("label = 0").select("weight", F.posexplode(vector_to_array("x")).alias("j", "one")).where("one > 0")
    seen = {names[r["j"]]: r["weight"] for r in known.groupBy("j").agg(F.sum("weight").alias("weight")).collect()}  # a row for each n-gram of the templates
    used = [j for j in range(len(names)) if matrix[:, j].any()]
    intercepts = fitted.interceptVector.toArray()
    needed = necessary_grams([names[j] for j in used], matrix[:, used], intercepts, seen)
    held = fitted.transform(plain.where("not teaches")).select("n", F.array_max(F.slice(
        vector_to_array("probability"), 2, len(families))).alias("p"))
    # Probabilities in steps of 1 / STEPS, rounded up: at most STEPS numbers, whatever the paragraphs.
    counts = held.groupBy(F.ceil(F.col("p") * STEPS).alias("step")).agg(F.sum("n").alias("n")).where(F.col("step") > int(LEAST_PROBABILITY * STEPS))
    return Model(table, [float(v) for v in intercepts], needed, least_probability(
        {r["step"]: r["n"] for r in counts.collect()}, totals.get(False, 0)))


def least_probability(counts: dict[int, int], total: int) -> float:
    """The least step that at most FALSE_SHARE of ``total`` paragraphs exceed, LEAST_PROBABILITY at least."""
    passing, allowed = 0, int(total * FALSE_SHARE)
    for step in sorted(counts, reverse=True):
        passing += counts[step]
        if passing > allowed:
            return max(LEAST_PROBABILITY, step / STEPS)
    return LEAST_PROBABILITY


def find_licences(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text",
                  marked: DataFrame | None = None) -> DataFrame:
    """(doc_id, k1, k2, pos, family, probability, similarity, confirmed) of each paragraph that may hold a licence.

    A paragraph is a line. It is reported if its probability of being unknown is below one half; only
    paragraphs with a necessary n-gram can be, so the others are not shuffled. ``family`` is the likeliest one if it exceeds the calibrated least
    probability, else ``unknown``; ``confirmed`` if CONFIRM of a template's n-grams of that family
    are in the paragraph. Null and empty texts have no paragraphs; rows of equal id and text share
    their findings once. Other columns of ``docs`` are not read.
    """
    if marked is None:
        marked = marked_paragraphs(docs, id_column, text_column)
    keys = ["k1", "k2", "pos"]
    needed = F.array(*[F.xxhash64(F.lit(g)) for g in model.needed]).cast("array<bigint>")
    near = marked.where(F.arrays_overlap("marks", needed)).dropDuplicates(keys)
    near = cut(_unmarked(near.select("doc_id", *keys, "marks")))
    judged = near.join(model.probabilities(near, *keys), keys).withColumn("unknown", F.get("p", 0)).where("unknown < 0.5")
    best = F.array_max(F.transform(F.slice("p", 2, len(model.families)), lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    judged = judged.withColumn("best", best).withColumn("family", F.when(
        F.col("best.p") > model.least, F.get(F.array(*[F.lit(f) for f in model.families[1:]]), -F.col("best.i"))).otherwise(UNKNOWN))
    templates = _with_grams(_table(docs.sparkSession, TEMPLATES, "of string, text string"), "text")
    shares = F.transform("templates", lambda t: F.size(F.array_intersect(t, "grams")) / F.size(t))
    templates = templates.groupBy("of").agg(F.collect_list("grams").alias("templates"))
    judged = judged.join(F.broadcast(templates), F.col("family") == F.col("of"), "left")  # a row for each family
    return judged.select("doc_id", *keys, "family", F.col("best.p").alias("probability"), F.coalesce(
        F.array_max(shares), F.lit(0.0)).alias("similarity")).withColumn("confirmed", F.col("similarity") >= CONFIRM)


def scan_licences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, families (confirmed, sorted, comma-joined), n_confirmed, n_unconfirmed, probability.

    probability is the highest of the confirmed paragraphs, null without one. Trains on ``docs`` first if no model is given.
    """
    marked = cut(marked_paragraphs(docs, id_column, text_column))
    found = find_licences(docs, model or train(docs, text_column, marked=marked), id_column, text_column, marked)
    per = found.groupBy("k1", "k2").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.count_if("confirmed").alias("n_confirmed"), F.count_if(~F.col("confirmed")).alias("n_unconfirmed"),
        F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"))
    k1, k2 = row_keys(id_column, text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), k1.alias("k1"), k2.alias("k2"))
    zero = F.lit(0).cast("bigint")
    return rows.join(per, ["k1", "k2"], "left").select(
        "doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_confirmed", zero).alias("n_confirmed"),
        F.coalesce("n_unconfirmed", zero).alias("n_unconfirmed"), "probability")
