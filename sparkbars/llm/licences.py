"""Licence scan: a trained paragraph classifier over sparse word n-grams.

Paragraphs (lines) become hashed counts of words and word pairs; a multinomial
logistic regression, trained on noisy copies of licence notices, statements of
the usual names and versions, and the paragraphs of licence texts, against
paragraphs of the corpus and sentences that only talk of licences, names the
licence family or ``unknown``. The probability from which a family is believed
is calibrated on rows kept out of training. A believed paragraph is confirmed
if it shares enough word shingles with a template of its family; lines shorter
than a shingle are compared by their words with templates that are, too.
"""

from __future__ import annotations

import json
from importlib import resources

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

UNKNOWN = "unknown"
FEATURES = 1 << 13
#: Length of every line's vector: about that of 12 words, of which each word and pair counts 1.
LENGTH = 5.0
#: Shingle length and share of shingles in common that confirm a notice.
SHINGLE, SIMILARITY = 5, 0.8
#: Noisy copies of each notice, and paragraphs of the corpus in training, at most about so many.
COPIES, BACKGROUND = 24, 2000
#: Copies of each statement and of each part of a licence text, their weight, and the words of a part.
STATEMENT_COPIES, PART_COPIES, WEIGHT, PART = 6, 2, 0.2, 12
#: Share of paragraphs kept out of training that may be taken for a licence.
FALSE_SHARE = 0.001

# Usual notices of public licences.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
}


def _names() -> dict[str, list[str]]:
    """How licences are named, with the usual versions."""
    gnu = {"GPL": ("General", "GPL", ("1", "2", "3")), "LGPL": ("Lesser General", "LGPL", ("2", "2.1", "3")), "AGPL": ("Affero General", "AGPL", ("1", "3"))}
    names = {
        "MIT": ["MIT License", "MIT License (MIT)", "MIT", "Expat License"],
        "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0", "Apache Software License 2.0", "Apache Software License, Version 2.0"],
        "BSD": ["BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "Simplified BSD License", "BSD-style license", "0BSD",
                'BSD 3-Clause "New" or "Revised" License', 'BSD 2-Clause "Simplified" License',
                *(n for k in "234" for n in (f"BSD {k}-Clause License", f"{k}-Clause BSD License", f"BSD-{k}-Clause"))],
        "MPL": [n for v in ("1.0", "1.1", "2.0") for n in (f"Mozilla Public License, version {v}", f"Mozilla Public License, v. {v}", f"Mozilla Public License {v}", f"MPL {v}", f"MPL v{v}")] + ["Mozilla Public License"],
        "ISC": ["ISC License", "ISC"],
        "CC0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons CC0 1.0 Universal License"],
        "Unlicense": ["Unlicense", "The Unlicense"],
    }
    for family, (kind, short, versions) in gnu.items():
        full = f"GNU {kind} Public License"
        names[family] = [full, f"GNU {short}", short]
        for v in versions:
            whole = v if "." in v else f"{v}.0"
            names[family] += [f"{full}, version {v}", f"{full} version {whole}", f"{full} v{v}", f"{full} v{whole}", f"{full} {whole}", f"GNU {short} version {v}", f"GNU {short}v{v}", f"{short}v{v}",
                              f"{short} version {v}", f"{short} {whole}", f"{short}-{whole}-only", f"{short}-{whole}-or-later", f"{full}, version {v} or later"]
    parts = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    for code in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        full = "Creative Commons " + "-".join(parts[p] for p in code.split("-"))
        names[f"CC-{code}"] = [n for v in ("1.0", "2.0", "2.5", "3.0", "4.0") for n in (
            f"CC {code} {v}", f"{full} {v} License", f"{full} {v} International License", f"{full} {v} Unported License", f"{full} {v} Generic License", f"{full} {v}")]
    return names


def statements() -> dict[str, list[str]]:
    """Usual ways to state a licence by its name. A longer line that holds one of
    them shares all its shingles, so who or what is licensed does not matter."""
    out = {}
    for family, names in _names().items():
        said = {}
        for n in names:
            forms = [f"{verb} under {the}{n}" for verb in ("Licensed", "Released", "Distributed", "Available", "Published") for the in ("", "the ")]
            forms += [f"Under the terms of the {n}", f"SPDX-License-Identifier: {n}", f"License: {n}"]
            forms += [f"{what} is {verb} under {the}{n}" for what in ("project", "software", "work", "program", "library", "code") for verb in ("licensed", "released", "distributed")
                      for the in ("", "the ")] if len(n.split()) < 3 else []
            said.update(dict.fromkeys(forms + ([n, f"The {n}"] if " " in n else [])))
        out[family] = list(said)
    return out


def texts() -> dict[str, list[str]]:
    """Paragraphs of licence texts."""
    return json.loads(resources.files(__package__).joinpath("licence_texts.json").read_text("utf-8"))


# Sentences about licences that license nothing.
TALK = [
    "You need a driving license to rent the car.", "The license fee is due every year.", "All rights reserved.",
    "Her fishing licence was suspended.", "The software was released under a new name.", "He was licensed to sell wine.",
    "The version released in June fixes the bug.", "Terms of use apply.", "The Apache helicopter landed at the base.",
    "MIT and other universities take part.", "See the license agreement for details.", "The public library opens at nine.",
    "A copy of the report was obtained from the office.", "Permission to enter was granted by the owner.",
    "The general public may attend version 3 of the show.", "Creative people share common ideas.",
]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _terms(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, 1 << 30),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)


def _shingles(words: Column, n: int = SHINGLE) -> Column:
    """Distinct runs of ``n`` words; the one run of all words if they are fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))


def _compared(words: Column) -> Column:
    """What is compared: shingles, of fewer words the words (no word is equal to a shingle)."""
    return F.when(F.size(words) < SHINGLE, F.array_distinct(words)).otherwise(_shingles(words))


def _notices(spark: SparkSession) -> DataFrame:
    """``family, notice, copies, weight, notice_words`` of all templates."""
    rows = [(f, t, n, w) for given, n, w in ((NOTICES, COPIES, 1.0), (statements(), STATEMENT_COPIES, WEIGHT)) for f, ts in given.items() for t in ts]
    # short licences are quoted whole: as much as notices
    rows += [(f, t, 0, 1.0 if len(ts) < 12 else WEIGHT) for f, ts in texts().items() for t in ts]
    return spark.createDataFrame(rows, "family string, notice string, copies int, weight double").withColumn("notice_words", _words(F.col("notice")))


def _similar(found: DataFrame) -> DataFrame:
    """``found`` (with ``family, words``) plus ``similarity``: the larger of the shares
    that a line and a template of its family have in common, at its best template;
    of lines shorter than a shingle the smaller one."""
    spark, kept = found.sparkSession, [c for c in found.columns if c != "words"]
    templates = _notices(spark).withColumn("template", F.xxhash64("family", "notice")).withColumn("shingles", _compared(F.col("notice_words")))
    table = templates.select("family", "template", F.size("shingles").alias("of"), F.explode("shingles").alias("shingle")).dropDuplicates(["template", "shingle"])
    # rows are numbered once: the frame is written
    lines = checkpointed(spark, found.withColumn("row", F.monotonically_increasing_id()))
    parts = (lines.withColumn("shingles", _compared(F.col("words")))
             .select("row", F.struct(*kept).alias("kept"), F.size("shingles").alias("n"), (F.size("words") < SHINGLE).alias("short"), F.col("family"),
                     F.explode_outer("shingles").alias("shingle")).join(F.broadcast(table), ["family", "shingle"], "left"))
    common = parts.groupBy("row", "template").agg(F.count("template").alias("common"), F.first("of").alias("of"), F.first("n").alias("n"),
                                                  F.first("short").alias("short"), F.first("kept").alias("kept"))
    share = F.col("common") / F.when(F.col("short"), F.greatest("n", "of")).otherwise(F.least("n", "of"))
    out = common.groupBy("row").agg(F.coalesce(F.max(share), F.lit(0.0)).alias("similarity"), F.first("kept").alias("kept"))
    return out.select("kept.*", "similarity")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> one row per line: ``doc_id, paragraph, line`` (null text: none)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))


class Scanner:
    def __init__(self, model: LogisticRegressionModel, families: list[str], threshold: float):
        self.model, self.families, self.threshold = model, families, threshold

    def classify(self, rows: DataFrame) -> DataFrame:
        """Rows with ``line`` -> plus ``words, family, probability``; family is ``unknown`` below the threshold."""
        termed = rows.withColumn("words", _words(F.col("line"))).withColumn("terms", _terms(F.col("words")))
        scored = self.model.transform(_featured(termed))
        # generated, so that a filter on the result does not compute the model's columns again
        p = F.inline(F.array(F.struct(vector_to_array("probability").alias("p"))))
        best = F.array_max(F.slice("p", 1, len(self.families)))
        name = F.element_at(F.array(*[F.lit(f) for f in self.families]), F.array_position("p", best).cast("int"))
        return scored.select(*rows.columns, "words", p).select(
            *rows.columns, "words", F.when(best >= self.threshold, name).otherwise(UNKNOWN).alias("family"), best.alias("probability"))

    def scan(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text) -> ``doc_id, paragraph, line, family, probability,
        similarity, confirmed`` of all lines that are taken for a licence."""
        found = _similar(self.classify(paragraphs(docs)).filter(F.col("family") != UNKNOWN))
        return (found.withColumn("confirmed", F.col("similarity") >= SIMILARITY)
                .select("doc_id", "paragraph", "line", "family", "probability", "similarity", "confirmed"))


def _featured(rows: DataFrame) -> DataFrame:
    """``terms`` -> ``features`` of one length: neither long lines nor words said many times weigh more."""
    hashed = HashingTF(inputCol="terms", outputCol="hashed", numFeatures=FEATURES, binary=True).transform(rows)
    unit = Normalizer(inputCol="hashed", outputCol="unit").transform(hashed)
    return ElementwiseProduct(inputCol="unit", outputCol="features", scalingVec=Vectors.dense([LENGTH] * FEATURES)).transform(unit)


def fit(spark: SparkSession, docs: DataFrame, background: int = BACKGROUND) -> Scanner:
    """Trains on noisy copies of each notice and statement, parts of licence texts,
    TALK, and about ``background`` lines of (doc_id, text) without a word shingle in
    common with a template. Without documents, TALK alone stands for the unknown."""
    families = sorted({*NOTICES, *_names()})
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    notices = _notices(spark)
    known = notices.select(F.explode(_shingles(F.col("notice_words"))).alias("s")).distinct()
    n = max(1, docs.count())
    # one line, told by a hash, of each document in a share of them
    u = F.shiftrightunsigned(F.xxhash64(F.lit("lines"), "doc_id"), 11) / F.lit(float(1 << 53))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    some = (docs.filter(u < background / n).select(F.xxhash64("doc_id").alias("h"), lines.alias("lines")).filter(F.size("lines") > 0)
            .select("h", F.element_at("lines", (F.pmod("h", F.size("lines")) + 1).cast("int")).alias("line"))
            .withColumn("words", _words(F.col("line"))))
    some = checkpointed(spark, some)
    alike = some.select("h", F.explode(_shingles(F.col("words"))).alias("s")).join(F.broadcast(known), "s", "left_semi")
    some = some.join(alike, "h", "left_anti")
    talk = spark.createDataFrame([(t,) for t in TALK], "line string").withColumn("words", _words(F.col("line")))
    copies = lambda n: F.explode(F.sequence(F.lit(0), n - 1)).alias("copy")
    noisy = F.filter("notice_words", lambda w, i: (F.col("copy") < 4) | (F.pmod(F.xxhash64("copy", "notice", i), F.lit(12)) > 0))
    around = F.filter(F.split(F.lit("the of and copyright 2019 2024 authors by file this project see notice for details"), " "),
                      lambda w: (F.col("copy") >= 4) & (F.pmod(F.xxhash64("copy", "notice", w), F.lit(4)) == 0))
    kept = (F.col("copy") % 4 == 1).alias("kept")
    # texts as a whole and in parts, as their lines are often broken
    whole = notices.filter("copies = 0")
    parts = F.transform(F.sequence(F.lit(1), F.size("notice_words"), F.lit(PART)), lambda i: F.slice("notice_words", i, PART))
    broken = whole.withColumn("notice_words", F.explode(F.array_append(F.filter(parts, lambda w: F.size(w) >= SHINGLE), F.col("notice_words"))))
    templates = notices.filter("copies > 0").unionByName(broken.withColumn("copies", F.when(F.col("weight") == 1, COPIES).otherwise(PART_COPIES)))
    positive = templates.select("family", "notice", "notice_words", "weight", copies(F.col("copies"))).select(
        F.concat(around, noisy).alias("words"), number.alias("label"), "weight", kept)
    unknown = F.lit(float(len(families)))
    negative = some.select("words", unknown.alias("label"), F.lit(1.0).alias("weight"), (F.pmod("h", F.lit(4)) == 1).alias("kept")).union(
        talk.select("words", unknown.alias("label"), copies(F.lit(COPIES))).select("words", "label", F.lit(1.0), kept))
    rows = checkpointed(spark, positive.union(negative).withColumn("terms", _terms(F.col("words"))).coalesce(2))
    hashed = _featured(rows)
    model = LogisticRegression(maxIter=30, regParam=1e-4, family="multinomial", standardization=False, weightCol="weight").fit(hashed.filter("not kept"))
    scanner = Scanner(model, families, 0.0)
    held = scanner.classify(rows.filter("kept").select("label", F.array_join("words", " ").alias("line")))
    at = F.percentile(F.when(F.col("label") == unknown, F.col("probability")), 1 - FALSE_SHARE).alias("at")
    # halfway between what the unknown reach and certainty
    scanner.threshold = max(0.5, (1 + float(held.agg(at).first()["at"] or 0.0)) / 2)
    return scanner


def by_document(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row per doc_id of ``docs`` (rows of one id are one document, null ids
    too): ``doc_id, n_found, n_confirmed, families`` (confirmed, sorted),
    ``family, probability, similarity`` (the most probable confirmed one)."""
    none = docs.select("doc_id", F.lit(None).cast("string").alias("family"), F.lit(None).cast("double").alias("probability"),
                       F.lit(None).cast("double").alias("similarity"), F.lit(False).alias("confirmed"))
    rows = none.union(found.select(*none.columns))
    sure = F.col("confirmed")
    best = F.max(F.when(sure, F.struct("probability", "family", "similarity")))
    out = rows.groupBy("doc_id").agg(F.count("family").alias("n_found"), F.sum(sure.cast("long")).alias("n_confirmed"),
                                     F.sort_array(F.collect_set(F.when(sure, F.col("family")))).alias("families"), best.alias("best"))
    return out.select("doc_id", "n_found", "n_confirmed", "families", "best.family", "best.probability", "best.similarity")
