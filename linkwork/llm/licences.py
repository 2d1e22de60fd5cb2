"""Licence notices in documents (operator 4), in DataFrame functions and Spark's ML library only.

A trained classifier names the licence family of a paragraph, a line or a few lines in a row: multinomial logistic regression over
sparse word one- and two-grams.  It learns from the notices below, each also with a word left out that names no licence, as
its family, from near notices as class ``other``, and from a bounded sample of the corpus's own paragraphs as class ``unknown``.
The n-grams of the notices are the features, so the model is a small table whose size does not depend on the
corpus.  The probability that a prediction needs is calibrated on sampled paragraphs that
training has not seen; near notices, of other licences and in prose, are among both.  A prediction counts only if
a stretch of the paragraph about as long as one of the family's notices has ``overlap`` of its word pairs, and all
of its words that name a licence.

A paragraph with that share of a notice's words has a word of any set of them that is larger than the
rest, so paragraphs without any such cue are not scored; nothing is lost by that.  Cues are beginnings of words, and one
regular expression looks for all of them where words can begin.

Notices are often wrapped, so each line is also taken together with its next lines, ``wrapped`` lines at most and none
beyond a line without words (a blank line, or a bare comment sign).  Such a unit counts where no line in it is
by itself a notice of the same family; of overlapping units the most similar one counts, of equal ones the shortest, then
the first.  A line gives way to a more similar unit of another family.

Defined cases: a null or empty text has no notices; null ids are kept; repeated rows are reported
alike; a table without paragraphs for ``unknown`` leaves the template comparison to decide; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkwork.llm.common import saved

#: Ordinary text, and near notices; neither is reported.
UNKNOWN, OTHER = "unknown", "other"
#: Common public licence notices, by family.
NOTICES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        "Released under the Apache 2.0 license.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation.",
        "Licensed under the GNU GPL version 2 or later.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "proprietary": ("All rights reserved.", "Confidential and proprietary. Unauthorized copying is strictly prohibited."),
}

#: Near notices: other licences, and prose with the same words.  Examples of the class ``other``, half of them for calibration.
NEAR = (
    "Licensed under the Eclipse Public License, version 2.0.",
    "This program is made available under the terms of the Eclipse Public License 1.0.",
    "This project is licensed under the terms of the ISC license.",
    "Released under the ISC License.",
    "Licensed under the Artistic License 2.0.",
    "This library is free software; you may use it under the Artistic License.",
    "Released under the zlib License.",
    "This software is released under the terms of the zlib license.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Licensed under the EUPL, version 1.2 or later.",
    "Released under the Boost Software License, Version 1.0.",
    "Licensed under the Microsoft Public License.",
    "She said that all of her human rights had been reserved by the court and the journalists.",
    "All seats are reserved and the rights of way remain with the city.",
    "He asked whether the right table was reserved for all of them.",
    "All of the human rights were reserved to the court.",
    "The fishing boats are released under the terms of the new permit to the license office by the harbour master.",
    "He was licensed under the old rules to drive a bus of the general public.",
    "The work of the author is free to any person under the terms of the law.",
    "The foundation is free to publish the program in general terms for the public.",
    "A copy of the source and of the binary form is used with permission of the owner.",
    "The species was released into the public domain of the forest, free and wild.",
)
#: Words that name a licence: a notice with one of them is confirmed only where all of its own stand.
NAMES = {
    "mit", "apache", "gnu", "gpl", "lesser", "bsd", "mozilla", "creative", "commons", "cc", "by", "sa", "nc", "sharealike",
    "noncommercial", "cc0", "unencumbered", "reserved", "confidential",
}

#: Word beginnings that ordinary text is full of: cues only where a notice has too few others.
COMMON = {"this", "that", "with", "under", "use", "work", "free", "terms", "person", "source", "withou", "public"}


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and inner points."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*"), F.lit(0))


def ngrams(w: Column) -> Column:
    pairs = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.when(F.size(w) > 1, F.slice(pairs, F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def _ordered(w: Column, notice: Column) -> Column:
    """Share of the notice's word pairs in the best stretch of ``w`` half as long again, all of its ``names`` included.

    Stretches begin where a pair of the notice stands.
    """
    pair = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))
    last = F.greatest(F.size(w) - 2, F.lit(0))
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: F.array_contains(notice["pairs"], pair(i)))
    wide = (F.size(notice["pairs"]) * 3 / 2).cast("int") + 2

    def share(i: Column) -> Column:
        part = F.slice(w, i + 1, wide)
        pairs = F.zip_with(part, F.slice(part, F.lit(2), wide), lambda a, b: F.concat_ws(" ", a, b))
        named = F.size(F.array_intersect(notice["names"], part)) == F.size(notice["names"])
        return F.when(named, F.size(F.array_intersect(notice["pairs"], pairs)) / F.size(notice["pairs"])).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(starts, share)), F.lit(0.0))


def _notices(spark: SparkSession) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, ts in NOTICES.items() for t in ts]))
    return spark.range(1).select(rows.alias("r")).select("r.family", words(F.col("r.text")).alias("w"))


def _confirmed(w: Column, notice: Column) -> Column:
    return F.size(F.array_intersect(w, notice)) / F.size(F.array_distinct(notice))


def _alike(w: Column, notices: list[list[str]], share: float) -> Column:
    """Whether a paragraph has that share of the words of any notice."""
    known = F.array(*[F.array(*[F.lit(x) for x in notice]) for notice in notices])
    return F.exists(known, lambda t: _confirmed(w, t) >= share)


class LicenceModel:
    """Weights of n-grams by family (small tables), families and the probability a prediction needs."""

    def __init__(self, weights: DataFrame, bias: list[float], families: list[str], needed: float):
        self.weights, self.bias, self.families, self.needed = weights, bias, families, needed


def _scored(rows: DataFrame, model: LicenceModel, keys: list[str]) -> DataFrame:
    """The keys with the best family and its probability; paragraphs without any known n-gram fall out as unknown."""
    grams = rows.select(*keys, F.explode(F.array_distinct(ngrams(F.col("w")))).alias("gram"))
    n = len(model.families)
    hit = grams.join(F.broadcast(model.weights), "gram")  # at most the n-grams of NOTICES
    sums = hit.groupBy(*keys).agg(*[F.sum(F.col("weights")[i]).alias(f"_s{i}") for i in range(n)])
    logits = F.array(*[F.col(f"_s{i}") + F.lit(model.bias[i]) for i in range(n)])
    sums = sums.select(*keys, logits.alias("z")).withColumn("top", F.array_max("z"))
    sums = sums.withColumn("total", F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top"))))
    names = F.array(*[F.lit(f) for f in model.families])
    return sums.select(
        *keys,
        F.element_at(names, F.array_position("z", F.col("top")).cast("int")).alias("family"),
        (1 / F.col("total")).alias("probability"),
    )


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, paragraph, text``: the lines of each text, numbered from 0."""
    lines = F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("paragraph", "text")
    return docs.select(F.col(id_col).alias("id"), lines)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = 400, unknown: int = 4000) -> LicenceModel:
    """Train on the notices and on at most ``unknown`` paragraphs of ``documents`` documents, those of least hash."""
    spark = docs.sparkSession
    notices = _notices(spark)
    # without a word that names its licence a notice would be another's
    at = F.filter(F.transform("w", lambda x, i: F.when(~x.isin(*NAMES), i)), lambda i: i.isNotNull())
    holes = F.explode(F.concat(F.array("w"), F.transform(at, lambda i: F.concat(F.slice("w", F.lit(1), i), F.slice("w", i + 2, F.size("w"))))))
    known = notices.select("family", holes.alias("w"))
    chosen = docs.select(id_col, text_col).orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(documents)
    sample = paragraphs(chosen, id_col, text_col).select(words(F.col("text")).alias("w")).where(F.size("w") > 0)
    # the corpus's own notices are not examples of the class unknown
    sample = sample.where(~_alike(F.col("w"), [r.w for r in notices.collect()], 0.5)).distinct().orderBy(F.xxhash64("w"), F.col("w").cast("string")).limit(unknown)
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("w", F.lit("fold")), F.lit(4)))
    near = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in NEAR])).alias("at", "text"))
    near = near.select((F.col("at") % 2).alias("fold"), words(F.col("text")).alias("w"))
    known = known.union(near.where("fold <> 0").select(F.lit(OTHER).alias("family"), holes.alias("w")))
    train = known.union(sample.where("fold <> 0").select(F.lit(UNKNOWN), "w"))
    families = [*NOTICES, OTHER, UNKNOWN]
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    weight = F.count("*").over(Window.partitionBy("family"))
    train = train.select(label.cast("double").alias("label"), F.array_distinct(ngrams(F.col("w"))).alias("grams"), (1 / weight).alias("weight"))
    vocabulary = sorted({g for r in known.select(ngrams(F.col("w")).alias("g")).collect() for g in r.g})
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=1.0)
    fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.0001, maxIter=100, standardization=False).fit(
        counts.transform(train)
    )
    matrix = fitted.coefficientMatrix.toArray()
    rows = [(g, [float(x) for x in matrix[:, i]]) for i, g in enumerate(vocabulary)]
    missing = [0.0] * (len(families) - matrix.shape[0])
    rows = [(g, w + missing) for g, w in rows]
    bias = [float(x) for x in fitted.interceptVector] + [-30.0 for _ in missing]
    model = LicenceModel(spark.createDataFrame(rows, "gram string, weights array<double>"), bias, families, 0.5)
    # calibration: what at most one in a thousand unseen unknown paragraphs, near notices among them, reaches
    unseen = sample.where("fold = 0").select("w").union(near.where("fold = 0").select("w")).withColumn("id", F.monotonically_increasing_id())
    wrong = _scored(unseen, model, ["id"]).where(~F.col("family").isin(UNKNOWN, OTHER))
    worst = wrong.agg(F.percentile_approx("probability", 0.999)).first()[0]
    model.needed = max(0.5, min(worst or 0.0, 0.95))
    return model


def _cues(notices: list[list[str]], overlap: float) -> list[str]:
    """Few word beginnings such that text with ``overlap`` of a notice's words has one of them.

    Each notice needs more covered words than may be missing; beginnings that cover the most open needs go first.
    """
    cues: list[str] = []
    needs = [(list(w), int(len(w) * (1 - overlap) + 1e-9) + 1) for w in notices]
    while needs:
        counts: dict[str, int] = {}
        for open_words, need in needs:
            for start in {w[:6] for w in open_words}:
                covered = sum(w.startswith(start) for w in open_words)
                plain = start in COMMON or (len(start) < 4 and start.isalpha())
                counts[start] = counts.get(start, 0) + min(need, covered) * (1e-3 if plain else 1) * len(start) ** 2
        best = max(sorted(counts), key=counts.get)
        cues.append(best)
        left = []
        for open_words, need in needs:
            rest = [w for w in open_words if not w.startswith(best)]
            if (need := need - (len(open_words) - len(rest))) > 0:
                left.append((rest, need))
        needs = left
    return cues


def _cue_pattern(cues: list[str]) -> str:
    """Matches where a word of lower-case text behind a blank begins with a cue; no word begins right after a letter.

    Cues of one first character share a branch, and places before other characters are left at once.
    """
    rest: dict[str, list[str]] = {}
    for cue in sorted(cues):
        rest.setdefault(cue[0], []).append(re.escape(cue[1:]))
    branches = "|".join(f"{re.escape(first)}(?:{'|'.join(more)})" for first, more in rest.items())
    return f"[^a-z](?=[{''.join(map(re.escape, rest))}])(?:{branches})"


def _units(docs: DataFrame, notices: list[list[str]], id_col: str, text_col: str, overlap: float, wrapped: int) -> DataFrame:
    """``doc, id, paragraph, lines, w``: lines, and runs of them, that are like some notice.

    ``doc`` tells rows apart that share an id.
    """
    pattern = _cue_pattern(_cues(notices, overlap))
    has_cue = lambda c: F.concat(F.lit(" "), F.lower(c)).rlike(pattern)
    once = lambda c, name: F.explode(F.array(c)).alias(name)  # noqa: E731  a filter above does not evaluate it again
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(has_cue(F.col("text")))
    rows = texts.select(F.monotonically_increasing_id().alias("doc"), "id", once(F.split("text", "\n", -1), "l"))
    # a cue is part of a word, so a run has one if a line of it has
    rows = rows.select("doc", "id", "l", once(F.transform("l", has_cue), "c")).where(F.array_contains("c", True))
    near = lambda i: F.array_contains(F.slice("c", F.greatest(i - (wrapped - 1), F.lit(0)) + 1, F.lit(2 * wrapped - 1)), True)
    read = F.transform("l", lambda x, i: F.when(near(i), words(x)).otherwise(F.array().cast("array<string>")))
    rows = rows.select("doc", "id", "c", once(read, "w"))
    some = lambda x, i: F.when((F.size(x) > 0) & F.array_contains(F.slice("c", i + 1, F.lit(wrapped)), True), F.slice("w", i + 1, F.lit(wrapped)))
    rows = rows.select("doc", "id", F.posexplode(F.transform("w", some)).alias("paragraph", "l")).where("l is not null")
    end = F.array_position(F.transform("l", lambda w: F.size(w) == 0), True).cast("int")
    rows = rows.select("doc", "id", "paragraph", once(F.when(end > 0, F.slice("l", F.lit(1), end - 1)).otherwise(F.col("l")), "l"))
    # what no run of all the lines has no shorter one has: few lines go on
    known = F.array(*[F.lit(x) for x in sorted({x for notice in notices for x in notice})])
    rows = rows.select("*", once(F.array_intersect(F.flatten("l"), known), "f"))
    rows = saved(rows.where(_alike(F.col("f"), notices, overlap)).drop("f"), "licence-lines")
    rows = rows.withColumn("lines", F.explode(F.sequence(F.lit(1), F.size("l"))))
    rows = rows.select("doc", "id", "paragraph", "lines", once(F.flatten(F.slice("l", F.lit(1), F.col("lines"))), "w"))
    return saved(rows.where(_alike(F.col("w"), notices, overlap)), "licence-paragraphs")


def _apart(found: DataFrame) -> DataFrame:
    """Of the ``found`` units of a document those that count; none of them overlap."""
    meets = lambda x, y: (x["paragraph"] < y["paragraph"] + y["lines"]) & (y["paragraph"] < x["paragraph"] + x["lines"])
    # units that cannot meet any other's fall into different clusters, so that each is small
    end = F.max(F.col("paragraph") + F.col("lines")).over(
        Window.partitionBy("doc").orderBy("paragraph", "lines").rowsBetween(Window.unboundedPreceding, -1)
    )
    found = found.withColumn("opens", F.coalesce((F.col("paragraph") >= end).cast("int"), F.lit(0)))
    run = Window.partitionBy("doc").orderBy("paragraph", "lines").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("cluster", F.sum("opens").over(run))
    unit = F.struct((-F.col("similarity")).alias("rank"), "lines", "paragraph", "family", "probability", "similarity")
    rows = found.groupBy("doc", "cluster").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(unit)).alias("units"))
    rows = rows.withColumn("single", F.filter("units", lambda u: u["lines"] == 1))
    own = lambda u: F.exists("single", lambda x: (x["family"] == u["family"]) & meets(x, u))
    rows = rows.withColumn("units", F.filter("units", lambda u: (u["lines"] == 1) | ~own(u)))
    take = lambda kept, u: F.when(F.exists(kept, lambda x: meets(x, u)), kept).otherwise(F.concat(kept, F.array(u)))
    rows = rows.select("id", "units", F.slice("units", 1, 0).alias("none"))
    rows = rows.select("id", F.explode(F.aggregate("units", F.col("none"), take)).alias("u"))
    return rows.select("id", "u.paragraph", "u.family", "u.probability", "u.similarity")


def scan(
    docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text", overlap: float = 0.7, wrapped: int = 8
) -> DataFrame:
    """``id_col, paragraph, family, probability, similarity`` of each licence notice; ``paragraph`` is its first line."""
    spark = docs.sparkSession
    notices = _notices(spark).select("family", F.array_distinct("w").alias("w"))
    # the template comparison has to hold for some family in any case: few paragraphs go on
    rows = _units(docs, [row.w for row in notices.collect()], id_col, text_col, overlap, wrapped)
    rows = rows.withColumn("th", F.xxhash64("w"))
    best = _scored(rows.select("th", "w").distinct(), model, ["th"])
    found = best.where(~F.col("family").isin(UNKNOWN, OTHER) & (F.col("probability") >= model.needed))
    rows = rows.join(found, "th")
    names = F.array(*[F.lit(x) for x in sorted(NAMES)])
    pairs = F.array_distinct(F.filter(ngrams(F.col("w")), lambda g: g.contains(" ")))
    notice = F.struct(pairs.alias("pairs"), F.array_intersect("w", names).alias("names"))
    by_family = _notices(spark).groupBy("family").agg(F.collect_list(notice).alias("notices"))
    rows = rows.join(F.broadcast(by_family), "family")  # the fixed notices
    similarity = F.array_max(F.transform("notices", lambda t: _ordered(F.col("w"), t)))
    rows = rows.withColumn("similarity", similarity).where(F.col("similarity") >= overlap)
    return _apart(rows).withColumnRenamed("id", id_col)
