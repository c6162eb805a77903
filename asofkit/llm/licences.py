"""Operator 3: licence scan by a trained paragraph classifier, DataFrame functions and Spark ML only.

A text is cut into lines and sentences ("paragraphs" below), and every one is scored. A multinomial logistic regression over
hashed word uni- and bigrams tells licence families, licences of no known family and ordinary prose apart. It is trained on fixed
templates, whole, clipped and mixed into prose, against the prose of at most NEGATIVE_DOCS documents. A temperature and the least
probability of a family are calibrated on rows and on whole families that a first fit has not seen. A paragraph that is no prose
is `unknown` where the model says so, where no family is likely enough, or where the templates of its family do not confirm it.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, row_key

# Sentences of public licences and their notices, by SPDX-like family name.
TEMPLATES = {
    "afl-3.0": ["Licensed under the Academic Free License version 3.0", "SPDX-License-Identifier: AFL-3.0"],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "You should have received a copy of the GNU Affero General Public License along with this program.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License.",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
                   "See the License for the specific language governing permissions and limitations under the License.", "SPDX-License-Identifier: Apache-2.0"],
    "artistic-2.0": ["This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0.", "(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "SPDX-License-Identifier: BSL-1.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "Available under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "cddl": ["The contents of this file are subject to the terms of the Common Development and Distribution License", "SPDX-License-Identifier: CDDL-1.0"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Distributed under the Eclipse Public License v2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "either version 2 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program.",
            "Licensed under GPLv3", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "Licensed under the ISC license.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Released under MIT", "Distributed under the MIT terms.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY", "SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"],
    "ofl-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"],
    "proprietary": ["All rights reserved.", "Proprietary and confidential.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "This file contains confidential and proprietary information."],
    "unlicense": ["This is free and unencumbered software released into the public domain.",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "wtfpl": ["This program is free software. It comes without any warranty, to the extent permitted by applicable law.", "Do What The Fuck You Want To Public License"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty.",
             "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "SPDX-License-Identifier: Zlib"],
}
# How licences speak that are in no family above.
OTHER = ["Licensed under the Frobnicate Community Licence of 1999.", "You may use this code under the terms of the Example Public License, version 4.", "This software is governed by the Free Tools Agreement.",
         "You may copy and modify this work for any purpose as long as this notice stays in place.", "Use of this file is subject to the terms of the vendor's end user license agreement.",
         "The licensee may redistribute unmodified copies only.", "Permission is granted to anyone to use these files for research only.", "No part of this package may be sold without a separate license.",
         "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty.", "This data set is distributed under an open data licence with share-alike terms.",
         "Licensed to you under the terms described in the accompanying notice.", "The grant of rights under this license ends if you sue over patents.", "Distributed under a custom permissive licence.",
         "By downloading the material you accept the license conditions of the publisher.", "SPDX-License-Identifier: LicenseRef-Custom"]
# Ordinary sentences with the words that licences use.
PLAIN = ["She asked for permission to leave the room early.", "The driver lost his license after the accident.", "All copies of the letter were kept in a drawer.", "The software crashed twice on Monday.",
         "You may use the back door after six.", "The permitted speed on this road is fifty.", "A warranty card came with the new kettle.", "They distribute bread to the poor every week.",
         "The general public was allowed into the garden.", "Redistribution of wealth was the theme of his speech.", "He has the rights to the film and the book.", "The terms of the contract were discussed over lunch.",
         "This program about birds is on television tonight.", "The author of the report thanked his sources.", "Without any doubt the version in blue is better.", "Fishing without a licence is not allowed here.",
         "The company kept its plans confidential until spring.", "It is free for children and students.", "The copyright dispute went to court last year.", "Use two cups of flour and one of sugar."]
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)        # class number of licences of no family
PROSE = UNKNOWN + 1            # class number of ordinary text
NEGATIVE_DOCS = 200            # bound of the training sample: documents whose prose is the other class
NEGATIVES = 4000               # and most paragraphs taken from them
FEATURES = 1 << 13
LEAST_SHARED = 0.5             # share of a paragraph's bigrams that the templates of its family must hold
TEMPERATURES = (0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
PROBABILITIES = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)  # least probability of a family; the calibration picks one
HELD_FAMILIES = 4              # every so many families are left out of the first fit and have to come out as unknown


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n+|(?<=[.;!?])[ \t\r]+"), lambda p: F.length(p) > 0)


def words_of(paragraph: Column) -> Column:
    """Words and numbers; dots and dashes inside them stay, as in 2.0 or BY-NC."""
    return F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}.-]+|\.+$|\.+(?=[^\p{L}\p{N}])"), lambda w: F.length(w) > 0)


def bigrams(words: Column) -> Column:
    """Pairs of neighbours; a single word is its own."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) == 1, words).otherwise(pairs)


def _featured(rows: DataFrame) -> DataFrame:
    """Adds `words`, `pairs`, the sparse vector `x` and `once` to rows with a `paragraph`.

    `once` is never below 0. A filter that reads it stays above the word split, which would be copied into each of its uses.
    """
    rows = rows.select("*", words_of(F.col("paragraph")).alias("words"), F.rand(0).alias("once")).withColumn("pairs", bigrams(F.col("words")))
    return HashingTF(inputCol="grams", outputCol="x", numFeatures=FEATURES, binary=True).transform(rows.withColumn("grams", F.concat("words", "pairs")))


def _templates(spark) -> DataFrame:
    rows = [(k, t) for k, name in enumerate(FAMILIES) for t in TEMPLATES[name]] + [(UNKNOWN, t) for t in OTHER]
    return spark.createDataFrame(rows, "label int, paragraph string")


def _template_pairs(family: str) -> list[str]:
    """Bigrams of a family's templates, as `bigrams` and `words_of` make them."""
    out = set()
    for t in TEMPLATES[family]:
        words = [w for w in re.split(r"[^\w.-]+|\.+$|\.+(?=[^\w])", t.lower().replace("_", " ")) if w]
        out.update(words if len(words) == 1 else map(" ".join, zip(words, words[1:])))
    return sorted(out)


def _shared(paragraph_pairs: Column, family: Column) -> Column:
    """Share of a paragraph's bigrams that stand in the templates of the family."""
    held = F.array(*[F.array(*map(F.lit, _template_pairs(name))) for name in FAMILIES])
    own = F.array_distinct(paragraph_pairs)
    return F.size(F.array_intersect(own, F.element_at(held, family + 1))) / F.greatest(F.size(own), F.lit(1))


def training_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """label, paragraph: templates whole, clipped, broken and inside prose, and prose of the bounded sample."""
    spark = docs.sparkSession
    sample = docs.where(F.col(text).isNotNull()).orderBy(F.xxhash64(key, text), key).limit(NEGATIVE_DOCS)
    prose = materialise(sample.select(F.explode(paragraphs(F.col(text))).alias("paragraph")).limit(NEGATIVES))
    # Paragraphs that a template confirms are notices; all others are prose.
    prose = materialise(prose.withColumn("pairs", bigrams(words_of(F.col("paragraph")))))
    confirmed = F.greatest(*[_shared(F.col("pairs"), F.lit(k)) for k in range(len(FAMILIES))]) >= LEAST_SHARED
    plain = materialise(prose.where(~confirmed).select("paragraph"))
    templates = _templates(spark)
    clipped = templates.withColumn("w", F.split("paragraph", " ")).withColumn("cut", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    clipped = clipped.where("size(w) > cut + 3").select("label", F.array_join(F.slice("w", F.lit(1), F.size("w") - F.col("cut")), " ").alias("paragraph"))
    # Long sentences are often broken over lines: their halves and thirds count as well.
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for n in (2, 3) for k in range(n)])).alias("part")
    broken = templates.withColumn("w", F.split("paragraph", " ")).select("*", parts).where("size(w) >= 6 * part.n")
    size = F.ceil(F.size("w") / F.col("part.n")).cast("int")
    broken = broken.select("label", F.array_join(F.slice("w", F.col("part.k") * size + 1, size), " ").alias("paragraph")).where("paragraph <> ''")
    some = plain.orderBy(F.xxhash64("paragraph")).limit(20)
    mixed = templates.join(F.broadcast(some.withColumnRenamed("paragraph", "other")), F.lit(True)).select(
        "label", F.concat_ws(" ", "paragraph", "other").alias("paragraph"))  # at most 20 rows a template
    whole = templates.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("n")
    common = spark.createDataFrame([(PROSE, t) for t in PLAIN for _ in range(5)], "label int, paragraph string")
    rows = whole.unionByName(clipped).unionByName(broken).unionByName(mixed).unionByName(plain.withColumn("label", F.lit(PROSE))).unionByName(common)
    return materialise(rows.coalesce(4))


def train(docs: DataFrame, text: str = "text", key: str = "doc_id"):
    """(model, temperature, least probability of a family).

    A first fit has seen neither every fifth row by hash nor any row of every fourth family. The rows of families that it has seen
    choose the temperature by their log loss; the least probability is the one with which most of them keep their family and most rows of
    the unseen families do not get one (shares of both added; the first of equal values). The model is then fitted on all rows.
    """
    rows = _featured(training_rows(docs, text, key)).withColumn("label", F.col("label").cast("double"))
    rows = materialise(rows.select("label", "paragraph", "pairs", "x"))
    away = F.pmod(F.xxhash64("paragraph", F.lit(9)), F.lit(5)) == 0
    unseen = (F.col("label") < UNKNOWN) & (F.col("label") % HELD_FAMILIES == 0)
    fit = LogisticRegression(featuresCol="x", family="multinomial", regParam=1e-3, maxIter=40, standardization=False)
    # Labels keep their numbers: the first fit knows of the unseen families only that they are never right.
    tested = fit.fit(rows.where(~away & ~unseen)).transform(rows.where(away | unseen)).select("label", "pairs", unseen.alias("unseen"), vector_to_array("rawPrediction").alias("raw"))
    tested = materialise(tested.withColumn("raw", F.concat("raw", F.array_repeat(F.lit(-1e9), F.lit(PROSE + 1) - F.size("raw")))))
    losses = tested.where(~F.col("unseen")).agg(*[F.avg(-F.log(F.greatest(F.get(_softmax(F.col("raw"), t), F.col("label").cast("int")), F.lit(1e-12)))).alias(str(k))
                                                  for k, t in enumerate(TEMPERATURES)]).first()
    best = TEMPERATURES[min(range(len(TEMPERATURES)), key=lambda k: losses[k] if losses[k] is not None else abs(TEMPERATURES[k] - 1))]
    chance = _softmax(F.col("raw"), best)
    judged = tested.select("label", "unseen", "pairs", F.array_max(chance).alias("p"), (F.array_position(chance, F.array_max(chance)) - 1).cast("int").alias("guess"))
    judged = judged.withColumn("named", (F.col("guess") < UNKNOWN) & (_shared(F.col("pairs"), F.least("guess", F.lit(UNKNOWN - 1))) >= LEAST_SHARED))
    known = (F.col("label") < UNKNOWN) & ~F.col("unseen")
    share = lambda rows, hit: F.coalesce(F.avg(F.when(rows, hit.cast("double"))), F.lit(0.0))
    scores = judged.agg(*[(share(known, F.col("named") & (F.col("guess") == F.col("label")) & (F.col("p") >= t)) + share(F.col("unseen"), ~(F.col("named") & (F.col("p") >= t)))).alias(str(k))
                          for k, t in enumerate(PROBABILITIES)]).first()
    least = PROBABILITIES[max(range(len(PROBABILITIES)), key=lambda k: (scores[k], -k))]
    return fit.fit(rows), best, least


def _softmax(raw: Column, temperature: float) -> Column:
    top = F.array_max(raw)
    powers = F.transform(raw, lambda v: F.exp((v - top) / F.lit(temperature)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
    return F.transform(powers, lambda v: v / total)


def licence_findings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per paragraph that is no prose: id (NULL id as the smallest long), place, paragraph, family, probability, shared.

    `family` is `unknown` where the model says so, where no family is likely enough or where the templates do not confirm it.
    """
    model, temperature, least = train(docs, text, key)
    rows = docs.select(row_key(key).alias("id"), F.posexplode(paragraphs(F.col(text))).alias("place", "paragraph"))
    # Without the column of probabilities, which only the few rows that stay need, scaled.
    scored = model.setProbabilityCol("").transform(_featured(rows)).where((F.col("prediction") != PROSE) & (F.col("once") >= 0))
    chance = _softmax(vector_to_array("rawPrediction"), temperature)
    named = scored.select("id", "place", "paragraph", "pairs", F.col("prediction").cast("int").alias("guess"), F.array_max(chance).alias("probability"))
    named = named.withColumn("shared", F.when(F.col("guess") < UNKNOWN, _shared(F.col("pairs"), F.least("guess", F.lit(UNKNOWN - 1)))).otherwise(0.0))
    sure = (F.col("guess") < UNKNOWN) & (F.col("probability") >= least) & (F.col("shared") >= LEAST_SHARED)
    family = F.when(sure, F.element_at(F.array(*map(F.lit, FAMILIES)), F.least("guess", F.lit(UNKNOWN - 1)) + 1)).otherwise("unknown")
    return named.select("id", "place", "paragraph", family.alias("family"), "probability", "shared")


def licence_scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, licences (names of confirmed families, sorted, comma-joined), n_confirmed, n_unknown.

    NULL and empty texts have no paragraphs. Rows that share an id share their findings. An empty table gives an empty result:
    the model then knows the templates alone. Other columns are not read.
    """
    found = licence_findings(docs, text, key).groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("family") != "unknown", F.col("family")))), ",").alias("licences"),
        F.count_if(F.col("family") != "unknown").alias("n_confirmed"), F.count_if(F.col("family") == "unknown").alias("n_unknown"))
    found = materialise(found)
    out = docs.select(row_key(key).alias("id")).join(found, "id", "left")
    return out.select(F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"), F.coalesce("licences", F.lit("")).alias("licences"),
                      F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))
