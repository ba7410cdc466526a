"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a run of lines that ends at a blank line or after a line that ends a sentence, so a
hard-wrapped notice is one, and licences that stand line by line are several. It is described by the word
pairs and triples it shares with the templates; a multinomial logistic regression over those sparse counts names a licence family or
`unknown`. It learns from every window of MIN_WINDOW and more words of the templates, from
decoys, and from the paragraphs of at most UNKNOWN_DOCS documents, leaving out those that hold
half of a template. A second regression, on rows kept back, calibrates the margin between the
best family and `unknown`; below even odds a paragraph is unknown. A prediction is confirmed
if the paragraph holds all triples (of two words: the pair) of some template of the family, such as a
licence's whole name, or shares at least LEAST_SHARED with one, and CONFIRMED of the shorter's.

Everything is DataFrame functions and JVM models: a map over the documents without a shuffle.
Paragraphs without a pair or triple of any template have no feature, so only the intercepts
speak, which is `unknown` for all of them; they are dropped before triples are made or anything is scored.

Null and empty texts have no paragraphs and so no rows. Repeated rows are scanned each. Of
documents only doc_id and text are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, hash_share, read

UNKNOWN = "unknown"
UNKNOWN_DOCS = 2_000
MIN_WINDOW = 4
CONFIRMED, LEAST_SHARED = 0.5, 5

# By family its tag, the names it goes by, and its notices and conditions as they are published.
FAMILIES: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "MIT": ("MIT", ("MIT License",), (
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    )),
    "Apache-2.0": ("Apache-2.0", ("Apache License 2.0", "Apache License, Version 2.0"), (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    )),
    "GPL": ("GPL-3.0-or-later", ("GNU General Public License", "GNU General Public License, version 3", "GNU General Public License v2"), (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    )),
    "LGPL": ("LGPL-2.1-or-later", ("GNU Lesser General Public License", "GNU Lesser General Public License, version 3"), (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
    )),
    "AGPL": ("AGPL-3.0-only", ("GNU Affero General Public License", "GNU Affero General Public License, version 3"), (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    )),
    "BSD": ("BSD-3-Clause", ("BSD 3-Clause License", "BSD 2-Clause License", "BSD License"), (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    )),
    "MPL-2.0": ("MPL-2.0", ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"), (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    )),
    "EPL-2.0": ("EPL-2.0", ("Eclipse Public License 2.0", "Eclipse Public License - v 2.0", "Eclipse Public License, Version 2.0"), (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "The accompanying program is provided under the terms of this Eclipse Public License. Any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement.",
    )),
    "EUPL-1.2": ("EUPL-1.2", ("European Union Public Licence v. 1.2", "European Union Public Licence 1.2", "EUPL, Version 1.2"), (
        "Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.",
        "Unless required by applicable law or agreed to in writing, software distributed under the Licence is distributed on an \"AS IS\" basis, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the Licence for the specific language governing permissions and limitations under the Licence.",
    )),
    "BSL-1.0": ("BSL-1.0", ("Boost Software License 1.0", "Boost Software License - Version 1.0", "Boost Software License, Version 1.0"), (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software",
    )),
    "Zlib": ("Zlib", ("zlib License", "zlib/libpng License"), (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "This notice may not be removed or altered from any source distribution.",
    )),
    "ISC": ("ISC", ("ISC License",), (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
    )),
    "WTFPL": ("WTFPL", ("WTFPL License", "Do What The Fuck You Want To Public License"), (
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    )),
    "OFL-1.1": ("OFL-1.1", ("SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"), (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software, subject to the following conditions:",
    )),
    "CC-BY": ("CC-BY-4.0", ("Creative Commons Attribution 4.0", "Creative Commons Attribution 4.0 International License", "CC BY 4.0"), ()),
    "CC-BY-SA": ("CC-BY-SA-4.0", ("Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"), ()),
    "CC-BY-NC": ("CC-BY-NC-4.0", ("Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"), ()),
    "CC0": ("CC0-1.0", ("CC0 1.0 Universal", "CC0 1.0"), (
        "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
    )),
    "Unlicense": ("Unlicense", ("The Unlicense",), (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    )),
    "proprietary": ("", (), (
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
    )),
}
#: Sentences that a licence is named in, beside its bare name and its tag.
NAMED = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.")
TEMPLATES: dict[str, tuple[str, ...]] = {
    family: (
        *((f"SPDX-License-Identifier: {tag}", f"License: {tag}") if tag else ()),
        *(text for name in names for text in (name, *(sentence.format(name) for sentence in NAMED))),
        *texts,
    )
    for family, (tag, names, texts) in FAMILIES.items()
}
# Sentences about licences and software that license nothing.
DECOYS = (
    "He renewed his driving license last week.",
    "The committee discussed the license fee for the new stadium.",
    "She was licensed under the new state law to practice medicine.",
    "The software was released under pressure from the public.",
    "Permission to enter the building is granted by the guard.",
    "The public license plate register is kept by the general office.",
    "You may obtain a copy of the form at the front desk.",
    "This program is broadcast under the terms of a new agreement.",
    "The above is subject to the terms of the contract with the supplier.",
    "In all copies of the map the above road is missing.",
    "This dataset may be used freely for any purpose under the licence that its authors chose.",
    "Any purpose for which the authors hold a license is listed in the notice above.",
    "The terms of the public license of this radio station are published by the commission.",
    "See the license for more details of the agreement with the software company.",
)


_WORDS = r"[a-z0-9]+(?:\.[0-9]+)*"
#: A line after which a paragraph ends: without words, or at the end of a sentence.
_ENDS = r"^[\x20\x09-\x0D]*$|[.!?:;\"')\]][\x20\x09-\x0D]*$"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORDS), 0)


def template_pairs() -> list[str]:
    """The word pairs of all templates."""
    listed = [re.findall(_WORDS, text.lower()) for texts in TEMPLATES.values() for text in texts]
    return sorted({f"{a} {b}" for words in listed for a, b in zip(words, words[1:])})  # noqa: B905  one less


def _grams(rows: DataFrame, only: list[str] | None = None) -> DataFrame:
    """rows (with words) plus triples and grams: pairs and triples; of rows that hold a pair of only, if given."""
    pairs = NGram(n=2, inputCol="words", outputCol="__pairs").transform(rows)
    if only is not None:
        pairs = pairs.where(F.exists("__pairs", lambda pair: pair.isin(only)))
    both = NGram(n=3, inputCol="words", outputCol="triples").transform(pairs)
    return both.withColumn("grams", F.concat("__pairs", "triples")).drop("__pairs")


def paragraphs(docs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """doc_id, paragraph (number of its first line, from 0), words, triples and grams of paragraphs with at least two words."""
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | F.get("lines", i - 1).rlike(_ENDS))
    begun = lines.withColumn("starts", starts)
    whole = F.transform(
        "starts",
        lambda start, nth: F.struct(start.alias("paragraph"), F.array_join(F.slice("lines", start + 1, F.coalesce(F.get("starts", nth + 1), F.size("lines")) - start), " ").alias("text")),
    )
    each = begun.select("doc_id", F.explode(whole).alias("each")).select("doc_id", "each.paragraph", _words(F.col("each.text")).alias("words"))
    return _grams(each.where(F.size("words") > 1), only)


def templates(spark: SparkSession) -> DataFrame:
    """family, words, triples, grams of the templates."""
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    frame = spark.createDataFrame(rows, "family string, text string")
    return _grams(frame.select("family", _words(F.col("text")).alias("words")))


def _marks(grams: Column, triples: Column) -> Column:
    """What texts are compared by: triples, or the pair of a text of two words."""
    return F.when(F.size(triples) > 0, triples).otherwise(grams)


def _compared(template: Column, paragraph: Column) -> Column:
    """(confirmed, similarity) of a paragraph with a template, both as marks; similarity is the share of the shorter's that both have."""
    shared, of_template = F.size(F.array_intersect(template, paragraph)), F.size(F.array_distinct(template))
    least = F.least(of_template, F.size(F.array_distinct(paragraph)))
    similarity = F.when(least > 0, shared / least).otherwise(F.lit(0.0))
    whole = (of_template > 0) & (shared == of_template)
    return F.struct((whole | ((shared >= LEAST_SHARED) & (similarity >= CONFIRMED))).alias("confirmed"), similarity.alias("similarity"))


def like_templates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The ids of rows (id, grams, triples) that some template would confirm, found by the marks they share."""
    marked = known.select(F.xxhash64("grams").alias("template"), F.array_distinct(_marks(F.col("grams"), F.col("triples"))).alias("m")).distinct()
    marks = marked.select("template", F.size("m").alias("of_template"), F.explode("m").alias("mark"))
    own = F.size(F.array_distinct(_marks(F.col("grams"), F.col("triples"))))
    each = rows.select("id", own.alias("own"), F.explode(F.array_distinct("grams")).alias("mark"))
    shared = each.join(F.broadcast(marks), "mark").groupBy("id", "own", "template", "of_template").agg(F.count("*").alias("n"))
    found = (F.col("n") == F.col("of_template")) | ((F.col("n") >= LEAST_SHARED) & (F.col("n") >= CONFIRMED * F.least("own", "of_template")))
    return shared.where(found).select("id").distinct()


@dataclass(frozen=True)
class LicenseModel:
    families: tuple[str, ...]
    counts: CountVectorizerModel
    classifier: LogisticRegressionModel
    calibration: LogisticRegressionModel

    def predicted(self, rows: DataFrame) -> DataFrame:
        """rows (with grams) plus family and probability (calibrated, of not unknown)."""
        return self._judged(self.counts.transform(rows))

    def _judged(self, counted: DataFrame) -> DataFrame:
        judged = self.calibration.transform(margins(self.classifier, counted))
        best = F.element_at(F.array(*map(F.lit, self.families[1:])), F.col("__best"))
        probability = vector_to_array("__calibrated")[1]
        return judged.withColumn("probability", probability).withColumn("family", F.when(F.col("probability") >= 0.5, best).otherwise(UNKNOWN)).drop(
            "features", "__raw", "__best", "__margin", "__margins", "__calibrated"
        )


def margins(classifier: LogisticRegressionModel, counted: DataFrame) -> DataFrame:
    """counted plus __best (the strongest family, from 1) and __margins (its lead over unknown, a vector)."""
    raw = classifier.transform(counted).withColumn("__raw", vector_to_array("__scores"))
    known = F.slice("__raw", 2, F.size("__raw") - 1)
    lead = raw.withColumn("__best", F.array_position(known, F.array_max(known)).cast("int")).withColumn("__margin", F.array_max(known) - F.element_at("__raw", 1))
    return VectorAssembler(inputCols=["__margin"], outputCol="__margins").transform(lead.drop("__scores", "__probabilities", "__predicted"))


def fit(docs: DataFrame) -> LicenseModel:
    """A model for the corpus docs; it reads the text of at most about UNKNOWN_DOCS documents."""
    spark = docs.sparkSession
    families = (UNKNOWN, *TEMPLATES)
    known = templates(spark)
    vocabulary = sorted({g for r in known.select("grams").collect() for g in r["grams"]})
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    width = F.size("words")
    spans = known.select("family", "words", F.explode(F.sequence(F.lit(1), width)).alias("start")).withColumn(
        "length", F.explode(F.filter(F.array(*[F.lit(n) for n in (MIN_WINDOW, 6, 9, 14, 1000)]), lambda n: (n <= width) | (n == 1000)))
    )
    spans = spans.where((F.col("start") == 1) | (F.col("start") + F.col("length") <= width + 1))
    windows = spans.select("family", F.slice("words", F.col("start"), F.col("length")).alias("words"))
    decoys = spark.createDataFrame([(UNKNOWN, t) for t in DECOYS], "family string, text string").select("family", _words(F.col("text")).alias("words"))
    share = min(1.0, UNKNOWN_DOCS / max(1, docs.count()))
    chosen = docs.select("doc_id", "text").where(hash_share(share, "doc_id", "text"))
    some = paragraphs(chosen.dropDuplicates(["text"])).withColumn("id", F.xxhash64("words"))  # many rows may repeat one text
    some = some.join(like_templates(some, known), "id", "left_anti").select(F.lit(UNKNOWN).alias("family"), "words")
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    rows = _grams(windows.unionByName(decoys).unionByName(some)).withColumn("label", label)
    rows = rows.withColumn("kept_back", F.pmod(F.xxhash64("words"), F.lit(5)) == 0)
    rows = cut(counts.transform(rows).select("features", "label", "kept_back")).coalesce(4)  # a few thousand rows: iterations are short
    regression = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, rawPredictionCol="__scores", probabilityCol="__probabilities", predictionCol="__predicted")
    classifier = regression.fit(rows.where("not kept_back or label > 0"))
    binary = margins(classifier, rows.where("kept_back")).withColumn("label", (F.col("label") > 0).cast("double"))
    platt = LogisticRegression(featuresCol="__margins", regParam=1e-3, rawPredictionCol="__m", probabilityCol="__calibrated", predictionCol="__p")
    return LicenseModel(families, counts, classifier, platt.fit(binary.select("__margins", "label")))


def scanned(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed of every paragraph that the model gives a family."""
    model = model or fit(docs)
    by_family = templates(docs.sparkSession).groupBy("family").agg(F.collect_list("grams").alias("__templates"), F.collect_list("triples").alias("__triples"))
    found = model.predicted(paragraphs(docs, template_pairs())).where(F.col("family") != UNKNOWN).join(F.broadcast(by_family), "family")
    # where either has two words only, the pairs of both are compared
    short = F.size("triples") == 0
    best = F.array_max(F.transform("__templates", lambda t, i: F.when(short | (F.size(F.get("__triples", i)) == 0), _compared(t, F.col("grams"))).otherwise(_compared(F.get("__triples", i), F.col("triples")))))
    return found.withColumn("__best", best).select("doc_id", "paragraph", "family", "probability", F.col("__best.similarity").alias("similarity"), F.col("__best.confirmed").alias("confirmed"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents").select("doc_id", "text"))
