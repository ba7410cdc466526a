import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import license_scan


@pytest.fixture(scope="module")
def prose(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def model(prose):
    return license_scan.fit(prose)


def test_templates_in_documents_are_found_and_prose_is_not(spark, prose, model):
    rows = [(n, f"The first line of it.\n\n{text}\nThe end of it.") for n, text in enumerate(t for texts in license_scan.TEMPLATES.values() for t in texts)]
    families = [f for f, texts in license_scan.TEMPLATES.items() for _ in texts]
    found = license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string"), model).where("confirmed").collect()
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in found} == {(n, 2, f) for n, f in enumerate(families)}


def test_corpus_lines(spark, prose, model):
    lines = {"This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "All rights reserved."}
    # a line without a sentence's end before the licence begins its paragraph
    expected = {(r["doc_id"], max(k for k in plain_paragraphs(r["text"]) if k <= n)) for r in prose.collect() for n, line in enumerate(r["text"].split("\n")) if line in lines}
    found = {(r["doc_id"], r["paragraph"]) for r in license_scan.scanned(prose, model).where("confirmed").collect()}
    assert found == expected


def test_variants_and_decoys(spark, model):
    rows = [
        (1, "LICENSED UNDER THE MIT LICENSE"), (2, "code is released under the apache license, version 2.0, see below"), (3, "He renewed his driving license last week."),
        (4, "the public library is open to any person"), (5, None), (6, ""), (7, "license"), (1, "LICENSED UNDER THE MIT LICENSE"),
    ]
    found = license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string"), model).where("confirmed")
    assert sorted((r["doc_id"], r["family"]) for r in found.collect()) == [(1, "MIT"), (1, "MIT"), (2, "Apache-2.0")]


def test_hard_wrapped_notices_are_one_paragraph(spark, model):
    notice = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction, including\nwithout limitation the rights to use, copy, modify, merge, publish,\ndistribute, sublicense, and/or sell copies of the Software"
    text = f"Some title\n\n{notice}\n\nThis Source Code Form is subject to the terms of the\nMozilla Public License, v. 2.0.\nAll rights reserved.\n"
    found = license_scan.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).where("confirmed").collect()
    assert sorted((r["paragraph"], r["family"]) for r in found) == [(2, "MIT"), (8, "MPL-2.0"), (10, "proprietary")]


def test_tags_and_headings(spark, model):
    rows = [(1, "SPDX-License-Identifier: MIT"), (2, "SPDX-License-Identifier: Apache-2.0"), (3, "MIT License"), (4, "ISC License\n\nCopyright someone")]
    found = license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string"), model).where("confirmed").collect()
    assert sorted((r["doc_id"], r["family"]) for r in found) == [(1, "MIT"), (2, "Apache-2.0"), (3, "MIT"), (4, "ISC")]


def plain_paragraphs(text: str) -> dict[int, list[str]]:
    """Words of the paragraphs by the number of their first line."""
    out, open_at = {}, None
    for n, line in enumerate((text or "").split("\n")):
        if open_at is None:
            out[open_at := n] = []
        out[open_at] += re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", line.lower())
        if re.fullmatch(r"[\x20\x09-\x0D]*|.*[.!?:;\"')\]][\x20\x09-\x0D]*", line, re.S):
            open_at = None
    return {n: words for n, words in out.items() if len(words) > 1}


def test_paragraphs_and_the_filter_equal_a_plain_version(spark, odd_dir):
    pairs = set(license_scan.template_pairs())
    for folder in (odd_dir, "/root/testdata/sf0.001"):
        docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("monotonically_increasing_id() AS doc_id", "text").cache()
        expected = {(r["doc_id"], n): words for r in docs.collect() for n, words in plain_paragraphs(r["text"]).items()}
        assert {(r["doc_id"], r["paragraph"]): r["words"] for r in license_scan.paragraphs(docs).collect()} == expected
        some = {(r["doc_id"], r["paragraph"]) for r in license_scan.paragraphs(docs, sorted(pairs)).collect()}
        assert some == {k for k, w in expected.items() if pairs & {" ".join(p) for p in zip(w, w[1:])}}


def test_probabilities_are_calibrated(prose, model):
    """Of paragraphs given a family with a probability of at least 0.9, nine in ten hold a template's line."""
    rows = license_scan.scanned(prose, model).where("probability >= 0.9").collect()
    assert sum(r["confirmed"] for r in rows) >= 0.9 * len(rows) > 0


LOOK_ALIKES = [
    ("Eclipse Public License - v 2.0", "EPL-2.0"), ("License: MIT", "MIT"),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', "MIT"),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "GPL"),
    ("Licensed under the EUPL, Version 1.2", "EUPL-1.2"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("This software is provided 'as-is', without any express or implied warranty.", "Zlib"), ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
    ("Mozilla Public License 2.0", "MPL-2.0"), ("GNU Affero General Public License", "AGPL"), ("WTFPL License", "WTFPL"),
    ("This dataset may be used freely for any purpose under the licence that its authors chose.", None), ("Galaxy Public License - v 2.0", None), ("The public license of the station", None),
    ("See the license for more details.", None), ("Permission to use the hall is hereby granted by the mayor.", None), ("License: unknown", None),
]


def test_look_alikes_get_their_own_family_or_none(spark, model):
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(LOOK_ALIKES)], "doc_id long, text string")
    found = {r["doc_id"]: r["family"] for r in license_scan.scanned(rows, model).where("confirmed").collect()}
    assert {LOOK_ALIKES[i][0]: found.get(i) for i in range(len(LOOK_ALIKES))} == dict(LOOK_ALIKES)


def plain_comparison(words: list[str], family: str) -> tuple[bool, float]:
    """(confirmed, similarity) of the best template of a family, by sets of Python."""
    best = (False, 0.0)
    for text in license_scan.TEMPLATES[family]:
        own = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())
        grams = lambda w, n: {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
        one, two = (grams(own, 3), grams(words, 3)) if len(own) > 2 and len(words) > 2 else (grams(own, 2) | grams(own, 3), grams(words, 2) | grams(words, 3))
        shared, least = len(one & two), min(len(one), len(two))
        similarity = shared / least if least else 0.0
        best = max(best, (bool(one) and one <= two or (shared >= 5 and similarity >= 0.5), similarity))
    return best


def test_similarity_and_confirmation_equal_a_plain_version(spark, model, prose):
    texts = [t for t, _ in LOOK_ALIKES] + [" ".join(t.split()[i : i + 9]) for texts in license_scan.TEMPLATES.values() for t in texts for i in (0, 3, 8)]
    docs = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(prose)
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = license_scan.scanned(docs, model).collect()
    assert len(rows) > 300
    for r in rows:
        words = plain_paragraphs(held[r["doc_id"]])[r["paragraph"]]
        confirmed, similarity = plain_comparison(words, r["family"])
        assert r["confirmed"] is confirmed and r["similarity"] == pytest.approx(similarity), (r, words)


def test_rows_like_templates_are_those_that_one_would_confirm(spark):
    known = license_scan.templates(spark)
    texts = [t for t, _ in LOOK_ALIKES] + [" ".join(t.split()[i : i + 7]) for texts in license_scan.TEMPLATES.values() for t in texts for i in (0, 4)] + ["the town of the people", "a b"]
    rows = license_scan.paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("id", F.concat_ws("-", "doc_id", "paragraph")).cache()
    found = {r["id"] for r in license_scan.like_templates(rows, known).collect()}
    for r in rows.collect():
        like = any(plain_comparison(r["words"], family)[0] for family in license_scan.TEMPLATES)
        assert (r["id"] in found) is like or len(r["words"]) == 2, r


def test_probabilities_order_what_is_a_licence(spark, prose, model):
    """Of beginnings of templates and as many paragraphs of prose, those with a higher probability are of licences more often, in each of three bins."""
    texts = [" ".join(t.split()[: 2 + i % 9]) for i, t in enumerate(t for texts in license_scan.TEMPLATES.values() for t in texts)]
    some = license_scan.paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("licence", F.lit(1))
    plain = license_scan.paragraphs(prose).where(F.pmod(F.xxhash64("words"), F.lit(20)) == 0).limit(some.count()).withColumn("licence", F.lit(0))
    rows = model.predicted(some.unionByName(plain)).select("probability", "licence").toPandas()
    low, middle, high = (rows[rows["probability"].between(a, b)]["licence"] for a, b in ((0, 0.2), (0.2, 0.8), (0.8, 1)))
    assert high.mean() > 0.9 > low.mean() and (not len(middle) or low.mean() <= middle.mean() <= high.mean())
