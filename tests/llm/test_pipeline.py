import re
from collections import Counter

import corpus_pipeline
from plumbline.llm import quality

from .test_near_dedup import brute_classes


def run_stages(spark, docs, folder):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(path := f"{folder}/{len(out)}")
        out.append(docs := spark.read.parquet(path))
    return out


def test_each_stage_against_brute_force_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rules, exact, near, mix, packs = run_stages(spark, docs, str(tmp_path))
    assert all(d.columns == docs.columns for d in (rules, exact, near, mix))
    verdict = {r["doc_id"]: r["kept"] for r in quality.verdicts(docs).collect()}
    assert Counter(map(tuple, rules.collect())) == Counter(tuple(r) for r in docs.collect() if verdict[r["doc_id"]])
    normal, first = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), {}
    for r in sorted(rules.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(normal(r), r)
    assert Counter(map(tuple, exact.collect())) == Counter(map(tuple, first.values()))
    classes = brute_classes({r["doc_id"]: r["text"] for r in exact.collect()})
    kept = {r["doc_id"] for r in near.collect()}
    assert near.count() == len(kept) and kept == set(classes.values())
    times = Counter(r["doc_id"] for r in mix.collect())
    assert set(times) <= kept and max(times.values()) <= 2
    whole = Counter(r["doc_id"] for r in packs.where("start = 0").collect())
    assert whole == times
    assert packs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_run_equals_the_stages_and_survives_odd_rows(spark, odd_dir, empty_dir, tmp_path):
    for folder in (odd_dir, empty_dir):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        last = run_stages(spark, docs, f"{tmp_path}/{folder.rsplit('/', 1)[1]}")[-1]
        key = lambda r: (str(r["doc_id"]), r["piece"], r["start"], r["length"])
        assert Counter(map(key, corpus_pipeline.run(spark, folder).collect())) == Counter(map(key, last.collect()))
