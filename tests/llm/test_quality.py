import re
from collections import Counter

from plumbline.llm import quality
from plumbline.llm.quality import Rule


def test_filter_and_rules(spark):
    good = " ".join(f"the word{i} of" for i in range(30))
    rows = [(1, good, "a"), (1, good, "a"), (2, good + " #" * 60, "b"), (3, None, "c"), (4, "short text", "d"), (None, good, "e"), (5, "the of and " * 40, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    assert sorted(r["n_words"] for r in kept.collect()) == ["a", "a", "e"]
    strict = quality.verdicts(docs.select("doc_id", "text"), (Rule("never", "n_words", 1e9), Rule("null", "nullif(n_words, n_words)", 0)))
    assert not strict.where("kept").count() and all(r["failed_rules"] == ["never", "null"] for r in strict.collect())


def test_repeats_by_hand(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text")
    for r, d in zip(quality.measured(docs.coalesce(1)).collect(), docs.coalesce(1).collect(), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(grams)
        assert r["n_repeat_words"] == len({i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)})
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))


def test_one_projection_without_python(spark):
    plan = quality.op9_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Python", "Arrow", "Pandas", "Join"))
