import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import toxicity
from plumbline.llm.common import hash_share


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, folder):
    rows = toxicity.op4_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]).all()
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all()
    held = rows[rows["held_out"]]
    right = held["toxic"] == held["predicted"]
    # some labelled documents lost their toxic words, which no reader could tell
    assert right[held["toxic"] == 0].mean() > 0.99 and right[held["toxic"] == 1].mean() > 0.8


def area(score: np.ndarray, label: np.ndarray) -> float:
    """Of pairs of a toxic and a clean document, the share in which the toxic one scores higher; ties count half."""
    toxic, clean = np.sort(score[label == 1]), np.sort(score[label == 0])
    return (np.searchsorted(clean, toxic, "left").sum() + np.searchsorted(clean, toxic, "right").sum()) / (2 * len(toxic) * len(clean))


def test_held_out_scores_rank_and_are_calibrated(spark):
    folder = "/root/testdata/sf0.1"
    rows = toxicity.op4_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out and toxic is not null").toPandas()
    score, label = rows["score"].to_numpy(), rows["toxic"].to_numpy()
    assert area(score, label) > 0.9 and area(rows["raw"].to_numpy(), label) > 0.9
    # in ten bins of scores the share of toxic documents differs from the mean score by little, weighed by the bins' sizes
    bins = np.minimum((score * 10).astype(int), 9)
    error = sum((bins == b).sum() * abs(score[bins == b].mean() - label[bins == b].mean()) for b in set(bins.tolist())) / len(rows)
    assert error < 0.03
    # a score is a step of the isotonic regression and nothing else
    assert len(set(score.tolist())) < 60


def test_the_lexicon_is_that_of_the_plain_test(spark):
    draw = np.random.default_rng(5)
    words = [f"word{i}" for i in range(200)]
    texts = [(" ".join(draw.choice(words, 30).tolist() + (["slur", "slurry"] if i % 4 == 0 else []) + (["calm"] if i % 4 else [])), int(i % 4 == 0)) for i in range(400)]
    found = toxicity.learn_lexicon(spark.createDataFrame(texts, "text string, toxic int").repartition(3))
    held = [({t for w in text.split() for t in toxicity.terms_of(w)}, label) for text, label in texts]
    n, toxic, expected, counts = len(held), sum(label for _, label in held), {}, {}
    for terms, label in held:
        for term in terms:
            counts.setdefault(term, [0, 0])[label] += 1
    tested = {t: c for t, c in counts.items() if sum(c) >= 3}
    for term, (c, t) in tested.items():
        cells = [(t, (t + c) * toxic / n), (c, (t + c) * (n - toxic) / n), (toxic - t, (n - t - c) * toxic / n), (n - toxic - c, (n - t - c) * (n - toxic) / n)]
        g = 2 * sum(o * np.log(o / e) for o, e in cells if o > 0)
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (n - toxic + 1))
        if g > 2 * np.log(len(tested)) + 2 and odds > np.log(4):
            expected[term] = odds
    assert found == pytest.approx(expected) and {"=slur", "=slurry", "slur"} <= set(found) and "=calm" not in found


def test_a_small_share_of_a_large_table_is_learned_from(spark):
    """The share is kept far below a millionth, where a count of millionths would be 0."""
    for share in (1.0, 0.3, 1e-3, 3e-7):
        n = 4_000_000
        found = spark.range(n).where(hash_share(share, "id")).count()
        assert abs(found - share * n) <= 6 * (share * n) ** 0.5
    tiny = spark.sql("SELECT 1 AS id").where(hash_share(1e-12, "id"))
    assert "shiftrightunsigned" in tiny._jdf.queryExecution().toString().lower() and int(1e-12 * 2.0**63) > 0


def test_scores_ignore_ids_and_odd_labels(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text")
    rows = toxicity.op4_toxicity(spark, odd_dir).collect()
    assert len(rows) == docs.count()
    scores = {}
    for r, text in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"])), range(len(rows)), strict=True):
        assert 0 <= r["score"] <= 1
        scores.setdefault(r["doc_id"], []).append(r["score"])
    assert scores[1][0] == scores[2][0]  # empty and blank texts


def test_labels_held_out_and_other_columns_are_not_learned(spark, tmp_path):
    """Turning every held-out label, and lang and source of every document, leaves all scores as they are."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    held = toxicity.fold() == toxicity.HELD_OUT
    folder = str(tmp_path)
    docs.withColumn("lang", F.lit("x")).withColumn("source", F.col("doc_id").cast("string")).orderBy(F.desc("doc_id")).write.parquet(f"{folder}/documents.parquet")
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int")).write.parquet(f"{folder}/labels.parquet")
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.op4_toxicity(spark, f).collect()} for f in ("/root/testdata/sf0.01", folder))
    assert one.keys() == two.keys() and max(abs(one[i] - two[i]) for i in one) < 1e-9


def test_null_ids_are_held_out_and_repeated_ids_are_one_training_row(spark, odd_dir):
    rows = toxicity.op4_toxicity(spark, odd_dir).collect()
    assert [r["held_out"] for r in rows if r["doc_id"] is None] and all(r["held_out"] is (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in rows)
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(500)] + [(2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert sorted((r["doc_id"], r["text"]) for r in toxicity.training_rows(docs, labels).collect()) == [(1, "text 0"), (2, "x")]


def plain_features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The features again, one definition a line, word by word."""
    words = re.findall(r"[^\W_]+(?:[@$*'\-.][^\W_]+)*", text)
    if not words:
        return [0.0] * 13
    clear = [toxicity.plain(w) for w in words]
    second = [w in toxicity.SECOND_PERSON.split() for w in clear]
    weight = [0.0 if s else max([lexicon.get("=" + w, 0.0)] + [lexicon.get(w[:k], 0.0) for k in range(1, len(w) + 1)]) for w, s in zip(clear, second, strict=True)]
    hit = [w > 0 for w in weight]
    apart = [abs(i - j) for i, h in enumerate(hit) if h for j, s in enumerate(second) if s]
    n = len(words)
    return [
        sum(hit), sum(hit) / n, max(weight), sum(weight) / n, len({w for w, h in zip(words, hit, strict=True) if h}), sum(second) / n, 1 / (1 + min(apart)) if apart else 0.0,
        sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ" for c in text) / len(text), text.count("!") / n, text.count("?") / n, sum(re.match(r"[^\w\s]", c) is not None for c in text) / len(text),
        len(toxicity._OBFUSCATED.findall(text)) / n, len(toxicity._REPEATED.findall(text)) / n,
    ]


def test_features_equal_a_plain_version(spark, odd_dir):
    lexicon = {"=idiot": 3.0, "the": 0.5, "=clown": 2.0, "pathe": 1.5, "los": 1.0}
    for folder in (odd_dir, "/root/testdata/sf0.001"):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("text")
        rows = toxicity.with_features(docs.withColumn("kept", F.col("text")), lexicon).collect()
        assert all(np.allclose(r["features"].toArray(), plain_features(r["kept"] or "", lexicon)) for r in rows) and rows


def test_features():
    of = toxicity.Features({"=idiot": 3.0, "mor": 1.0})
    named = lambda text: dict(zip(toxicity.FEATURES, of(text), strict=True))
    assert set(of("")) == set(of(" \n")) == {0.0}
    one = named("You are an IDIOT!! m0ron")
    assert one["hits"] == 2 and one["strongest"] == 3.0 and one["proximity"] == 0.25 and one["exclamations"] == 2 / 5
    assert named("i.d.i.o.t")["hits"] == 1 and named("i.d.i.o.t")["obfuscated"] > 0
    assert named("soooo")["repeated_letters"] == 1.0
