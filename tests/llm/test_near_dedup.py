import math
import os
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bags, near_dedup
from plumbline.llm import components as components_module
from plumbline.llm.common import read
from plumbline.llm.components import components
from plumbline.llm.shingles import shingles


def brute_bags(texts: dict) -> dict:
    """(shingles, weights) of each text with words: times * (1 + ln(N / df)), df by one counter over all texts."""
    found = {i: shingles([" ".join(re.findall(r"[^\x20\x09-\x0D]+", t.lower()))])[1:] for i, t in texts.items() if t and re.search(r"[^\x20\x09-\x0D]", t)}
    df = Counter(h for hashes, _ in found.values() for h in hashes.tolist())
    return {i: (hashes, times * np.array([1 + math.log(len(texts) / df[h]) for h in hashes.tolist()])) for i, (hashes, times) in found.items()}


def alike(one: tuple, two: tuple) -> float:
    return bags.similarity(one, two, one[1].sum(), two[1].sum())


def brute_classes(texts: dict) -> dict:
    """Smallest id of the component of each text with words, every pair compared."""
    found = brute_bags(texts)
    ids = sorted(found)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if alike(found[i], found[j]) >= near_dedup.THRESHOLD:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def varied(words: int, seed: int) -> list[str]:
    return [f"w{v}" for v in np.random.Generator(np.random.PCG64(seed)).integers(0, 500, words)]


def groups() -> dict[int, str]:
    """Chains and stars of edited copies, exact copies, unrelated and short texts."""
    out, at = {}, 0
    for seed in range(6):
        base = varied(120, seed)
        for copies in range(9):
            words = list(base)
            for k in range(copies):
                words[(13 * k + 7 * seed) % 120] = f"edit{seed}_{copies}_{k}"
            out[at] = " ".join(words)
            at += 1
        out[at] = out[at - 9].upper().replace(" ", "\n")
        at += 1
    for seed in range(100, 140):
        out[at] = " ".join(varied(60, seed))
        at += 1
    return out | {at: "too short", at + 1: "too  short", at + 2: "", at + 3: None}


def test_classes_equal_brute_force(spark, tmp_path):
    texts = groups()
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in near_dedup.op2_near_dedup(spark, str(tmp_path)).collect()}
    expected = brute_classes(texts)
    assert len(found) == len(texts)
    assert {i: found[i]["class_id"] for i in expected} == expected
    assert all(found[i]["class_id"] == i and found[i]["kept"] for i in texts if i not in expected)
    assert {i for i in expected if found[i]["kept"]} == set(expected.values())


@pytest.mark.parametrize(("growth", "broadcast"), [(2, 0), (1024, 16 << 20)])
def test_a_bucket_of_several_components_is_searched_to_the_end(spark, monkeypatch, growth, broadcast):
    """With one sample for a band, unrelated texts share buckets, and links between nodes that are no centre must be found."""
    monkeypatch.setattr(near_dedup, "GROWTH", growth)
    monkeypatch.setattr(near_dedup, "BROADCAST_BYTES", broadcast)
    texts = groups()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows, nodes = near_dedup.classes(docs, bands=30, rows=1)
    found = {r["first"]["doc_id"]: r["class_first"]["doc_id"] for r in rows.join(nodes, "digest").collect()}
    assert found == brute_classes(texts)


def test_filter_keeps_one_row_of_each_class(spark):
    story = " ".join(varied(80, 1))
    other = " ".join(varied(80, 2))
    rows = [(3, story, "x"), (1, story.replace("w", "W", 1), "y"), (7, other, "x"), (7, other, "x"), (None, other, "x"), (8, None, "x"), (8, None, "x"), (9, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["digest"]) for r in kept.collect()) == [(1, "y"), (7, "x"), (8, "x"), (8, "x"), (9, "z")]


def test_samples_agree_as_often_as_texts_are_similar():
    base = varied(400, 5)
    changed = list(base)
    changed[100:140] = [f"new{i}" for i in range(40)]
    of, hashes, times = shingles([" ".join(base), " ".join(changed)])
    weight = times * (1 + hashes % np.uint64(3)).astype(float)
    starts = np.array([0, np.searchsorted(of, 1)])
    drawn = near_dedup.samples(hashes, weight, starts, 2000)
    exact = alike((hashes[: starts[1]], weight[: starts[1]]), (hashes[starts[1] :], weight[starts[1] :]))
    assert abs((drawn[0] == drawn[1]).mean() - exact) < 0.04


@pytest.mark.parametrize(("block", "bucket"), [(1 << 20, 1 << 24), (500, 300)])
def test_frequencies_are_those_of_one_counter(spark, monkeypatch, block, bucket):
    """Every bag has the weights that a plain count gives, however texts and hashes are dealt, with a text of a third of all rows."""
    monkeypatch.setattr(bags, "BLOCK_CHARS", block)
    monkeypatch.setattr(bags, "BUCKET_CHARS", bucket)
    texts = {i: t for i, t in groups().items() if t}
    often = texts[0]
    texts |= {1000 + i: often for i in range(50)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).select(near_dedup.text_digest(F.col("text")).alias("digest"), "text")
    heavy = {bytes(rows.where(F.col("text") == often).first()["digest"]): sum(t.lower().split() == often.lower().split() for t in texts.values())}
    found = bags.bags(rows, len(texts), sum(map(len, texts.values())), heavy, near_dedup.signer(2, 1), 0.0).collect()
    by_text = {" ".join(t.lower().split()): b for t, b in ((texts[i], b) for i, b in brute_bags(texts).items())}
    digests = {bytes(r["digest"]): " ".join(r["text"].lower().split()) for r in rows.collect()}
    df = Counter(h for hashes, _ in by_text.values() for h in hashes.tolist())  # texts, not rows
    assert len(found) == sum(any(df[h] > 1 for h in hashes.tolist()) for hashes, _ in by_text.values())
    for row in found:
        hashes, weight = by_text[digests[bytes(row["digest"])]]
        shared = np.array([df[h] > 1 for h in hashes.tolist()], bool)
        mine = bags.bag(row.asDict(), len(texts))
        assert mine[0].tolist() == hashes[shared].tolist() and np.allclose(mine[1], weight[shared], rtol=1e-12)
        assert math.isclose(row["weight"], weight.sum(), rel_tol=1e-9) and len(row["runs"]) == len(mine[0]) and len(row["signature"]) == 2


def test_buckets_cost_what_the_hashes_cost():
    """A block's hashes are dealt to 2^25 buckets, those of 100 TB, in little more time than to a thousand."""
    hashes = np.sort(np.random.default_rng(3).integers(0, 1 << 48, 170_000, dtype=np.uint64))
    for bits in (0, 10, 25):
        began = time.perf_counter()
        parts = list(bags.parts_of(hashes, bits))
        assert time.perf_counter() - began < 0.5
        assert [b for b, _ in parts] == sorted({h >> (48 - bits) for h in hashes.tolist()})
        assert parts[0][1].start == 0 and parts[-1][1].stop == len(hashes) and all(a.stop == b.start for (_, a), (_, b) in zip(parts, parts[1:], strict=False))
        assert all((hashes[p] >> np.uint64(48 - bits) == b).all() for b, p in parts[:50])
    assert list(bags.parts_of(hashes[:0], 5)) == []


def test_recall_on_planted_near_copies(spark):
    """Two thousand texts and a near copy of each, of one to six other words in 300: of the pairs that reach 0.8, 99 in 100 are found."""
    draw = np.random.default_rng(11)
    words, texts = np.array([f"w{i}" for i in range(5_000)]), {}
    for i in range(2_000):
        own = words[draw.integers(0, len(words), 300)].tolist()
        near = list(own)
        for at in draw.choice(300, 1 + i % 6, replace=False):
            near[at] = f"other{i}x{at}"
        texts[2 * i], texts[2 * i + 1] = " ".join(own), " ".join(near)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    rows, nodes = near_dedup.classes(docs)
    found = {r["first"]["doc_id"]: r["class_first"]["doc_id"] for r in rows.join(nodes, "digest").collect()}
    held = brute_bags(texts)
    pairs = [i for i in range(0, 4_000, 2) if alike(held[i], held[i + 1]) >= near_dedup.THRESHOLD]
    assert len(pairs) > 800
    assert sum(found[i] == found[i + 1] for i in pairs) >= 0.99 * len(pairs)
    assert all(found[i] in (i, i - i % 2) for i in found)


def test_near_copies_in_a_group_meet_however_large_the_table_is(spark):
    """Twenty copies of a text of 300 words, six of them others in each, among 20,000 texts: a plain similarity of 0.82 each with the text."""
    draw = np.random.default_rng(5)
    texts = {i: " ".join(f"w{v}" for v in draw.integers(0, 50_000, 8)) for i in range(100, 20_000)}
    texts[0] = " ".join(varied(300, 77))
    for i in range(1, 20):
        words = texts[0].split()
        for at in range(6):
            words[10 + 50 * at + i] = f"other{i}x{at}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    rows, nodes = near_dedup.classes(docs)
    found = {r["first"]["doc_id"]: r["class_first"]["doc_id"] for r in rows.join(nodes, "digest").collect()}
    assert [found[i] for i in range(20)] == [0] * 20
    assert all(found[i] == i for i in range(100, 20_000))


def test_packed_numbers_come_back():
    values = np.array([0, 1, 255, 256, (1 << 48) - 1, 123456789012], np.uint64)
    assert bags.unpacked(bags.packed(values)).tolist() == values.tolist() and bags.unpacked(b"").tolist() == []


def test_recall_on_a_driver_table(spark):
    """All pairs of sf0.01 that share a shingle: 95 of 100 at the threshold lie in one class, and no class is larger than their component."""
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in read(spark, folder, "documents").collect()}
    found, holders, common = brute_bags(texts), {}, Counter()
    for i, (hashes, weight) in found.items():
        for h, w in zip(hashes.tolist(), weight.tolist(), strict=True):
            holders.setdefault(h, []).append((i, w))
    for held in holders.values():
        for n, (i, w) in enumerate(held):
            for j, v in held[:n]:
                common[i, j] += min(w, v)
    total = {i: weight.sum() for i, (_, weight) in found.items()}
    pairs = [p for p, c in common.items() if c >= near_dedup.THRESHOLD * (total[p[0]] + total[p[1]] - c)]
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.op2_near_dedup(spark, folder).collect()}
    assert len(classes) == len(texts) and len(pairs) > 50
    assert sum(classes[i] == classes[j] for i, j in pairs) >= 0.95 * len(pairs)
    root = {i: i for i in texts}
    for i, j in sorted(pairs):
        a, b = root[i], root[j]
        root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert all(root[i] == root[c] for i, c in classes.items())


def test_only_tables_that_the_result_reads_are_left(spark, tmp_path):
    texts = groups()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    rows, nodes = near_dedup.classes(docs)
    left = {n for n in os.listdir(folder) if n.startswith("cut-")} - before
    read_by = {f.split("/cut-")[1].split("/")[0] for df in (rows, nodes) for f in df.inputFiles() if "/cut-" in f}
    assert {n.removeprefix("cut-") for n in left} == read_by


def test_shingles_of_few_and_many_words():
    of, hashes, times = shingles(["", "a b", "A  b", "a b c d e", "a b c d e a b c d e", " "])
    by = {t: hashes[of == t].tolist() for t in range(6)}
    assert by[0] == by[5] == [] and by[1] == by[2] and len(by[3]) == 1 and len(by[4]) == 5
    assert dict(zip(by[4], times[of == 4].tolist(), strict=True))[by[3][0]] == 2
    assert shingles([])[0].size == 0


@pytest.mark.parametrize("small", [0, 50_000])
def test_components_of_chains_and_stars(spark, monkeypatch, small):
    monkeypatch.setattr(components_module, "SMALL", small)
    edges = [(str(i), str(i + 1)) for i in range(10, 40)] + [("99", str(i)) for i in range(50, 80)] + [("a", "a"), ("b", "c"), ("b", "c")]
    frame = spark.createDataFrame([(u.encode(), v.encode()) for u, v in edges], "u binary, v binary")
    roots = {bytes(r["node"]).decode(): bytes(r["root"]).decode() for r in components(frame).collect()}
    assert roots == {str(i): "10" for i in range(10, 41)} | {str(i): "50" for i in [*range(50, 80), 99]} | {"b": "b", "c": "b"}
