"""Boosted trees against a plain version that splits lists of rows, and their guards, draws and files."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plumbline.operators import boosting, experiment
from plumbline.operators.boosting import UNIT, BoostedTrees, BoostedTreesModel


def table(spark, n=300):
    """Three classes that two of three features decide, with some wrong labels."""
    rows = []
    for i in range(n):
        x, y, z = (i * 37 % 101) / 10.0, float(i * 13 % 7), float(i % 2)
        label = 0 if x < 3 else 1 if y < 3 else 2
        rows.append((i, x, y, z, float((label + 1) % 3 if i % 17 == 0 else label)))
    made = spark.createDataFrame(rows, "id long, x double, y double, z double, label double")
    return VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(made), rows


def plain(rows, draws, o):
    """The same trees from lists of rows, one node after the other: nested (feature, threshold, left, right) or values."""
    xs, labels = [r[1:4] for r in rows], [int(r[4]) for r in rows]
    k, scores = max(labels) + 1, [[0.0] * (max(labels) + 1) for _ in rows]
    cuts = [sorted(set(x[f] for x in xs))[:-1] for f in range(3)]
    trees = []
    for number in range(o["rounds"]):
        chosen = boosting.uniform(draws, o.get("seed", 0), number) < o.get("subsample", 1.0)
        g, h = boosting.gradients(np.array(scores).T, np.array(labels))
        added = []
        for c in range(k):

            def node(rows_in, depth, c=c, g=g, h=h):
                drawn = [i for i in rows_in if chosen[i]]
                sg, sh = sum(int(g[c][i]) for i in drawn), sum(int(h[c][i]) for i in drawn)
                value = -o["rate"] * (sg / UNIT) / (sh / UNIT + 1.0)
                best = (1e-6, None)
                if depth < o["maxDepth"] and len(drawn) >= o.get("minSamplesSplit", 2):
                    for f in range(3):
                        for cut in cuts[f]:
                            left = [i for i in drawn if xs[i][f] <= cut]
                            gl, hl = sum(int(g[c][i]) for i in left), sum(int(h[c][i]) for i in left)
                            sides = ((gl / UNIT, hl / UNIT, len(left)), ((sg - gl) / UNIT, (sh - hl) / UNIT, len(drawn) - len(left)))
                            if any(b < o.get("minChildWeight", 1.0) or n < max(1, o.get("minSamplesLeaf", 1)) for _, b, n in sides):
                                continue
                            gain = (sum(a**2 / (b + 1.0) for a, b, _ in sides) - (sg / UNIT) ** 2 / (sh / UNIT + 1.0)) / 2
                            if gain > best[0]:
                                best = (gain, (f, cut))
                if best[1] is None:
                    return value
                f, cut = best[1]
                return f, cut, node([i for i in rows_in if xs[i][f] <= cut], depth + 1), node([i for i in rows_in if xs[i][f] > cut], depth + 1)

            added.append(node(range(len(rows)), 0))
        trees.append(added)
        for i, x in enumerate(xs):
            for c in range(k):
                scores[i][c] += value_of(added[c], x)
    return trees


def value_of(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def nested(tree, at=0):
    if tree.feature[at] < 0:
        return tree.value[at]
    return tree.feature[at], tree.cut[at], nested(tree, tree.left[at]), nested(tree, tree.left[at] + 1)


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


OPTIONS = [
    {"rounds": 3, "maxDepth": 3, "rate": 0.3},
    {"rounds": 2, "maxDepth": 4, "rate": 0.1, "minChildWeight": 5.0},
    {"rounds": 2, "maxDepth": 4, "rate": 0.1, "minSamplesSplit": 40, "minSamplesLeaf": 7},
    {"rounds": 3, "maxDepth": 2, "rate": 0.05, "subsample": 0.6, "seed": 5},
]


@pytest.mark.parametrize("options", OPTIONS)
def test_trees_are_those_of_the_plain_version(spark, options):
    rows, plain_rows = table(spark)
    draws = np.array([r[0] for r in rows.orderBy("id").select(F.xxhash64("id")).collect()])
    model = BoostedTrees(**options).fit(rows.repartition(3))
    theirs = plain(plain_rows, draws, options)
    assert len(model.trees) == options["rounds"]
    for mine, other in zip(model.trees, theirs, strict=True):
        assert all(same(nested(a), b) for a, b in zip(mine, other, strict=True))
    found = {r["id"]: r for r in model.transform(rows).select("id", "probability", "prediction").collect()}
    for i, r in enumerate(plain_rows):
        scores = [sum(value_of(group[c], r[1:4]) for group in theirs) for c in range(3)]
        powers = [math.exp(s) for s in scores]
        assert found[i]["probability"].toArray() == pytest.approx([p / sum(powers) for p in powers])
        assert found[i]["prediction"] == scores.index(max(scores))


def test_partitions_blocks_and_passes_change_nothing(spark, monkeypatch):
    rows, _ = table(spark)
    whole = BoostedTrees(rounds=4, maxDepth=3, subsample=0.7).fit(rows.coalesce(1))
    monkeypatch.setattr(boosting, "BLOCK", 11)
    monkeypatch.setattr(boosting, "MANY_TASKS", 2)
    monkeypatch.setattr(boosting, "MOST_CELLS", 700)  # a few nodes a pass
    monkeypatch.setattr(boosting, "CUT_ROUNDS", 2)
    parts = BoostedTrees(rounds=4, maxDepth=3, subsample=0.7).fit(rows.repartition(5))
    assert parts.trees == whole.trees


def test_guards_hold(spark):
    rows, _ = table(spark)
    few = BoostedTrees(rounds=1, maxDepth=6, minSamplesLeaf=60).fit(rows)
    columns = np.array([r["features"].toArray() for r in rows.collect()]).T
    for tree in few.trees[0]:
        ended = np.bincount(tree.nodes_of(columns), minlength=len(tree.feature))
        assert min(n for n, f in zip(ended, tree.feature, strict=True) if f < 0) >= 60
    assert [t.feature for t in BoostedTrees(rounds=1, minSamplesSplit=301).fit(rows).trees[0]] == [[-1]] * 3
    assert [t.feature for t in BoostedTrees(rounds=1, maxDepth=0).fit(rows).trees[0]] == [[-1]] * 3


def test_learns_and_is_saved(spark, tmp_path):
    rows, _ = table(spark, 600)
    model = BoostedTrees(rounds=12, maxDepth=3, rate=0.3).fit(rows)
    scored = model.transform(rows)
    assert scored.where("prediction = label").count() > 540
    assert sum(model.featureImportances.toArray()) == pytest.approx(1) and model.featureImportances[2] < 0.1
    model.write().overwrite().save(f"{tmp_path}/model")
    again = BoostedTreesModel.load(f"{tmp_path}/model")
    assert again.trees == model.trees and again.uid == model.uid
    assert again.transform(rows.limit(0)).collect() == []


def test_many_bins_and_wrong_rows(spark):
    made = spark.range(2000).selectExpr("id", "cast(id as double) as x", "cast(id % 3 = 0 as double) as label")
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(made)
    model = BoostedTrees(rounds=1, maxDepth=2, maxBins=1000).fit(rows)
    assert all(f in (-1, 0) for t in model.trees[0] for f in t.feature)
    with pytest.raises(ValueError, match="no rows"):
        BoostedTrees().fit(rows.limit(0))
    with pytest.raises(ValueError, match="no label"):
        BoostedTrees().fit(rows.withColumn("label", F.when(F.col("id") > 3, F.col("label"))))


def pruned(nodes, least, at=0):
    """A tree of Spark's rows whose nodes of fewer rows than least are leaves."""
    node = nodes[at]
    if node["leftChild"] < 0 or node["rawCount"] < least:
        return list(node["impurityStats"])
    return node["split"]["featureIndex"], tuple(node["split"]["leftCategoriesOrThreshold"]), pruned(nodes, least, node["leftChild"]), pruned(nodes, least, node["rightChild"])


@pytest.mark.parametrize("kind", ["decision_tree", "random_forest"])
def test_a_guard_of_nodes_leaves_small_ones_out(spark, tmp_path, kind):
    rows, _ = table(spark)
    options = {"max_depth": 6} | ({"n_estimators": 3} if kind == "random_forest" else {})
    trees = {}
    for least in (2, 50):
        model = experiment.fit_classifier(rows, kind, options | {"min_samples_split": least}, 3, "id")
        model.write().save(f"{tmp_path}/{kind}-{least}")
        held = spark.read.parquet(f"{tmp_path}/{kind}-{least}/data")
        held = held.select("treeID", "nodeData.*") if kind == "random_forest" else held.withColumn("treeID", F.lit(0))
        for r in held.collect():
            trees.setdefault(least, {}).setdefault(r["treeID"], {})[r["id"]] = r
        assert model.transform(rows).where("prediction is not null").count() == 300
    assert trees[2].keys() == trees[50].keys()
    for t in trees[2]:
        assert pruned(trees[2][t], 50) == pruned(trees[50][t], 0)
        assert any(n["leftChild"] >= 0 and n["rawCount"] < 50 for n in trees[2][t].values())


def test_grids_are_whole():
    assert [len(experiment.expand(g)) for g in experiment.GRIDS.values()] == [72, 72, 64]
    for kind, grid in experiment.GRIDS.items():
        for parameters in experiment.expand(grid):
            experiment.estimator(kind, parameters, 1)
    with pytest.raises(ValueError, match="min_child_weight"):
        experiment.estimator("decision_tree", {"min_child_weight": 1}, 1)
