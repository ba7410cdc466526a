"""Runs that are stopped and go on; models, timing, frozen tests and committees from what runs wrote."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import artifacts, experiment, lifecycle

GRID = {"max_depth": [2, 3], "min_samples_leaf": [2], "sampler": ["none"]}
ARGS = ("decision_tree", GRID, ["x", "b"], ["c"], "kind", "id")
FIT = ("decision_tree", {"max_depth": 3, "min_samples_leaf": 2, "sampler": "none"}, ["x", "b"], ["c"], "kind", "id", [1, 2])


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(240).selectExpr("id", "cast(id % 17 as double) as x", "cast(id % 5 as double) as b", "concat('c', id % 3) as c", "case when id % 17 < 8 then 'low' when id % 3 = 0 then 'mid' else 'top' end as kind")
    return made.cache()


def test_a_stopped_run_goes_on(spark, rows, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/run"
    fitted, fit = [], experiment.fit

    def stops(part, kind, parameters, seed, target, key):
        if len(fitted) == 3:
            raise KeyboardInterrupt
        fitted.append(parameters)
        return fit(part, kind, parameters, seed, target, key)

    monkeypatch.setattr(experiment, "fit", stops)
    with pytest.raises(KeyboardInterrupt):
        lifecycle.cross_validated(rows, folder, *ARGS, seeds=(1,), k=2, parallel=1)
    assert lifecycle.load_table(spark, folder, "folds").count() == 2  # the fold that had ended
    fitted.clear()
    monkeypatch.setattr(experiment, "fit", lambda *a: (fitted.append(a), fit(*a))[1])
    found = lifecycle.cross_validated(rows, folder, *ARGS, seeds=(1,), k=2, parallel=1)
    assert found.count() == 4 and len(fitted) == 2
    whole = experiment.cross_validate(rows, *ARGS, seeds=(1,), k=2)
    key = lambda r: (r["configuration_id"], r["seed"], r["fold"])
    assert {key(r): round(r["macro_f1"], 9) for r in found.collect()} == {key(r): round(r["macro_f1"], 9) for r in whole.collect()}
    fitted.clear()
    lifecycle.cross_validated(rows, folder, *ARGS, seeds=(1,), k=2)
    assert fitted == []
    best = lifecycle.best_parameters(spark, folder)
    assert best in experiment.expand(GRID) and 0 < lifecycle.mean_validation(spark, folder) <= 1


def test_models_are_kept_and_tested_without_fitting(spark, rows, tmp_path):
    folder, train, test = f"file://{tmp_path}/final", rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    assert lifecycle.refitted(train, test, folder, *FIT) == [1, 2] and lifecycle.refitted(train, test, folder, *FIT) == []
    assert sorted(r["seed"] for r in lifecycle.load_table(spark, folder, "timing").collect()) == [1, 2]
    predicted, found = lifecycle.frozen_test(test, folder, "kind", "id", [1, 2])
    stored = spark.read.parquet(f"{folder}/predictions")
    assert predicted.count() == stored.count() == 2 * test.count()
    assert predicted.join(stored.select("seed", "id", F.col("predicted_class").alias("p")), ["seed", "id"]).where("p <> predicted_class").count() == 0
    assert {r["seed"] for r in found.collect()} == {1, 2} and found.where("accuracy > 0.8").count() == 2
    with pytest.raises(FileNotFoundError, match="3"):
        lifecycle.load_models(spark, folder, [1, 3])


def test_only_missing_timing_is_filled(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/timing"
    lifecycle.append_table(spark.createDataFrame([(1, 0.5, 0.25, 0.125)], lifecycle.TIMING), folder, "timing")
    assert lifecycle.missing_timing(rows, rows, folder, *FIT) == [2] and lifecycle.missing_timing(rows, rows, folder, *FIT) == []
    assert {r["seed"]: r["fit_seconds"] for r in lifecycle.load_table(spark, folder, "timing").collect()}[1] == 0.5


def test_tables_of_other_columns_are_refused(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/run/folds")
    with pytest.raises(ValueError, match="has the columns"):
        lifecycle.load_table(spark, f"file://{tmp_path}/run", "folds")


def test_a_nested_checkpoint_becomes_rows():
    one, two = ({m: v for m in experiment.METRICS} for v in (0.25, 0.5))
    assert [r[:4] for r in lifecycle.flattened({"b": {"32": [one]}, "a": {"59": [two], "27": [one, two]}})] == [("a", 27, 1, 0.25), ("a", 27, 2, 0.5), ("a", 59, 1, 0.5), ("b", 32, 1, 0.25)]


def test_a_committee_reads_only_what_runs_wrote(spark, rows, tmp_path, monkeypatch):
    folders, train, test = {}, rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    for name, depth in (("deep", 3), ("flat", 1)):
        folders[name] = folder = f"file://{tmp_path}/{name}"
        lifecycle.cross_validated(train, folder, "decision_tree", {"max_depth": [depth], "sampler": ["none"]}, ["x", "b"], ["c"], "kind", "id", seeds=(1,), k=2)
        lifecycle.refitted(train, test, folder, "decision_tree", {"max_depth": depth, "sampler": "none"}, ["x", "b"], ["c"], "kind", "id", [1])
    monkeypatch.setattr(experiment, "fit", None)
    found = lifecycle.committee(spark, folders, ["low", "mid", "top"], "id")
    assert sum(r["weight"] for r in found["weights"].collect()) == pytest.approx(1)
    artifacts.faultless(artifacts.weight_faults(found["weights"].withColumn("all", F.lit(1)), ["all"], ["deep", "flat"], "value"))
    assert found["votes"].count() == 4 * test.count() and found["seeds"].count() == found["summary"].count() == 4
    assert all(0 <= r[m] <= 1 for r in found["seeds"].collect() for m in ("roc_auc", "pr_auc", "accuracy"))
    assert [(r["classifier_a"], r["classifier_b"], r["n"]) for r in found["diversity"].collect()] == [("deep", "flat", test.count())]
    assert found["corrections"].count() == found["corrected"].count() == 4 and found["pairs"].count() == 1
    spark.read.parquet(f"{folders['flat']}/predictions").where("id <> 8").drop("seed").write.mode("overwrite").parquet(f"{folders['flat']}/part")
    spark.read.parquet(f"{folders['flat']}/part").write.mode("overwrite").parquet(f"{folders['flat']}/predictions/seed=1")
    with pytest.raises(ValueError, match="1 rows aren't predicted once by each of deep, flat"):
        lifecycle.committee(spark, folders, ["low", "mid", "top"], "id")


def test_faults_are_raised(spark):
    rows = spark.createDataFrame([(27, "f", 0.5), (27, "f", -1.0)], "seed int, transformed_feature string, importance double")
    with pytest.raises(ValueError, match="numbers: 1; repeated: 1"):
        artifacts.faultless(artifacts.importance_faults(rows, [27]))
    artifacts.faultless(artifacts.importance_faults(rows.limit(1).where("importance > 0"), [27]))
