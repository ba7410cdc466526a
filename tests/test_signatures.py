"""Digests of rows, runs that are refused or start anew, micro-batches that are asked once, and pipelines in one folder."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from plumbline.operators import experiment, inference, lifecycle, pipeline, signatures
from plumbline.operators.signatures import ChangedRun, digest
from plumbline.sources.paths import exists, names

ROOT = Path(__file__).resolve().parent.parent
GRID = {"max_depth": [2], "sampler": ["none"]}
ARGS = (["x", "b"], ["c"], "kind", "id")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(240).selectExpr("id", "cast(id % 17 as double) as x", "cast(id % 5 as double) as b", "concat('c', id % 3) as c", "case when id % 17 < 8 then 'low' when id % 3 = 0 then 'mid' else 'top' end as kind").cache()


def test_order_and_partitions_do_not_count(spark, rows):
    own = digest(rows)
    assert len(own) == 64 and own == digest(rows.repartition(7)) == digest(rows.orderBy(F.desc("x"))) == digest(rows.select("kind", "c", "b", "x", "id"))


def test_every_change_counts(spark, rows):
    others = [
        rows.where("id <> 5"), rows.unionByName(rows.where("id = 5")), rows.withColumn("x", F.when(F.col("id") == 5, 0.25).otherwise(F.col("x"))),
        rows.withColumn("x", F.when(F.col("id") != 5, F.col("x"))), rows.withColumnRenamed("x", "y"), rows.withColumn("b", F.col("b").cast("float")),
        rows.selectExpr("id", "b as x", "x as b", "c", "kind"), rows.drop("b"), rows.limit(0), rows.unionByName(rows).unionByName(rows),
        rows.withColumn("c", F.when(F.col("id") == 0, F.lit("c1")).when(F.col("id") == 1, F.lit("c0")).otherwise(F.col("c"))),
    ]
    assert len({digest(rows), *map(digest, others)}) == len(others) + 1


def test_nulls_and_nested_values(spark):
    made = [spark.createDataFrame(r, "a int, b int, v array<int>, m map<string,int>") for r in ([(None, 1, [1, None], {"k": None})], [(1, None, [1, None], {"k": None})], [(None, 1, [1], {"k": None})], [(None, 1, [1, None], {})], [(None, 1, None, None)])]
    assert len({digest(m) for m in made}) == 5
    by = {r["a"]: r["digest"] for r in signatures.digests(made[0].unionByName(made[1]), ["a"]).collect()}
    assert len(set(by.values())) == 2
    with pytest.raises(ValueError, match="no z"):
        digest(made[0], ["a", "z"])


def test_a_changed_search_is_refused_or_starts_anew(spark, rows, tmp_path, monkeypatch):
    folder, fitted, fit = f"file://{tmp_path}/run", [], experiment.fit
    monkeypatch.setattr(experiment, "fit", lambda *a: (fitted.append(a), fit(*a))[1])

    def run(rows=rows, grid=GRID, **options):
        fitted.clear()
        lifecycle.cross_validated(rows, folder, "decision_tree", grid, *ARGS, **{"seeds": (1,), "k": 2} | options)
        return len(fitted)

    assert run() == 2 and run() == 0
    assert run(rows.withColumn("unused", F.lit(1)).repartition(3)) == 0
    one = rows.withColumn("x", F.when(F.col("id") == 5, 0.25).otherwise(F.col("x")))
    for change, word in (({"rows": one}, "rows"), ({"grid": {"max_depth": [3], "sampler": ["none"]}}, "grid"), ({"seeds": (2,)}, "seeds"), ({"k": 3}, "folds")):
        with pytest.raises(ChangedRun, match=f"other {word};"):
            run(**change)
    assert run(one, changed="restart") == 2 and run(one) == 0
    assert lifecycle.load_table(spark, folder, "folds").count() == 2
    with pytest.raises(ValueError, match="raise or restart"):
        run(changed="ask")


def test_results_without_a_signature_are_refused(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/old"
    lifecycle.append_table(spark.createDataFrame([("a", "{}")], lifecycle.TABLES["configurations"]), folder, "configurations")
    with pytest.raises(ChangedRun, match="configurations without a signature"):
        lifecycle.cross_validated(rows, folder, "decision_tree", GRID, *ARGS, seeds=(1,), k=2)


def test_a_stop_in_a_restart_keeps_the_old_signature(spark, rows, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/run"
    signatures.begin(spark, folder, "search", {"a": 1}, [])
    rows.write.parquet(f"{folder}/folds")
    monkeypatch.setattr(signatures, "delete", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        signatures.begin(spark, folder, "search", {"a": 2}, ["folds"], "restart")
    assert signatures.differences(spark, folder, "search", signatures.signature({"a": 1})) == []
    assert signatures.differences(spark, folder, "search", signatures.signature({"a": 2, "b": 1})) == ["a", "b"]


def test_a_changed_final_fit_is_refused_and_models_are_of_their_run(spark, rows, tmp_path):
    folder, train, test = f"file://{tmp_path}/final", rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")

    def run(train=train, test=test, depth=2, **options):
        return lifecycle.refitted(train, test, folder, "decision_tree", {"max_depth": depth, "sampler": "none"}, *ARGS, [1, 2], **options)

    assert run() == [1, 2] and run() == []
    for change, word in (({"train": train.where("id <> 5")}, "train"), ({"test": test.where("id <> 8")}, "test"), ({"depth": 3}, "parameters")):
        with pytest.raises(ChangedRun, match=word):
            run(**change)
    with pytest.raises(ChangedRun, match="parameters"):
        lifecycle.missing_timing(train, test, folder, "decision_tree", {"max_depth": 5, "sampler": "none"}, *ARGS, [1, 2])
    lifecycle.load_models(spark, folder, [1, 2])
    (tmp_path / "final/model-1.json").write_text((tmp_path / "final/model-2.json").read_text())
    (tmp_path / "final/.model-1.json.crc").unlink(missing_ok=True)
    with pytest.raises(ChangedRun, match="model-1"):
        lifecycle.load_models(spark, folder, [1, 2])
    assert run(depth=3, changed="restart") == [1, 2]
    spark.read.parquet(f"{folder}/predictions/seed=1").where("id <> 8").write.parquet(f"{folder}/part")
    spark.read.parquet(f"{folder}/part").write.mode("overwrite").parquet(f"{folder}/predictions/seed=1")
    with pytest.raises(ValueError, match="lacking: 1"):
        run(depth=3)


def asked_rows(spark, n=60):
    return spark.range(n).selectExpr("id AS row_index", "CAST(id AS STRING) AS prompt").repartition(4)


def test_a_killed_run_asks_no_committed_row_again(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/run", tmp_path / "calls"

    def model(prompt, stop=None, calls=str(calls)):
        import os

        with open(calls, "a") as log:
            log.write(prompt + "\n")
        if stop and len(open(calls).read().split()) >= stop:
            os.kill(os.getpid(), 9)
        return "a"

    asked, no = asked_rows(spark), {"model": "a"}
    with pytest.raises(Exception):  # noqa: B017  the worker dies again in each try of its task
        inference.resumed(asked, lambda prompt: model(prompt, 25), ["a"], folder, every=10, definition=no, in_flight=1)
    committed = {r["row_index"] for r in inference.answers_of(spark, folder, asked.schema["row_index"]).collect()}
    assert 10 <= len(committed) <= 25
    calls.unlink()
    found = inference.resumed(asked, model, ["a"], folder, every=10, definition=no)
    again = [int(c) for c in calls.read_text().split()]
    assert not committed & set(again) and len(again) == len(set(again)) == 60 - len(committed)
    assert found.count() == 60 and not exists(spark, f"{folder}/queue") and not exists(spark, f"{folder}/progress")
    assert found.groupBy("batch").count().agg(F.max("count")).first()[0] <= 10
    assert names(spark, f"{folder}/answers") == ["000000", "000001"]


def test_files_are_asked_side_by_side_and_ended_tasks_keep_their_answers(spark, tmp_path):
    """Of four files of ten rows, three wait until the first has begun, which waits for their answers to be written and dies."""
    folder, began = f"file://{tmp_path}/run", tmp_path / "began"

    def model(prompt, began=str(began), answers=str(tmp_path / "run/answers/000000")):
        import glob
        import os
        import time

        def wait(met):
            end = time.time() + 15
            while not met():
                if time.time() > end:
                    raise TimeoutError("the other tasks don't run")
                time.sleep(0.05)

        if prompt == "0":
            open(began, "w").close()
            try:
                wait(lambda: len(glob.glob(f"{answers}/*/part-*")) == 3)
            finally:
                os.kill(os.getpid(), 9)
        elif int(prompt) % 10 == 0:
            wait(lambda: os.path.exists(began))
        return "a"

    asked = spark.range(0, 40, 1, 4).selectExpr("id AS row_index", "CAST(id AS STRING) AS prompt")
    with pytest.raises(Exception):  # noqa: B017
        inference.resumed(asked, model, ["a"], folder, every=10)
    kept = inference.answers_of(spark, folder, asked.schema["row_index"])
    assert {r["row_index"] for r in kept.where("response_valid").collect()} == set(range(10, 40)) and kept.groupBy("batch").count().where("count > 10").isEmpty()
    found = inference.resumed(asked, lambda prompt: "b", ["a"], folder, every=10)
    assert {r["row_index"] for r in found.where("response_valid").collect()} == set(range(10, 40)) and found.count() == 40


def test_answers_count_under_their_fingerprint_alone(spark, tmp_path):
    folder, asked = f"file://{tmp_path}/run", asked_rows(spark, 20)

    def run(answer, asked=asked, classes=("old", "new"), **options):
        found = inference.resumed(asked, lambda prompt: answer, list(classes), folder, every=8, **options)
        return {r["row_index"]: r["predicted_class"] for r in found.collect()}

    assert set(run("old").values()) == {"old"} and set(run("new").values()) == {"old"}
    other = asked.withColumn("prompt", F.when(F.col("row_index") == 3, F.lit("x")).otherwise(F.col("prompt")))
    with pytest.raises(ChangedRun, match="answers of 1 rows"):
        run("new", other, changed="raise")
    assert run("new", other) == {i: "new" if i == 3 else "old" for i in range(20)}
    assert set(run("none", other, changed="raise").values()) == {"old", "new"}
    assert set(run("new", definition={"model": "b"}).values()) == {"new"}
    assert set(run("old", classes=("old",)).values()) == {"old"}
    assert set(run("none").values()) == {"old"}
    with pytest.raises(ValueError, match="ask or raise"):
        run("old", changed="restart")


def test_repeated_keys_are_refused(spark, tmp_path):
    asked = asked_rows(spark, 4)
    with pytest.raises(ValueError, match="repeated: 1"):
        inference.resumed(asked.unionByName(asked.where("row_index = 1")), lambda prompt: "a", ["a"], f"file://{tmp_path}/twice")


@pytest.mark.parametrize("kind,options", [("decision_tree", {"max_depth": 3, "min_samples_split": 20}), ("random_forest", {"n_estimators": 3}), ("boosted_trees", {"rounds": 3, "max_depth": 2})])
def test_a_pipeline_is_whole_in_one_folder(spark, rows, tmp_path, kind, options):
    odd = rows.withColumns({"x": F.when(F.col("id") % 11 != 0, F.col("x")), "c": F.when(F.col("id") % 7 != 0, F.col("c"))})
    model = pipeline.fitted(odd, kind, options | {"sampler": "oversample"}, *ARGS, 3)
    expected = sorted(pipeline.predictions(model, odd, "kind", "id").collect())
    assert sum(r["actual_class"] == r["predicted_class"] for r in expected) > 120 and all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in expected)
    path = f"{tmp_path}/{kind}"
    model.write().save(path)
    again = PipelineModel.load(path)
    assert sorted(pipeline.predictions(again, odd, "kind", "id").collect()) == expected
    assert pipeline.classes_of(again) == ["low", "mid", "top"] and [n for n, _, _ in pipeline.importances(again)] == ["x", "b", "c_c0", "c_c1", "c_c2"]
    assert again.transform(odd.drop("kind")).select("predicted_class").count() == 240
    stages = pipeline.unfitted(kind, options, *ARGS, 3)
    stages.write().save(f"{path}-unfitted")
    refit = Pipeline.load(f"{path}-unfitted").fit(odd)
    assert refit.stages[0].classes == ["low", "mid", "top"]


def test_a_new_session_loads_it(spark, rows, tmp_path):
    model = pipeline.fitted(rows, "boosted_trees", {"rounds": 2, "max_depth": 2, "sampler": "none"}, *ARGS, 3)
    model.write().save(f"{tmp_path}/model")
    rows.write.parquet(f"{tmp_path}/rows")
    code = f"""
from pyspark.ml import PipelineModel
from plumbline.session import local_session
from plumbline.operators import pipeline
spark = local_session("2", 2)
rows = spark.read.parquet("{tmp_path}/rows")
pipeline.predictions(PipelineModel.load("{tmp_path}/model"), rows, "kind", "id").write.parquet("{tmp_path}/found")
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    assert sorted(spark.read.parquet(f"{tmp_path}/found").collect()) == sorted(pipeline.predictions(model, rows, "kind", "id").collect())
