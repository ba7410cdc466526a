"""Runs of a text model that are stopped and go on; guards, names, ticks and lists."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import axes, lists
from plumbline.operators import ensemble, inference, reporting, sampling, summaries
from plumbline.plans.queries import QUERIES
from plumbline.schema import Role, from_struct


def test_a_stopped_run_keeps_the_answers_of_ended_parts(spark, tmp_path):
    asked, folder = spark.range(60).selectExpr("id AS row_index", "CAST(id AS STRING) AS prompt"), f"file://{tmp_path}/run"
    first = asked.where("row_index < 20")
    assert inference.resumed(first, lambda prompt: "old", ["old", "new"], folder, every=5).count() == 20
    found = inference.resumed(asked, lambda prompt: "new", ["old", "new"], folder, every=5)
    assert {r["row_index"]: r["predicted_class"] for r in found.collect()} == {i: "old" if i < 20 else "new" for i in range(60)}
    again = inference.resumed(first, lambda prompt: "none", ["old", "new"], folder, every=5)
    assert again.count() == 20 and again.where("predicted_class = 'old'").count() == 20


def shuffled(spark) -> int:
    """Bytes that the session's shuffles have written so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_a_run_shuffles_keys_and_short_fingerprints_once(spark, tmp_path):
    """Neither prompts nor whole fingerprints are shuffled by a first run, and one that finds all answers shuffles prompts once."""
    prompt = "concat(sha2(CAST(id AS STRING), 512), sha2(CAST(id + 1 AS STRING), 512))"  # 256 characters that don't compress well
    asked, folder = spark.range(30_000).selectExpr("id AS row_index", f"{prompt} AS prompt"), f"file://{tmp_path}/run"
    for most in (120, 500):
        before = shuffled(spark)
        inference.resumed(asked, lambda prompt: "a", ["a"], folder, every=10_000)
        assert shuffled(spark) - before < most * 30_000
    assert inference.answers_of(spark, folder, asked.schema["row_index"]).count() == 30_000


def test_every_run_has_a_folder_and_needs_classes(spark, tmp_path):
    asked = spark.range(4).selectExpr("id AS row_index", "CAST(id AS STRING) AS prompt")
    runs = {"one": asked, "two": asked.where("row_index < 2")}
    found = inference.run_all(runs, lambda prompt: "a", {"one": ["a"], "two": ["b"]}, f"file://{tmp_path}/all", every=3)
    assert {n: rows.where("response_valid").count() for n, rows in found.items()} == {"one": 4, "two": 0}
    with pytest.raises(ValueError, match="two"):
        inference.run_all(runs, None, {"one": ["a"]}, f"file://{tmp_path}/none")


def test_rows_without_class_or_key_are_refused(spark):
    rows = spark.createDataFrame([(1, "a"), (1, None), (None, "b")], "id int, kind string")
    with pytest.raises(ValueError, match="n_null_targets: 1; n_null_keys: 1; n_repeated_keys: 1"):
        sampling.guarded(rows, "kind", "id")
    assert sampling.guarded(rows.limit(1), "kind", "id").count() == 1
    assert sampling.target_faults(rows.limit(0), "kind", "id").first() == (0, 0, 0)


def test_timing_of_other_seeds_is_refused(spark):
    training = spark.createDataFrame([("c", 1, 2.0), ("c", 2, 4.0)], "name string, seed int, training_s double")
    inference_rows = training.select("name", "seed", *[F.lit(1.0).alias(m) for m in summaries.MEASURES[1:]])
    row = summaries.timing_table(training, inference_rows, ["name"]).first()
    assert (row["n_seeds"], row["training_s_mean"], row["inference_s_std"]) == (2, 3.0, 0.0) and row["training_s_std"] == pytest.approx(math.sqrt(2))
    with pytest.raises(Exception, match="not one to one in seed 2"):
        summaries.timing_table(training, inference_rows.where("seed = 1"), ["name"]).collect()


def test_names_are_stripped_and_stay_unique(spark):
    rows = spark.createDataFrame([(1, 2.0)], "classifier__depth int, macro_f1_mean double")
    assert reporting.stripped_names(rows, ["classifier__"], ["_mean"]).columns == ["depth", "macro_f1"]
    with pytest.raises(ValueError, match="not unique"):
        reporting.stripped_names(spark.createDataFrame([(1, 2)], "a_x int, x int"), ["a_"])
    nan = spark.createDataFrame([(float("nan"), 1.5), (None, float("inf"))], "a double, b double")
    assert [tuple(r) for r in reporting.restored_parameters(nan, ["a", "b"]).collect()] == [(None, 1.5), (None, float("inf"))]


def test_schemas_drop_and_gain_columns(spark):
    schema = from_struct(spark.createDataFrame([], "id bigint, x double, kind string").schema, {"id": Role.IDENTIFIER, "kind": Role.TARGET})
    assert schema.retained(["x"]) == ("id", "kind") and schema.retained(roles=[Role.PREDICTOR]) == ("x",)
    assert schema.extended(from_struct(spark.createDataFrame([], "y double, k string").schema, {"k": Role.TARGET}).feature("y")).labels == ("id", "x", "kind", "y")
    with pytest.raises(ValueError, match="z"):
        schema.retained(["z"])


def test_ticks_hold_the_ends_and_enough_between():
    assert axes.nice_step(0, 100, 5) == 25 and axes.nice_step(0, 10, 8, 5) == 1.5 and axes.nice_step(2, 2) == 1
    assert axes.linear_ticks(0, 10) == [0, 1.5, 3, 4.5, 6, 7.5, 9, 10] and axes.linear_ticks(4, 4) == [4]
    for low, high in ((-3.7, 12.1), (0.001, 0.0047), (5, 5.5), (-1e6, 2e7)):
        ticks = axes.linear_ticks(low, high)
        assert ticks == sorted(set(ticks)) and (ticks[0], ticks[-1]) == (low, high) and len(ticks) >= 7


def test_lists_of_metadata():
    assert lists.integers(["27", 3], "seeds") == [3, 27] and lists.strings(("a", "a"), "names") == {"a"}
    assert lists.header_names([" Source  port ", "x"]) == ["Source port", "x"]
    for bad in ([True], [1.5], "12"):
        with pytest.raises(TypeError):
            lists.integers(bad, "seeds")
    for call in (lambda: lists.integers(["x"], "seeds"), lambda: lists.strings([1], "names"), lambda: lists.header_names(["a b", "a  b"]), lambda: lists.header_names([" "])):
        with pytest.raises(ValueError):
            call()


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_votes_and_their_rows_are_not_broadcast(spark):
    """Both sides of the join have a row for each key, so neither goes through the driver, however small it is estimated."""
    rows = spark.createDataFrame([(i, f"c{c}", "a", "ab"[i % 2], [0.5, 0.5]) for i in range(4) for c in range(2)], "id int, classifier string, actual_class string, predicted_class string, probabilities array<double>")
    found = ensemble.corrections(ensemble.votes(rows, ["id"], ["a", "b"], {"c0": 0.5, "c1": 0.5}), rows, [], ["id"])
    assert {(r["n"], r["right_where_any_wrong"]) for r in found.collect()} == {(4, 0), (4, 2)}
    assert "isFinalPlan=true" in plan(found) and "Broadcast" not in plan(found)  # the plan that ran, which adaptive execution may have changed


def test_rows_in_another_order_are_dealt_to_as_many_tasks_as_they_need(spark):
    assert "REPARTITION_BY_NUM" not in plan(QUERIES["exp_7_changed_rows"](spark, "/root/testdata/sf0.001"))


def test_alignment_reads_each_prediction_once(spark):
    """Counts of distinct values don't repeat the rows, and missing values aren't counted."""
    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (2, "a", "y"), (3, "a", None), (3, "b", None)], "id int, classifier string, actual_class string")
    found = ensemble.aligned(rows, ["id"], 2)
    assert "Expand" not in plan(found) and sorted(map(tuple, found.collect())) == [(2, 2, 1, 2), (3, 2, 2, 0)]
