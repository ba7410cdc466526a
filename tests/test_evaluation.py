import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.operators import checks, ensemble, experiment, inference, metrics, pipeline, prepare, profile, sampling, summaries


def table(spark, matrix, classes):
    rows = [(a, p) for i, a in enumerate(classes) for j, p in enumerate(classes) for _ in range(matrix[i][j])]
    return spark.createDataFrame(rows, "actual_class string, predicted_class string")


def test_metrics_by_hand(spark):
    rows = table(spark, [[5, 1, 0], [2, 3, 1], [0, 0, 0]], "abc")
    m = metrics.summary_metrics(rows, []).first()
    f1 = [2 * 5 / (6 + 7), 2 * 3 / (6 + 4), 0.0]
    assert m["accuracy"] == pytest.approx(8 / 12) and m["macro_f1"] == pytest.approx(sum(f1) / 3) and m["balanced_accuracy"] == pytest.approx((5 / 6 + 3 / 6) / 2)
    t, p, c, s = [6, 6, 0], [7, 4, 1], 8, 12
    assert m["mcc"] == pytest.approx((c * s - sum(x * y for x, y in zip(t, p, strict=True))) / math.sqrt((s * s - sum(x * x for x in p)) * (s * s - sum(x * x for x in t))))
    one = metrics.summary_metrics(table(spark, [[3, 0], [0, 0]], "ab"), []).first()
    assert (one["accuracy"], one["mcc"]) == (1.0, 0.0)


def test_auc_with_ties_by_hand(spark):
    scores = [(1, True, 0.9), (1, False, 0.9), (1, True, 0.4), (1, False, 0.1), (2, True, 0.5)]
    frame = spark.createDataFrame(scores, "k int, positive boolean, score double")
    auc = {r["k"]: r["roc_auc"] for r in metrics.roc_auc(frame, ["k"]).collect()}
    assert auc[1] == pytest.approx((0.5 + 1 + 0 + 1) / 4) and auc[2] is None
    ap = {r["k"]: r["pr_auc"] for r in metrics.average_precision(frame, ["k"]).collect()}
    assert ap[1] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3) and ap[2] == 1.0


def test_votes_break_ties_by_probability_then_order(spark):
    rows = [(1, "c0", "a", "a", [0.6, 0.4]), (1, "c1", "a", "b", [0.1, 0.9]), (2, "c0", "a", "a", [0.5, 0.5]), (2, "c1", "a", "b", [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "row_index int, classifier string, actual_class string, predicted_class string, probabilities array<double>")
    got = {(r["row_index"], r["strategy"]): r["predicted_class"] for r in ensemble.votes(frame, ["row_index"], ["a", "b"], {"c0": 0.75, "c1": 0.25}).collect()}
    assert got[1, "hard_voting"] == "b" and got[1, "weighted_hard_voting"] == "a" and got[1, "soft_voting"] == "b"
    assert {got[2, s] for s in ensemble.STRATEGIES} == {"a"}


def test_probability_columns():
    assert ensemble.probability_classes(["seed", "probability_1_b_c", "probability_0_a"]) == ["a", "b_c"]
    for bad in (["x"], ["probability_1_a"], ["probability_0_a", "probability_1_a"]):
        with pytest.raises(ValueError, match="."):
            ensemble.probability_classes(bad)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=8), st.floats(0, 1))
def test_allocations(counts, share):
    total = sum(counts)
    size = max(len(counts), min(total, round(share * total)))
    taken = sampling.allocations([(f"k{i}", n) for i, n in enumerate(counts)], size)
    assert sum(taken.values()) == size and all(1 <= taken[f"k{i}"] <= n for i, n in enumerate(counts))


def test_sampling_contracts(spark):
    rows = spark.range(600).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'rare' WHEN id % 3 = 0 THEN 'some' ELSE 'most' END AS y")
    sizes = lambda frame: {r[0]: r[1] for r in frame.groupBy("y").count().collect()}
    split = sampling.stratified_split(rows, "y", 0.2, 27, "id").toPandas()
    assert (split["split"] == "test").sum() == 120 and split["id"].is_unique
    folded = sampling.folds(rows, "y", 3, 27, "id").toPandas().groupby(["y", "fold"]).size()
    assert all(folded[y].max() - folded[y].min() <= 1 for y in ("rare", "some", "most"))
    over = sampling.oversampled(rows, "y", 27, "id")
    assert len(set(sizes(over).values())) == 1 and over.where("copy = 0").count() == 600
    one, two, other = (sorted(r["id"] for r in sampling.stratified_sample(rows.repartition(n), "y", 50, s, "id").collect()) for n, s in ((1, 27), (5, 27), (1, 32)))
    assert one == two != other
    for size in (0, 601, 2):
        with pytest.raises(ValueError, match="sample"):
            sampling.stratified_sample(rows, "y", size, 27, "id")
    shots = sampling.few_shot(rows, "y", 2, 27, "id")
    assert [r["example"] for r in shots.orderBy("example").collect()] == [1, 2, 3, 4, 5, 6]
    assert sum(inference.check_examples(shots, rows, "y", 2, "id").first()) == 0
    assert inference.check_examples(shots.withColumn("example", shots["example"] + 1), rows, "y", 1, "id").first()["n_over_cap"] == 3


def test_preprocessing_ties_and_unknown(spark):
    train = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "b"), (4.0, "a"), (float("inf"), None)], "v double, c string")
    fitted = prepare.fit(train, ["v"], ["c"])
    assert fitted.medians == {"v": 2.5} and fitted.modes == {"c": "a"} and fitted.categories == {"c": ("a", "b")}
    out = fitted.transform(spark.createDataFrame([(None, "z"), (float("-inf"), None)], "v double, c string")).collect()
    assert [tuple(r) for r in out] == [(2.5, 0.0, 0.0), (2.5, 1.0, 0.0)]


def test_checks(spark):
    frame = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.7, 0.7), (2, None, 1.0)], "k int, p double, q double")
    assert frame.agg(checks.bad_probabilities(["p", "q"])).first()[0] == 2
    assert checks.repeated_keys(frame, ["k"]).collect()[0]["n"] == 2
    assert frame.agg(checks.expected_set("k", [1, 2])).first()[0] is False and frame.agg(checks.expected_set("k", [1])).first()[0] is True
    with pytest.raises(ValueError, match="too many"):
        checks.expect(frame, checks.Expectation("too many", checks.F.count("*") > 2), checks.Expectation("fine", checks.F.count("*") < 0))
    assert checks.unequal(frame.select("k", "q").limit(1), frame.select("k", "q").limit(1), ["k"], ["q"]).count() == 0
    with pytest.raises(ValueError, match="missing columns: z"):
        checks.require_columns(frame, ["k", "z"])


def test_one_to_one_join_raises(spark):
    one = spark.createDataFrame([(27, 0.5), (32, 0.6)], "seed int, f double")
    good = summaries.seed_comparison(one, one, ["f"]).collect()
    assert [r["f_drop"] for r in good] == [0.0, 0.0]
    for other in (one.limit(1), one.unionByName(one)):
        with pytest.raises(Exception, match="not one to one"):
            summaries.seed_comparison(one, other, ["f"]).collect()


def test_histogram_of_a_single_value_and_of_none(spark):
    frame = spark.createDataFrame([(4.0,), (4.0,), (float("nan"),), (None,)], "v double")
    rows = profile.histogram(frame, "v", 8).collect()
    assert [(r["low"], r["high"], r["n"]) for r in rows] == [(3.5, 4.5, 2)]
    assert profile.histogram(frame.where("false"), "v", 8).count() == 0


def test_experiment(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    rows = spark.createDataFrame([(i, float(v), "x" if i % 4 else "y", "high" if v > 0.6 else "low") for i, v in enumerate(rng.random(240))], "id long, v double, c string, y string")
    grid = {"max_depth": [1, None], "sampler": ["none"]}
    assert len(experiment.expand(grid)) == 2 and experiment.configuration_id({"b": 1, "a": 2}) == experiment.configuration_id({"a": 2, "b": 1})
    for bad in ({"max_depth": [1]}, {"sampler": ["none"], "random_state": [1]}):
        with pytest.raises(ValueError, match="."):
            experiment.expand(bad)
    first = experiment.cross_validate(rows, "decision_tree", {"max_depth": [1], "sampler": ["none"]}, ["v"], ["c"], "y", "id", seeds=(27,), k=2)
    both = experiment.cross_validate(rows, "decision_tree", grid, ["v"], ["c"], "y", "id", seeds=(27,), k=2, done=first)
    assert both.count() == 4 and both.agg({"accuracy": "min"}).first()[0] > 0.9
    assert experiment.select_best(both) in {experiment.configuration_id(p) for p in experiment.expand(grid)}
    model, predicted, seconds = experiment.refit(rows, rows, "boosted_trees", {"rounds": 2, "sampler": "oversample"}, ["v"], ["c"], "y", "id", 27)
    assert predicted.count() == 240 and set(seconds) == {"fit_seconds", "predict_seconds", "predict_seconds_per_100"}
    assert abs(sum(p for _, _, p in pipeline.importances(model)) - 1) < 1e-6
    assert abs(sum(predicted.first()["probabilities"]) - 1) < 1e-9


def test_text_model_failures_are_results(spark):
    def model(prompt: str) -> str:
        if "1" in prompt:
            raise RuntimeError("down")
        return " Yes\n"

    asked = spark.createDataFrame([(0, "a"), (1, "a1")], "row_index long, prompt string")
    rows = {r["row_index"]: r for r in inference.classify(asked, model, ["yes", "no"]).collect()}
    assert rows[0]["predicted_class"] == "yes" and rows[1]["response_error"] == "request_failed: down" and not rows[1]["response_valid"]
    assert "- no: never" in inference.system_prompt(["yes", "no"], {"no": "never"})
