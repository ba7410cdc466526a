import numpy as np
import pandas as pd
import pytest

from plumbline.operators import quantiles
from plumbline.operators.quantiles import exact_quantiles, quantile_columns


@pytest.mark.parametrize("n", [1, 2, 3, 10, 4_999, 20_001])
def test_equals_numpy(spark, n):
    rng = np.random.Generator(np.random.PCG64(n))
    groups = {"smooth": rng.normal(size=n), "ties": rng.integers(0, 5, n).astype(float), "skew": np.where(rng.random(n) < 0.97, 0.0, rng.random(n))}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None), ("smooth", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(3)
    p = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    found = {(r["g"], r["p"]): r["quantile"] for r in exact_quantiles(frame, ["g"], "v", p).collect()}
    assert len(found) == len(groups) * len(p)
    for g, values in groups.items():
        assert np.allclose([found[g, x] for x in p], np.quantile(values, p), rtol=0, atol=1e-12)


def test_without_keys_and_with_null_keys(spark):
    frame = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "g string, v double")
    assert exact_quantiles(frame, [], "v", [0.5]).collect()[0]["quantile"] == 2.0
    assert {r["g"]: r["m"] for r in quantile_columns(frame, ["g"], "v", {"m": 0.5}).collect()} == {None: 1.5, "a": 5.0}
    assert exact_quantiles(frame.where("false"), ["g"], "v", [0.5]).count() == 0


def test_brackets_are_what_is_broadcast(spark):
    frame = spark.range(10).selectExpr("cast(id as double) v", "id % 2 as g")
    for keys in ([], ["g"]):
        plan = exact_quantiles(frame, keys, "v", [0.5])._jdf.queryExecution().executedPlan().toString()
        assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("most_groups", [1, 20_000])
def test_brackets_are_narrowed_until_they_are_small(spark, monkeypatch, most_groups):
    """With brackets of at most 60 rows, several rounds and an expensive group among small ones give the same quantiles."""
    for name, value in (("MOST_INSIDE", 60), ("GRID", 10), ("MOST_GROUPS", most_groups), ("SMALL", 1000)):
        monkeypatch.setattr(quantiles, name, value)
    rng = np.random.Generator(np.random.PCG64(7))
    n = 60_000
    groups = {"smooth": rng.normal(size=n), "ties": rng.integers(0, 5, n).astype(float), "skew": np.where(rng.random(n) < 0.97, 0.0, rng.random(n)), "few": rng.random(50), "steps": np.round(rng.random(n), 2)}
    frame = spark.createDataFrame(pd.DataFrame({"g": [g for g, v in groups.items() for _ in v], "v": np.concatenate(list(groups.values()))})).repartition(3)
    p, passes, narrowed = [0.0, 0.05, 0.5, 0.95, 1.0], [], quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda values, keys, held, shares: (narrowed(values, keys, held, shares), passes.append(held)))
    found = {(r["g"], r["p"]): r["quantile"] for r in exact_quantiles(frame, ["g"], "v", p).collect()}
    for g, values in groups.items():
        assert np.allclose([found[g, x] for x in p], np.quantile(values, p), rtol=0, atol=1e-12)
    for group in (h for held in passes for h in held if h["n"] >= 1000):
        values = groups[group["key"][0]]
        assert all(lo == hi or len(set(values[(values >= lo) & (values <= hi)])) <= 120 for lo, hi in zip(group["lo"], group["hi"], strict=True))


def test_rows_of_small_groups_are_not_multiplied(spark):
    """Of 2,000 groups of 5 rows no step makes more rows than there are, and a large group beside them has its own quantiles."""
    frame = spark.range(10_000).selectExpr("id % 2000 as g", "cast(id * 7919 % 10007 as double) as v")
    p = [0.0, 0.25, 0.5, 0.75, 1.0]
    plan = exact_quantiles(frame, ["g"], "v", p)._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("row_number")  # what is below the ranking comes after it
    assert "Generate" not in plan[at:]
    both = frame.unionByName(spark.range(6_000).selectExpr("-1 as g", "cast(id as double) as v"))
    found = {(r["g"], r["p"]): r["quantile"] for r in exact_quantiles(both, ["g"], "v", p).collect()}
    plain = both.toPandas().groupby("g")["v"]
    assert len(found) == 2_001 * len(p) and all(np.isclose(found[g, x], np.quantile(v, x), rtol=0, atol=1e-12) for g, v in plain for x in p)
