"""exp_7_cross_validation against folds and metrics by brute force."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from plumbline.operators import experiment, metrics, prepare, sampling
from plumbline.plans import sampling_queries


def lineitem() -> list[tuple]:
    """(orderkey, linenumber, partkey, quantity, price, linestatus, returnflag): O is N, F is A up to 24 and R beyond, with one flag in 23 wrong; every tenth key comes twice."""
    rows = []
    for i in range(1980):
        quantity, status = float(i * 7 % 10 * 5 + 1), "O" if i % 3 == 0 else "F"
        flag = "N" if status == "O" else "A" if quantity < 25 else "R"
        flag = {"N": "A", "A": "R", "R": "N"}[flag] if i % 23 == 0 else flag
        rows.append((i // 4 - (i // 4) % 3, i % 4, i % 10, quantity, 100.0, status, flag))
    return rows + [(*r[:3], r[3], 200.0, *r[5:]) for r in rows[::10]]


def brute_folds(rows: list[tuple], seed: int, k: int = 3) -> list[list[tuple]]:
    seen, drawn, folds = Counter(), defaultdict(list), [[] for _ in range(k)]
    for row in sorted(rows, key=lambda r: r[3:]):
        name = f"{row[0]}-{row[1]}-{row[2]}"
        seen[name] += 1
        name = f"{name}-{seen[name]}"
        drawn[row[6]].append((hashlib.md5(f"{seed}:{name}".encode()).hexdigest(), name, row))
    for found in drawn.values():
        for n, (_, _, row) in enumerate(sorted(found)):
            folds[n % k].append(row)
    return folds


def test_all_rows_meet_a_fold_and_the_metrics_are_those_of_the_rule(spark, tmp_path):
    rows = lineitem()
    assert len({r[:3] for r in rows}) < len(rows) and len(rows) > 2000
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag"]
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))), tmp_path / "lineitem.parquet")
    found = {(r["seed"], r["fold"]): r for r in sampling_queries.cross_validation(spark, str(tmp_path)).collect()}
    assert set(found) == {(seed, fold) for seed in (27, 32, 59) for fold in (1, 2, 3)}
    for seed in (27, 32, 59):
        folds = brute_folds(rows, seed)
        assert sum(map(len, folds)) == len(rows)
        for fold, test in enumerate(folds, 1):
            pairs = Counter((r[6], "N" if r[5] == "O" else "A" if r[3] < 25 else "R") for r in test)
            right = {c: pairs[c, c] for c in "ANR"}
            recall = [right[c] / sum(n for (actual, _), n in pairs.items() if actual == c) for c in "ANR"]
            precision = [right[c] / sum(n for (_, given), n in pairs.items() if given == c) for c in "ANR"]
            row = found[seed, fold]
            assert row["accuracy"] == pytest.approx(sum(right.values()) / len(test))
            assert row["balanced_accuracy"] == pytest.approx(sum(recall) / 3)
            assert row["macro_f1"] == pytest.approx(sum(2 * p * r / (p + r) for p, r in zip(precision, recall, strict=True)) / 3)


def test_rows_are_ranked_once_a_seed(spark, monkeypatch):
    """Folds and the balancing of their training rows share one ranking, and ranks without a fold are those of a new ranking."""
    rows = spark.range(200).selectExpr("cast(id as string) as id", "cast(id % 10 as double) as x", "if(id % 10 < 3, 'a', 'b') as y")
    ranked, calls = sampling.ranked, []
    for fold in (1, 2, 3):
        apart = sampling.without_fold(ranked(rows, "y", 27, "id"), 3, fold)
        assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, ranked(apart.drop("__nth"), "y", 27, "id").collect()))
    monkeypatch.setattr(sampling, "ranked", lambda *given: (calls.append(given), ranked(*given))[1])
    grid = {"max_depth": [1], "min_samples_leaf": [5], "sampler": ["oversample"]}
    found = experiment.cross_validate(rows, "decision_tree", grid, ["x"], [], "y", "id", seeds=(27,), k=2).collect()
    assert len(calls) == 1 and [r["accuracy"] for r in found] == [1.0, 1.0]


def test_balancing_reads_ranked_rows_once_and_draws_the_same_either_way(spark, tmp_path, monkeypatch):
    """Few draws go to the rows, many are shuffled with them: the same rows and copies come out."""
    rows = spark.range(300).selectExpr("cast(id as string) as id", "if(id % 10 < 3, 'a', if(id % 10 = 3, 'c', 'b')) as y")
    sampling.ranked(rows, "y", 27, "id").write.parquet(f"{tmp_path}/ranked")
    ranked = spark.read.parquet(f"{tmp_path}/ranked")
    few = sampling.oversampled(ranked, "y", 27, "id")
    assert few._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    found = sorted(map(tuple, few.collect()))
    assert Counter(y for _, y, _ in found) == {"a": 180, "b": 180, "c": 180} and sum(copy == 0 for *_, copy in found) == 300
    for name in ("BROADCAST_DRAWS", "BROADCAST_CLASSES"):
        with monkeypatch.context() as held:
            held.setattr(sampling, name, 0)
            assert sorted(map(tuple, sampling.oversampled(ranked, "y", 27, "id").collect())) == found


def test_medians_and_modes_are_sought_where_values_are_missing(spark, monkeypatch):
    whole = spark.range(120).selectExpr("cast(id as string) as id", "cast(id % 10 as double) as x", "cast(id % 2 as string) as c", "if(id % 10 < 3, 'a', 'b') as y")
    asked, medians, modes = [], prepare.medians, prepare.modes
    monkeypatch.setattr(prepare, "medians", lambda rows, columns: (asked.extend(columns), medians(rows, columns))[1])
    monkeypatch.setattr(prepare, "modes", lambda rows, columns: (asked.extend(columns), modes(rows, columns))[1])
    grid = {"max_depth": [1], "min_samples_leaf": [5], "sampler": ["none"]}
    run = lambda rows: [r["accuracy"] for r in experiment.cross_validate(rows, "decision_tree", grid, ["x"], ["c"], "y", "id", seeds=(27,), k=2).collect()]
    assert run(whole) == [1.0, 1.0] and asked == []
    run(whole.selectExpr("id", "if(id = '4', double('nan'), x) as x", "if(id = '7', null, c) as c", "y"))
    assert sorted(asked) == ["c", "c", "x", "x"]


def test_equal_predictions_are_counted_once(spark):
    cells = [(i, "ab"[i % 2], "ab"[i % 3 == 0], [0.25 * (i % 4), 1 - 0.25 * (i % 4)]) for i in range(60)]
    rows = spark.createDataFrame(cells, "id int, actual_class string, predicted_class string, probabilities array<double>")
    wide = rows.selectExpr("actual_class", "predicted_class", "probabilities[0] as p0", "probabilities[1] as p1")
    expected = metrics.summary_metrics(wide, []).first().asDict() | metrics.macro_auc(wide, [], ["a", "b"], ["p0", "p1"]).first().asDict()
    kept = []
    spark.catalog.clearCache()
    cache = type(rows).cache
    try:
        type(rows).cache = lambda self: (kept.append(self.count()), cache(self))[1]
        assert experiment.scores(rows, ["a", "b"]) == pytest.approx(expected)
    finally:
        type(rows).cache = cache
    assert kept == [8]  # distinct cells of 60 rows
