"""Experiments that survive a stopped driver: results are tables in a folder, and what is there is not done again.

A run's folder holds folds (a row for each configuration, seed and fold, appended when a fold
ends), and for each seed of the final fit a pipeline, its predictions and its timing. Small objects
are JSON, the others Parquet and Spark ML's own format.

Both parts of a run are signed: search.json and final.json hold digests of their rows and options
(signatures.begin), so that a folder whose results came from something else isn't gone on with.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import artifacts, ensemble, experiment, metrics, pipeline, signatures, summaries
from plumbline.sources import files, sinks
from plumbline.sources.paths import exists, names

TIMING = "seed int, fit_seconds double, predict_seconds double, predict_seconds_per_100 double"
TABLES = {
    "folds": experiment.RESULTS,
    "timing": TIMING,
    "weights": "classifier string, value double, weight double",
    "configurations": "configuration_id string, parameters string",
}


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a run with its schema; one that was not written yet is empty, one of other columns or types is refused."""
    schema = spark.createDataFrame([], TABLES[name]).schema
    path = f"{folder}/{name}"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(path)
    if {f.name: f.dataType for f in rows.schema} != {f.name: f.dataType for f in schema}:
        raise ValueError(f"{path} has the columns {rows.schema.simpleString()}, not {schema.simpleString()}")
    return rows.select(schema.names)


def append_table(rows: DataFrame, folder: str, name: str) -> None:
    rows.write.mode("append").parquet(f"{folder}/{name}")


def flattened(checkpoint: Mapping) -> list[tuple]:
    """Rows of folds from a nested checkpoint: {configuration_id: {seed: [metrics of fold 1, of fold 2 ...]}}."""
    return [
        (configuration, int(seed), fold, *[float(found[m]) for m in experiment.METRICS])
        for configuration, seeds in sorted(checkpoint.items())
        for seed, folds in sorted(seeds.items(), key=lambda item: int(item[0]))
        for fold, found in enumerate(folds, 1)
    ]


def load_checkpoint(spark: SparkSession, path: str, measures: Sequence[str] = experiment.METRICS) -> DataFrame:
    """Rows of folds (configuration_id, seed, fold, measures) of nested JSON checkpoints, {configuration_id: {seed: [metrics of fold 1 ...]}}, an object a line."""
    held = ", ".join(f"{m}: double" for m in measures)
    lines = spark.read.text(path).select(F.from_json("value", f"map<string, map<string, array<struct<{held}>>>>", {"mode": "FAILFAST"}).alias("c"))
    seeds = lines.select(F.explode("c").alias("configuration_id", "seeds")).select("configuration_id", F.explode("seeds").alias("seed", "folds"))
    each = seeds.select("configuration_id", F.col("seed").cast("int").alias("seed"), F.posexplode("folds").alias("fold", "m"))
    return each.select("configuration_id", "seed", (F.col("fold") + 1).alias("fold"), *(F.col(f"m.{m}").alias(m) for m in measures))


def _used(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, key: str) -> DataFrame:
    """The columns that a run reads; others may change without making it another run."""
    return rows.select(*dict.fromkeys([key, *numeric, *categorical, target]))


def cross_validated(
    rows: DataFrame, folder: str, kind: str, grid: Mapping[str, Sequence], numeric: Sequence[str], categorical: Sequence[str], target: str, key: str,
    seeds: Sequence[int] = (27, 32, 59), k: int = 3, parallel: int = 4, changed: str = "raise",
) -> DataFrame:
    """The folds of a run, after fitting those that its table lacks; each fold is appended when it ends.

    A folder whose folds came from other rows, options or seeds is refused, or emptied of them with changed = "restart".
    """
    spark = rows.sparkSession
    parts = {"rows": _used(rows, numeric, categorical, target, key), "kind": kind, "grid": grid, "columns": [list(numeric), list(categorical), target, key], "seeds": list(seeds), "folds": k}
    signatures.begin(spark, folder, "search", parts, ["folds", "configurations"], changed)
    parameters = [(experiment.configuration_id(p), experiment.canonical(p)) for p in experiment.expand(grid)]
    known = {r["configuration_id"] for r in load_table(spark, folder, "configurations").collect()}
    if new := [p for p in parameters if p[0] not in known]:
        append_table(spark.createDataFrame(new, TABLES["configurations"]), folder, "configurations")
    done = load_table(spark, folder, "folds")
    experiment.cross_validate(rows, kind, grid, numeric, categorical, target, key, seeds, k, done=done, parallel=parallel, record=lambda ended: append_table(ended, folder, "folds"))
    return load_table(spark, folder, "folds")


def best_parameters(spark: SparkSession, folder: str, metric: str = "macro_f1") -> dict:
    """The parameters of the configuration that the folds of a run select."""
    chosen = experiment.select_best(load_table(spark, folder, "folds"), metric)
    return json.loads(load_table(spark, folder, "configurations").where(F.col("configuration_id") == chosen).first()["parameters"])


def mean_validation(spark: SparkSession, folder: str, metric: str = "macro_f1") -> float:
    """The mean of a metric over seeds and folds of the configuration selected by it."""
    folds = load_table(spark, folder, "folds")
    chosen = experiment.select_best(folds, metric)
    return folds.where(F.col("configuration_id") == chosen).groupBy("seed").agg(F.avg(metric).alias("m")).agg(F.avg("m")).first()[0]


def save_model(model: PipelineModel, folder: str, seed: int) -> None:
    """A fitted pipeline, in one folder; then what it was made from, so that a half-written one isn't taken for whole."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{folder}/model-{seed}")
    made = files.load_json(spark, f"{folder}/final.json") if exists(spark, f"{folder}/final.json") else {}
    sinks.write_json(spark, {"seed": seed, "made": experiment.signature(made)}, f"{folder}/model-{seed}.json")


def load_model(spark: SparkSession, folder: str, seed: int) -> PipelineModel:
    """A pipeline of the run that the folder is signed for; one of another run or seed is refused."""
    held = files.load_json(spark, f"{folder}/model-{seed}.json")
    made = files.load_json(spark, f"{folder}/final.json") if exists(spark, f"{folder}/final.json") else {}
    if held != {"seed": seed, "made": experiment.signature(made)}:
        raise signatures.ChangedRun(f"{folder}/model-{seed} is of another run or seed than {folder}/final.json")
    return PipelineModel.load(f"{folder}/model-{seed}")


def load_models(spark: SparkSession, folder: str, seeds: Sequence[int]) -> dict[int, PipelineModel]:
    """The pipelines of all seeds; one that is missing is an error."""
    lacking = [s for s in seeds if not exists(spark, f"{folder}/model-{s}.json")]
    if lacking:
        raise FileNotFoundError(f"{folder} has no model of the seeds {lacking}")
    return {s: load_model(spark, folder, s) for s in seeds}


def _final(train: DataFrame, test: DataFrame, folder: str, kind: str, parameters: Mapping, numeric: Sequence[str], categorical: Sequence[str], target: str, key: str, changed: str) -> None:
    """Signs the final fit of a folder, or refuses it."""
    spark = train.sparkSession
    sides = {name: _used(side, numeric, categorical, target, key) for name, side in (("train", train), ("test", test))}
    parts = sides | {"kind": kind, "parameters": parameters, "columns": [list(numeric), list(categorical), target, key]}
    own = [n for n in names(spark, folder) if n.startswith(("model-", "predictions", "timing"))]
    signatures.begin(spark, folder, "final", parts, own, changed)


def refitted(
    train: DataFrame, test: DataFrame, folder: str, kind: str, parameters: Mapping, numeric: Sequence[str], categorical: Sequence[str], target: str, key: str, seeds: Sequence[int], changed: str = "raise",
) -> list[int]:
    """Fits, predicts and times the seeds whose model, predictions or timing are not all there; returns those that it did.

    A folder made from other rows or parameters is refused, or emptied with changed = "restart". Predictions that are
    there are reused only if they answer each test row once.
    """
    spark, did = train.sparkSession, []
    _final(train, test, folder, kind, parameters, numeric, categorical, target, key, changed)
    timed = {r["seed"] for r in load_table(spark, folder, "timing").collect()}
    for seed in seeds:
        if seed in timed and all(exists(spark, f"{folder}/{p}") for p in (f"model-{seed}.json", f"predictions/seed={seed}/_SUCCESS")):
            there = spark.read.parquet(f"{folder}/predictions/seed={seed}").withColumn("__valid", F.col("predicted_class").isNotNull())
            artifacts.faultless(artifacts.reuse_faults(there, test, key, "predicted_class", "__valid", ""))
            continue
        model, predicted, seconds = experiment.refit(train, test, kind, parameters, numeric, categorical, target, key, seed)
        save_model(model, folder, seed)
        sinks.write_table(predicted, f"{folder}/predictions/seed={seed}")
        if seed not in timed:
            append_table(spark.createDataFrame([(seed, *map(float, seconds.values()))], TIMING), folder, "timing")
        predicted.unpersist()
        did.append(seed)
    return did


def missing_timing(train: DataFrame, test: DataFrame, folder: str, kind: str, parameters: Mapping, numeric: Sequence[str], categorical: Sequence[str], target: str, key: str, seeds: Sequence[int]) -> list[int]:
    """Times the fit and prediction of the seeds whose timing is missing, and leaves models and predictions as they are."""
    spark = train.sparkSession
    if exists(spark, f"{folder}/final.json"):
        _final(train, test, folder, kind, parameters, numeric, categorical, target, key, "raise")
    wanted = spark.createDataFrame([(s,) for s in seeds], "seed int").join(load_table(spark, folder, "timing"), "seed", "left_anti")
    lacking = sorted(r["seed"] for r in wanted.collect())
    for seed in lacking:
        _, predicted, seconds = experiment.refit(train, test, kind, parameters, numeric, categorical, target, key, seed)
        predicted.unpersist()
        append_table(spark.createDataFrame([(seed, *map(float, seconds.values()))], TIMING), folder, "timing")
    return lacking


def frozen_test(test: DataFrame, folder: str, target: str, key: str, seeds: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Predictions (seed, key, actual_class, predicted_class, probabilities) of saved models for rows they never saw, and all metrics by seed. Nothing is fitted."""
    parts, classes = [], None
    for seed, model in load_models(test.sparkSession, folder, seeds).items():
        found = pipeline.classes_of(model)
        if classes not in (None, found):
            raise ValueError(f"the model of seed {seed} has other classes")
        classes = found
        parts.append(pipeline.predictions(model, test, target, key).select(F.lit(seed).alias("seed"), "*"))
    predicted = parts[0]
    for part in parts[1:]:
        predicted = predicted.unionByName(part)
    named = {f"probability_{i}_{c}": F.get("probabilities", F.lit(i)) for i, c in enumerate(classes)}
    wide = predicted.withColumns(named)
    return predicted, metrics.summary_metrics(wide, ["seed"]).join(metrics.macro_auc(wide, ["seed"], classes, list(named)), "seed")


def committee(spark: SparkSession, folders: Mapping[str, str], classes: Sequence[str], key: str, metric: str = "macro_f1") -> dict[str, DataFrame]:
    """All tables of a committee of the classifiers whose runs lie in folders; only what the runs wrote is read, and nothing is fitted.

    weights: a classifier weighs its mean validation metric's share of the sum. votes; seeds (all eight metrics by seed and
    strategy) and summary (their mean and spread over seeds); diversity of pairs by seed and pairs (over seeds); corrections
    by seed and corrected (over seeds).

    Predictions that aren't one of each classifier for each row and seed, of one actual class, raise.
    """
    values = spark.createDataFrame([(name, mean_validation(spark, folder, metric)) for name, folder in folders.items()], "classifier string, value double")
    weights = ensemble.weights_of(values, "value")
    parts = [spark.read.parquet(f"{folder}/predictions").withColumn("classifier", F.lit(name)) for name, folder in folders.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    if apart := ensemble.aligned(rows, ["seed", key], len(folders)).count():
        raise ValueError(f"{apart} rows aren't predicted once by each of {', '.join(folders)}, of one actual class")
    voted = ensemble.votes(rows, ["seed", key], classes, {r["classifier"]: r["weight"] for r in weights.collect()})
    by = ["seed", "strategy"]
    scores = {f"probability_{i}_{c}": F.round(F.get("scores", F.lit(i)), SCORE_PLACES) for i, c in enumerate(classes)}
    # every strategy of a seed has one row of areas, so a left join loses none, and Spark leaves it out where no area is read
    seeds = metrics.summary_metrics(voted, by).join(metrics.macro_auc(voted.withColumns(scores), by, classes, list(scores)), by, "left")
    pairs = ensemble.diversity(rows, ["seed"], [key])
    corrected = ensemble.corrections(voted, rows, ["seed"], [key])
    rates = [c for c in corrected.columns if c.endswith("_rate")]
    return {
        "weights": weights, "votes": voted, "seeds": seeds, "summary": summaries.mean_and_std(seeds, ["strategy"], experiment.METRICS),
        "diversity": pairs, "pairs": summaries.mean_and_std(pairs, ["classifier_a", "classifier_b"], ["disagreement", "double_fault", "error_jaccard"]),
        "corrections": corrected, "corrected": summaries.mean_and_std(corrected, ["strategy"], rates),
    }


#: Places to which scores of votes count as different in AUCs: sums of weights in another order differ beyond them.
SCORE_PLACES = 9
