"""Repeated stratified cross-validation of tree models on Spark ML, with a results table to resume from."""

from __future__ import annotations

import hashlib
import itertools
import json
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from threading import Semaphore

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import class_index
from plumbline.operators import metrics, pipeline, prepare, sampling
from plumbline.operators.boosting import BoostedTrees
from plumbline.sources.paths import delete, scratch

#: Spark trees go down to this depth at most; an unlimited depth becomes it.
DEEPEST = 30
ESTIMATORS = ("decision_tree", "random_forest", "boosted_trees")
#: Options of a grid, and the parameter each sets, by kind of estimator.
_TREE = {"max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "criterion": "impurity", "max_bins": "maxBins"}
OPTIONS = {
    "decision_tree": _TREE,
    "random_forest": _TREE | {"n_estimators": "numTrees", "max_features": "featureSubsetStrategy", "subsample": "subsamplingRate"},
    "boosted_trees": {
        "rounds": "rounds", "max_depth": "maxDepth", "learning_rate": "rate", "subsample": "subsample", "min_child_weight": "minChildWeight", "min_samples_split": "minSamplesSplit",
        "min_samples_leaf": "minSamplesLeaf", "min_gain": "minGain", "reg": "reg", "max_bins": "maxBins",
    },
}
#: Rows beyond which cross-validation fits one model at a time.
MANY_ROWS = 20_000_000
#: Options that act beside the estimator: the sampler before, and the guard of nodes after.
BESIDE = ("sampler", "min_samples_split")


# The published grids, of 72, 72 and 64 configurations.
GRIDS = {
    "decision_tree": {"sampler": ("none", "oversample"), "criterion": ("gini", "entropy"), "max_depth": (10, 20, None), "min_samples_split": (2, 5, 10), "min_samples_leaf": (1, 5)},
    "random_forest": {"sampler": ("none", "oversample"), "n_estimators": (100, 200), "max_depth": (10, 20, None), "min_samples_split": (2, 5, 10), "min_samples_leaf": (1, 5)},
    "boosted_trees": {"sampler": ("none", "oversample"), "rounds": (100, 200), "max_depth": (3, 6), "learning_rate": (0.05, 0.1), "min_child_weight": (1, 5), "subsample": (0.8, 1.0)},
}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def configuration_id(parameters: Mapping) -> str:
    """The first 12 hex digits of the SHA-256 of the canonical JSON."""
    return hashlib.sha256(canonical(parameters).encode()).hexdigest()[:12]


def signature(parts: Mapping) -> str:
    return hashlib.sha256(canonical(parts).encode()).hexdigest()


def expand(grid: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of a grid's options. Options are known, and include the sampler; seeds belong to the run."""
    unknown = set(grid) - {o for options in OPTIONS.values() for o in options} - set(BESIDE)
    if "sampler" not in grid or unknown or not all(grid.values()):
        raise ValueError(f"a grid names samplers, and values for known options only: {sorted(unknown)}")
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def gridded(rows: DataFrame, grid: Mapping[str, Sequence]) -> DataFrame:
    """rows, each with every combination of a grid as columns: for grids of many datasets at once. Options are checked by expand."""
    expand(grid)
    for name, values in grid.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows


def configuration_ids(rows: DataFrame, columns: Sequence[str], name: str = "configuration_id") -> DataFrame:
    """rows plus configuration_id of each row's columns, as configuration_id gives it for one; columns hold text, whole numbers or truth values."""
    held = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return rows.withColumn(name, F.substring(F.sha2(held, 256), 1, 12))


def estimator(kind: str, parameters: Mapping, seed: int, key: str = "id"):
    """A classifier on features and label that gives probability; an option that its kind doesn't have raises."""
    if kind not in OPTIONS:
        raise ValueError(f"unknown estimator {kind}; there are {', '.join(ESTIMATORS)}")
    names = OPTIONS[kind]
    if unknown := set(parameters) - set(names) - set(BESIDE):
        raise ValueError(f"{kind} has no {', '.join(sorted(unknown))}")
    options = {names[k]: (DEEPEST if k == "max_depth" and v is None else v) for k, v in parameters.items() if k in names}
    if kind == "decision_tree":
        return DecisionTreeClassifier(seed=seed, **options)
    if kind == "random_forest":
        return RandomForestClassifier(seed=seed, **options)
    return BoostedTrees(seed=seed, key=key, **options)


def guarded_splits(model: Model, spark: SparkSession, min_samples_split: int) -> Model:
    """model, a tree or forest, as if nodes of fewer training rows than min_samples_split had not been split.

    A node's split doesn't depend on what is below or beside it, so the tree that a guard would have grown is the grown
    one with the children of such nodes left out. The nodes are a column of the table that Spark saves a model in.
    """
    path = scratch(spark, "trees")
    model.write().save(f"{path}/grown")
    nodes = spark.read.parquet(f"{path}/grown/data")
    forest = "nodeData" in nodes.columns
    at = "nodeData." if forest else ""
    small = F.col(f"{at}rawCount") < min_samples_split
    ends = {"leftChild": F.lit(-1), "rightChild": F.lit(-1), "gain": F.lit(-1.0)}
    if forest:
        fields = [F.when(small, ends[n]).otherwise(F.col(f"nodeData.{n}")).alias(n) if n in ends else F.col(f"nodeData.{n}") for n in nodes.schema["nodeData"].dataType.names]
        kept = nodes.withColumn("nodeData", F.struct(*fields))
    else:
        kept = nodes.withColumns({n: F.when(small, end).otherwise(F.col(n)) for n, end in ends.items()})
    try:
        kept.write.parquet(f"{path}/data")
        delete(spark, f"{path}/grown/data")
        spark.read.parquet(f"{path}/data").write.parquet(f"{path}/grown/data")
        return (RandomForestClassificationModel if forest else DecisionTreeClassificationModel).load(f"{path}/grown")
    finally:
        delete(spark, path)


def fit_classifier(rows: DataFrame, kind: str, parameters: Mapping, seed: int, key: str) -> Model:
    """The model of rows (key, label, features) as they are, with its guard of nodes."""
    model, least = estimator(kind, parameters, seed, key).fit(rows), parameters.get("min_samples_split", 2)
    return guarded_splits(model, rows.sparkSession, least) if kind != "boosted_trees" and least > 2 else model


def assembled(rows: DataFrame, fitted: prepare.Preprocessor, target: str, classes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep, target, label and features of rows."""
    ready = fitted.transform(rows, [*keep, target]).withColumn("label", class_index(F.col(target), classes).cast("double"))
    return VectorAssembler(inputCols=[n for n, _ in fitted.outputs], outputCol="features").transform(ready).select(*keep, target, "label", "features")


def fit(rows: DataFrame, kind: str, parameters: Mapping, seed: int, target: str, key: str) -> Model:
    """Rows (from assembled) balanced if the sampler says so, and a model fitted on them."""
    return pipeline.Balanced(kind=kind, options=canonical(dict(parameters)), seed=seed, target=target, key=key).fit(rows)


def predictions(model: Model, rows: DataFrame, classes: Sequence[str], target: str, key: str) -> DataFrame:
    """key, actual_class, predicted_class, probabilities of rows from assembled."""
    scored = pipeline.Decision(classes=list(classes)).transform(model.transform(rows))
    return scored.select(key, F.col(target).alias("actual_class"), "predicted_class", "probabilities")


def scores(predicted: DataFrame, classes: Sequence[str]) -> dict[str, float]:
    """The eight metrics of a prediction table. Equal predictions are counted once, and the counts are cached: of a tree as many as leaves and classes."""
    named = {f"probability_{i}_{c}": F.get("probabilities", F.lit(i)) for i, c in enumerate(classes)}
    counted = predicted.groupBy("actual_class", "predicted_class", "probabilities").agg(F.count("*").alias("times"))
    wide = counted.select("actual_class", "predicted_class", "times", *(p.alias(n) for n, p in named.items())).cache()
    try:
        return metrics.summary_metrics(wide, [], times="times").first().asDict() | metrics.macro_auc(wide, [], classes, list(named), times="times").first().asDict()
    finally:
        wide.unpersist()


def cross_validate(
    rows: DataFrame, kind: str, grid: Mapping[str, Sequence], numeric: Sequence[str], categorical: Sequence[str], target: str, key: str,
    seeds: Sequence[int] = (27, 32, 59), k: int = 3, done: DataFrame | None = None, parallel: int = 4, record: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """configuration_id, seed, fold and metrics of every combination that done lacks, and those of done.

    record gets the rows of each fold when it ends (lifecycle.cross_validated appends them to a table, and resumes from it);
    it is called by the calling thread, for one fold at a time.

    Rows are written to the shared folder once, and again ranked by the draw of each seed: folds are remainders of ranks, and
    balancing a fold's training rows takes their ranks from there, so no fold sorts rows. Folds of a seed run side by side; at
    most parallel fits run at a time, from driver threads. Each fit is a row of Spark jobs. Of more than MANY_ROWS a fit fills a
    cluster by itself, and fits run one after the other, beside the scoring of those before, so that one training set is held at a time. Beside the files, only balanced
    features and labels and the counts of equal predictions of a fit are cached. Medians and modes are sought for columns with missing values alone.
    """
    spark, base = rows.sparkSession, scratch(rows.sparkSession, "folds")
    known = {(r["configuration_id"], r["seed"], r["fold"]) for r in done.select("configuration_id", "seed", "fold").collect()} if done is not None else set()
    found = []

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{base}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{base}/{name}")

    try:
        rows = written(rows.select(*(F.col(f"`{c}`") for c in dict.fromkeys((key, *numeric, *categorical, target)))), "rows")
        classes, whole = prepare.classes_of(rows, target), prepare.whole_columns(rows, numeric, categorical)
        fits = Semaphore(1 if rows.count() > MANY_ROWS else parallel)
        for seed in seeds:
            wanted = {fold: [p for p in expand(grid) if (configuration_id(p), seed, fold) not in known] for fold in range(1, k + 1)}
            wanted = {fold: some for fold, some in wanted.items() if some}
            if not wanted:
                continue
            ranked = written(sampling.ranked(rows, target, seed, key), f"seed-{seed}")
            at_once = min(parallel, len(wanted))

            def one_fold(fold: int, ranked=ranked, seed=seed, wanted=wanted, at_once=at_once) -> list[tuple]:
                train, test = sampling.without_fold(ranked, k, fold), ranked.where(sampling.fold_of(k) == fold)
                ready = prepare.fit(train, numeric, categorical, whole=whole)
                train, test = assembled(train, ready, target, classes, [key, "__nth"]), assembled(test, ready, target, classes, [key])

                def one(parameters: Mapping) -> tuple:
                    with fits:
                        model = fit(train, kind, parameters, seed, target, key)
                    result = scores(predictions(model, test, classes, target, key), classes)
                    return (configuration_id(parameters), seed, fold, *[float(result[m]) for m in METRICS])

                with ThreadPoolExecutor(max(1, parallel // at_once)) as threads:
                    return list(threads.map(one, wanted[fold]))

            with ThreadPoolExecutor(at_once) as threads:
                for ended in as_completed([threads.submit(one_fold, fold) for fold in wanted]):
                    if record:
                        record(spark.createDataFrame(ended.result(), RESULTS))
                    found += ended.result()
            delete(spark, f"{base}/seed-{seed}")
    finally:
        delete(spark, base)
    new = spark.createDataFrame(found, RESULTS)
    return new if done is None else done.select(new.columns).unionByName(new)


METRICS = ("accuracy", "precision", "recall", "macro_f1", "roc_auc", "pr_auc", "mcc", "balanced_accuracy")
RESULTS = ", ".join(["configuration_id string", "seed int", "fold int", *[f"{m} double" for m in METRICS]])


def select_best(folds: DataFrame, metric: str = "macro_f1") -> str:
    """The configuration with the best mean over seeds of its fold means; then the smallest spread, then its id."""
    from plumbline.operators.summaries import mean_and_std, means, ranked_configurations

    by_seed = means(folds, ["configuration_id", "seed"], [metric])
    return ranked_configurations(mean_and_std(by_seed, ["configuration_id"], [metric]), metric, limit=1).first()["configuration_id"]


def refit(train: DataFrame, test: DataFrame, kind: str, parameters: Mapping, numeric: Sequence[str], categorical: Sequence[str], target: str, key: str, seed: int) -> tuple[PipelineModel, DataFrame, dict[str, float]]:
    """The pipeline of all training rows, its predictions of the test rows, and the seconds of the fit and the prediction."""
    began = time.perf_counter()
    model = pipeline.fitted(train, kind, parameters, numeric, categorical, target, key, seed)
    fitted = time.perf_counter()
    predicted = pipeline.predictions(model, test, target, key).cache()
    n = predicted.count()
    seconds = time.perf_counter() - fitted
    return model, predicted, {"fit_seconds": fitted - began, "predict_seconds": seconds, "predict_seconds_per_100": 100 * seconds / max(1, n)}
