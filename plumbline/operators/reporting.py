"""Report tables, assembled from the operators: each bundle is a dict of lazy tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.axes import nonlinear_ticks
from plumbline.functions.columns import domain_order, finite, mean_std
from plumbline.operators import profile, summaries
from plumbline.operators.quantiles import quantile_columns


def parameter_columns(table: DataFrame, excluded: Sequence[str] = ("configuration_id", "seed", "fold"), suffixes: Sequence[str] = ("_mean", "_std"), prefixes: Sequence[str] = ("seed_",)) -> list[str]:
    """The columns of a results table that are neither keys nor metrics."""
    return [c for c in table.columns if c not in excluded and not c.endswith(tuple(suffixes)) and not c.startswith(tuple(prefixes))]


def restored_parameters(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """table with NaN as NULL in those of columns that hold floating-point numbers: options that a configuration doesn't set."""
    floats = [f.name for f in table.schema if f.name in columns and f.dataType.typeName() in ("double", "float")]
    return table.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def stripped_names(table: DataFrame, prefixes: Sequence[str] = (), suffixes: Sequence[str] = ()) -> DataFrame:
    """table without the first prefix, then the first suffix, that a column's name has; names that become equal or empty raise."""
    names = []
    for name in table.columns:
        name = name.removeprefix(next((p for p in prefixes if name.startswith(p)), ""))
        names.append(name.removesuffix(next((s for s in suffixes if name.endswith(s)), "")))
    if len(set(names)) != len(names) or "" in names:
        raise ValueError(f"stripped names are not unique: {', '.join(names)}")
    return table.toDF(*names)


def cross_validation(folds: DataFrame, metrics: Sequence[str], seeds: Sequence[int], metric: str = "macro_f1", top: int = 5) -> dict[str, DataFrame]:
    """seeds (fold means), configurations (over seeds), best (the first of the ranking) and shown (the top ones as text)."""
    by_seed = summaries.means(folds, ["configuration_id", "seed"], metrics)
    table = summaries.configuration_table(by_seed, seeds, metric, metrics)
    ranked = summaries.ranked_configurations(table, metric, limit=top)
    return {"seeds": by_seed, "configurations": table, "best": summaries.ranked_configurations(table, metric, limit=1), "shown": summaries.shown(ranked, metrics)}


def test_evaluation(seed_rows: DataFrame, names: Sequence[str], metrics: Sequence[str], training: DataFrame | None = None, inference: DataFrame | None = None) -> dict[str, DataFrame]:
    """summary (mean and std of metrics by names) and shown (the same as text); with times of training and inference by names and seed also timing."""
    summary = summaries.mean_and_std(seed_rows, names, metrics)
    timing = {} if training is None or inference is None else {"timing": summaries.timing_table(training, inference, names)}
    return {"summary": summary, "shown": summaries.shown(summary, metrics)} | timing


def feature_differences(rows: DataFrame, by: str = "classifier", feature: str = "original_feature") -> DataFrame:
    """feature, n, missing_in of the features that not every classifier has importances of; empty if all have the same."""
    names = rows.select(by).distinct()
    n = names.count()
    held = rows.select(feature, by).distinct().groupBy(feature).agg(F.count("*").alias("n"), F.collect_set(by).alias("__in")).where(F.col("n") < n)
    every = names.agg(F.collect_set(by).alias("__all"))
    return held.join(F.broadcast(every), F.lit(True)).select(feature, "n", F.array_join(F.array_sort(F.array_except("__all", "__in")), ", ").alias("missing_in"))


def importance_summary(rows: DataFrame, n: int, seeds: int) -> DataFrame:
    """feature, mean, std, peak and place of the n original features with the highest peak; a feature that lacks a seed raises."""
    levels = summaries.importance_levels(rows, ["seed"], "transformed_feature", "original_feature", "importance").where("level = 'original'")
    stats = levels.groupBy("feature").agg(F.avg("importance").alias("mean"), summaries.spread("importance").alias("std"), F.max("importance").alias("peak"), F.count_distinct("seed").alias("__seeds"))
    whole = F.when(F.col("__seeds") == seeds, F.col("peak")).otherwise(F.raise_error(F.concat(F.col("feature"), F.lit(" lacks a seed"))).cast("double"))
    top = stats.withColumn("peak", whole).orderBy(F.desc("peak"), "feature").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("peak"), "feature"))).drop("__seeds")


def committee_comparison(individual: DataFrame, committee: DataFrame, metrics: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """kind, name, position and of each metric mean, std and gain over the best individual: individuals (classifier) and committees (strategy) in a given order.

    Columns are named by their metric, but for a single one.
    """
    names = [metrics] if isinstance(metrics, str) else list(metrics)
    prefix = {m: "" if isinstance(metrics, str) else f"{m}_" for m in names}

    def side(rows: DataFrame, kind: str, name: str) -> DataFrame:
        stats = [F.col(f"{m}_{s}").alias(f"{prefix[m]}{s}") for m in names for s in ("mean", "std")]
        return summaries.mean_and_std(rows, [name], names).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), *stats)

    both = side(individual, "individual", "classifier").unionByName(side(committee, "committee", "strategy"))
    best = {f"{prefix[m]}gain": F.col(f"{prefix[m]}mean") - F.max(F.when(F.col("kind") == "individual", F.col(f"{prefix[m]}mean"))).over(Window.partitionBy()) for m in names}
    return both.withColumns(best).withColumn("position", F.row_number().over(Window.orderBy(domain_order(F.col("name"), order), "name")))


def feature_inspection(rows: DataFrame, column: str, target: str, bins: int = 20, transform: str = "linear") -> dict[str, DataFrame]:
    """statistics, histogram, histogram by class, box statistics by class and axis ticks of a numeric feature: what its plots show."""
    return {
        "statistics": profile.feature_statistics(rows, column), "histogram": profile.histogram(rows, column, bins, transform),
        "histogram_by_class": profile.histogram(rows, column, bins, transform, [target]), "box": profile.box_statistics(rows, column, target), "ticks": profile.quantile_ticks(rows, column, transform),
    }


def axis_ticks(rows: DataFrame, column: str, keys: Sequence[str] = (), transform: str = "log1p", least: int = 5) -> DataFrame:
    """keys, ticks: of each group the ends and ticks of an axis of its finite values in a transformed space (axes.nonlinear_ticks)."""
    value = finite(F.col(f"`{column}`").cast("double"))
    held = rows.select(*keys, value.alias("__value")).where("__value is not null")
    quartiles = quantile_columns(held, keys, "__value", {"__low": 0.0, "__q1": 0.25, "__q2": 0.5, "__q3": 0.75, "__high": 1.0})

    def ticks(low: pd.Series, one: pd.Series, two: pd.Series, three: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([nonlinear_ticks(a, b, transform, q, least) for a, *q, b in zip(low, one, two, three, high, strict=True)])

    return quartiles.select(*keys, F.pandas_udf(ticks, "array<double>")("__low", "__q1", "__q2", "__q3", "__high").alias("ticks"))


def shown_metric(summary: DataFrame, metric: str) -> DataFrame:
    return summary.withColumn("shown", mean_std(F.col(f"{metric}_mean"), F.col(f"{metric}_std")))
