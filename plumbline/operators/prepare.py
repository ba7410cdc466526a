"""Preprocessing fitted on training rows and applied to any: imputation, one-hot columns, label codes."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import finite
from plumbline.operators.profile import long_form
from plumbline.operators.quantiles import exact_quantiles

#: Categories of all columns, or classes, that a fit takes to the driver; each category becomes a column.
MOST_CATEGORIES = 10_000


@dataclass(frozen=True)
class Preprocessor:
    """medians by numeric column; mode and sorted categories by categorical column."""

    medians: dict[str, float]
    modes: dict[str, str]
    categories: dict[str, tuple[str, ...]]

    @property
    def outputs(self) -> list[tuple[str, str]]:
        """(transformed, original) feature names in order."""
        return [(c, c) for c in self.medians] + [(f"{c}_{v}", c) for c, values in self.categories.items() for v in values]

    def columns(self) -> list[Column]:
        numeric = [F.coalesce(finite(F.col(f"`{c}`").cast("double")), F.lit(m)).alias(c) for c, m in self.medians.items()]
        filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(m)) for c, m in self.modes.items()}
        return numeric + [(filled[c] == v).cast("double").alias(f"{c}_{v}") for c, values in self.categories.items() for v in values]

    def transform(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """keep, and the transformed features; all other columns are dropped."""
        return rows.select(*keep, *self.columns())


def medians(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, median of the finite values, interpolated between two."""
    long = long_form(rows, [], columns, "double").withColumn("value", finite(F.col("value")))
    return exact_quantiles(long, ["feature"], "value", [0.5]).select("feature", F.col("quantile").alias("median"))


def modes(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, mode: the most frequent category, the first by name among equals."""
    counted = long_form(rows, [], columns, "string").where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    best = counted.groupBy("feature").agg(F.max("n").alias("most"))
    return counted.join(best, "feature").where("n = most").groupBy("feature").agg(F.min("value").alias("mode"))


def _few(values: DataFrame, most: int, what: str) -> list:
    """The distinct rows of values, which come to the driver; ValueError if there are more than most."""
    found = values.distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} {what}")
    return found


def whole_columns(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> set[str]:
    """The columns in which no row lacks a value, or a finite one: nothing is ever filled in there."""
    held = {c: finite(F.col(f"`{c}`").cast("double")) for c in numeric} | {c: F.col(f"`{c}`") for c in categorical}
    counts = rows.agg(F.lit(0), *(F.count_if(value.isNull()) for value in held.values())).first()
    return {c for c, n in zip(held, counts[1:], strict=True) if not n}


def fit(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], most: int = MOST_CATEGORIES, whole: Collection[str] = ()) -> Preprocessor:
    """Medians, modes and categories of training rows; columns without a finite value get 0. More than most categories in all raise.

    whole are columns without a missing value in any row that the fit is for: what would stand for one isn't sought, and is 0 or empty.
    """
    sought = [c for c in numeric if c not in whole]
    found = {r[0]: r[1] for r in medians(rows, sought).collect()} if sought else {}
    seen = _few(long_form(rows, [], categorical, "string").where("value is not null"), most, "categories") if categorical else []
    named = [c for c in categorical if c not in whole]
    frequent = {r[0]: r[1] for r in modes(rows, named).collect()} if named else {}
    return Preprocessor({c: found.get(c, 0.0) for c in numeric}, {c: frequent.get(c, "") for c in categorical}, {c: tuple(sorted(r[1] for r in seen if r[0] == c)) for c in categorical})


def classes_of(rows: DataFrame, target: str, most: int = MOST_CATEGORIES) -> list[str]:
    """The sorted labels that occur; more than most raise."""
    return sorted(r[0] for r in _few(rows.select(target).where(F.col(target).isNotNull()), most, "classes"))
