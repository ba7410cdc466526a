"""Integrity checks: each is an aggregate that counts violations; expect() runs them as one query and raises."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import finite


@dataclass(frozen=True)
class Expectation:
    """what is wrong if the aggregate violated is true."""

    what: str
    violated: Column


def expect(rows: DataFrame, *expectations: Expectation) -> DataFrame:
    """rows, if no expectation is violated; all are tested in one pass."""
    found = rows.agg(*[e.violated.alias(f"v{i}") for i, e in enumerate(expectations)]).first()
    broken = [e.what for e, bad in zip(expectations, found, strict=True) if bad]
    if broken:
        raise ValueError("; ".join(broken))
    return rows


def require_columns(rows: DataFrame, names: Sequence[str]) -> None:
    lacking = [n for n in names if n not in rows.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")


def outside_domain(rows: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Distinct values that a domain doesn't have; NULL is exempt."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*domain)).select(column).distinct()


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def out_of_range(column: str, low: float, high: float) -> Column:
    """How many values are missing, not finite or outside [low, high]."""
    value = F.col(column)
    return F.count_if(value.isNull() | F.isnan(value) | ~F.coalesce(value.between(low, high), F.lit(False)))


def not_whole(column: str) -> Column:
    """How many finite values have a fraction."""
    value = finite(F.col(column))
    return F.count_if(value != F.floor(value))


def bad_probabilities(columns: Sequence[str], tolerance: float = 1e-6) -> Column:
    """How many rows have a probability outside [0, 1], or probabilities that don't sum to 1."""
    cells = [F.col(f"`{c}`") for c in columns]
    total = sum(cells[1:], cells[0])
    inside = cells[0].between(0, 1)
    for cell in cells[1:]:
        inside = inside & cell.between(0, 1)
    return F.count_if(~F.coalesce(inside & (F.abs(total - 1) <= tolerance), F.lit(False)))


def expected_set(column: str, expected: Sequence) -> Column:
    """Whether the distinct values of a column are others than expected; only values among those are gathered."""
    known = F.col(column).isin(*expected)
    return (F.count_if(~F.coalesce(known, F.lit(False))) > 0) | (F.size(F.collect_set(F.when(known, F.col(column)))) != len(set(expected)))


def groups_without(rows: DataFrame, group: str, column: str, expected: int) -> DataFrame:
    """Groups that don't have exactly expected distinct values of column."""
    return rows.groupBy(group).agg(F.count_distinct(column).alias("n")).where(F.col("n") != expected)


def unequal(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], relative: float = 1e-10, absolute: float = 1e-12) -> DataFrame:
    """Keys that one side lacks, and rows whose values differ by more than the tolerance."""
    both = left.alias("l").join(right.alias("r"), list(keys), "full_outer")
    wrong = F.lit(False)
    for v in values:
        a, b = F.col(f"l.{v}"), F.col(f"r.{v}")
        near = F.abs(a - b) <= absolute + relative * F.abs(b)
        wrong = wrong | ~F.coalesce(near, a.isNull() & b.isNull())
    return both.where(wrong).select(*keys)
