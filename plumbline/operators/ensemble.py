"""Voting over several classifiers' predictions, their diversity, and what the vote corrects.

Predictions are in long form: keys (seed, row_index ...), classifier, actual_class, predicted_class and probabilities, an
array in the order of classes. All strategies come from one grouping by keys.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import ratio

STRATEGIES = ("hard_voting", "weighted_hard_voting", "soft_voting", "weighted_soft_voting")
#: Decimal places to which votes and tie-breaking probabilities count as different.
PLACES = 12

_PROBABILITY = re.compile(r"probability_(\d+)_(.*)")


def probability_classes(columns: Sequence[str]) -> list[str]:
    """The classes named by probability_<i>_<label> columns, in order; indices are without gaps, labels unique."""
    found = sorted((int(m[1]), m[2]) for c in columns if (m := _PROBABILITY.fullmatch(c)))
    labels = [label for _, label in found]
    if not found or [i for i, _ in found] != list(range(len(found))) or len(set(labels)) != len(labels):
        raise ValueError("probability columns are missing, have gaps or repeat a label")
    return labels


def long_predictions(rows: DataFrame) -> DataFrame:
    """rows of probability_<i>_<label> columns with these as probabilities, an array in the order of classes."""
    names = [f"probability_{i}_{c}" for i, c in enumerate(probability_classes(rows.columns))]
    return rows.withColumn("probabilities", F.array(*(F.col(f"`{n}`") for n in names))).drop(*names)


def weights_of(metric: DataFrame, value: str) -> DataFrame:
    """metric plus weight: value over the sum of all; a table of a row for each classifier."""
    from pyspark.sql.window import Window

    return metric.withColumn("weight", F.col(value) / F.sum(value).over(Window.partitionBy()))


def _weight(weights: Mapping[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, w in weights.items():
        out = F.when(F.col("classifier") == name, F.lit(float(w))).otherwise(out)
    return out


def votes(rows: DataFrame, keys: Sequence[str], classes: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """keys, actual_class, strategy, predicted_class, scores (array by class).

    Hard votes tie-break by the larger mean probability, and all ties end with the first class.
    """
    n, w = len(classes), _weight(weights)
    each = lambda make: F.array(*[make(i).alias(f"x{i}") for i in range(n)])
    at = F.array_position(F.array(*map(F.lit, classes)), F.col("predicted_class")) - 1
    vote = lambda i: (at == i).cast("double")
    p = lambda i: F.get("probabilities", F.lit(i))
    scored = rows.groupBy(*keys, "actual_class").agg(
        each(lambda i: F.avg(vote(i))).alias("hard_voting"), each(lambda i: F.sum(w * vote(i))).alias("weighted_hard_voting"),
        each(lambda i: F.avg(p(i))).alias("soft_voting"), each(lambda i: F.sum(w * p(i))).alias("weighted_soft_voting"),
    )
    cells = []
    for name in STRATEGIES:
        place = F.array(*[
            F.struct(
                F.round(F.get(name, F.lit(i)), PLACES).alias("score"),
                (F.round(F.get("soft_voting", F.lit(i)), PLACES) if "hard" in name else F.lit(0.0)).alias("tie"),
                F.lit(-i).alias("order"),
            )
            for i in range(n)
        ])
        best = F.get(F.array(*map(F.lit, classes)), -F.array_max(place)["order"])
        cells.append(F.struct(F.lit(name).alias("strategy"), best.alias("predicted_class"), F.col(name).alias("scores")))
    return scored.select(*keys, "actual_class", F.explode(F.array(*cells)).alias("c")).select(*keys, "actual_class", "c.*")


def _distinct(column: str) -> Column:
    """How many values a key's few predictions have; unlike count(DISTINCT) it doesn't repeat their rows for each column."""
    return F.size(F.collect_set(column)).cast("long")


def aligned(rows: DataFrame, keys: Sequence[str], classifiers: int) -> DataFrame:
    """Keys that not exactly classifiers predictions have, or whose actual class they disagree on; empty if all is well."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), _distinct("classifier").alias("n_classifiers"), _distinct("actual_class").alias("n_actual"))
    return counts.where((F.col("n") != classifiers) | (F.col("n_classifiers") != classifiers) | (F.col("n_actual") != 1))


def diversity(rows: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """group, classifier_a, classifier_b, n, disagreement, double_fault, error_jaccard of every pair.

    The predictions of a key are collected (one for each classifier) and paired inside the row, so no self-join is needed.
    """
    one = F.struct("classifier", "predicted_class", (F.col("predicted_class") != F.col("actual_class")).alias("wrong"))
    sets = rows.groupBy(*group, *keys).agg(F.sort_array(F.collect_list(one)).alias("all"))
    a = sets.select(*group, F.posexplode("all").alias("i", "a"), "all")
    pairs = a.select(*group, "a", F.explode(F.slice("all", F.col("i") + 2, F.greatest(F.size("all") - F.col("i") - 1, F.lit(0)))).alias("b"))
    both, either = F.col("a.wrong") & F.col("b.wrong"), F.col("a.wrong") | F.col("b.wrong")
    return pairs.groupBy(*group, F.col("a.classifier").alias("classifier_a"), F.col("b.classifier").alias("classifier_b")).agg(
        F.count("*").alias("n"), F.avg((F.col("a.predicted_class") != F.col("b.predicted_class")).cast("double")).alias("disagreement"),
        F.avg(both.cast("double")).alias("double_fault"), ratio(F.count_if(both), F.count_if(either), 1.0).alias("error_jaccard"),
    )


def corrections(voted: DataFrame, rows: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """group, strategy, n and counts and rates of: right where all are wrong, wrong where all are right, right where any is wrong.

    Both sides have a row or more for each key, so neither is broadcast, whatever it is estimated at.
    """
    wrong = F.col("predicted_class") != F.col("actual_class")
    parts = rows.groupBy(*group, *keys).agg(F.bool_and(wrong).alias("all_wrong"), F.bool_or(wrong).alias("any_wrong"))
    right = ~wrong
    joined = voted.join(parts.hint("merge"), [*group, *keys])
    counts = {"right_where_all_wrong": right & F.col("all_wrong"), "wrong_where_all_right": wrong & ~F.col("any_wrong"), "right_where_any_wrong": right & F.col("any_wrong")}
    out = joined.groupBy(*group, "strategy").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    return out.withColumns({f"{k}_rate": F.col(k) / F.col("n") for k in counts})


def disagreement_matrix(pairs: DataFrame, classifiers: Sequence[str], value: str = "disagreement") -> DataFrame:
    """A row and a column for each classifier, the mean of value over seeds in both triangles."""
    swapped = pairs.select(F.col("classifier_b").alias("classifier_a"), F.col("classifier_a").alias("classifier_b"), value)
    both = pairs.select("classifier_a", "classifier_b", value).unionByName(swapped)
    return both.groupBy("classifier_a").pivot("classifier_b", list(classifiers)).agg(F.avg(value))
