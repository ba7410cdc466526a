"""Checks of result tables before they are used: each gives one row with the number of violations of each kind.

`faultless` raises on a row that counts any. Tables of weights, confusions and importances are
small; predictions and partitions may be of any size and are only aggregated and joined by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOLERANCE = 1e-9


def faultless(faults: DataFrame) -> None:
    """Raises if the one row of faults counts any."""
    found = {k: n for k, n in faults.first().asDict().items() if n}
    if found:
        raise ValueError("; ".join(f"{k}: {n}" for k, n in found.items()))


def _bad(value: Column) -> Column:
    """Missing, not finite or negative."""
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (value < 0)


def weight_faults(weights: DataFrame, keys: Sequence[str], classifiers: Sequence[str], metric: str) -> DataFrame:
    """Of weights (keys, classifier, weight and the metric they come from): classifiers that differ, bad numbers, sums that are not 1, weights that are not their share of the metric.

    `classifiers` counts groups whose set is another, `sums` groups, the others rows.
    """
    group = Window.partitionBy(*keys)
    each = weights.withColumn("__share", F.col(metric) / F.sum(metric).over(group)).withColumn("__off", F.abs(F.col("weight") - F.col("__share")) > TOLERANCE)
    expected = F.array(*map(F.lit, sorted(classifiers)))
    by_group = each.groupBy(*keys).agg(
        (F.array_sort(F.collect_list("classifier")) != expected).cast("long").alias("classifiers"),
        F.count_if(_bad(F.col("weight")) | _bad(F.col(metric))).alias("numbers"),
        (~F.coalesce(F.abs(F.sum("weight") - 1) <= TOLERANCE, F.lit(False))).cast("long").alias("sums"),
        F.count_if(F.coalesce("__off", F.lit(True))).alias("shares"),
    )
    return by_group.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("classifiers", "numbers", "sums", "shares")])


def confusion_faults(counts: DataFrame, shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of counts (keys, actual, predicted, n) and shares (keys, actual, predicted, share): matrices that are not square, cells that repeat, bad counts, shares that disagree.

    `square` counts matrices whose cells are not every pair of one set of labels.
    """
    matrix = counts.groupBy(*keys).agg(F.array_sort(F.collect_set("actual")).alias("rows"), F.array_sort(F.collect_set("predicted")).alias("columns"), F.count_distinct("actual", "predicted").alias("cells"))
    square = matrix.agg(F.count_if((F.col("rows") != F.col("columns")) | (F.size("rows") * F.size("columns") != F.col("cells"))).alias("square"))
    repeated = counts.groupBy(*keys, "actual", "predicted").agg(F.count("*").alias("times")).agg(F.count_if(F.col("times") > 1).alias("repeated"))
    n = F.col("n").cast("double")
    numbers = counts.agg(F.count_if(_bad(n) | (n != F.floor(n))).alias("numbers"))
    own = counts.withColumn("__share", F.coalesce(n / F.nullif(F.sum(n).over(Window.partitionBy(*keys, "actual")), F.lit(0.0)), F.lit(0.0)))
    cell = [*keys, "actual", "predicted"]
    both = own.select(*cell, "__share").join(shares.select(*cell, "share"), cell, "full_outer")
    disagree = both.agg(F.count_if(~F.coalesce(F.abs(F.col("share") - F.col("__share")) <= TOLERANCE, F.lit(False))).alias("disagree"))
    return _beside(square, repeated, numbers, disagree)


def identity_faults(artifacts: DataFrame) -> DataFrame:
    """Of artifacts (artifact, field, value), what each says it was made from: fields of several values, and fields that an artifact lacks."""
    n = artifacts.select("artifact").distinct().count()
    fields = artifacts.groupBy("field").agg(F.count_distinct("value").alias("values"), F.count_distinct("artifact").alias("artifacts"))
    return fields.agg(F.count_if(F.col("values") > 1).alias("differ"), F.coalesce(F.sum(F.lit(n) - F.col("artifacts")), F.lit(0)).cast("long").alias("lacking"))


def reuse_faults(completed: DataFrame, wanted: DataFrame, key: str, prediction: str, valid: str, sentinel: str, version: str | None = None) -> DataFrame:
    """Whether a finished prediction table answers exactly the wanted keys: lacking, other and repeated keys, and rows that break the sentinel rule.

    A row's prediction is the sentinel exactly where valid is false. Rows of completed whose version (a column of both
    tables, if it is given) isn't the wanted one don't count. Keys, versions and a flag of each row are shuffled, once.
    """
    ids = [key, version] if version else [key]
    broken = (F.col(prediction) == sentinel) == F.coalesce(F.col(valid), F.lit(False))
    held = completed.select(*ids, F.lit(1).alias("times"), F.coalesce(broken, F.lit(False)).cast("int").alias("broken"), F.lit(0).alias("asked"))
    rows = held.unionByName(wanted.select(*ids, F.lit(0).alias("times"), F.lit(0).alias("broken"), F.lit(1).alias("asked")))
    counts = [F.sum("times").alias("times"), F.sum("broken").alias("broken"), F.max("asked").alias("asked")]
    if version:
        rows = rows.repartition(key).groupBy(*ids).agg(*counts).where("asked = 1")
    there, asked, unknown = F.col("times") > 0, F.col("asked") > 0, F.col(key).isNull()  # a missing key answers none
    return rows.groupBy(key).agg(*counts).agg(
        F.count_if(asked & (~there | unknown)).alias("lacking"),
        F.count_if(there & (~asked | unknown)).alias("other"),
        F.count_if(F.col("times") > 1).alias("repeated"),
        F.coalesce(F.sum("broken"), F.lit(0)).cast("long").alias("sentinels"),
    )


def importance_faults(importances: DataFrame, seeds: Sequence[int], feature: str = "transformed_feature") -> DataFrame:
    """Of importances (seed, feature, importance): bad numbers, features that repeat within a seed, and features that lack a seed or have another."""
    expected = F.array(*[F.lit(s) for s in sorted(seeds)])
    each = importances.groupBy(feature, "seed").agg(F.count("*").alias("times"), F.count_if(_bad(F.col("importance"))).alias("bad"))
    by_feature = each.groupBy(feature).agg(F.sum("bad").alias("bad"), F.count_if(F.col("times") > 1).alias("repeated"), (F.array_sort(F.collect_set("seed")) != expected).cast("long").alias("seeds"))
    return by_feature.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("bad", "numbers"), ("repeated", "repeated"), ("seeds", "seeds"))])


def partition_faults(features: DataFrame, target: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Of a partition's features and target, both with a key: columns out of the schema's order, keys that are missing, repeat, or are on one side only, and emptiness."""
    order = sum(a != b for a, b in zip([c for c in features.columns if c != key], columns, strict=False)) + abs(len(features.columns) - 1 - len(columns))
    sides = [side.groupBy(key).agg(F.count("*").alias(n)) for side, n in ((features, "f"), (target, "t"))]
    both = sides[0].withColumn("k", F.col(key)).join(sides[1].withColumn("k", F.col(key)).drop(key), "k", "full_outer")
    missing = [side.where(F.col(key).isNull()).agg(F.count("*").alias(n)) for side, n in ((features, "mf"), (target, "mt"))]
    counted = both.where("k is not null").agg(
        F.count_if((F.col("f") > 1) | (F.col("t") > 1)).alias("repeated"), F.count_if(F.col("f").isNull() | F.col("t").isNull()).alias("unaligned"), (F.count("f") == 0).cast("long").alias("empty")
    )
    return _beside(*missing, counted).select(F.lit(order).cast("long").alias("columns"), (F.col("mf") + F.col("mt")).alias("missing"), "repeated", "unaligned", "empty")


def _beside(*rows: DataFrame) -> DataFrame:
    """One row of the columns of tables that have one row each."""
    keyed = [r.withColumn("__one", F.lit(1)) for r in rows]
    out = keyed[0]
    for other in keyed[1:]:
        out = out.join(other, "__one")
    return out.drop("__one")
