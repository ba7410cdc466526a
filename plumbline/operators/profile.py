"""Dataset and feature profiles: one pass per kind of statistic over all columns at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.columns import TRANSFORMS, domain_order, finite, infinite, missing, ratio
from plumbline.operators.quantiles import exact_quantiles, quantile_columns
from plumbline.schema import Role, Schema, Semantic
from plumbline.sources.paths import scratch

MISSING = "<missing>"
PERCENTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def overview(rows: DataFrame, schema: Schema, split: str = "split") -> DataFrame:
    """Rows per split, with the schema's column and role counts and target."""
    counts = {f"{role.value}_columns": len(schema.of_role(role)) for role in Role}
    return rows.groupBy(split).agg(F.count("*").alias("n_rows")).withColumns(
        {"n_columns": F.lit(len(schema.features)), **{k: F.lit(v) for k, v in counts.items()}, "target": F.lit(schema.target.label)}
    )


def long_form(rows: DataFrame, keys: Sequence[str], columns: Mapping[str, Column] | Sequence[str], kind: str) -> DataFrame:
    """keys, feature, value: a row for each column, cast to kind."""
    named = columns if isinstance(columns, Mapping) else {c: F.col(f"`{c}`") for c in columns}
    cells = F.array(*[F.struct(F.lit(name).alias("feature"), value.cast(kind).alias("value")) for name, value in named.items()])
    return rows.select(*keys, F.explode(cells).alias("__cell")).select(*keys, "__cell.feature", "__cell.value")


def value_counts(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, feature, category (NULL as <missing>), n, share of the feature's rows in its keys."""
    counted = long_form(rows, keys, columns, "string").groupBy(*keys, "feature", F.coalesce("value", F.lit(MISSING)).alias("category")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*keys, "feature"))
    return counted.withColumn("share", F.col("n") / whole)


def target_distribution(rows: DataFrame, target: str, split: str = "split") -> DataFrame:
    return value_counts(rows, [split], [target]).drop("feature")


def data_quality(rows: DataFrame, keys: Sequence[str], columns: Mapping[str, bool]) -> DataFrame:
    """keys, feature, n_missing, missing_share, n_infinite of every column (name -> whether numeric): one aggregate."""
    totals = [F.count("*").alias("__n")]
    for i, (name, numeric) in enumerate(columns.items()):
        value = F.col(f"`{name}`")
        totals += [F.count_if(missing(value, numeric)).alias(f"__m{i}"), (F.count_if(infinite(value)) if numeric else F.lit(0).cast("long")).alias(f"__i{i}")]
    wide = rows.groupBy(*keys).agg(*totals)
    cells = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(f"__m{i}").alias("n_missing"), F.col(f"__i{i}").alias("n_infinite")) for i, name in enumerate(columns)])
    long = wide.select(*keys, "__n", F.explode(cells).alias("c"))
    return long.select(*keys, "c.feature", "c.n_missing", ratio(F.col("c.n_missing"), F.col("__n")).alias("missing_share"), "c.n_infinite")


def numeric_profile(rows: DataFrame, keys: Sequence[str], columns: Mapping[str, Column] | Sequence[str], sample: bool = False) -> DataFrame:
    """keys, feature, min, max, mean, std and percentiles of finite values; features without any are left out.

    std is of the population, or with sample of the sample (NULL for one value).
    """
    long = long_form(rows, keys, columns, "double").withColumn("value", finite(F.col("value"))).where("value is not null")
    by = [*keys, "feature"]
    std = F.stddev_samp("value") if sample else F.stddev_pop("value")
    moments = long.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), std.alias("std"))
    return moments.join(quantile_columns(long, by, "value", PERCENTILES), by)


def feature_statistics(rows: DataFrame, column: str) -> DataFrame:
    """(statistic, value) of one numeric feature: missing, infinite, the range as text, sample std and percentiles."""
    value = F.col(f"`{column}`").cast("double")
    counts = rows.agg(F.count_if(missing(value, True)).alias("missing"), F.count_if(infinite(value)).alias("infinite")).withColumn("feature", F.lit(column))
    whole = numeric_profile(rows, [], [column], sample=True).join(counts, "feature")
    text = lambda c: F.round(F.col(c), 6).cast("string")
    shown = {"missing": F.col("missing").cast("string"), "infinite": F.col("infinite").cast("string"), "range": F.concat(F.lit("["), text("min"), F.lit(", "), text("max"), F.lit("]")), "std": text("std")}
    shown |= {name: text(name) for name in PERCENTILES}
    return whole.select(F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), v.alias("value")) for k, v in shown.items()])).alias("s")).select("s.*")


def ordered_categories(rows: DataFrame, column: str, domain: Sequence[str] = ()) -> DataFrame:
    """category, n, position: categories that occur, in the order of the domain, or by name; missing values raise."""
    checked = F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{column} has missing values")).cast("string")).otherwise(F.col(column).cast("string"))
    counted = rows.groupBy(checked.alias("category")).agg(F.count("*").alias("n"))
    order = domain_order(F.col("category"), domain) if domain else F.lit(0)
    return counted.withColumn("position", F.row_number().over(Window.orderBy(order, "category")))


def datetime_profile(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, feature, min, max, n_missing, n_distinct."""
    long = long_form(rows, keys, columns, "timestamp_ntz")
    return long.groupBy(*keys, "feature").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.count_distinct("value").alias("n_distinct")
    )


def dataset_cells(rows: DataFrame, schema: Schema, split: str = "split") -> DataFrame:
    """split, feature, category, n, n_missing, n_infinite, min, max, mean, std, first, last: all that one scan tells of a dataset.

    Each column of a row is a cell, and cells are grouped once: of a numeric feature all together, of any other by
    category (a date's is its text). A cell without feature stands for the row.
    """
    cells = [F.struct(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(False).alias("gone"), F.lit(False).alias("endless"))]
    for f in schema.features:
        value, numeric, dated = F.col(f"`{f.label}`"), f.semantic is Semantic.NUMERIC, f.semantic is Semantic.DATETIME
        cells.append(
            F.struct(
                F.lit(f.label).alias("feature"),
                (F.lit(None).cast("string") if numeric else value.cast("string") if dated else F.coalesce(value.cast("string"), F.lit(MISSING))).alias("category"),
                (finite(value.cast("double")) if numeric else F.lit(None).cast("double")).alias("v"),
                (value.cast("timestamp_ntz") if dated else F.lit(None).cast("timestamp_ntz")).alias("at"),
                missing(value, numeric).alias("gone"),
                (infinite(value) if numeric else F.lit(False)).alias("endless"),
            )
        )
    each = rows.select(split, F.explode(F.array(*cells)).alias("c")).select(split, "c.*")
    return each.groupBy(split, "feature", "category").agg(
        F.count("*").alias("n"), F.count_if("gone").alias("n_missing"), F.count_if("endless").alias("n_infinite"), F.count("v").alias("n_finite"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("at").alias("first"), F.max("at").alias("last"),
    )


def dataset_statistics(rows: DataFrame, schema: Schema, split: str = "split", percentiles: bool = True) -> dict[str, DataFrame]:
    """All dataset tables: overview, target, inventory, quality, numeric, binary, categorical, datetime.

    They are cut from dataset_cells, which is computed once, in one scan of rows, into a table in the shared folder. Exact
    percentiles of numeric features can't come from it; unless they are left out, exact_quantiles scans rows again.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "cells")
    dataset_cells(rows, schema, split).write.parquet(path)
    held = spark.read.parquet(path)
    of = lambda labels: held.where(F.col("feature").isin(labels))
    labels = lambda *kinds: [f.label for f in schema.of_semantic(*kinds) if f.role is not Role.TARGET]
    numeric, binary, categorical, dates = (labels(k) for k in (Semantic.NUMERIC, Semantic.BINARY, Semantic.CATEGORICAL, Semantic.DATETIME))
    counts = {f"{role.value}_columns": len(schema.of_role(role)) for role in Role}
    totals = held.where("feature is null").select(split, F.col("n").alias("n_rows"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(split, "feature"))
    by_feature = of([f.label for f in schema.features]).groupBy(split, "feature").agg(F.sum("n_missing").alias("n_missing"), F.sum("n_infinite").alias("n_infinite"))
    out = {
        "overview": totals.withColumns({"n_columns": F.lit(len(schema.features)), **{k: F.lit(v) for k, v in counts.items()}, "target": F.lit(schema.target.label)}),
        "target": of([schema.target.label]).withColumn("share", share).select(split, "category", "n", "share"),
        "inventory": spark.createDataFrame(schema.inventory(), "position int, label string, name string, data_type string, semantic string, role string, domain_size int"),
        "quality": by_feature.join(totals, split).select(split, "feature", "n_missing", ratio(F.col("n_missing"), F.col("n_rows")).alias("missing_share"), "n_infinite"),
    }
    if numeric:
        moments = of(numeric).where("n_finite > 0").select(split, "feature", F.col("n_finite").alias("n"), "min", "max", "mean", "std")
        if percentiles:
            long = long_form(rows, [split], numeric, "double").withColumn("value", finite(F.col("value"))).where("value is not null")
            moments = moments.join(quantile_columns(long, [split, "feature"], "value", PERCENTILES), [split, "feature"])
        out["numeric"] = moments
    for name, columns in (("binary", binary), ("categorical", categorical)):
        if columns:
            out[name] = of(columns).withColumn("share", share).select(split, "feature", "category", "n", "share")
    if dates:
        out["datetime"] = of(dates).groupBy(split, "feature").agg(F.min("first").alias("min"), F.max("last").alias("max"), F.sum("n_missing").alias("n_missing"), F.count("category").alias("n_distinct"))
    return out


def crosstab(rows: DataFrame, row: str, column: str, row_domain: Sequence[str], column_domain: Sequence[str]) -> DataFrame:
    """A row for each value of row_domain, a column for each of column_domain, 0 where none occur."""
    counted = rows.groupBy(row).pivot(column, list(column_domain)).agg(F.count(F.lit(1)))
    every = rows.sparkSession.createDataFrame([(v,) for v in row_domain], f"{row} string")
    return every.join(counted, row, "left").na.fill(0)


def histogram_edges(rows: DataFrame, column: str, bins: int, transform: str = "linear", margin: float = 0.5, share: float = 0.05) -> DataFrame:
    """bin (from 0), low, high: equal widths in the transformed space of the finite values, taken back.

    A single value gets one bin around it: margin to both sides, and in other than linear space share of it if that is more.
    """
    forward, back = TRANSFORMS[transform]
    value = finite(F.col(f"`{column}`").cast("double"))
    ends = rows.agg(F.min(value).alias("a"), F.max(value).alias("b")).where("a is not null")
    wide = F.lit(margin) if transform == "linear" else F.greatest(F.lit(margin), F.abs(F.col("a")) * share)
    low, high = forward(F.col("a")), forward(F.col("b"))
    i = F.col("bin")
    at = lambda k: F.when(k == 0, F.col("a")).when(k == bins, F.col("b")).otherwise(back(low + (high - low) * k / bins))
    n = F.when(F.col("a") == F.col("b"), F.lit(1)).otherwise(F.lit(bins))
    split = ends.select("a", "b", F.explode(F.sequence(F.lit(0), n - 1)).alias("bin"))
    single = F.col("a") == F.col("b")
    return split.select("bin", F.when(single, F.col("a") - wide).otherwise(at(i)).alias("low"), F.when(single, F.col("b") + wide).otherwise(at(i + 1)).alias("high"))


def histogram(rows: DataFrame, column: str, bins: int, transform: str = "linear", keys: Sequence[str] = ()) -> DataFrame:
    """keys, bin, low, high, n of finite values; edges are shared by all keys, the last bin holds the maximum, empty bins count 0."""
    forward, _ = TRANSFORMS[transform]
    edges = histogram_edges(rows, column, bins, transform)
    value = finite(F.col(f"`{column}`").cast("double"))
    ends = rows.agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    low, high = forward(F.col("__a")), forward(F.col("__b"))
    at = F.when(F.col("__a") == F.col("__b"), F.lit(0)).otherwise(F.least(F.floor((forward(F.col("__v")) - low) / (high - low) * bins), F.lit(bins - 1)))
    placed = rows.select(*keys, value.alias("__v"), F.lit(1).alias("__one")).where("__v is not null").join(F.broadcast(ends.withColumn("__one", F.lit(1))), "__one")
    counted = placed.groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = edges.withColumn("__one", F.lit(1))
    if keys:
        every = every.join(rows.select(*keys).distinct().withColumn("__one", F.lit(1)), "__one")
    return every.drop("__one").join(counted, [*keys, "bin"], "left").na.fill(0, ["n"]).select(*keys, "bin", "low", "high", "n")


def _boxed(rows: DataFrame, column: str, group: str, everything: str) -> DataFrame:
    """group (and everything), value, q1, median, q3 and inside (within 1.5 IQR) of every finite value."""
    value = finite(F.col(f"`{column}`").cast("double"))
    base = rows.select(F.col(group).cast("string").alias(group), value.alias("value")).where("value is not null")
    both = base.select(F.explode(F.array(F.col(group), F.lit(everything))).alias(group), "value")
    quartiles = quantile_columns(both, [group], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    quartiles = quartiles.withColumnRenamed(group, "__group")
    joined = both.join(F.broadcast(quartiles), F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
    return joined.withColumn("inside", inside)


def box_statistics(rows: DataFrame, column: str, group: str, everything: str = "<all>") -> DataFrame:
    """group (and everything), n, q1, median, q3, whiskers (furthest values within 1.5 IQR) and n_outside."""
    inside = F.col("inside")
    return _boxed(rows, column, group, everything).groupBy(group, "q1", "median", "q3").agg(
        F.count("*").alias("n"), F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.count_if(~inside).alias("n_outside")
    )


def fliers(rows: DataFrame, column: str, group: str, everything: str = "<all>") -> DataFrame:
    """group (and everything), value, n: the values outside the whiskers of box_statistics, each once with its number."""
    return _boxed(rows, column, group, everything).where(~F.col("inside")).groupBy(group, "value").agg(F.count("*").alias("n"))


def quantile_ticks(rows: DataFrame, column: str, transform: str = "linear") -> DataFrame:
    """The distinct quartiles of the transformed finite values, in order."""
    forward, _ = TRANSFORMS[transform]
    values = rows.select(forward(finite(F.col(f"`{column}`").cast("double"))).alias("value"))
    return exact_quantiles(values, [], "value", [0.25, 0.5, 0.75]).select(F.col("quantile").alias("tick")).distinct().orderBy("tick")


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """n_rows, n_distinct, n_duplicates; NULLs equal each other, and so do NaNs."""
    groups = rows.groupBy(*[f"`{c}`" for c in rows.columns]).agg(F.count("*").alias("__n"))
    return groups.agg(F.sum("__n").alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))
