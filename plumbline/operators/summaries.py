"""Summaries over seeds, folds and groups; rankings; importances; timing; digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from plumbline.functions.columns import domain_order, mean_std, ratio
from plumbline.operators.quantiles import quantile_columns


def spread(column: str) -> Column:
    """Sample standard deviation; 0 for a single value."""
    return F.coalesce(F.stddev_samp(column), F.when(F.count(column) > 0, 0.0))


def means(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def mean_and_std(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, <column>_mean, <column>_std."""
    return rows.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (spread, "std"))])


def shown(summary: DataFrame, columns: Sequence[str], digits: int = 5) -> DataFrame:
    """summary with each <column>_mean and _std as one text `mean ± std`."""
    return summary.select(*[c for c in summary.columns if not any(c in (f"{x}_mean", f"{x}_std") for x in columns)], *[mean_std(F.col(f"{c}_mean"), F.col(f"{c}_std"), digits).alias(c) for c in columns])


def group_statistics(rows: DataFrame, keys: Sequence[str], value: str, distinct: str) -> DataFrame:
    """keys, mean, std, n_distinct of another column."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), spread(value).alias("std"), F.count_distinct(distinct).alias("n_distinct"))


def configuration_table(seed_rows: DataFrame, seeds: Sequence[int], metric: str, columns: Sequence[str], key: str = "configuration_id") -> DataFrame:
    """key, seed_<s>_<metric> of each seed, and mean and std of columns over seeds."""
    own = [F.max(F.when(F.col("seed") == s, F.col(metric))).alias(f"seed_{s}_{metric}") for s in seeds]
    stats = [f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (spread, "std"))]
    return seed_rows.groupBy(key).agg(*own, *stats)


def ranked_configurations(table: DataFrame, metric: str, key: str = "configuration_id", limit: int | None = None) -> DataFrame:
    """Best mean first, then smallest std, then key; with limit only the first ones, without a full sort."""
    ordered = table.orderBy(F.desc(f"{metric}_mean"), F.asc(f"{metric}_std"), F.asc(key))
    return ordered.limit(limit) if limit else ordered


def best_row(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The whole row with the largest order of each group, by one aggregate."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__b")).select("__b.*")


def importance_levels(rows: DataFrame, keys: Sequence[str], transformed: str, original: str, value: str) -> DataFrame:
    """keys, level, feature, importance: transformed features as they are, and summed by original feature."""
    detail = rows.select(*keys, F.lit("transformed").alias("level"), F.col(transformed).alias("feature"), F.col(value).cast("double").alias("importance"))
    rolled = rows.groupBy(*keys, F.col(original).alias("feature")).agg(F.sum(value).alias("importance")).select(*keys, F.lit("original").alias("level"), "feature", "importance")
    return detail.unionByName(rolled)


def top_features(rows: DataFrame, feature: str, value: str, n: int) -> DataFrame:
    """The n features with the highest peak, highest first, then by name."""
    return rows.groupBy(feature).agg(F.max(value).alias("peak")).orderBy(F.desc("peak"), feature).limit(n)


def by_domain(rows: DataFrame, column: str, domain: Sequence[str], *then: Column | str) -> DataFrame:
    """rows in the order of a domain; position counts from 1.

    Rows are numbered within each place of the domain and after those of the places before, so that the values of a domain
    are numbered side by side; what is not in the domain is one place.
    """
    placed = rows.withColumn("__place", domain_order(F.col(column), domain))
    sizes = placed.groupBy("__place").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__place").rowsBetween(Window.unboundedPreceding, -1))  # a row for each place
    starts = sizes.select("__place", F.coalesce(before, F.lit(0)).alias("__start"))
    numbered = placed.withColumn("__nth", F.row_number().over(Window.partitionBy("__place").orderBy(*(then or [column]))))
    found = numbered.join(F.broadcast(starts), "__place")
    return found.select(*rows.columns, (F.col("__start") + F.col("__nth")).cast("int").alias("position"))


def constant_support(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], support: str = "support") -> DataFrame:
    """mean_and_std of columns, and support, which raises where it differs within keys."""
    stats = [f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (spread, "std"))]
    out = rows.groupBy(*keys).agg(*stats, F.min(support).alias("__lo"), F.max(support).alias("__hi"))
    return out.withColumn(support, F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(F.raise_error(F.lit("support is not constant")).cast("long"))).drop("__lo", "__hi")


def latency(rows: DataFrame, keys: Sequence[str], seconds: str, tokens: str) -> DataFrame:
    """keys, n, total, mean, p50, p95 and longest seconds, requests and tokens per second."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(seconds).alias("total_s"), F.avg(seconds).alias("mean_s"), F.max(seconds).alias("max_s"), F.sum(tokens).alias("total_tokens"))
    both = sums.join(quantile_columns(rows, keys, seconds, {"p50_s": 0.5, "p95_s": 0.95}), list(keys))
    return both.withColumns({"requests_per_s": ratio(F.col("n"), F.col("total_s")), "tokens_per_s": ratio(F.col("total_tokens"), F.col("total_s"))})


def id_digest(rows: DataFrame, key: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, digest: SHA-256 of the sorted ids, a line for each; null ids are left out.

    The ids of a group are sorted into one partition and go through the hash as they come, so that a task holds a batch of
    them and never the group. SHA-256 takes its input in order, so a group is one task's work; signatures.digests has an
    order-free digest that isn't.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    ids = rows.where(F.col(key).isNotNull()).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(key).alias("__id"))
    lines = ids.select(*names, "__id", F.col("__id").cast("string").alias("__line"))
    placed = (lines.repartition(*names) if names else lines.coalesce(1)).sortWithinPartitions(*names, "__id").select(*names, "__line")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        for batch in batches:
            keyed = batch.select(names) if names else None
            rows_of = keyed.to_pylist() if names else [{}] * batch.num_rows
            texts, low = batch.column(len(names)).to_pylist(), 0
            while low < len(texts):
                high = low + 1
                while high < len(texts) and rows_of[high] == rows_of[low]:
                    high += 1
                if held is None or rows_of[low] != group:
                    if held is not None:
                        yield ended(group, held)
                    group, held = rows_of[low], hashlib.sha256()
                held.update("".join(f"{t}\n" for t in texts[low:high]).encode())
                low = high
        if held is not None:
            yield ended(group, held)

    schema = placed.select(*names).schema.add("digest", "string")
    arrow = to_arrow_schema(schema)

    def ended(group: dict, held) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{**group, "digest": held.hexdigest()}], arrow)

    return placed.mapInArrow(hashed, schema).withColumnsRenamed(dict(zip(names, keys, strict=True)))


def pairwise_differences(summary: DataFrame, name: str, value: str) -> DataFrame:
    """name_a, name_b, difference of every pair of rows of a summary; a theta join of a table with a row for each name."""
    a, b = summary.select(F.col(name).alias("name_a"), F.col(value).alias("__a")), summary.select(F.col(name).alias("name_b"), F.col(value).alias("__b"))
    return a.join(b, F.col("name_a") < F.col("name_b")).select("name_a", "name_b", (F.col("__a") - F.col("__b")).alias("difference"))


def seed_comparison(validation: DataFrame, test: DataFrame, metrics: Sequence[str], key: str = "seed") -> DataFrame:
    """The one-to-one join of validation and test metrics, with suffixes and the drop from one to the other.

    Repeated keys, and keys of one side only, raise.
    """
    side = lambda rows, s: rows.groupBy(key).agg(*[F.max(m).alias(f"{m}_{s}") for m in metrics], F.count("*").alias(f"__{s}"))
    both = side(validation, "validation").join(side(test, "test"), key, "full_outer")
    fault = F.coalesce((F.col("__validation") != 1) | (F.col("__test") != 1), F.lit(True))
    checked = F.when(fault, F.raise_error(F.concat(F.lit(f"{key} is not one to one: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    out = both.where(checked)
    return out.select(key, *[c for m in metrics for c in (f"{m}_validation", f"{m}_test")], *[(F.col(f"{m}_validation") - F.col(f"{m}_test")).alias(f"{m}_drop") for m in metrics])


def pivoted(rows: DataFrame, keys: Sequence[str], column: str, values: Sequence, value: str) -> DataFrame:
    """A column for each of values, in that order."""
    return rows.groupBy(*keys).pivot(column, list(values)).agg(F.first(value))


def melted(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return rows.unpivot(list(keys), list(columns), name, value)


def one_hot(rows: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """rows plus <column>_<category> of each category, 0 or 1; unknown and missing values have all 0."""
    return rows.withColumns({f"{column}_{c}": F.coalesce((F.col(column) == c).cast("int"), F.lit(0)) for c in categories})


def timing_checks(rows: DataFrame, parts: Mapping[str, Sequence[str]], per: tuple[str, str, str]) -> DataFrame:
    """n_negative, n_sum_off (totals that are not the sum of their parts) and n_ratio_off (of (rate, total, rows), a rate for 100 rows)."""
    negative, off = F.lit(False), F.lit(False)
    for total, names in parts.items():
        sums = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        off = off | (F.abs(F.col(total) - sums) > 1e-9)
        for n in (total, *names):
            negative = negative | ~(F.col(n) >= 0)
    rate, total, n = per
    wrong = F.abs(F.col(rate) - F.col(total) / F.col(n) * 100) > 1e-9
    return rows.agg(F.count_if(negative).alias("n_negative"), F.count_if(off).alias("n_sum_off"), F.count_if(wrong).alias("n_ratio_off"))


def supports(rows: DataFrame, column: str, support: str = "support") -> DataFrame:
    """Each class with its support, once, largest first and then by name; a class with two supports has two rows."""
    return rows.select(column, support).distinct().orderBy(F.desc(support), column)


def throughput(rows: DataFrame, keys: Sequence[str], started: str, seconds: str, tokens: str) -> DataFrame:
    """keys, n, busy_s, wall_s (first start to last end), in_flight (busy by wall), requests and tokens per wall second, wall seconds for 100 rows; 0 where the wall is 0."""
    begin = F.unix_micros(F.col(started).cast("timestamp")).cast("double")
    wall = (F.max(begin + F.col(seconds) * 1e6) - F.min(begin)) / 1e6
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(seconds).alias("busy_s"), wall.alias("wall_s"), F.sum(tokens).alias("__tokens"))
    rates = {"in_flight": "busy_s", "requests_per_wall_s": "n", "tokens_per_wall_s": "__tokens"}
    out = sums.withColumns({name: ratio(F.col(part), F.col("wall_s")) for name, part in rates.items()})
    return out.withColumn("wall_s_per_100", ratio(F.col("wall_s"), F.col("n")) * 100).drop("__tokens")


MEASURES = ("training_s", "prediction_s", "probability_s", "inference_s", "inference_s_per_100")


def timing_table(training: DataFrame, inference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_seeds, <measure>_mean and _std of MEASURES over seeds. A seed of one table only, or twice in one, raises."""
    by = [*keys, "seed"]
    fits = training.groupBy(*by).agg(F.max(MEASURES[0]).alias(MEASURES[0]), F.count("*").alias("__fits"))
    runs = inference.groupBy(*by).agg(*[F.max(m).alias(m) for m in MEASURES[1:]], F.count("*").alias("__runs"))
    fault = F.coalesce((F.col("__fits") != 1) | (F.col("__runs") != 1), F.lit(True))
    checked = F.when(fault, F.raise_error(F.concat(F.lit("training and inference are not one to one in seed "), F.col("seed").cast("string")))).otherwise(F.lit(True))
    both = fits.join(runs, by, "full_outer").where(checked)
    stats = [f(m).alias(f"{m}_{n}") for m in MEASURES for f, n in ((F.avg, "mean"), (spread, "std"))]
    return both.groupBy(*keys).agg(F.count("*").alias("n_seeds"), *stats)
