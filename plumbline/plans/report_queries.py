"""Queries of the report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.operators import ensemble, metrics, reporting, summaries
from plumbline.plans import fixtures as X
from plumbline.plans.evaluation_queries import _CONFIGS, _VOTES
from plumbline.plans.queries import query


@query(
    "rep_1_cross_validation",
    f"WITH {_CONFIGS} SELECT configuration_id, round(am, 5) AS accuracy_mean, round(ad, 5) AS accuracy_std, round(m, 5) AS macro_f1_mean, round(d, 5) AS macro_f1_std FROM g ORDER BY m DESC, d, configuration_id LIMIT 5",
)
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shown table, its texts read back."""
    shown = reporting.cross_validation(X.fold_metrics(spark, sf_dir), X.METRIC_COLUMNS, X.SEEDS)["shown"]
    parts = {f"{m}_{n}": part for m in X.METRIC_COLUMNS for n, part in zip(("mean", "std"), C.parsed_mean_std(F.col(m)), strict=True)}
    return shown.select("configuration_id", *[p.alias(n) for n, p in parts.items()])


_BY_NAME = """f AS (SELECT seed, {0}, c, 2 * sum(t)::DOUBLE / count(*) AS f1 FROM (SELECT seed, {0}, actual_class AS c, (actual_class = predicted_class)::INT AS t FROM {1} UNION ALL SELECT seed, {0}, predicted_class, 0 FROM {1}) GROUP BY 1, 2, 3),
s AS (SELECT * FROM (SELECT seed, {0}, avg((actual_class = predicted_class)::INT) AS accuracy FROM {1} GROUP BY 1, 2) JOIN (SELECT seed, {0}, avg(f1) AS macro_f1 FROM f GROUP BY 1, 2) USING (seed, {0}))"""


@query(
    "rep_2_test_evaluation",
    f"""WITH {X.PREDICTIONS_SQL}, {_BY_NAME.format("classifier", "predictions")},
t AS (SELECT seed, classifier, sum(row_index % 7)::DOUBLE AS training_s, sum(row_index % 5)::DOUBLE AS prediction_s, sum(row_index % 3)::DOUBLE AS probability_s, count(*) AS n FROM predictions GROUP BY 1, 2),
i AS (SELECT *, prediction_s + probability_s AS inference_s, (prediction_s + probability_s) / n * 100 AS inference_s_per_100 FROM t)
SELECT * FROM (SELECT classifier, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_std, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_samp(macro_f1), 6) AS macro_f1_std FROM s GROUP BY 1)
 JOIN (SELECT classifier, {', '.join(f'round(avg({m}), 6) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 6) AS {m}_std' for m in summaries.MEASURES)} FROM i GROUP BY 1) USING (classifier)""",
)
def test_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and times of three seeds for each classifier; times are sums of remainders of row numbers."""
    rows = X.predictions(spark, sf_dir)
    by = rows.groupBy("seed", "classifier")
    times = {name: F.sum(F.col("row_index") % k).cast("double").alias(name) for name, k in (("training_s", 7), ("prediction_s", 5), ("probability_s", 3))}
    asked = by.agg(times["prediction_s"], times["probability_s"], F.count("*").alias("n")).withColumn("inference_s", F.col("prediction_s") + F.col("probability_s")).withColumn("inference_s_per_100", F.col("inference_s") / F.col("n") * 100)
    found = reporting.test_evaluation(metrics.summary_metrics(rows, ["seed", "classifier"]), ["classifier"], X.METRIC_COLUMNS, by.agg(times["training_s"]), asked)
    return found["summary"].join(found["timing"].drop("n_seeds"), "classifier")


@query(
    "rep_3_importances",
    f"""WITH {X.IMPORTANCES_SQL}, o AS (SELECT seed, original_feature AS feature, sum(importance) AS importance FROM importances GROUP BY 1, 2),
s AS (SELECT feature, avg(importance) AS mean, coalesce(stddev_samp(importance), 0) AS std, max(importance) AS peak FROM o GROUP BY 1)
SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std, round(peak, 6) AS peak, row_number() OVER (ORDER BY peak DESC, feature) AS place FROM s QUALIFY place <= 8""",
)
def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.importance_summary(X.importances(spark, sf_dir), 8, len(X.SEEDS))


@query(
    "rep_4_committee_comparison",
    f"""WITH {_VOTES}, {_BY_NAME.format("classifier", "predictions")}, {_BY_NAME.format("strategy", "voted").replace("f AS", "g AS", 1).replace("FROM f ", "FROM g ").replace("s AS (SELECT *", "k AS (SELECT *")},
b AS (SELECT 'individual' AS kind, classifier AS name, avg(accuracy) AS am, stddev_samp(accuracy) AS ad, avg(macro_f1) AS m, stddev_samp(macro_f1) AS d FROM s9 GROUP BY 2
 UNION ALL SELECT 'committee', strategy, avg(accuracy), stddev_samp(accuracy), avg(macro_f1), stddev_samp(macro_f1) FROM k GROUP BY 2)
SELECT kind, name, round(am, 6) AS accuracy_mean, round(ad, 6) AS accuracy_std, round(m, 6) AS macro_f1_mean, round(d, 6) AS macro_f1_std, round(am - max(am) FILTER (kind = 'individual') OVER (), 6) AS accuracy_gain,
 round(m - max(m) FILTER (kind = 'individual') OVER (), 6) AS macro_f1_gain, row_number() OVER (ORDER BY CASE name WHEN 'soft_voting' THEN 1 WHEN 'c2' THEN 2 ELSE 3 END, name) AS position FROM b""".replace("s AS (SELECT * FROM (SELECT seed, classifier", "s9 AS (SELECT * FROM (SELECT seed, classifier"),
)
def committee_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.predictions(spark, sf_dir)
    voted = ensemble.votes(rows, ["seed", "row_index"], X.CLASSES, X.WEIGHTS)
    individual, committee = metrics.summary_metrics(rows, ["seed", "classifier"]), metrics.summary_metrics(voted, ["seed", "strategy"])
    return reporting.committee_comparison(individual, committee, X.METRIC_COLUMNS, ["soft_voting", "c2"])


@query(
    "rep_5_feature_inspection",
    """WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events), c AS (SELECT event_type, least(floor((value - a) / (b - a) * 20), 19)::INT AS bin, count(*) AS n FROM events, e GROUP BY 1, 2)
SELECT t.event_type, bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(20))::INT AS bin) CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN c USING (event_type, bin)""",
)
def feature_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.feature_inspection(X.table(spark, sf_dir, "events"), "value", "event_type")["histogram_by_class"].select("event_type", "bin", "n")


@query(
    "rep_3_feature_differences",
    f"""WITH {X.IMPORTANCES_SQL}, c AS (SELECT unnest(['c0', 'c1', 'c2']) AS classifier), i AS (SELECT DISTINCT original_feature, classifier FROM importances, c WHERE NOT (classifier = 'c1' AND original_feature IN ('Brand#11', 'Brand#23')) AND NOT (classifier = 'c2' AND original_feature = 'Brand#23'))
SELECT original_feature, count(*) AS n, array_to_string(list_sort(list_filter(['c0', 'c1', 'c2'], lambda x: NOT list_contains(list(classifier), x))), ', ') AS missing_in FROM i GROUP BY 1 HAVING count(*) < 3""",
)
def feature_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted: features that one or two of three classifiers lack."""
    rows = X.importances(spark, sf_dir).withColumn("classifier", F.explode(F.array(*map(F.lit, X.CLASSIFIERS))))
    return reporting.feature_differences(rows.where("NOT (classifier = 'c1' AND original_feature IN ('Brand#11', 'Brand#23')) AND NOT (classifier = 'c2' AND original_feature = 'Brand#23')"))


@query(
    "rep_5_inspection_tables",
    """WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events), g AS (SELECT event_type, value FROM events UNION ALL SELECT '<all>', value FROM events), h AS (SELECT least(floor((value - a) / (b - a) * 20), 19)::INT AS bin, count(*) AS n FROM events, e GROUP BY 1)
SELECT 'histogram' AS part, bin::VARCHAR AS name, coalesce(n, 0)::DOUBLE AS value FROM (SELECT unnest(range(20))::INT AS bin) LEFT JOIN h USING (bin)
UNION ALL SELECT 'box', event_type, round(quantile_cont(value, 0.5), 6) FROM g GROUP BY 2
UNION ALL SELECT DISTINCT 'ticks', NULL, round(unnest(list_distinct([quantile_cont(value, 0.25), quantile_cont(value, 0.5), quantile_cont(value, 0.75)])), 6) FROM events
UNION ALL SELECT 'statistics', 'std', round(stddev_samp(value), 6) FROM events""",
)
def inspection_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a feature's other tables their counts, medians and ticks."""
    found = reporting.feature_inspection(X.table(spark, sf_dir, "events"), "value", "event_type")
    rows = lambda part, name, value, table: table.select(F.lit(part).alias("part"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    parts = [
        rows("histogram", F.col("bin"), F.col("n"), found["histogram"]), rows("box", F.col("event_type"), F.col("median"), found["box"]),
        rows("ticks", F.lit(None), F.col("tick"), found["ticks"]), rows("statistics", F.col("statistic"), F.col("value"), found["statistics"].where("statistic = 'std'")),
    ]
    return reduce(DataFrame.unionByName, parts)


def nonlinear_ticks(spark: SparkSession, sf_dir: str, kind: str = "supplier", table: str = "lineitem", key: str = "l_suppkey", value: str = "l_extendedprice") -> DataFrame:
    """Ticks of the values of a table by a key, by default of prices by supplier."""
    lines = reporting.axis_ticks(X.table(spark, sf_dir, table).selectExpr(f"{key} AS id", f"{value} AS value"), "value", ["id"])
    return lines.select(F.lit(kind).alias("kind"), "id", F.posexplode("ticks").alias("place", "tick"))


@query("fn_11_nonlinear_ticks")
def all_nonlinear_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of prices by supplier and by part, of values by user: tests compare them with a plain version."""
    by = [("supplier", "lineitem", "l_suppkey", "l_extendedprice"), ("part", "lineitem", "l_partkey", "l_extendedprice"), ("user", "events", "user_id", "value")]
    return reduce(DataFrame.unionByName, [nonlinear_ticks(spark, sf_dir, *one) for one in by])
