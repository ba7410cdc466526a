"""Queries of the sampling, experiment and text-model operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import experiment, inference, prepare, sampling
from plumbline.plans import fixtures as X
from plumbline.plans.queries import query

SEED = 27
_DRAW = "md5('27:' || event_id)"


@query(
    "smp_1_stratified_sample",
    f"""WITH n AS (SELECT event_type, count(*) AS n, count(*) * 150 / (sum(count(*)) OVER ())::DOUBLE AS q FROM events GROUP BY 1),
a AS (SELECT event_type, n, greatest(floor(q), 1) AS base, q - floor(q) AS r FROM n),
k AS (SELECT event_type, base + CASE WHEN row_number() OVER (ORDER BY r DESC, n DESC, event_type) = 1 THEN 150 - (SELECT sum(base) FROM a) ELSE 0 END AS take FROM a)
SELECT event_id, event_type FROM events JOIN k USING (event_type) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_DRAW}, event_id) <= take""",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(X.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 150, SEED, "event_id")


@query(
    "smp_2_stratified_split",
    f"""WITH s AS (SELECT ceil(count(*) * 0.2)::BIGINT AS size, count(*) AS total FROM events), n AS (SELECT event_type, count(*) AS n, count(*) * any_value(size) / any_value(total)::DOUBLE AS q FROM events, s GROUP BY 1),
a AS (SELECT event_type, n, greatest(floor(q), 1) AS base, q - floor(q) AS r FROM n),
k AS (SELECT event_type, base + CASE WHEN row_number() OVER (ORDER BY r DESC, n DESC, event_type) = 1 THEN (SELECT size FROM s) - (SELECT sum(base) FROM a) ELSE 0 END AS take FROM a)
SELECT event_id, event_type, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY {_DRAW}, event_id) <= take THEN 'test' ELSE 'train' END AS split FROM events JOIN k USING (event_type)""",
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(X.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 0.2, SEED, "event_id")


@query("smp_3_folds", f"SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY {_DRAW}, event_id) - 1) % 3 + 1 AS fold FROM events")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.folds(X.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 3, SEED, "event_id")


@query(
    "smp_4_oversampled",
    f"""WITH n AS (SELECT event_type, count(*) AS n, max(count(*)) OVER () - count(*) AS lack FROM events GROUP BY 1),
d AS (SELECT event_type, n, unnest(range(1, lack + 1)) AS copy FROM n),
e AS (SELECT event_type, copy, ('0x' || substr(md5('27:' || event_type || ':' || copy), 1, 12))::BIGINT % n + 1 AS nth FROM d),
r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_DRAW}, event_id) AS nth FROM events)
SELECT event_id, event_type, 0 AS copy FROM events UNION ALL SELECT event_id, event_type, copy FROM e JOIN r USING (event_type, nth)""",
)
def oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.oversampled(X.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", SEED, "event_id")


@query(
    "smp_5_few_shot",
    f"""WITH c AS (SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_DRAW}, event_id) <= 4) SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, event_id) AS example FROM c""",
)
def few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.few_shot(X.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 4, SEED, "event_id")


@query(
    "chk_15_few_shot_checks",
    f"""WITH c AS (SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_DRAW}, event_id) <= 4),
e AS (SELECT CASE WHEN event_type = 'view' THEN -event_id - 1 ELSE event_id END AS event_id, event_type, row_number() OVER (ORDER BY event_type, event_id) AS example FROM c),
x AS (SELECT event_id, CASE WHEN example = 2 THEN 'signup' ELSE event_type END AS event_type, example FROM e UNION ALL SELECT * FROM e WHERE event_type = 'error'),
k AS (SELECT x.*, events.event_type AS t FROM x LEFT JOIN events ON x.event_id = events.event_id)
SELECT count(*) FILTER (t IS NULL OR t <> event_type) AS n_unknown, count(*) - count(DISTINCT event_id) AS n_repeated,
 (NOT (count(DISTINCT example) = count(*) AND min(example) = 1 AND max(example) = count(*)))::INT AS n_number_off, (SELECT count(*) FROM (SELECT 1 FROM k GROUP BY event_type HAVING count(*) > 4)) AS n_over_cap FROM k""",
)
def few_shot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of which the views are unknown rows, one has another class, and the errors stand twice."""
    rows = X.table(spark, sf_dir, "events").select("event_id", "event_type")
    chosen = sampling.few_shot(rows, "event_type", 4, SEED, "event_id")
    moved = chosen.selectExpr("CASE WHEN event_type = 'view' THEN -event_id - 1 ELSE event_id END AS event_id", "event_type", "example")
    planted = moved.selectExpr("event_id", "CASE WHEN example = 2 THEN 'signup' ELSE event_type END AS event_type", "example").unionByName(moved.where("event_type = 'error'"))
    return inference.check_examples(planted, rows, "event_type", 4, "event_id")


@query(
    "rsh_5_preprocessed",
    f"""WITH {X.DIRTY_SQL}, m AS (SELECT quantile_cont(dirty, 0.5) AS med FROM dirty_events WHERE isfinite(dirty) AND split = 'train')
SELECT event_id, round(CASE WHEN isfinite(dirty) THEN dirty ELSE med END, 6) AS dirty, {', '.join(f'''(event_type = '{c}')::INT::DOUBLE AS "event_type_{c}"''' for c in X.CLASSES)} FROM dirty_events, m WHERE split = 'test'""",
)
def preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.dirty_events(spark, sf_dir)
    return prepare.fit(rows.where("split = 'train'"), ["dirty"], ["event_type"]).transform(rows.where("split = 'test'"), ["event_id"])


@query(
    "llm_1_classification",
    """SELECT event_id AS row_index, CASE WHEN user_id % 11 = 10 THEN NULL ELSE CASE user_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' END END AS predicted_class,
 CASE WHEN user_id % 11 = 10 THEN 'request_failed: no answer' WHEN user_id % 5 = 3 THEN 'unrecognized_label' WHEN user_id % 5 = 4 THEN 'empty_response' END AS response_error, user_id % 11 <> 10 AND user_id % 5 < 3 AS response_valid FROM events WHERE event_id % 4 <> 0""",
)
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "events").withColumnRenamed("event_id", "row_index")
    asked = inference.prompts(inference.pending(rows, rows.where("row_index % 4 = 0")), {"user_id": "bigint", "event_type": "string"}, ["row_index"], [("user_id: 0", "click")])
    return inference.classify(asked, X.rule, X.CLASSES, in_flight=4).select("row_index", "predicted_class", "response_error", "response_valid")


@query("exp_7_cross_validation")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, with the default seeds and folds; the grid is a single configuration."""
    used = ["l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag"]
    rows = X.table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), *used)
    nth = F.row_number().over(Window.partitionBy("id").orderBy(*used))  # the three columns are not unique; rows that tie here are equal
    rows = rows.withColumn("id", F.concat_ws("-", "id", nth))
    grid = {"max_depth": [2], "min_samples_leaf": [5], "sampler": ["oversample"]}
    return experiment.cross_validate(rows, "decision_tree", grid, ["l_quantity", "l_extendedprice"], ["l_linestatus"], "l_returnflag", "id")
