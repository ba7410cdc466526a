"""Queries of the artifact checks, over tables with planted faults that the SQL counts again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import artifacts
from plumbline.plans import fixtures as X
from plumbline.plans.queries import query

P = X.PREDICTIONS_SQL

# Seed 32 has a weight too large, seed 59 lacks c2.
_WEIGHT = "accuracy / total + CASE WHEN seed = 32 AND classifier = 'c1' THEN CAST(0.125 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


@query(
    "chk_11_weights",
    f"""WITH {P}, a AS (SELECT seed, classifier, avg((actual_class = predicted_class)::INT)::DOUBLE AS accuracy FROM predictions GROUP BY 1, 2),
w AS (SELECT seed, classifier, accuracy, {_WEIGHT} AS weight FROM (SELECT *, sum(accuracy) OVER (PARTITION BY seed) AS total FROM a) WHERE NOT (seed = 59 AND classifier = 'c2')),
s AS (SELECT *, accuracy / sum(accuracy) OVER (PARTITION BY seed) AS share FROM w),
g AS (SELECT seed, (list_sort(list(classifier)) <> ['c0', 'c1', 'c2'])::INT AS classifiers, count(*) FILTER (weight < 0 OR accuracy < 0) AS numbers,
 (abs(sum(weight) - 1) > 1e-9)::INT AS sums, count(*) FILTER (abs(weight - share) > 1e-9) AS shares FROM s GROUP BY 1)
SELECT sum(classifiers)::BIGINT AS classifiers, sum(numbers)::BIGINT AS numbers, sum(sums)::BIGINT AS sums, sum(shares)::BIGINT AS shares FROM g""",
)
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    accuracy = X.predictions(spark, sf_dir).groupBy("seed", "classifier").agg(F.avg((F.col("actual_class") == F.col("predicted_class")).cast("int")).alias("accuracy"))
    totals = accuracy.groupBy("seed").agg(F.sum("accuracy").alias("total"))
    planted = accuracy.join(totals, "seed").selectExpr("seed", "classifier", "accuracy", f"{_WEIGHT} AS weight").where("not (seed = 59 and classifier = 'c2')")
    return artifacts.weight_faults(planted, ["seed"], X.CLASSIFIERS, "accuracy")


_CELLS = "seed <> 'c2-59' OR predicted_class <> 'view'"
_COUNT = "CASE WHEN seed = 'c2-27' AND actual_class = 'click' AND predicted_class = 'click' THEN -n WHEN seed = 'c1-32' AND actual_class = 'error' THEN n + CAST(0.5 AS DOUBLE) ELSE n END"


@query(
    "chk_12_confusion_matrices",
    f"""WITH {P}, n AS (SELECT classifier || '-' || seed AS seed, actual_class, predicted_class, count(*)::DOUBLE AS n FROM predictions GROUP BY 1, 2, 3),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY seed, actual_class) AS share FROM n),
c AS (SELECT seed, actual_class, predicted_class, {_COUNT} AS n FROM n WHERE {_CELLS}),
m AS (SELECT seed, list_sort(list(DISTINCT actual_class)) AS r, list_sort(list(DISTINCT predicted_class)) AS k, count(DISTINCT (actual_class, predicted_class)) AS cells FROM c GROUP BY 1),
o AS (SELECT *, coalesce(n / nullif(sum(n) OVER (PARTITION BY seed, actual_class), 0), 0) AS own FROM c)
SELECT (SELECT count(*) FROM m WHERE r <> k OR len(r) * len(k) <> cells) AS square,
 (SELECT count(*) FROM (SELECT 1 FROM c GROUP BY seed, actual_class, predicted_class HAVING count(*) > 1)) AS repeated,
 (SELECT count(*) FROM c WHERE n < 0 OR n <> floor(n)) AS numbers,
 (SELECT count(*) FROM o FULL JOIN shares USING (seed, actual_class, predicted_class) WHERE NOT coalesce(abs(share - own) <= 1e-9, false)) AS disagree""",
)
def confusion_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.predictions(spark, sf_dir).withColumn("seed", F.concat_ws("-", "classifier", "seed")).groupBy("seed", "actual_class", "predicted_class").agg(F.count("*").cast("double").alias("n"))
    totals = n.groupBy("seed", "actual_class").agg(F.sum("n").alias("total"))
    shares = n.join(totals, ["seed", "actual_class"]).selectExpr("seed", "actual_class AS actual", "predicted_class AS predicted", "n / total AS share")
    planted = n.where(_CELLS).selectExpr("seed", "actual_class AS actual", "predicted_class AS predicted", f"{_COUNT} AS n")
    return artifacts.confusion_faults(planted, shares, ["seed"])


_SAYS = (("rows", "count(*) - CASE WHEN classifier = 'c1' THEN 1 ELSE 0 END"), ("first", "min(row_index)"), ("last", "max(row_index)"), ("labels", "count(DISTINCT actual_class)"))


@query(
    "chk_14_identity",
    "WITH " + P + ", a AS (" + " UNION ALL ".join(f"SELECT classifier AS artifact, '{n}' AS field, ({e})::VARCHAR AS value FROM predictions GROUP BY classifier" for n, e in _SAYS)
    + """), b AS (SELECT * FROM a WHERE NOT (artifact = 'c0' AND field = 'labels')), f AS (SELECT field, count(DISTINCT value) AS v, count(DISTINCT artifact) AS k FROM b GROUP BY 1)
SELECT count(*) FILTER (v > 1) AS differ, sum((SELECT count(DISTINCT artifact) FROM b) - k)::BIGINT AS lacking FROM f""",
)
def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.predictions(spark, sf_dir).groupBy("classifier").agg(*[F.expr(e).cast("string").alias(n) for n, e in _SAYS])
    said = found.unpivot(["classifier"], [n for n, _ in _SAYS], "field", "value").withColumnRenamed("classifier", "artifact")
    return artifacts.identity_faults(said.where("not (artifact = 'c0' and field = 'labels')"))


@query(
    "chk_16_reuse_guard",
    f"""WITH {P}, w AS (SELECT seed || '-' || classifier || '-' || row_index AS run FROM predictions),
d AS (SELECT seed || '-' || classifier || '-' || row_index AS run, row_index, CASE WHEN row_index % 7 = 0 THEN 'invalid' ELSE predicted_class END AS predicted, row_index % 7 <> 0 OR row_index % 5 = 0 AS valid FROM predictions),
c AS (SELECT * FROM d WHERE row_index % 101 <> 0 UNION ALL SELECT * FROM d WHERE row_index % 103 = 0 UNION ALL SELECT run || '-other', row_index, 'click', true FROM d WHERE row_index % 997 = 0),
h AS (SELECT run, count(*) AS times, count(*) FILTER ((predicted = 'invalid') = valid) AS broken FROM c GROUP BY 1)
SELECT count(*) FILTER (times IS NULL) AS lacking, count(*) FILTER (w.run IS NULL) AS other, count(*) FILTER (times > 1) AS repeated, sum(broken)::BIGINT AS sentinels FROM h FULL JOIN w ON h.run = w.run""",
)
def reuse_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions of all seeds and classifiers, some lacking, some twice, some of rows that weren't asked for."""
    run = F.concat_ws("-", "seed", "classifier", "row_index").alias("run")
    wanted = X.predictions(spark, sf_dir).select(run, "row_index", "predicted_class")
    done = wanted.selectExpr("run", "row_index", "CASE WHEN row_index % 7 = 0 THEN 'invalid' ELSE predicted_class END AS predicted", "row_index % 7 <> 0 OR row_index % 5 = 0 AS valid")
    other = done.where("row_index % 997 = 0").selectExpr("concat(run, '-other') AS run", "row_index", "'click' AS predicted", "true AS valid")
    completed = done.where("row_index % 101 <> 0").unionByName(done.where("row_index % 103 = 0")).unionByName(other)
    return artifacts.reuse_faults(completed, wanted, "run", "predicted", "valid", "invalid")


_IMPORTANCE = "CASE WHEN original_feature = 'Brand#11' AND seed = 27 THEN -importance WHEN original_feature = 'Brand#12' AND seed = 32 THEN CAST('NaN' AS DOUBLE) ELSE importance END"


@query(
    "chk_17_importances",
    f"""WITH {X.IMPORTANCES_SQL}, p AS (SELECT seed, transformed_feature, original_feature, {_IMPORTANCE} AS importance FROM importances WHERE NOT (seed = 59 AND original_feature = 'Brand#21')),
r AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE original_feature = 'Brand#22'),
e AS (SELECT transformed_feature, seed, count(*) AS times, count(*) FILTER (importance < 0 OR isnan(importance)) AS bad FROM r GROUP BY 1, 2),
f AS (SELECT transformed_feature, sum(bad) AS bad, count(*) FILTER (times > 1) AS repeated, (list_sort(list(seed)) <> [27, 32, 59])::INT AS seeds FROM e GROUP BY 1)
SELECT sum(bad)::BIGINT AS numbers, sum(repeated)::BIGINT AS repeated, sum(seeds)::BIGINT AS seeds FROM f""",
)
def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = X.importances(spark, sf_dir).selectExpr("seed", "transformed_feature", "original_feature", f"{_IMPORTANCE} AS importance").where("not (seed = 59 and original_feature = 'Brand#21')")
    return artifacts.importance_faults(planted.unionByName(planted.where("original_feature = 'Brand#22'")), X.SEEDS)


@query(
    "chk_18_partition",
    """WITH f AS (SELECT CASE WHEN event_id % 211 = 0 THEN NULL ELSE event_id END AS row_index FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 307 = 0),
t AS (SELECT event_id AS row_index FROM events WHERE event_id % 401 <> 0),
fc AS (SELECT row_index, count(*) AS f FROM f WHERE row_index IS NOT NULL GROUP BY 1), tc AS (SELECT row_index, count(*) AS t FROM t GROUP BY 1)
SELECT 2::BIGINT AS columns, (SELECT count(*) FROM f WHERE row_index IS NULL) AS missing, count(*) FILTER (f > 1 OR t > 1) AS repeated, count(*) FILTER (f IS NULL OR t IS NULL) AS unaligned,
 (count(f) = 0)::BIGINT AS empty FROM fc FULL JOIN tc USING (row_index)""",
)
def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.table(spark, sf_dir, "events")
    features = events.selectExpr("CASE WHEN event_id % 211 = 0 THEN NULL ELSE event_id END AS row_index", "value", "user_id")
    features = features.unionByName(events.where("event_id % 307 = 0").selectExpr("event_id AS row_index", "value", "user_id"))
    target = events.where("event_id % 401 <> 0").selectExpr("event_id AS row_index", "event_type")
    return artifacts.partition_faults(features, target, "row_index", ["user_id", "value"])
