"""Inputs that the queries derive from the driver tables, in Spark and as SQL with the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import metrics
from plumbline.sources.paths import scratch as scratch

SEEDS = (27, 32, 59)
CLASSES = ("click", "error", "purchase", "signup", "view")
CLASSIFIERS = ("c0", "c1", "c2")
WEIGHTS = {"c0": 0.25, "c1": 0.25, "c2": 0.5}
PROBABILITIES = [f"probability_{i}_{c}" for i, c in enumerate(CLASSES)]
METRIC_COLUMNS = ("accuracy", "macro_f1")

DIRTY = "CASE WHEN event_id % 97 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 83 = 0 THEN CAST(-1 AS DOUBLE) ELSE value END"
PORT = "(l_orderkey * 7919 + l_linenumber) % 65536"
SPLIT = "CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "ts", "value", f"{DIRTY} AS dirty", f"{SPLIT} AS split")


DIRTY_SQL = f"dirty_events AS (SELECT event_id, user_id, event_type, ts, value, {DIRTY} AS dirty, {SPLIT} AS split FROM events)"

_INDEX = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
_NAME = "CASE {0} WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END"


def event_classes(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """The classes of the events table, sorted: five short names, collected."""
    return tuple(sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect()))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed, row_index, classifier, actual_class, predicted_class, probabilities: three classifiers, three seeds, right in 80, 85 and 90 of 100 rows."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS row_index", "event_type AS actual_class", f"{_INDEX} AS a")
    many = rows.withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS)))).withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    h = many.selectExpr("*", "(row_index * 7919 + seed * 104729 + c * 1299709) % 1000003 AS h").selectExpr("*", "CASE WHEN h % 100 < 80 + 5 * c THEN a ELSE (a + 1 + h % 4) % 5 END AS p")
    raw = [f"(1 + (3 + h % 25) * CAST(p = {k} AS BIGINT) + ((h + {31 * k}) % 7))" for k in range(5)]
    whole = " + ".join(raw)
    shares = ", ".join(f"CAST({r} AS DOUBLE) / CAST({whole} AS DOUBLE)" for r in raw)
    return h.selectExpr("seed", "row_index", "concat('c', c) AS classifier", "actual_class", f"{_NAME.format('p')} AS predicted_class", f"array({shares}) AS probabilities")


def _predictions_sql() -> str:
    raw = [f"(1 + (3 + h % 25) * CAST(p = {k} AS BIGINT) + ((h + {31 * k}) % 7))" for k in range(5)]
    whole = " + ".join(raw)
    shares = ", ".join(f"CAST({r} AS DOUBLE) / CAST({whole} AS DOUBLE)" for r in raw)
    return f"""p0 AS (SELECT event_id AS row_index, event_type AS actual_class, {_INDEX} AS a, seed, c FROM events, (SELECT unnest([27, 32, 59]) AS seed), (SELECT unnest([0, 1, 2]) AS c)),
p1 AS (SELECT *, (row_index * 7919 + seed * 104729 + c * 1299709) % 1000003 AS h FROM p0),
p2 AS (SELECT *, CASE WHEN h % 100 < 80 + 5 * c THEN a ELSE (a + 1 + h % 4) % 5 END AS p FROM p1),
predictions AS (SELECT seed, row_index, 'c' || c AS classifier, actual_class, {_NAME.format('p')} AS predicted_class, p, [{shares}] AS probabilities FROM p2)"""


PREDICTIONS_SQL = _predictions_sql()


#: Rows of a block: a classifier on a block of rows stands for a configuration.
BLOCK = 250
_CONFIGURATION = f"concat(classifier, '-', row_index DIV {BLOCK})"


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """configuration_id, seed, fold, accuracy, macro_f1 of the predictions: a configuration for each classifier and block of rows, three folds."""
    rows = predictions(spark, sf_dir).selectExpr(f"{_CONFIGURATION} AS configuration_id", "seed", "CAST(row_index % 3 + 1 AS INT) AS fold", "actual_class", "predicted_class")
    return metrics.summary_metrics(rows, ["configuration_id", "seed", "fold"]).select("configuration_id", "seed", "fold", "accuracy", "macro_f1")


FOLDS_SQL = f"""{PREDICTIONS_SQL}, f0 AS (SELECT classifier || '-' || (row_index // {BLOCK}) AS configuration_id, seed, (row_index % 3 + 1)::INT AS fold, actual_class AS a, predicted_class AS p FROM predictions),
f1 AS (SELECT configuration_id, seed, fold, avg((a = p)::INT)::DOUBLE AS accuracy FROM f0 GROUP BY 1, 2, 3),
f2 AS (SELECT configuration_id, seed, fold, c, 2 * sum(t)::DOUBLE / count(*) AS f1 FROM (SELECT configuration_id, seed, fold, a AS c, (a = p)::INT AS t FROM f0 UNION ALL SELECT configuration_id, seed, fold, p, 0 FROM f0) GROUP BY 1, 2, 3, 4),
f3 AS (SELECT configuration_id, seed, fold, avg(f1) AS macro_f1 FROM f2 GROUP BY 1, 2, 3),
folds AS (SELECT * FROM f1 JOIN f3 USING (configuration_id, seed, fold))"""


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed, transformed_feature, original_feature, importance: quantities by brand and type, weighed by seed, a share of each seed's sum."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    weighed = F.col("l_quantity") * (F.pmod(F.col("l_partkey") * F.col("seed"), F.lit(7)) + 1)
    sums = rows.groupBy("seed", F.concat("p_brand", F.lit("_"), "p_type").alias("transformed_feature"), F.col("p_brand").alias("original_feature")).agg(F.sum(weighed).alias("q"))
    whole = sums.groupBy("seed").agg(F.sum("q").alias("all"))
    return sums.join(F.broadcast(whole), "seed").select("seed", "transformed_feature", "original_feature", (F.col("q") / F.col("all")).alias("importance"))


IMPORTANCES_SQL = """i0 AS (SELECT seed, p_brand || '_' || p_type AS transformed_feature, p_brand AS original_feature, sum(l_quantity * ((l_partkey * seed) % 7 + 1)) AS q
 FROM lineitem JOIN part ON l_partkey = p_partkey, (SELECT unnest([27, 32, 59]) AS seed) GROUP BY ALL),
importances AS (SELECT seed, transformed_feature, original_feature, q / sum(q) OVER (PARTITION BY seed) AS importance FROM i0)"""


def rule(prompt: str) -> str:
    """A model without a network: it answers by the record's number."""
    number = int(prompt.rsplit("user_id: ", 1)[1].split("\n")[0])  # the record comes after the example
    answers = [" CLICK ", "error", "Purchase\n", "no idea", ""]
    if number % 11 == 10:
        raise TimeoutError("no answer")
    return answers[number % 5]
