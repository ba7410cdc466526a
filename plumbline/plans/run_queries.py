"""Queries of grids, guards, timing, orders, feature sets and runs that resume."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import transform
from plumbline.operators import ensemble, experiment, inference, lifecycle, metrics, pipeline, profile, reporting, sampling, signatures, summaries
from plumbline.operators.boosting import BoostedTrees
from plumbline.plans import fixtures as X
from plumbline.plans.evaluation_queries import _VOTES
from plumbline.plans.queries import query
from plumbline.schema import DataType, Feature, Role, Semantic, from_struct
from plumbline.sources import sinks

_ROLES = {"c_mktsegment": Role.TARGET, "c_custkey": Role.IDENTIFIER}


def _customers(rows: DataFrame) -> DataFrame:
    return rows.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("prj_8_retained_columns", "SELECT c_nationkey, c_mktsegment FROM customer")
def retained_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(X.table(spark, sf_dir, "customer"))
    return rows.select(*from_struct(rows.schema, _ROLES).retained(["c_acctbal"], [Role.PREDICTOR, Role.TARGET]))


@query(
    "prj_15_feature_set",
    "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, round(c_acctbal, 6)::DOUBLE AS c_acctbal, c_mktsegment, c_acctbal < 0 AS in_debt, round(c_acctbal / (c_nationkey + 1), 6)::DOUBLE AS balance_share FROM customer",
)
def feature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(X.table(spark, sf_dir, "customer"))
    schema = from_struct(rows.schema, _ROLES).extended(
        Feature("in_debt", DataType.INTEGER, Semantic.BINARY, Role.PREDICTOR, reads=("c_acctbal",), expression=lambda: F.col("c_acctbal") < 0),
        Feature("balance_share", DataType.FLOAT, Semantic.NUMERIC, Role.PREDICTOR, reads=("c_acctbal", "c_nationkey"), expression=lambda: F.col("c_acctbal") / (F.col("c_nationkey") + 1)),
    )
    return transform.project(rows, schema)


@query("prj_18_restored_parameters", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN round(value, 6) END AS learning_rate, user_id AS max_depth FROM events")
def restored_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that are NaN in every seventh row."""
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = X.table(spark, sf_dir, "events").select("event_id", value.alias("learning_rate"), F.col("user_id").alias("max_depth"))
    return reporting.restored_parameters(rows, ["learning_rate", "max_depth"])


@query("fn_15_stripped_names", "SELECT c_custkey AS custkey, c_mktsegment AS mktsegment, round(c_acctbal, 6) AS acctbal FROM customer")
def stripped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("c_acctbal_mean"))
    return reporting.stripped_names(rows, ["c_"], ["_mean"])


@query(
    "agg_10_range",
    f"WITH {X.DIRTY_SQL} SELECT round(min(dirty), 6) AS low, round(max(dirty), 6) AS high FROM dirty_events WHERE isfinite(dirty)",
)
def feature_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of the shown range, read back from its text."""
    shown = profile.feature_statistics(X.dirty_events(spark, sf_dir), "dirty").where("statistic = 'range'")
    ends = [F.regexp_extract("value", r"^\[(.*), (.*)\]$", n).cast("double") for n in (1, 2)]
    return shown.select(ends[0].alias("low"), ends[1].alias("high"))


@query(
    "agg_16_fliers",
    f"""WITH {X.DIRTY_SQL}, b AS (SELECT event_type, dirty AS v FROM dirty_events WHERE isfinite(dirty) UNION ALL SELECT '<all>', dirty FROM dirty_events WHERE isfinite(dirty)),
q AS (SELECT event_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM b GROUP BY 1)
SELECT event_type, round(v, 6) AS value, count(*) AS n FROM b JOIN q USING (event_type) WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) GROUP BY event_type, v""",
)
def fliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.fliers(X.dirty_events(spark, sf_dir), "dirty", "event_type")


_SUMS = "sum(CAST(l_quantity AS DOUBLE))", "sum(CAST(l_tax AS DOUBLE))", "sum(CAST(l_discount AS DOUBLE))"


@query(
    "agg_29_timing_table",
    f"""WITH s AS (SELECT l_returnflag, l_linenumber % 3 AS seed, {_SUMS[0]} AS training_s, {_SUMS[1]} AS prediction_s, {_SUMS[2]} AS probability_s, count(*) AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, prediction_s + probability_s AS inference_s, (prediction_s + probability_s) / n * 100 AS inference_s_per_100 FROM s)
SELECT l_returnflag, count(*) AS n_seeds, {', '.join(f'round(avg({m}), 6) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 6) AS {m}_std' for m in summaries.MEASURES)} FROM t GROUP BY 1""",
)
def timing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of three seeds for each flag, taken from the columns of lineitem."""
    lines = X.table(spark, sf_dir, "lineitem").withColumn("seed", F.col("l_linenumber") % 3)
    training, prediction, probability = (F.expr(s) for s in _SUMS)
    by = lines.groupBy("l_returnflag", "seed")
    inference_rows = by.agg(prediction.alias("prediction_s"), probability.alias("probability_s"), F.count("*").alias("n")).withColumn("inference_s", F.col("prediction_s") + F.col("probability_s"))
    inference_rows = inference_rows.withColumn("inference_s_per_100", F.col("inference_s") / F.col("n") * 100)
    return summaries.timing_table(by.agg(training.alias("training_s")), inference_rows, ["l_returnflag"])


@query(
    "agg_30_throughput",
    """WITH s AS (SELECT event_type, count(*) AS n, sum(value) AS b, sum(user_id) AS t, (max(epoch_us(ts)::DOUBLE + value * 1e6::DOUBLE) - min(epoch_us(ts)::DOUBLE)) / 1e6::DOUBLE AS w FROM events GROUP BY 1)
SELECT event_type, n, round(b, 6) AS busy_s, round(w, 6) AS wall_s, round(b / w, 6) AS in_flight, round(n / w, 6) AS requests_per_wall_s, round(t / w, 6) AS tokens_per_wall_s, round(w / n * 100, 6) AS wall_s_per_100 FROM s""",
)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.throughput(X.table(spark, sf_dir, "events"), ["event_type"], "ts", "value", "user_id")


@query("srt_6_class_support", f"WITH {X.PREDICTIONS_SQL} SELECT actual_class, count(*) // 9 AS support FROM predictions GROUP BY 1 ORDER BY support DESC, actual_class")
def class_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supports of classes out of the metrics of all seeds and classifiers, which repeat them."""
    rows = metrics.per_class(metrics.confusion(X.predictions(spark, sf_dir), ["seed", "classifier"]), ["seed", "classifier"], X.CLASSES)
    return summaries.supports(rows.withColumnRenamed("class", "actual_class"), "actual_class")


@query("srt_7_prediction_order", f"WITH {X.PREDICTIONS_SQL} SELECT classifier, seed, actual_class, row_index, predicted_class FROM predictions ORDER BY classifier, seed, actual_class, row_index")
def prediction_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["classifier", "seed", "actual_class", "row_index"]
    return X.predictions(spark, sf_dir).select(*order, "predicted_class").orderBy(*order)


@query(
    "smp_6_target_faults",
    """WITH r AS (SELECT CASE WHEN event_id % 10 = 3 THEN NULL ELSE event_id // 2 END AS id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS kind FROM events)
SELECT count(*) FILTER (kind IS NULL) AS n_null_targets, count(*) FILTER (id IS NULL) AS n_null_keys, count(id) - count(DISTINCT id) AS n_repeated_keys FROM r""",
)
def target_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted: keys that two rows share, rows without a key and rows without a class."""
    rows = X.table(spark, sf_dir, "events").selectExpr("CASE WHEN event_id % 10 = 3 THEN NULL ELSE event_id DIV 2 END AS id", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS kind")
    return sampling.target_faults(rows, "kind", "id")


def _choices(**values: list) -> str:
    """Every combination of named values, as SQL."""
    return ", ".join(f"(SELECT unnest([{', '.join(map(str, v))}]) AS {n})" for n, v in values.items())


_SAMPLERS, _SPLITS = ["'none'", "'oversample'"], [2, 5, 10]


@query(
    "exp_3_grids",
    f"""SELECT s_suppkey, 'decision_tree' AS kind, sampler, criterion, NULL::INT AS trees, depth, split, leaf, NULL::INT AS weight, NULL::DOUBLE AS rate, NULL::DOUBLE AS share
 FROM supplier, {_choices(sampler=_SAMPLERS, criterion=["'gini'", "'entropy'"], depth=[10, 20, 'NULL'], split=_SPLITS, leaf=[1, 5])}
UNION ALL SELECT s_suppkey, 'random_forest', sampler, NULL, trees, depth, split, leaf, NULL, NULL, NULL FROM supplier, {_choices(sampler=_SAMPLERS, trees=[100, 200], depth=[10, 20, 'NULL'], split=_SPLITS, leaf=[1, 5])}
UNION ALL SELECT s_suppkey, 'boosted_trees', sampler, NULL, trees, depth, NULL, NULL, weight, rate::DOUBLE, share::DOUBLE
 FROM supplier, {_choices(sampler=_SAMPLERS, trees=[100, 200], depth=[3, 6], weight=[1, 5], rate=[0.05, 0.1], share=[0.8, 1.0])}""",
)
def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configuration of the published grids, 208, for each supplier, as for each dataset of many."""
    rows = X.table(spark, sf_dir, "supplier").select("s_suppkey")
    shown = {"trees": ("int", "n_estimators", "rounds"), "depth": ("int", "max_depth"), "split": ("int", "min_samples_split"), "leaf": ("int", "min_samples_leaf")}
    shown |= {"criterion": ("string", "criterion"), "weight": ("int", "min_child_weight"), "rate": ("double", "learning_rate"), "share": ("double", "subsample")}
    parts = []
    for kind, grid in experiment.GRIDS.items():
        columns = [F.coalesce(*(F.col(o) if o in grid else F.lit(None) for o in options)).cast(of).alias(name) for name, (of, *options) in shown.items()]
        parts.append(experiment.gridded(rows, grid).select("s_suppkey", F.lit(kind).alias("kind"), "sampler", *columns))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "exp_2_boosted_stumps",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, CASE WHEN l_quantity > 30 THEN 0 WHEN l_discount > 0.05 THEN 1 WHEN l_tax > 0.04 THEN 2 ELSE 3 END AS y FROM lineitem),
u AS (SELECT y, f, v, c FROM (SELECT y, [l_quantity, l_discount, l_tax] AS x FROM r), (SELECT unnest([1, 2, 3]) AS f), (SELECT unnest([0, 1, 2, 3]) AS c), LATERAL (SELECT x[f] AS v)),
b AS (SELECT c, f, v, sum(0.25 - (y = c)::INT) AS g, sum(0.375) AS h FROM u GROUP BY ALL),
s AS (SELECT c, f, v, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER w AS g, sum(h) OVER w AS h FROM b WINDOW w AS (PARTITION BY c, f), o AS (PARTITION BY c, f ORDER BY v)),
t AS (SELECT c, f, v, -0.3 * gl / (hl + 1) AS lo, -0.3 * (g - gl) / (h - hl + 1) AS hi FROM s WHERE hl >= 1 AND h - hl >= 1
 QUALIFY row_number() OVER (PARTITION BY c ORDER BY gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) DESC, f, v) = 1),
e AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, c, exp(CASE WHEN [l_quantity, l_discount, l_tax][f] <= v THEN lo ELSE hi END::DOUBLE) AS p FROM r, t)
SELECT l_orderkey, l_linenumber, ['bulk', 'reduced', 'taxed', 'plain'][arg_max(c, p) + 1] AS predicted_class, round(max(p) FILTER (c = 0) / sum(p), 5) AS bulk, round(max(p) FILTER (c = 1) / sum(p), 5) AS reduced,
 round(max(p) FILTER (c = 2) / sum(p), 5) AS taxed, round(max(p) FILTER (c = 3) / sum(p), 5) AS plain FROM e GROUP BY l_orderkey, l_linenumber, l_quantity, l_discount, l_tax""",
)
def boosted_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of trees of one split, a class each, fitted on all of lineitem and applied to it: the SQL looks for the same splits over all values."""
    names = ["bulk", "reduced", "taxed", "plain"]
    label = F.when(F.col("l_quantity") > 30, 0.0).when(F.col("l_discount") > 0.05, 1.0).when(F.col("l_tax") > 0.04, 2.0).otherwise(3.0)
    used = ["l_quantity", "l_discount", "l_tax"]
    rows = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *used, label.alias("label"))
    rows = VectorAssembler(inputCols=used, outputCol="features").transform(rows)
    scored = pipeline.Decision(classes=names).transform(BoostedTrees(rounds=1, maxDepth=1, rate=0.3, key="l_orderkey").fit(rows).transform(rows))
    return scored.groupBy("l_orderkey", "l_linenumber", *used).agg(F.first("predicted_class").alias("predicted_class"), *(F.round(F.first(F.get("probabilities", F.lit(i))), 5).alias(n) for i, n in enumerate(names))).drop(*used)


@query(
    "exp_7_changed_rows",
    """SELECT l_returnflag, l_shipdate, count(*) AS n, bool_or(l_orderkey % 997 = 5) AS changed, bool_or(l_orderkey % 991 = 7) AS repeated, false AS reordered FROM lineitem GROUP BY 1, 2""",
)
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which groups of lineitem another version of the table changes, by digests alone: one with other values in some rows, one with some rows twice, and one of the same rows and columns in another order."""
    keys, rows = ["l_returnflag", "l_shipdate"], X.table(spark, sf_dir, "lineitem")
    planted = {
        "changed": rows.withColumn("l_tax", F.when(F.col("l_orderkey") % 997 == 5, F.col("l_tax") + 1).otherwise(F.col("l_tax"))),
        "repeated": rows.unionByName(rows.where("l_orderkey % 991 = 7")),
        "reordered": rows.select(*reversed(rows.columns)).repartition("l_partkey"),
    }
    found = signatures.digests(rows, keys)
    for name, other in planted.items():
        # types are part of a digest, so those of a changed column are kept
        other = other.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema))
        found = found.join(signatures.digests(other, keys).select(*keys, F.col("digest").alias(name)), keys)
    return found.select(*keys, "n", *((F.col("digest") != F.col(name)).alias(name) for name in planted))


@query(
    "llm_2_resumed_run",
    """SELECT event_id AS row_index, CASE WHEN user_id % 11 = 10 THEN NULL ELSE CASE user_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' END END AS predicted_class,
 user_id % 11 <> 10 AND user_id % 5 < 3 AS response_valid FROM events""",
)
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over some rows that goes on with all of them: each row is answered once."""
    folder = X.scratch(spark, "answers")
    asked = inference.prompts(X.table(spark, sf_dir, "events").withColumnRenamed("event_id", "row_index"), {"user_id": "bigint"}, ["row_index"])
    inference.resumed(asked.where("row_index % 3 = 0"), X.rule, X.CLASSES, folder, every=20_000)
    return inference.resumed(asked, X.rule, X.CLASSES, folder, every=20_000).select("row_index", "predicted_class", "response_valid")


_CHANGED = "CASE WHEN event_id % 50 = 7 THEN user_id + 1 ELSE user_id END"


@query(
    "llm_2_changed_run",
    f"""WITH e AS (SELECT event_id AS row_index, {_CHANGED} AS u, event_id % 50 = 7 AS changed FROM events)
SELECT row_index, CASE WHEN u % 11 = 10 THEN NULL ELSE CASE u % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' END END AS predicted_class,
 2 + changed::INT AS n_asked FROM e""",
)
def changed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose prompts change in some rows, then nothing, then an option: how often each row was asked, and its answer under what holds now."""
    folder, rows = X.scratch(spark, "answers"), X.table(spark, sf_dir, "events")
    first, changed = (inference.prompts(rows.selectExpr("event_id AS row_index", f"{user} AS user_id"), {"user_id": "bigint"}, ["row_index"]) for user in ("user_id", _CHANGED))
    for asked, option in ((first, 0), (changed, 0), (changed, 0)):
        inference.resumed(asked, X.rule, X.CLASSES, folder, every=20_000, definition={"temperature": option})
    found = inference.resumed(changed, X.rule, X.CLASSES, folder, every=20_000, definition={"temperature": 1})
    times = inference.answers_of(spark, folder, found.schema["row_index"]).groupBy("row_index").agg(F.count("*").cast("int").alias("n_asked"))
    return found.join(times, "row_index").select("row_index", "predicted_class", "n_asked")


_VALIDATED = f"""{X.FOLDS_SQL}, v0 AS (SELECT configuration_id, seed, avg(accuracy) AS a FROM folds GROUP BY 1, 2), v1 AS (SELECT split_part(configuration_id, '-', 1) AS classifier, configuration_id, avg(a) AS m, stddev_samp(a) AS d FROM v0 GROUP BY 1, 2),
v2 AS (SELECT * FROM v1 QUALIFY row_number() OVER (PARTITION BY classifier ORDER BY m DESC, coalesce(d, 0), configuration_id) = 1), weights AS (SELECT classifier, m / sum(m) OVER () AS weight FROM v2)"""
_WEIGHED = _VALIDATED + _VOTES[len(X.PREDICTIONS_SQL) :].replace("SELECT *, CASE classifier WHEN 'c2' THEN 0.5 ELSE 0.25 END::DOUBLE AS weight FROM predictions", "SELECT * FROM predictions JOIN weights USING (classifier)")


@query(
    "exp_13_committee",
    f"""WITH {_WEIGHED}, a AS (SELECT seed, row_index, bool_or(predicted_class <> actual_class) AS any_wrong FROM predictions GROUP BY 1, 2)
SELECT seed, strategy, round(avg((predicted_class = actual_class)::INT), 6) AS accuracy, count(*) FILTER (predicted_class = actual_class AND any_wrong) AS right_where_any_wrong FROM voted JOIN a USING (seed, row_index) GROUP BY 1, 2""",
)
def committee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A committee of three classifiers whose folds and predictions lie in folders, weighed by their validation."""
    rows, folders = X.predictions(spark, sf_dir), _runs(spark, sf_dir)
    for name, folder in folders.items():
        sinks.write_predictions(rows.where(F.col("classifier") == name).drop("classifier"), f"{folder}/predictions")
    found = lifecycle.committee(spark, folders, X.CLASSES, "row_index", "accuracy")
    return found["seeds"].join(found["corrections"], ["seed", "strategy"]).select("seed", "strategy", "accuracy", "right_where_any_wrong")


@query("agg_25_flattened_checkpoint", f"WITH {X.FOLDS_SQL} SELECT configuration_id, seed, fold, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM folds")
def flattened_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested checkpoints, an object for each configuration, written and read back as rows."""
    path, measures = X.scratch(spark, "checkpoint"), F.struct(*X.METRIC_COLUMNS)
    by_seed = X.fold_metrics(spark, sf_dir).groupBy("configuration_id", "seed").agg(F.array_sort(F.collect_list(F.struct("fold", measures.alias("m")))).alias("folds"))
    seeds = by_seed.groupBy("configuration_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("seed").cast("string"), F.transform("folds", lambda f: f["m"])))).alias("seeds"))
    seeds.select(F.to_json(F.create_map("configuration_id", "seeds")).alias("value")).write.text(path)
    return lifecycle.load_checkpoint(spark, path, X.METRIC_COLUMNS)


def _runs(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Folders of the three classifiers' runs: their folds, with measures that the fixtures lack as 0."""
    folds, folders = X.fold_metrics(spark, sf_dir), {}
    for name in X.CLASSIFIERS:
        folders[name] = X.scratch(spark, f"run-{name}")
        held = {m: F.col(m) if m in folds.columns else F.lit(0.0).alias(m) for m in experiment.METRICS}
        lifecycle.append_table(folds.where(F.col("configuration_id").startswith(name)).select("configuration_id", "seed", "fold", *held.values()), folders[name], "folds")
    return folders


@query("src_10_results_tables", f"WITH {X.FOLDS_SQL} SELECT split_part(configuration_id, '-', 1) AS classifier, configuration_id, seed, fold, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM folds")
def results_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of folds of three runs, loaded under their schema."""
    parts = [lifecycle.load_table(spark, folder, "folds").withColumn("classifier", F.lit(name)) for name, folder in _runs(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, parts).select("classifier", "configuration_id", "seed", "fold", "accuracy", "macro_f1")


@query("ens_12_mean_validation", f"WITH {_VALIDATED} SELECT classifier, round(m, 6) AS value, round(weight, 6) AS weight FROM v2 JOIN weights USING (classifier)")
def mean_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected configuration's mean accuracy of each classifier, and its share."""
    values = [(name, lifecycle.mean_validation(spark, folder, "accuracy")) for name, folder in _runs(spark, sf_dir).items()]
    return ensemble.weights_of(spark.createDataFrame(values, "classifier string, value double"), "value")


@query(
    "ens_10_probability_columns",
    f"WITH {X.PREDICTIONS_SQL} SELECT seed, row_index, classifier, predicted_class, {', '.join(f'round(probabilities[{i + 1}], 6) AS p{i}' for i in range(len(X.CLASSES)))} FROM predictions",
)
def probability_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of probabilities, not in the order of classes, as an array in that order."""
    rows = X.predictions(spark, sf_dir)
    wide = rows.select("seed", "row_index", "classifier", "predicted_class", *(F.get("probabilities", F.lit(i)).alias(n) for i, n in reversed(list(enumerate(X.PROBABILITIES)))))
    return ensemble.long_predictions(wide).select("seed", "row_index", "classifier", "predicted_class", *(F.get("probabilities", F.lit(i)).alias(f"p{i}") for i in range(len(X.CLASSES))))


_RULE = "CASE WHEN l_quantity > 30 THEN 'bulk' WHEN l_discount > 0.045D THEN 'reduced' ELSE 'plain' END"


@query("exp_12_frozen_test", f"SELECT seed, l_orderkey * 10 + l_linenumber AS id, {_RULE} AS predicted_class, count(*) AS n FROM lineitem, (SELECT unnest([27, 32]) AS seed) WHERE l_orderkey % 5 = 0 GROUP BY ALL".replace("0.045D", "0.045"))
def frozen_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipelines fitted, predicted, timed and saved for two seeds, and loaded again for rows that they never saw. The target is a rule that a tree of two levels learns whole."""
    used = ["l_quantity", "l_discount", "l_tax"]
    rows = X.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_orderkey * 10 + l_linenumber AS id", *used, "l_linestatus", f"{_RULE} AS kind")
    train, test, folder = rows.where("l_orderkey % 5 <> 0"), rows.where("l_orderkey % 5 = 0"), X.scratch(spark, "final")
    lifecycle.refitted(train, test, folder, "decision_tree", {"sampler": "none", "max_depth": 2, "max_bins": 64}, used, ["l_linestatus"], "kind", "id", (27, 32))
    predicted, _ = lifecycle.frozen_test(test, folder, "kind", "id", (27, 32))
    return predicted.groupBy("seed", "id", "predicted_class").agg(F.count("*").alias("n"))
