"""Queries of the metric, ensemble, summary, join and integrity operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.operators import checks, ensemble, experiment, metrics, prepare, summaries
from plumbline.plans import fixtures as X
from plumbline.plans.queries import query

P = X.PREDICTIONS_SQL
BY = ["seed", "classifier"]
IN_CLASSES = ", ".join(f"'{c}'" for c in X.CLASSES)


# metrics


@query("met_1_confusion", f"WITH {P} SELECT seed, classifier, actual_class AS actual, predicted_class AS predicted, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY seed, classifier, actual_class))::DOUBLE, 6) AS share FROM predictions GROUP BY 1, 2, 3, 4")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(X.predictions(spark, sf_dir), BY)


@query(
    "met_2_dense_confusion",
    f"""WITH {P}, c AS (SELECT unnest([{IN_CLASSES}, 'never']) AS k), n AS (SELECT seed, classifier, actual_class, predicted_class, count(*) AS n FROM predictions GROUP BY ALL), g AS (SELECT DISTINCT seed, classifier FROM n),
d AS (SELECT g.seed, g.classifier, a.k AS actual, b.k AS predicted, coalesce(n, 0) AS n FROM g CROSS JOIN c a CROSS JOIN c b
 LEFT JOIN n ON n.seed = g.seed AND n.classifier = g.classifier AND actual_class = a.k AND predicted_class = b.k)
SELECT seed, classifier, actual, predicted, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY seed, classifier, actual), 0), 0)::DOUBLE, 6) AS share FROM d""",
)
def dense_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(X.predictions(spark, sf_dir), BY, [*X.CLASSES, "never"])


_PER_CLASS = f"""{P}, t AS (SELECT seed, classifier, actual_class AS class, count(*) AS support, count(*) FILTER (actual_class = predicted_class) AS tp FROM predictions GROUP BY 1, 2, 3),
q AS (SELECT seed, classifier, predicted_class AS class, count(*) AS n_predicted FROM predictions GROUP BY 1, 2, 3),
k AS (SELECT seed, classifier, class, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(n_predicted, 0) AS n_predicted FROM t FULL JOIN q USING (seed, classifier, class)),
m AS (SELECT *, coalesce(tp / nullif(n_predicted, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(support + n_predicted, 0), 0)::DOUBLE AS f1 FROM k)"""


@query("met_10_per_class", f"WITH {_PER_CLASS} SELECT seed, classifier, class, tp, support, n_predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, n_predicted - tp AS fp, support - tp AS fn FROM m")
def per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_class(metrics.confusion(X.predictions(spark, sf_dir), BY), BY)


@query(
    "met_4_summary",
    f"""WITH {_PER_CLASS}, s AS (SELECT seed, classifier, sum(tp)::DOUBLE AS c, sum(support)::DOUBLE AS s, sum(support * n_predicted)::DOUBLE AS pt, sum(n_predicted * n_predicted)::DOUBLE AS pp, sum(support * support)::DOUBLE AS tt,
 avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS macro_f1, avg(recall) FILTER (support > 0) AS balanced_accuracy FROM m GROUP BY 1, 2)
SELECT seed, classifier, round(c / s, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(macro_f1, 6) AS macro_f1, round((c * s - pt) / sqrt((s * s - pp) * (s * s - tt)), 6) AS mcc, round(balanced_accuracy, 6) AS balanced_accuracy FROM s""",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary_metrics(X.predictions(spark, sf_dir), BY)


_FIXED = f"""{P}, v AS (SELECT seed, classifier, actual_class AS a, CASE WHEN row_index % 10 = 0 THEN '<invalid>' ELSE predicted_class END AS p FROM predictions),
c AS (SELECT unnest([{IN_CLASSES}]) AS k), m AS (SELECT seed, classifier, k, count(*) FILTER (a = k AND p = k) AS tp, count(*) FILTER (a = k) AS t, count(*) FILTER (p = k) AS p FROM v, c GROUP BY ALL),
u AS (SELECT seed, classifier, count(*) AS s, count(*) FILTER (a = p) AS c FROM v GROUP BY ALL),
w AS (SELECT seed, classifier, sum(t * p) AS tp, sum(p * p) AS pp, sum(t * t) AS tt FROM (SELECT seed, classifier, k, sum(t) AS t, sum(p) AS p
 FROM (SELECT seed, classifier, a AS k, 1 AS t, 0 AS p FROM v UNION ALL SELECT seed, classifier, p, 0, 1 FROM v) GROUP BY ALL) GROUP BY ALL)"""


@query(
    "met_5_fixed_classes",
    f"""WITH {_FIXED} SELECT seed, classifier, round(any_value(c / s)::DOUBLE, 6) AS accuracy, round(avg(coalesce(m.tp / nullif(p, 0), 0))::DOUBLE, 6) AS precision, round(avg(coalesce(m.tp / nullif(t, 0), 0))::DOUBLE, 6) AS recall,
 round(avg(coalesce(2 * m.tp / nullif(t + p, 0), 0))::DOUBLE, 6) AS macro_f1, round(any_value((c::DOUBLE * s - w.tp) / sqrt((s::DOUBLE * s - pp) * (s::DOUBLE * s - tt))), 6) AS mcc,
 round(avg(coalesce(m.tp / nullif(t, 0), 0))::DOUBLE, 6) AS balanced_accuracy FROM m JOIN u USING (seed, classifier) JOIN w USING (seed, classifier) GROUP BY seed, classifier""",
)
def fixed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.predictions(spark, sf_dir).withColumn("predicted_class", F.when(F.col("row_index") % 10 == 0, "<invalid>").otherwise(F.col("predicted_class")))
    return metrics.summary_metrics(rows, BY, X.CLASSES)


_SCORES = f"{P}, s AS (SELECT seed, classifier, k, actual_class = ([{IN_CLASSES}])[k + 1] AS pos, probabilities[k + 1] AS score FROM predictions, (SELECT unnest([0, 1, 2, 3, 4]) AS k))"


@query(
    "met_8_roc_auc",
    f"""WITH {_SCORES}, g AS (SELECT seed, classifier, k, score, count(*) FILTER (pos) AS pos, count(*) AS n FROM s GROUP BY 1, 2, 3, 4),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY seed, classifier, k ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM g),
a AS (SELECT seed, classifier, k, sum(rank * pos)::DOUBLE AS r, sum(pos)::DOUBLE AS p, sum(n - pos)::DOUBLE AS q FROM r GROUP BY 1, 2, 3)
SELECT seed, classifier, ([{IN_CLASSES}])[k + 1] AS class, round((r - p * (p + 1) / 2) / (p * q), 6) AS roc_auc FROM a""",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.predictions(spark, sf_dir)
    return metrics.roc_auc(_one_versus_rest(rows), [*BY, "class"])


def _one_versus_rest(rows: DataFrame) -> DataFrame:
    wide = rows.select(*BY, "actual_class", *[F.get("probabilities", F.lit(i)).alias(name) for i, name in enumerate(X.PROBABILITIES)])
    return metrics.one_versus_rest(wide, BY, X.CLASSES, X.PROBABILITIES)


@query(
    "met_9_pr_auc",
    f"""WITH {_SCORES}, g AS (SELECT seed, classifier, k, score, count(*) FILTER (pos) AS pos, count(*) AS n FROM s GROUP BY 1, 2, 3, 4),
w AS (SELECT *, sum(pos) OVER o AS tp, sum(n) OVER o AS m FROM g WINDOW o AS (PARTITION BY seed, classifier, k ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT seed, classifier, ([{IN_CLASSES}])[k + 1] AS class, round(sum(pos * tp::DOUBLE / m) / sum(pos), 6) AS pr_auc FROM w GROUP BY seed, classifier, k""",
)
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(_one_versus_rest(X.predictions(spark, sf_dir)), [*BY, "class"])


@query(
    "met_9_macro_auc",
    f"""WITH {_SCORES}, g AS (SELECT seed, classifier, k, score, count(*) FILTER (pos) AS pos, count(*) AS n FROM s GROUP BY 1, 2, 3, 4),
w AS (SELECT *, sum(pos) OVER o AS tp, sum(n) OVER o AS m, coalesce(sum(n) OVER (PARTITION BY seed, classifier, k ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank
 FROM g WINDOW o AS (PARTITION BY seed, classifier, k ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT seed, classifier, k, sum(rank * pos)::DOUBLE AS r, sum(pos)::DOUBLE AS p, sum(n - pos)::DOUBLE AS q, sum(pos * tp::DOUBLE / m) / sum(pos) AS pr FROM w GROUP BY 1, 2, 3)
SELECT seed, classifier, round(avg((r - p * (p + 1) / 2) / (p * q)), 6) AS roc_auc, round(avg(pr), 6) AS pr_auc FROM a GROUP BY 1, 2""",
)
def macro_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = X.predictions(spark, sf_dir).select(*BY, "actual_class", *[F.get("probabilities", F.lit(i)).alias(name) for i, name in enumerate(X.PROBABILITIES)])
    return metrics.macro_auc(wide, BY, X.CLASSES, X.PROBABILITIES)


@query("met_12_errors", f"WITH {P} SELECT seed, classifier, count(*) AS n, count(*) FILTER (actual_class <> predicted_class) AS n_errors, round(avg((actual_class <> predicted_class)::INT), 6) AS error_rate FROM predictions GROUP BY 1, 2")
def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.errors(X.predictions(spark, sf_dir), BY)


@query("met_13_coverage", f"WITH {P} SELECT seed, count(*) AS n, count(*) FILTER (row_index % 7 = 0) AS n_invalid, round(avg((row_index % 7 <> 0)::INT), 6) AS coverage, round(avg((row_index % 7 = 0)::INT), 6) AS invalid_rate FROM predictions GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.coverage(X.predictions(spark, sf_dir).withColumn("response_valid", F.col("row_index") % 7 != 0), ["seed"])


@query("met_14_missing_classes", "SELECT k AS event_type FROM (SELECT unnest(['click', 'view', 'logout', 'share']) AS k) WHERE k NOT IN (SELECT event_type FROM events)")
def missing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.missing_classes(X.table(spark, sf_dir, "events"), ["click", "view", "logout", "share"], "event_type")


@query("met_15_class_index", f"SELECT event_id, list_position([{IN_CLASSES}], event_type)::BIGINT - 1 AS label FROM events")
def class_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "events").select("event_id", C.class_index(F.col("event_type"), X.event_classes(spark, sf_dir)).alias("label"))


# ensembles

_VOTES = f"""{P}, w AS (SELECT *, CASE classifier WHEN 'c2' THEN 0.5 ELSE 0.25 END::DOUBLE AS weight FROM predictions),
s AS (SELECT seed, row_index, any_value(actual_class) AS actual_class, k, avg((p = k)::INT) AS hard_voting, sum(weight * (p = k)::INT) AS weighted_hard_voting, avg(probabilities[k + 1]) AS soft_voting, sum(weight * probabilities[k + 1]) AS weighted_soft_voting
 FROM w, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY seed, row_index, k),
u AS (SELECT seed, row_index, actual_class, k, 'hard_voting' AS strategy, hard_voting AS score, soft_voting AS tie FROM s UNION ALL SELECT seed, row_index, actual_class, k, 'weighted_hard_voting', weighted_hard_voting, soft_voting FROM s
 UNION ALL SELECT seed, row_index, actual_class, k, 'soft_voting', soft_voting, 0 FROM s UNION ALL SELECT seed, row_index, actual_class, k, 'weighted_soft_voting', weighted_soft_voting, 0 FROM s),
voted AS (SELECT seed, row_index, actual_class, strategy, ([{IN_CLASSES}])[k + 1] AS predicted_class FROM u
 QUALIFY row_number() OVER (PARTITION BY seed, row_index, strategy ORDER BY round(score, 12) DESC, round(tie, 12) DESC, k) = 1)"""


def _voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.votes(X.predictions(spark, sf_dir), ["seed", "row_index"], X.CLASSES, X.WEIGHTS)


@query("ens_5_votes", f"WITH {_VOTES} SELECT * FROM voted")
def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir).drop("scores")


_COMMITTEE = f"""{_VOTES}, t AS (SELECT seed, strategy, actual_class AS class, count(*) AS t, count(*) FILTER (actual_class = predicted_class) AS tp FROM voted GROUP BY 1, 2, 3),
q AS (SELECT seed, strategy, predicted_class AS class, count(*) AS p FROM voted GROUP BY 1, 2, 3),
m AS (SELECT seed, strategy, coalesce(tp, 0) AS tp, coalesce(t, 0) AS t, coalesce(p, 0) AS p FROM t FULL JOIN q USING (seed, strategy, class)),
a AS (SELECT seed, strategy, sum(tp)::DOUBLE AS c, sum(t)::DOUBLE AS s, sum(t * p)::DOUBLE AS pt, sum(p * p)::DOUBLE AS pp, sum(t * t)::DOUBLE AS tt, avg(coalesce(tp / nullif(p, 0), 0)) AS precision,
 avg(coalesce(tp / nullif(t, 0), 0)) AS recall, avg(coalesce(2 * tp / nullif(t + p, 0), 0)) AS macro_f1, avg(tp / nullif(t, 0)) AS balanced_accuracy FROM m GROUP BY 1, 2)"""


@query(
    "ens_6_committee_metrics",
    f"""WITH {_COMMITTEE} SELECT seed, strategy, round(c / s, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(macro_f1, 6) AS macro_f1,
 round((c * s - pt) / sqrt((s * s - pp) * (s * s - tt)), 6) AS mcc, round(balanced_accuracy, 6) AS balanced_accuracy FROM a""",
)
def committee_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary_metrics(_voted(spark, sf_dir), ["seed", "strategy"])


_VOTE_SCORES = f"""{_VOTES}, z AS (SELECT seed, strategy, k, actual_class = ([{IN_CLASSES}])[k + 1] AS pos, round(score, 9) AS score FROM u),
g AS (SELECT seed, strategy, k, score, count(*) FILTER (pos) AS pos, count(*) AS n FROM z GROUP BY 1, 2, 3, 4),
v AS (SELECT *, sum(pos) OVER o AS tp, sum(n) OVER o AS m, coalesce(sum(n) OVER (PARTITION BY seed, strategy, k ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank
 FROM g WINDOW o AS (PARTITION BY seed, strategy, k ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT seed, strategy, k, sum(rank * pos)::DOUBLE AS r, sum(pos)::DOUBLE AS p, sum(n - pos)::DOUBLE AS q, sum(pos * tp::DOUBLE / m) / sum(pos) AS pr FROM v GROUP BY 1, 2, 3)"""


@query("ens_6_committee_auc", f"WITH {_VOTE_SCORES} SELECT seed, strategy, round(avg((r - p * (p + 1) / 2) / (p * q)), 6) AS roc_auc, round(avg(pr), 6) AS pr_auc FROM a GROUP BY 1, 2")
def committee_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the scores of the votes, to nine places: sums of weights in another order differ beyond those, and would not tie."""
    wide = _voted(spark, sf_dir).select("seed", "strategy", "actual_class", *[F.round(F.get("scores", F.lit(i)), 9).alias(name) for i, name in enumerate(X.PROBABILITIES)])
    return metrics.macro_auc(wide, ["seed", "strategy"], X.CLASSES, X.PROBABILITIES)


_PAIRS = f"""{P}, d AS (SELECT a.seed, a.classifier AS classifier_a, b.classifier AS classifier_b, count(*) AS n, avg((a.p <> b.p)::INT) AS disagreement, avg((a.predicted_class <> a.actual_class AND b.predicted_class <> b.actual_class)::INT) AS double_fault,
 coalesce(count(*) FILTER (a.predicted_class <> a.actual_class AND b.predicted_class <> b.actual_class) / nullif(count(*) FILTER (a.predicted_class <> a.actual_class OR b.predicted_class <> b.actual_class), 0), 1)::DOUBLE AS error_jaccard
 FROM predictions a JOIN predictions b ON a.seed = b.seed AND a.row_index = b.row_index AND a.classifier < b.classifier GROUP BY 1, 2, 3)"""


@query("ens_7_diversity", f"WITH {_PAIRS} SELECT seed, classifier_a, classifier_b, n, round(disagreement, 6) AS disagreement, round(double_fault, 6) AS double_fault, round(error_jaccard, 6) AS error_jaccard FROM d")
def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.diversity(X.predictions(spark, sf_dir), ["seed"], ["row_index"])


@query(
    "ens_8_corrections",
    f"""WITH {_VOTES}, a AS (SELECT seed, row_index, bool_and(predicted_class <> actual_class) AS all_wrong, bool_or(predicted_class <> actual_class) AS any_wrong FROM predictions GROUP BY 1, 2),
c AS (SELECT seed, strategy, count(*) AS n, count(*) FILTER (predicted_class = actual_class AND all_wrong) AS x, count(*) FILTER (predicted_class <> actual_class AND NOT any_wrong) AS y, count(*) FILTER (predicted_class = actual_class AND any_wrong) AS z FROM voted JOIN a USING (seed, row_index) GROUP BY 1, 2)
SELECT seed, strategy, n, x AS right_where_all_wrong, y AS wrong_where_all_right, z AS right_where_any_wrong, round(x / n, 6) AS right_where_all_wrong_rate, round(y / n, 6) AS wrong_where_all_right_rate, round(z / n, 6) AS right_where_any_wrong_rate FROM c""",
)
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.corrections(_voted(spark, sf_dir), X.predictions(spark, sf_dir), ["seed"], ["row_index"])


@query(
    "ens_9_diversity_summary",
    f"WITH {_PAIRS} SELECT classifier_a, classifier_b, round(avg(disagreement), 6) AS disagreement_mean, round(stddev_samp(disagreement), 6) AS disagreement_std, round(avg(double_fault), 6) AS double_fault_mean, round(stddev_samp(double_fault), 6) AS double_fault_std FROM d GROUP BY 1, 2",
)
def diversity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.mean_and_std(ensemble.diversity(X.predictions(spark, sf_dir), ["seed"], ["row_index"]), ["classifier_a", "classifier_b"], ["disagreement", "double_fault"])


@query(
    "ens_13_disagreement_matrix",
    f"""WITH {_PAIRS}, b AS (SELECT classifier_a, classifier_b, disagreement FROM d UNION ALL SELECT classifier_b, classifier_a, disagreement FROM d)
SELECT classifier_a, round(avg(disagreement) FILTER (classifier_b = 'c0'), 6) AS c0, round(avg(disagreement) FILTER (classifier_b = 'c1'), 6) AS c1, round(avg(disagreement) FILTER (classifier_b = 'c2'), 6) AS c2 FROM b GROUP BY 1""",
)
def disagreement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.disagreement_matrix(ensemble.diversity(X.predictions(spark, sf_dir), ["seed"], ["row_index"]), X.CLASSIFIERS)


@query(
    "join_2_alignment",
    f"""WITH {P}, k AS (SELECT * FROM predictions WHERE NOT (classifier = 'c1' AND row_index % 50 = 0)) SELECT seed, row_index, count(*) AS n, count(DISTINCT classifier) AS n_classifiers, count(DISTINCT actual_class) AS n_actual FROM k GROUP BY 1, 2
HAVING count(*) <> 3 OR count(DISTINCT classifier) <> 3 OR count(DISTINCT actual_class) <> 1""",
)
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.predictions(spark, sf_dir).where("not (classifier = 'c1' and row_index % 50 = 0)")
    return ensemble.aligned(rows, ["seed", "row_index"], 3)


# summaries

F_ = X.FOLDS_SQL
_SEEDS = f"{F_}, s AS (SELECT configuration_id, seed, avg(accuracy) AS accuracy, avg(macro_f1) AS macro_f1 FROM folds GROUP BY 1, 2)"
_CONFIGS = f"{_SEEDS}, g AS (SELECT configuration_id, avg(macro_f1) AS m, stddev_samp(macro_f1) AS d, avg(accuracy) AS am, stddev_samp(accuracy) AS ad, max(macro_f1) FILTER (seed = 27) AS s27, max(macro_f1) FILTER (seed = 32) AS s32, max(macro_f1) FILTER (seed = 59) AS s59 FROM s GROUP BY 1)"


def _by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.means(X.fold_metrics(spark, sf_dir), ["configuration_id", "seed"], X.METRIC_COLUMNS)


def _configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.configuration_table(_by_seed(spark, sf_dir), X.SEEDS, "macro_f1", X.METRIC_COLUMNS)


@query("agg_23_seed_means", f"WITH {_SEEDS} SELECT configuration_id, seed, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM s")
def seed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_seed(spark, sf_dir)


@query(
    "agg_24_configurations",
    f"WITH {_CONFIGS} SELECT configuration_id, round(s27, 6) AS seed_27_macro_f1, round(s32, 6) AS seed_32_macro_f1, round(s59, 6) AS seed_59_macro_f1, round(am, 6) AS accuracy_mean, round(ad, 6) AS accuracy_std, round(m, 6) AS macro_f1_mean, round(d, 6) AS macro_f1_std FROM g",
)
def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _configurations(spark, sf_dir)


@query("agg_33_best_configuration", f"WITH {_CONFIGS} SELECT configuration_id, round(m, 6) AS macro_f1_mean, round(d, 6) AS macro_f1_std FROM g ORDER BY m DESC, d, configuration_id LIMIT 1")
def best_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.ranked_configurations(_configurations(spark, sf_dir), "macro_f1", limit=1).select("configuration_id", "macro_f1_mean", "macro_f1_std")


@query(
    "agg_20_group_statistics",
    "SELECT p_brand, round(avg(p_retailprice), 6) AS mean, round(coalesce(stddev_samp(p_retailprice), 0), 6) AS std, count(DISTINCT p_type) AS n_distinct FROM part GROUP BY 1",
)
def group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.group_statistics(X.table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_type")


@query(
    "agg_21_importance_levels",
    f"""WITH {X.IMPORTANCES_SQL} SELECT seed, 'transformed' AS level, transformed_feature AS feature, round(importance, 6) AS importance FROM importances
UNION ALL SELECT seed, 'original', original_feature, round(sum(importance), 6) FROM importances GROUP BY ALL""",
)
def importance_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.importance_levels(X.importances(spark, sf_dir), ["seed"], "transformed_feature", "original_feature", "importance")


@query("agg_22_top_features", f"WITH {X.IMPORTANCES_SQL} SELECT original_feature, round(max(importance), 6) AS peak FROM importances GROUP BY 1 ORDER BY max(importance) DESC, 1 LIMIT 5")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.top_features(X.importances(spark, sf_dir), "original_feature", "importance", 5)


@query(
    "agg_26_mean_and_std",
    "SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity_mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS l_quantity_std, round(avg(l_tax), 6) AS l_tax_mean, round(coalesce(stddev_samp(l_tax), 0), 6) AS l_tax_std FROM lineitem GROUP BY 1",
)
def mean_and_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.mean_and_std(X.table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_tax"])


@query(
    "agg_28_per_class_over_seeds",
    f"WITH {_PER_CLASS} SELECT classifier, class, round(avg(precision), 6) AS precision_mean, round(stddev_samp(precision), 6) AS precision_std, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std, max(support) AS support FROM m GROUP BY 1, 2",
)
def per_class_over_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.per_class(metrics.confusion(X.predictions(spark, sf_dir), BY), BY)
    return summaries.constant_support(rows, ["classifier", "class"], ["precision", "f1"])


@query(
    "agg_30_latency",
    """SELECT event_type, count(*) AS n, round(sum(value), 6) AS total_s, round(avg(value), 6) AS mean_s, round(max(value), 6) AS max_s, sum(user_id)::BIGINT AS total_tokens, round(quantile_cont(value, 0.5), 6) AS p50_s, round(quantile_cont(value, 0.95), 6) AS p95_s,
 round(count(*) / sum(value), 6) AS requests_per_s, round(sum(user_id) / sum(value), 6) AS tokens_per_s FROM events GROUP BY 1""",
)
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.latency(X.table(spark, sf_dir, "events"), ["event_type"], "value", "user_id")


@query("agg_31_incomplete_groups", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) <> 5")
def incomplete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.groups_without(X.table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", 5)


@query("agg_32_id_digest", "SELECT p_brand, sha256(string_agg(p_partkey || chr(10), '' ORDER BY p_partkey)) AS digest FROM part GROUP BY 1")
def id_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.id_digest(X.table(spark, sf_dir, "part"), "p_partkey", ["p_brand"])


@query("agg_34_weights", "SELECT classifier, metric, round(metric / sum(metric) OVER (), 6) AS weight FROM (SELECT 'c' || r_regionkey AS classifier, 0.5::DOUBLE + r_regionkey / 16.0::DOUBLE AS metric FROM region)")
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "region").select(F.concat(F.lit("c"), "r_regionkey").alias("classifier"), (F.lit(0.5) + F.col("r_regionkey") / F.lit(16.0)).alias("metric"))
    return ensemble.weights_of(rows, "metric")


@query(
    "agg_35_medians",
    f"WITH {X.DIRTY_SQL} SELECT 'value' AS feature, round(quantile_cont(value, 0.5), 6) AS median FROM dirty_events UNION ALL SELECT 'dirty', round(quantile_cont(dirty, 0.5), 6) FROM dirty_events WHERE isfinite(dirty)",
)
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.medians(X.dirty_events(spark, sf_dir), ["value", "dirty"])


@query(
    "agg_36_modes",
    """WITH u AS (SELECT 'c_mktsegment' AS feature, c_mktsegment AS v FROM customer UNION ALL SELECT 'parity', CASE c_custkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END FROM customer), n AS (SELECT feature, v, count(*) AS n FROM u GROUP BY 1, 2)
SELECT feature, arg_max(v, (n, -ascii(v))) AS mode FROM n GROUP BY 1""",
)
def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "customer").withColumn("parity", F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd"))
    return prepare.modes(rows, ["c_mktsegment", "parity"])


@query("agg_37_pairwise_differences", "WITH s AS (SELECT o_orderstatus AS name, avg(o_totalprice) AS v FROM orders GROUP BY 1) SELECT a.name AS name_a, b.name AS name_b, round(a.v - b.v, 6) AS difference FROM s a JOIN s b ON a.name < b.name")
def pairwise_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = X.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    return summaries.pairwise_differences(means, "o_orderstatus", "v")


_RUNS = "split_part(configuration_id, '-', 2) || '-' || seed AS run, split_part(configuration_id, '-', 1) AS classifier"


@query(
    "join_1_validation_test",
    f"""WITH {_SEEDS}, r AS (SELECT {_RUNS}, macro_f1 FROM s) SELECT run, round(v.macro_f1, 6) AS macro_f1_validation, round(t.macro_f1, 6) AS macro_f1_test, round(v.macro_f1 - t.macro_f1, 6) AS macro_f1_drop
FROM (SELECT * FROM r WHERE classifier = 'c1') v JOIN (SELECT * FROM r WHERE classifier = 'c2') t USING (run)""",
)
def validation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One classifier's metrics of every block and seed as validation, another's as test."""
    rows = _by_seed(spark, sf_dir).withColumns({"run": F.concat_ws("-", F.split_part("configuration_id", F.lit("-"), F.lit(2)), "seed"), "classifier": F.split_part("configuration_id", F.lit("-"), F.lit(1))})
    pick = lambda c: rows.where(F.col("classifier") == c).select("run", "macro_f1")
    return summaries.seed_comparison(pick("c1"), pick("c2"), ["macro_f1"], key="run")


@query("join_4_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = X.table(spark, sf_dir, "nation"), X.table(spark, sf_dir, "region")
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return X.table(spark, sf_dir, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("join_5_unknown_indices", "SELECT l_partkey AS row_index FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def unknown_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = X.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row_index")).distinct()
    return wanted.join(X.table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("row_index")), "row_index", "left_anti")


@query("join_7_parameter_grid", "SELECT s_suppkey, depth, leaf, sampler FROM supplier, (SELECT unnest([5, 10, NULL]) AS depth), (SELECT unnest([1, 5]) AS leaf), (SELECT unnest(['none', 'oversample']) AS sampler)")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each supplier, as for each dataset of several."""
    rows = X.table(spark, sf_dir, "supplier").select("s_suppkey")
    found = experiment.gridded(rows, {"max_depth": [5, 10, None], "min_samples_leaf": [1, 5], "sampler": ["none", "oversample"]})
    return found.select("s_suppkey", F.col("max_depth").alias("depth"), F.col("min_samples_leaf").alias("leaf"), "sampler")


@query("srt_4_top_confusions", f"WITH {P} SELECT actual_class AS actual, predicted_class AS predicted, count(*) AS n FROM predictions WHERE actual_class <> predicted_class GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5")
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = metrics.confusion(X.predictions(spark, sf_dir), []).where("actual <> predicted")
    return off.select("actual", "predicted", "n").orderBy(F.desc("n"), "actual", "predicted").limit(5)


@query("srt_5_first_errors", f"WITH {P} SELECT row_index, actual_class, predicted_class FROM predictions WHERE seed = 27 AND classifier = 'c0' AND actual_class <> predicted_class ORDER BY row_index LIMIT 5")
def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.predictions(spark, sf_dir).where("seed = 27 and classifier = 'c0' and actual_class <> predicted_class")
    return rows.orderBy("row_index").limit(5).select("row_index", "actual_class", "predicted_class")


@query("chk_7_probabilities", f"WITH {P} SELECT count(*) FILTER (row_index % 10 = 0) AS n_bad FROM predictions")
def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = lambda i: F.get("probabilities", F.lit(i)) * F.when(F.col("row_index") % 10 == 0, 1.01).otherwise(1.0)
    wide = X.predictions(spark, sf_dir).select(*[shift(i).alias(n) for i, n in enumerate(X.PROBABILITIES)])
    return wide.agg(checks.bad_probabilities(X.PROBABILITIES).alias("n_bad"))


@query(
    "chk_10_summary_rederived",
    """WITH stored AS (SELECT p_brand, avg(CASE WHEN p_partkey % 50 = 0 THEN p_size + 1 ELSE p_size END) AS mean FROM part WHERE p_brand <> 'Brand#13' GROUP BY 1),
rows AS (SELECT p_brand, avg(p_size) AS mean FROM part GROUP BY 1)
SELECT p_brand FROM stored FULL JOIN rows USING (p_brand) WHERE NOT coalesce(abs(stored.mean - rows.mean) <= 1e-12 + 1e-10 * abs(rows.mean), false)""",
)
def summary_rederived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored summary of rows of which some were larger then, and that lacks a brand."""
    part = X.table(spark, sf_dir, "part")
    stored = part.where("p_brand <> 'Brand#13'").groupBy("p_brand").agg(F.avg(F.when(F.col("p_partkey") % 50 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).alias("mean"))
    return checks.unequal(stored, part.groupBy("p_brand").agg(F.avg("p_size").alias("mean")), ["p_brand"], ["mean"])


_TIMES = """CASE WHEN l_orderkey % 31 = 0 THEN -1 ELSE 1 END * CAST(l_quantity AS DOUBLE) AS predict, CAST(l_tax AS DOUBLE) + 1 AS proba,
 CASE WHEN l_orderkey % 31 = 0 THEN -1 ELSE 1 END * CAST(l_quantity AS DOUBLE) + CAST(l_tax AS DOUBLE) + CASE WHEN l_partkey % 17 = 0 THEN 2 ELSE 1 END AS total, l_linenumber AS n, l_suppkey % 13 AS off"""


@query(
    "chk_13_timing",
    f"""WITH t AS (SELECT {_TIMES} FROM lineitem), r AS (SELECT *, total / n * 100 + CASE WHEN off = 0 THEN 0.5 ELSE 0 END AS per_100 FROM t)
SELECT count(*) FILTER (total < 0 OR predict < 0 OR proba < 0) AS n_negative, count(*) FILTER (abs(total - predict - proba) > 1e-9) AS n_sum_off, count(*) FILTER (abs(per_100 - total / n * 100) > 1e-9) AS n_ratio_off FROM r""",
)
def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "lineitem").selectExpr(*_split(_TIMES))
    rows = rows.withColumn("per_100", F.col("total") / F.col("n") * 100 + F.when(F.col("off") == 0, 0.5).otherwise(0.0))
    return summaries.timing_checks(rows, {"total": ["predict", "proba"]}, ("per_100", "total", "n"))


def _split(columns: str) -> list[str]:
    """The expressions of a list with an alias each."""
    return [c.strip() for c in re.split(r",(?=\s*(?:CASE|CAST|l_))", columns)]
