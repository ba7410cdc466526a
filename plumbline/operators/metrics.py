"""Classification metrics as aggregates over (keys, actual, predicted, scores)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.columns import ratio


def _rows(times: str | None) -> Column:
    """How many rows a row stands for: one, or its column of that name."""
    return F.col(times) if times else F.lit(1).cast("long")


def confusion(rows: DataFrame, keys: Sequence[str], classes: Sequence[str] = (), actual: str = "actual_class", predicted: str = "predicted_class", times: str | None = None) -> DataFrame:
    """keys, actual, predicted, n, share of the actual class; with classes every pair of them, 0 where none occur. times is a column with how many equal rows a row stands for."""
    keys = list(keys)
    counted = rows.groupBy(*keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg((F.sum(times) if times else F.count("*")).alias("n"))
    if classes:
        pair = F.explode(F.array(*map(F.lit, classes)))
        every = counted.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
        every = every.select(*keys, pair.alias("actual")).select(*keys, "actual", pair.alias("predicted"))
        counted = every.join(counted, [*keys, "actual", "predicted"], "left").na.fill(0, ["n"])
    return counted.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*keys, "actual"))))


def per_class(matrix: DataFrame, keys: Sequence[str], classes: Sequence[str] = ()) -> DataFrame:
    """keys, class, tp, support, n_predicted, precision, recall, f1, fp, fn from a confusion in long form.

    Classes are those that occur, or the given ones, whatever else occurs counting as wrong.
    """
    keys = list(keys)
    cells = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("n_predicted"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("n_predicted"), F.lit(0).cast("long").alias("tp")),
    )
    sums = matrix.where("n > 0").select(*keys, F.explode(cells).alias("c")).groupBy(*keys, F.col("c.class").alias("class")).agg(*[F.sum(f"c.{x}").alias(x) for x in ("tp", "support", "n_predicted")])
    if classes:
        every = matrix.select(*keys).distinct() if keys else matrix.sparkSession.range(1).select()
        every = every.select(*keys, F.explode(F.array(*map(F.lit, classes))).alias("class"))
        sums = every.join(sums, [*keys, "class"], "left").na.fill(0)
    tp, t, p = F.col("tp"), F.col("support"), F.col("n_predicted")
    return sums.withColumns({"precision": ratio(tp, p), "recall": ratio(tp, t), "f1": ratio(2 * tp, t + p), "fp": p - tp, "fn": t - tp})


def summary_metrics(rows: DataFrame, keys: Sequence[str], classes: Sequence[str] = (), actual: str = "actual_class", predicted: str = "predicted_class", times: str | None = None) -> DataFrame:
    """keys, accuracy, precision, recall, macro_f1, mcc, balanced_accuracy.

    Macro means are over the classes that occur as actual or predicted, balanced accuracy over the actual ones; with
    classes all are over those.
    """
    keys = list(keys)
    matrix = confusion(rows, keys, (), actual, predicted, times)
    own = per_class(matrix, keys, classes)
    everything = per_class(matrix, keys)
    means = own.groupBy(*keys).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("macro_f1"),
        (F.avg("recall") if classes else F.avg(F.when(F.col("support") > 0, F.col("recall")))).alias("balanced_accuracy"),
    )
    tp, t, p = (F.col(c).cast("double") for c in ("tp", "support", "n_predicted"))
    sums = everything.groupBy(*keys).agg(F.sum(tp).alias("__c"), F.sum(t).alias("__s"), F.sum(p * t).alias("__pt"), F.sum(p * p).alias("__pp"), F.sum(t * t).alias("__tt"))
    c, s, pt, pp, tt = (F.col(f"__{x}") for x in ("c", "s", "pt", "pp", "tt"))
    mcc = ratio(c * s - pt, F.sqrt((s * s - pp) * (s * s - tt)))
    joined = means.join(sums, keys) if keys else means.withColumn("__1", F.lit(1)).join(sums.withColumn("__1", F.lit(1)), "__1")
    return joined.select(*keys, ratio(c, s).alias("accuracy"), "precision", "recall", "macro_f1", mcc.alias("mcc"), "balanced_accuracy")


def _ranked(scores: DataFrame, keys: Sequence[str], times: str | None = None) -> DataFrame:
    """keys, score, pos, n of each distinct score: equal scores are combined before any window."""
    return scores.groupBy(*keys, "score").agg(F.sum(F.col("positive").cast("long") * _rows(times)).alias("pos"), F.sum(_rows(times)).alias("n"))


def _range(score: Column) -> Column:
    """The number of a range of scores, in their order: 64 to a unit of log odds of a probability; what is none lies in the first or last."""
    inside = F.floor(64 * F.log(score / (1 - score)))
    return F.when(score.isNull() | (score <= 0), F.lit(-(1 << 20))).when(score < 1, inside).otherwise(F.lit(1 << 20)).cast("long")


def _before(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ranked (keys, score, pos, n) plus pos_below and n_below: the sums over all smaller scores of the keys.

    Sums of ranges of scores are run up first, then the scores within each range, so no task holds all scores of a group.
    """
    each = ranked.withColumn("__range", _range(F.col("score")))
    ranges = each.groupBy(*keys, "__range").agg(F.sum("pos").alias("__pos"), F.sum("n").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*keys, "__range", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c + "0") for c in ("__pos", "__n")])
    inside = Window.partitionBy(*keys, "__range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = [(F.col(f"__{c}0") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_below") for c in ("pos", "n")]
    return each.join(starts, [*keys, "__range"]).select(*keys, "score", "pos", "n", *below)


def roc_auc(scores: DataFrame, keys: Sequence[str], times: str | None = None) -> DataFrame:
    """keys (not NULL), roc_auc from (keys, positive, score): rank sums with mean ranks for ties; NULL where a class is missing."""
    ranked = _before(_ranked(scores, keys, times), keys).withColumn("rank", F.col("n_below") + (F.col("n") + 1) / F.lit(2.0))
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("__r"), F.sum("pos").alias("__p"), F.sum("n").alias("__n"))
    pos, neg = F.col("__p").cast("double"), (F.col("__n") - F.col("__p")).cast("double")
    return sums.select(*keys, F.try_divide(F.col("__r") - pos * (pos + 1) / F.lit(2.0), pos * neg).alias("roc_auc"))


def average_precision(scores: DataFrame, keys: Sequence[str], times: str | None = None) -> DataFrame:
    """keys (not NULL), pr_auc: precision at each distinct score times the recall gained there."""
    ranked = _ranked(scores, keys, times)
    totals = ranked.groupBy(*keys).agg(F.sum("pos").alias("__p"), F.sum("n").alias("__all"))
    below = _before(ranked, keys)
    both = below.join(totals, list(keys)) if keys else below.withColumn("__1", F.lit(1)).join(totals.withColumn("__1", F.lit(1)), "__1")
    tp, n = F.col("__p") - F.col("pos_below"), F.col("__all") - F.col("n_below")  # at this score and above
    sums = both.groupBy(*keys).agg(F.sum(F.col("pos") * tp.cast("double") / n).alias("__a"), F.max("__p").cast("double").alias("__p"))
    return sums.select(*keys, F.try_divide(F.col("__a"), F.col("__p")).alias("pr_auc"))


def one_versus_rest(rows: DataFrame, keys: Sequence[str], classes: Sequence[str], probabilities: Sequence[str], actual: str = "actual_class", times: str | None = None) -> DataFrame:
    """keys, class, positive, score, and times if it is given: a row for each class of each row."""
    cells = F.array(*[F.struct(F.lit(c).alias("class"), (F.col(actual) == c).alias("positive"), F.col(f"`{p}`").alias("score")) for c, p in zip(classes, probabilities, strict=True)])
    kept = [*keys, *([times] if times else [])]
    return rows.select(*kept, F.explode(cells).alias("c")).select(*kept, "c.*")


def macro_auc(rows: DataFrame, keys: Sequence[str], classes: Sequence[str], probabilities: Sequence[str], actual: str = "actual_class", times: str | None = None) -> DataFrame:
    """keys, roc_auc, pr_auc: for two classes of the second, for more the mean over one-versus-rest."""
    scores = one_versus_rest(rows, keys, classes, probabilities, actual, times)
    if len(classes) == 2:
        scores = scores.where(F.col("class") == classes[1])
    by = [*keys, "class"]
    both = roc_auc(scores, by, times).join(average_precision(scores, by, times), by)
    return both.groupBy(*keys).agg(F.avg("roc_auc").alias("roc_auc"), F.avg("pr_auc").alias("pr_auc"))


def errors(rows: DataFrame, keys: Sequence[str], actual: str = "actual_class", predicted: str = "predicted_class") -> DataFrame:
    """keys, n, n_errors, error_rate."""
    wrong = F.col(actual) != F.col(predicted)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(wrong).alias("n_errors"), F.avg(wrong.cast("double")).alias("error_rate"))


def coverage(rows: DataFrame, keys: Sequence[str], valid: str = "response_valid") -> DataFrame:
    """keys, n, n_invalid, coverage, invalid_rate."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(~F.col(valid)).alias("n_invalid"), F.avg(F.col(valid).cast("double")).alias("coverage"), F.avg((~F.col(valid)).cast("double")).alias("invalid_rate")
    )


def missing_classes(rows: DataFrame, classes: Sequence[str], actual: str = "actual_class") -> DataFrame:
    """Classes without any actual row."""
    every = rows.sparkSession.createDataFrame([(c,) for c in classes], f"{actual} string")
    return every.join(rows.select(actual).distinct(), actual, "left_anti")


def all_classes(rows: DataFrame, classes: Sequence[str], actual: str = "actual_class") -> DataFrame:
    """rows, if each of classes has an actual row; else ValueError naming those that have none."""
    if lacking := sorted(r[0] for r in missing_classes(rows, classes, actual).collect()):
        raise ValueError(f"no rows of {', '.join(lacking)}")
    return rows
