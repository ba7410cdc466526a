"""Seeded stratified sampling, splitting, folding and balancing; draws are ordered by an md5 of seed and row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.columns import draw
from plumbline.operators.prepare import MOST_CATEGORIES


#: Hex digits of a draw that split a class.
DIGITS = 3
#: Classes whose counts by first digits are broadcast; of more they meet the rows by a shuffle.
BROADCAST_CLASSES = 50
#: Draws of all classes that are broadcast, a few MB.
BROADCAST_DRAWS = 200_000
#: Draws that one row makes; the draws of a class are spread over as many rows as that takes.
CHUNK = 100_000


def allocations(counts: list[tuple[str, int]], size: int) -> dict[str, int]:
    """How many of each class a sample of exactly size takes: proportional, at least one, at most all.

    What floors leave over goes to the class with the largest remainder until it is full, then to the next; what minimums
    take too much comes from the smallest remainder in the same way. Ties go by the larger class, then by the first in
    order. One entry for each class, so this is a small driver-side sum.
    """
    counts = sorted(counts)
    total = sum(n for _, n in counts)
    if not 0 < size <= total:
        raise ValueError(f"a sample of {size} from {total} rows is not possible")
    if size < len(counts):
        raise ValueError(f"a sample of {size} can't hold {len(counts)} classes")
    quota = {c: n * size / total for c, n in counts}
    taken = {c: min(n, max(1, int(quota[c]))) for c, n in counts}
    rest = {c: quota[c] - int(quota[c]) for c, _ in counts}
    order = {c: i for i, (c, _) in enumerate(counts)}
    room, number = dict(counts), sum(taken.values())
    while number < size:
        best = max((c for c in taken if taken[c] < room[c]), key=lambda c: (rest[c], room[c], -order[c]))
        taken[best] += 1
        number += 1
    while number > size:
        best = min((c for c in taken if taken[c] > 1), key=lambda c: (rest[c], -room[c], order[c]))
        taken[best] -= 1
        number -= 1
    return taken


def ranked(rows: DataFrame, target: str, seed: int, key: str) -> DataFrame:
    """rows plus __nth: the place of each row in the draw of its class.

    Rows are counted by class and the first DIGITS hex digits of their draw, and numbered within those, so that a class is
    spread over 16 ** DIGITS groups however large it is. The counts, so many rows a class at most, are broadcast for up to
    BROADCAST_CLASSES classes.
    """
    drawn = rows.withColumn("__draw", draw(seed, F.col(key))).withColumn("__part", F.substring("__draw", 1, DIGITS))
    counts = drawn.groupBy(F.col(target).alias("__class"), F.col("__part").alias("__first")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__class").orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__class", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(target, "__part").orderBy("__draw", key))
    met = F.col(target).eqNullSafe(F.col("__class")) & F.col("__part").eqNullSafe(F.col("__first"))
    few = rows.select(target).distinct().limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    numbered = drawn.join(F.broadcast(starts) if few else starts.hint("shuffle_hash"), met, "left").withColumn("__nth", (F.col("__start") + inside).cast("int"))
    return numbered.select(*rows.columns, "__nth")


def stratified_sample(rows: DataFrame, target: str, size: int, seed: int, key: str) -> DataFrame:
    """Exactly size rows, classes in proportion; more than MOST_CATEGORIES classes raise."""
    counts = [(r[0], r[1]) for r in rows.groupBy(target).count().limit(MOST_CATEGORIES + 1).collect()]
    if len(counts) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} classes")
    if any(c is None for c, _ in counts):
        raise ValueError(f"{target} has missing values")
    share = rows.sparkSession.createDataFrame(list(allocations(counts, size).items()), f"{target} string, __take int")
    return ranked(rows, target, seed, key).join(F.broadcast(share), target).where(F.col("__nth") <= F.col("__take")).select(*rows.columns)


def stratified_split(rows: DataFrame, target: str, share: float, seed: int, key: str) -> DataFrame:
    """rows plus split: test for ceil(share * n) rows, classes in proportion, train for the others."""
    n = rows.count()
    test = stratified_sample(rows, target, -int(-share * n // 1), seed, key).select(key, F.lit(True).alias("__test"))
    return rows.join(test, key, "left").withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def folds(rows: DataFrame, target: str, k: int, seed: int, key: str) -> DataFrame:
    """rows plus fold from 1 to k; within a class fold sizes differ by one at most."""
    return ranked(rows, target, seed, key).withColumn("fold", fold_of(k)).drop("__nth")


def fold_of(k: int) -> Column:
    """The fold, from 1 to k, of a row of ranked."""
    return (F.col("__nth") - 1) % k + 1


def without_fold(rows: DataFrame, k: int, fold: int) -> DataFrame:
    """The rows of ranked that are not of a fold, ranked among themselves: as many places less as there are rows of the fold before."""
    before = F.floor((F.col("__nth") - 1 - fold + k) / k).cast("int")
    return rows.where(fold_of(k) != fold).withColumn("__nth", F.col("__nth") - before)


def oversampled(rows: DataFrame, target: str, seed: int, key: str) -> DataFrame:
    """All rows, and for each smaller class draws with replacement up to the size of the largest; copy is 0 for originals, then 1, 2 ...

    Rows that have __nth are ranked already, and only classes that lack rows meet their draws. Up to BROADCAST_DRAWS draws, of
    up to BROADCAST_CLASSES classes, go to the rows, which are read once; of more, both are shuffled.
    """
    sizes = rows.groupBy(target).agg(F.count("*").alias("__n"))
    counted = sizes.limit(BROADCAST_CLASSES + 1).collect()
    few = len(counted) <= BROADCAST_CLASSES
    if few:
        sizes = rows.sparkSession.createDataFrame(counted, sizes.schema)
    most = max((r["__n"] for r in counted), default=0)
    sizes = sizes.withColumn("__lack", (F.lit(most) if few else F.max("__n").over(Window.partitionBy())) - F.col("__n"))
    chunks = sizes.where("__lack > 0").select(target, "__n", "__lack", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__lack") - 1) / CHUNK))).alias("__chunk"))
    first = F.col("__chunk") * CHUNK + 1
    spread = chunks.repartition(target, "__chunk")
    draws = spread.select(target, "__n", F.explode(F.sequence(first, F.least(first + (CHUNK - 1), F.col("__lack")))).alias("copy"))
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(target), F.lit(":"), F.col("copy").cast("string"))), 1, 12), 16, 10).cast("long")
    draws = draws.select(target, "copy", (number % F.col("__n") + 1).alias("__nth"))
    placed = rows if "__nth" in rows.columns else ranked(rows, target, seed, key)
    rows = rows.drop("__nth")
    if few and sum(most - r["__n"] for r in counted) <= BROADCAST_DRAWS:
        copies = draws.groupBy(target, "__nth").agg(F.collect_list("copy").alias("__copies"))
        each = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("__copies", F.array().cast("array<long>")))
        return placed.join(F.broadcast(copies), [target, "__nth"], "left").select(*rows.columns, F.explode(each).alias("copy"))
    smaller = placed.join(sizes.where("__lack > 0").select(target), target, "left_semi")
    extra = smaller.join(draws, [target, "__nth"]).select(*rows.columns, "copy")
    return rows.withColumn("copy", F.lit(0).cast("long")).unionByName(extra)


def few_shot(rows: DataFrame, target: str, per_class: int, seed: int, key: str) -> DataFrame:
    """At most per_class rows of each class, by class and row, numbered from 1 as example."""
    chosen = ranked(rows, target, seed, key).where(F.col("__nth") <= per_class).drop("__nth")
    return chosen.withColumn("example", F.row_number().over(Window.orderBy(target, key)))


def target_faults(rows: DataFrame, target: str, key: str) -> DataFrame:
    """n_null_targets, n_null_keys and n_repeated_keys (rows beyond the first of a key): all 0 if rows can be sampled."""
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"), F.count_if(F.col(target).isNull()).alias("__t"))
    total = lambda value, name: F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name)
    unkeyed = F.col(key).isNull()
    return counts.agg(total(F.col("__t"), "n_null_targets"), total(F.when(unkeyed, F.col("__n")), "n_null_keys"), total(F.when(~unkeyed, F.col("__n") - 1), "n_repeated_keys"))


def guarded(rows: DataFrame, target: str, key: str) -> DataFrame:
    """rows, if target_faults finds nothing; else ValueError with what it found."""
    found = {name: n for name, n in target_faults(rows, target, key).first().asDict().items() if n}
    if found:
        raise ValueError("; ".join(f"{name}: {n}" for name, n in found.items()))
    return rows
