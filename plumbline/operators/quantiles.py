"""Exact quantiles by selection, in rounds.

Spark's exact percentile keeps every distinct value of a group in one buffer. Here a mergeable sketch brackets each
wanted rank (a few thousandths of the group). Where a bracket may still hold more than MOST_INSIDE rows, another pass
counts what is below it, sketches what is in it, and takes the part around the rank, until it holds no more or a single
value. A last pass counts the rows below and the values inside each bracket: every row adds to one counter of its group,
in its task, and only values inside brackets are rows of their own. Those are shuffled and ranked, so no task ranks more
than the values of a bracket.

Groups of fewer than SMALL rows need none of that: a task sorts each whole, so their rows are shuffled once, as they are. Groups
are counted first, and only those of SMALL rows and more have sketches.

Brackets are computed when exact_quantiles is called. They come to the driver where there are at most MOST_GROUPS groups,
and are broadcast; of more groups only those with too many rows do, of which there can't be many, and the others meet
their values by a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rank error of a sketch is 1 / ACCURACY of its rows; half the width of a bracket; groups with keys and below SMALL rows are sorted whole.
ACCURACY, WIDTH, SMALL = 1000, 0.003, 5000
#: Rows of a bracket beyond which it is narrowed, into one of GRID parts and the two on either side of it; passes at most.
MOST_INSIDE, GRID, ROUNDS = 100_000, 100, 12
MOST_GROUPS = 20_000
_INF = float("inf")


def _met(keys: Sequence[str], values: DataFrame, brackets: DataFrame, how: str = "inner") -> DataFrame:
    """values with the columns of the brackets of their group."""
    named = {k: f"__k{i}" for i, k in enumerate(keys)}
    same = F.lit(True)
    for k, n in named.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    others = [c for c in brackets.columns if c not in named]
    return values.join(brackets.select(*(F.col(k).alias(n) for k, n in named.items()), *others), same, how).drop(*named.values())


def _sketch(of: Column, shares: Sequence[float]) -> Column:
    return F.percentile_approx(of, F.array(*map(F.lit, shares)), ACCURACY)


def _narrowed(values: DataFrame, keys: Sequence[str], held: list[dict], probabilities: Sequence[float]) -> None:
    """Narrows the brackets (lo, hi) of held groups in place until they are small enough."""
    spark, grid = values.sparkSession, [i / GRID for i in range(GRID + 1)]
    kind = T.StructType([values.schema[k] for k in keys]).add("__g", "integer").add("__i", "integer").add("__from", "double").add("__to", "double")
    share = {(g, i): 2 * WIDTH * r["n"] for g, r in enumerate(held) for i in range(len(probabilities)) if r["n"] >= SMALL}
    for _ in range(ROUNDS):
        wide = [(g, i) for (g, i), inside in share.items() if inside > MOST_INSIDE and held[g]["lo"][i] < held[g]["hi"][i]]
        if not wide:
            return
        rows = spark.createDataFrame([(*held[g]["key"], g, i, held[g]["lo"][i], held[g]["hi"][i]) for g, i in wide], kind)
        own = _met(keys, values, F.broadcast(rows))
        inside = F.col("__v").between(F.col("__from"), F.col("__to"))
        counts = own.groupBy("__g", "__i").agg(F.count_if(F.col("__v") < F.col("__from")).alias("below"), F.count_if(inside).alias("inside"), _sketch(F.when(inside, F.col("__v")), grid).alias("parts"))
        for r in counts.collect():
            group, i = held[r["__g"]], r["__i"]
            place = (probabilities[i] * (group["n"] - 1) - r["below"]) / max(1, r["inside"] - 1) * GRID
            low, high = max(0, int(place) - 2), min(GRID, int(place) + 3)
            # the ends stay where the part reaches them
            group["lo"][i], group["hi"][i] = (r["parts"][low] if low else group["lo"][i]), (r["parts"][high] if high < GRID else group["hi"][i])
            share[r["__g"], i] = r["inside"] * (high - low) / GRID


def _sorted_whole(values: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """keys, p, quantile of the values (keys, __v) of groups that are small enough for a task to sort."""
    group, v = Window.partitionBy(*keys), F.col("__v")
    each = values.withColumns({"__n": F.count("*").over(group), "__rank": F.row_number().over(group.orderBy("__v")) - 1})
    at = [F.lit(p) * (F.col("__n") - 1) for p in probabilities]
    holds = lambda rank: F.max(F.when((F.col("__rank") == rank) & ~F.isnan(v), v))
    ends = [holds(side(a)).alias(f"__{name}{i}") for i, a in enumerate(at) for name, side in (("lo", F.floor), ("hi", F.ceil))]
    wide = each.groupBy(*keys).agg(F.max("__n").alias("__n"), *ends)
    low, high = ([F.col(f"__{name}{i}") for i in range(len(probabilities))] for name in ("lo", "hi"))
    cells = [F.struct(F.lit(p).alias("p"), (lo + (hi - lo) * (a - F.floor(a))).alias("quantile")) for p, a, lo, hi in zip(probabilities, at, low, high, strict=True)]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("__c")).select(*keys, "__c.p", "__c.quantile").where("quantile is not null")


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """keys, p, quantile: linear interpolation between the two nearest ranks of the non-null values of each group."""
    keys, probabilities = list(keys), sorted(probabilities)
    values = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    if not keys:
        return _selected(values, keys, probabilities)
    counts = values.groupBy(*keys).agg(F.count("*").alias("__n"))
    n = counts.agg(F.count_if(F.col("__n") < SMALL).alias("small"), F.count_if(F.col("__n") >= SMALL).alias("large")).first()
    if n["large"] and not n["small"]:
        return _selected(values, keys, probabilities)
    large = counts.where(F.col("__n") >= SMALL)
    marked = _met(keys, values, F.broadcast(large) if n["large"] <= MOST_GROUPS else large.hint("shuffle_hash"), "left")
    small = _sorted_whole(marked.where("__n is null").drop("__n"), keys, probabilities)
    return small.unionByName(_selected(marked.where("__n is not null").drop("__n"), keys, probabilities)) if n["large"] else small


def _selected(values: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """keys, p, quantile of values (keys, __v), by brackets."""
    spark = values.sparkSession
    bounds = [min(1.0, max(0.0, p + side)) for p in probabilities for side in (-WIDTH, WIDTH)]
    stats = values.groupBy(*keys).agg(F.count("*").alias("__n"), _sketch(F.col("__v"), bounds).alias("__b"))
    small, n = F.col("__n") < SMALL, range(len(probabilities))
    ends = [F.array(*(F.when(small, F.lit(side)).otherwise(F.col("__b")[2 * i + at]) for i in n)).alias(name) for name, side, at in (("__lo", -_INF, 0), ("__hi", _INF, 1))]
    brackets = stats.select(*keys, "__n", *ends)

    def found(many: DataFrame) -> list[dict]:
        return [{"key": tuple(r[k] for k in keys), "n": r["__n"], "lo": list(r["__lo"]), "hi": list(r["__hi"])} for r in many.collect()]

    def local(held: list[dict]) -> DataFrame:
        _narrowed(values, keys, held, probabilities)
        return F.broadcast(spark.createDataFrame([(*h["key"], h["n"], h["lo"], h["hi"]) for h in held], brackets.schema))

    held = found(brackets.limit(MOST_GROUPS + 1))
    if len(held) <= MOST_GROUPS:
        joined = _met(keys, values, local(held))
    else:
        large = local(found(brackets.where(F.col("__n") * (2 * WIDTH) > MOST_INSIDE)))
        others = brackets.where(F.col("__n") * (2 * WIDTH) <= MOST_INSIDE)
        joined = _met(keys, values, large).unionByName(_met(keys, values, others.hint("shuffle_hash")))
    # a row counts under -1 - the number of brackets that begin at or below it, and for each bracket it is in as its value
    v, last = F.col("__v"), len(probabilities) - 1
    own = [v.between(F.col("__lo")[i], F.col("__hi")[i]) for i in n]
    outside = F.struct((F.lit(-1) - sum(((v >= F.col("__lo")[i]).cast("int") for i in n), F.lit(0))).alias("i"), F.lit(None).cast("double").alias("v"))
    each = F.array(outside, *(F.when(o, F.struct(F.lit(i).alias("i"), v.alias("v"))) for i, o in enumerate(own)))
    cells = F.when(reduce(Column.__or__, own), each).otherwise(F.array(outside))
    placed = joined.select(*keys, "__n", F.explode(cells).alias("__c")).where("__c is not null")
    counted = placed.groupBy(*keys, "__n", F.col("__c.i").alias("__i"), F.col("__c.v").alias("__v")).agg(F.count("*").alias("__m"))
    # the rows of counter -1 - k are below the brackets k and after
    under = F.when(F.col("__i") >= 0, F.array("__i")).when(-1 - F.col("__i") <= last, F.sequence(-1 - F.col("__i"), F.lit(last)))
    both = counted.select(*keys, "__n", "__v", "__m", F.explode(under).alias("__i"))
    order = Window.partitionBy(*keys, "__i").orderBy(F.col("__v").asc_nulls_first())
    upto = F.sum("__m").over(order.rowsBetween(Window.unboundedPreceding, 0))
    p = F.element_at(F.array(*map(F.lit, probabilities)), F.col("__i") + 1)
    ranked = both.withColumns({"__to": upto, "p": p}).withColumn("__at", F.col("p") * (F.col("__n") - 1))
    low, high = F.floor("__at"), F.ceil("__at")
    holds = lambda rank: F.max(F.when((rank < F.col("__to")) & (rank >= F.col("__to") - F.col("__m")), F.col("__v")))
    chosen = ranked.groupBy(*keys, "p", "__at").agg(holds(low).alias("__lo"), holds(high).alias("__hi"))
    part = F.col("__at") - F.floor("__at")
    return chosen.select(*keys, "p", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * part).alias("quantile"))


def quantile_columns(rows: DataFrame, keys: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """exact_quantiles with a column for each name."""
    found = exact_quantiles(rows, keys, value, list(named.values()))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name) for name, p in named.items()])
