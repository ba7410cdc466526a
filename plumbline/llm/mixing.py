"""Mixing sources to target weights by systematic sampling.

Sources, in code point order with null last, weigh 5, 2, 1, repeating. Together they share
SHARE times the size (words) of all documents; a source's target stops at CAP times its own
size and what is above is shared again by weight. That fixed point is the level L with
sum(min(cap, L * weight)) = total, found from one sort of the sources by cap / weight.

Each document of a source expects target / source size copies. The documents of a source are
put in an order that does not depend on partitions: by stratum (whole square root of the
size), then one of 256 salts from the md5 of the id (in `mixed`, of a hash of the whole row), then size and id. Rows that agree in
all of these are interchangeable, so each task counts its own and only counts go on. The expected copies are
prefix-summed over that order in two levels - counts of every (source, stratum, salt), then
running counts within each - so that no task holds more than one salt of one stratum, however
large the source and however many rows share an id or have none. One offset per source comes from an md5 of seed and source; a document is
emitted once for every whole number its prefix sum crosses. Since the order is nearly by size,
the words taken stay within about one large document of the target.

Null texts have size 0 and, like all empty texts, take nothing and never change a total. A
source without words has target 0. Repeated rows are separate documents; those equal in size
and id are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import WORD, bounded, cut, ordered_id, read

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
SEED = "mix-27"
#: Salts of a stratum: a stratum of a hot source is split over so many tasks.
SALTS = 256

_KEYS = ["__null", "__source", "__stratum", "__salt"]


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (__null, __source, source_size) plus target: one row per source.

    The windows run over the table of sources, whose size is the number of sources.
    """
    by_name = Window.orderBy("__null", "__source")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("__weight", weight).withColumn("__cap", F.lit(cap) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__weight"), "__null", "__source")
    below, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (F.lit(share) * total - F.coalesce(F.sum("__cap").over(below), F.lit(0.0))) / F.sum("__weight").over(rest)
    fits = ranked.withColumn("__level", level).withColumn(
        "__level", F.when(F.col("__level") <= F.col("__cap") / F.col("__weight"), F.col("__level"))
    )
    # The first source that its level does not fill leaves that level to all after it.
    first = F.min(F.when(F.col("__level").isNotNull(), F.struct(F.col("__cap") / F.col("__weight"), "__null", "__source", "__level")))
    chosen = first.over(Window.partitionBy())["__level"]
    return fits.select("__null", "__source", "source_size", F.least("__cap", chosen * F.col("__weight")).alias("target"))


def words(text: Column) -> Column:
    """The size of a document."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def counted(docs: DataFrame, size: Column, carry: list[Column], apart: Column | None = None, seed: str = SEED, **shares) -> DataFrame:
    """carry, size, source_size and target of groups of n interchangeable rows of docs, with __before, __rate and __offset.

    docs has doc_id and source; salts come from apart, or else doc_id. docs is read twice: once for the totals of (source, stratum, salt), once
    for the rows themselves. Row i of a group, from 1, takes as many copies as whole numbers lie in
    (__before + i - 1, __before + i] times __rate, plus __offset.
    """
    carried = [f"__carry{i}" for i in range(len(carry))]
    source = F.coalesce(F.col("source"), F.lit(""))
    salt = F.substring(F.md5(F.coalesce((F.col("doc_id") if apart is None else apart).cast("string"), F.lit(""))), 1, 2)
    rows = docs.select(
        F.col("source").isNull().alias("__null"), source.alias("__source"), salt.alias("__salt"), F.col("doc_id").alias("__id"),
        size.alias("size"), *[c.alias(n) for c, n in zip(carry, carried, strict=True)],
    ).withColumn("__stratum", F.floor(F.sqrt(F.col("size").cast("double"))))
    cells = rows.groupBy(*_KEYS).agg(F.count("*").alias("__n"), F.sum("size").alias("__words"))
    sizes = cells.groupBy("__null", "__source").agg(F.sum("__words").alias("source_size"))
    before = Window.partitionBy("__null", "__source").orderBy("__stratum", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    starts = starts.join(targets(sizes, **shares), ["__null", "__source"]).select(*_KEYS, "__start", "source_size", "target")
    # A task's equal rows become one with their number; those of other tasks come beside it in the order.
    grouped = rows.groupBy(*_KEYS, "size", "__id", *carried, F.spark_partition_id().alias("__task")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*_KEYS).orderBy("size", "__id", *carried, "__task"))
    return grouped.withColumn("__within", upto - F.col("n")).join(starts, _KEYS).select(
        *carried, "size", "n", "source_size", "target",
        (F.col("__start") + F.col("__within")).alias("__before"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__rate"),
        _unit(F.concat(F.lit(f"{seed}:"), F.col("__source"))).alias("__offset"),
    )


def crossed(first: Column, last: Column) -> Column:
    """Whole numbers that rows first + 1 to last of counted's order cross."""
    return F.floor(last * F.col("__rate") + F.col("__offset")) - F.floor(first * F.col("__rate") + F.col("__offset"))


def copies(docs: DataFrame, size: Column, carry: list[Column], **options) -> DataFrame:
    """carry (as __carry0 ...) of every row of docs, with size, source_size, target and copies."""
    groups = counted(docs, size, carry, **options)
    each = groups.withColumn("__last", F.explode(F.sequence(F.col("__before") + 1, F.col("__before") + F.col("n"))))
    return each.select(*[f"__carry{i}" for i in range(len(carry))], "size", "source_size", "target", crossed(F.col("__last") - 1, F.col("__last")).alias("copies"))


def _identity(docs: DataFrame) -> Column:
    """A hash of the whole row, but for columns that hold maps, which Spark doesn't hash."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs.

    Only ids, sizes and hashes of rows are put in order; their copies are then joined to the rows, whose texts are
    shuffled only if the copies are too many to broadcast, and never sorted. Of rows that repeat every column (columns that
    hold maps, which Spark doesn't compare, do not count) one is emitted for all of them.
    """
    sized = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size"), _identity(docs).alias("row")))
    groups = counted(sized, F.col("size"), [ordered_id(), F.col("row")], apart=F.col("row"), **options)
    of_group = crossed(F.col("__before"), F.col("__before") + F.col("n"))
    taken = groups.groupBy(F.col("__carry0").alias("id"), F.col("__carry1").alias("row")).agg(F.sum(of_group).alias("copies"), F.sum("n").alias("times"))
    rows = docs.select(F.struct("*").alias("__row"), ordered_id().alias("id"), _identity(docs).alias("row"))
    rows = rows.join(bounded(cut(taken.where("copies > 0"), sized)), ["id", "row"])
    chosen = rows.where("times = 1").unionByName(rows.where("times > 1").dropDuplicates(["id", "row"]))
    return chosen.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).select("__row.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(read(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size")))
    return copies(sized, F.col("size"), [F.col("doc_id")]).select(
        F.col("__carry0").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS nul, coalesce(source, '') AS src, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS salt,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT nul, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY nul, src) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / (sum(weight) OVER (ORDER BY cap / weight, nul, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w
), t AS (
  SELECT nul, src, source_size,
         least(cap, weight * (SELECT arg_min(level, (ratio, nul, src)) FROM l WHERE level <= ratio)) AS target
  FROM l
), r AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-27:' || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY nul, src ORDER BY floor(sqrt(size::DOUBLE)), salt, size, doc_id) AS n
  FROM d JOIN t USING (nul, src)
)
SELECT doc_id, size, source_size, target,
       (size * (floor(n * rate + u) - floor((n - 1) * rate + u)))::BIGINT AS taken
FROM r
"""
