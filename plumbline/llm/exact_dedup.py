"""Exact dedup with a heavy-hitter split.

Texts are equal when identical after every run of white space became one space; they are
compared by SHA-256. A Misra-Gries summary per partition, merged under the same bound, holds
every digest that more than one row in COUNTERS + 1 carries. Exact counts verify those
candidates, and the winners (at most COUNTERS rows, so a broadcast of bounded size) settle
their copies on the map side. Only the other digests are shuffled, and none of their groups
can hold more than one row in COUNTERS + 1.

Null texts count as empty, and empty texts equal each other. Of equal texts the smallest
doc_id stays (null ids last); of rows that repeat both text and id, exactly one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import cut, ordered_id, read, without_marked

#: Counters of the summary: digests of more than one row in COUNTERS + 1 are found, and at most so many broadcast.
COUNTERS = 8192

#: Only the runs that are not already a single space, so that few matches are replaced.
CHANGED_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with every run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), CHANGED_RUN, " "), 256))


def merge_counters(counters: dict[bytes, int], k: int) -> dict[bytes, int]:
    """The Misra-Gries reduction: lower all by the (k + 1)-th largest count, keep what is above zero."""
    if len(counters) <= k:
        return counters
    least = sorted(counters.values(), reverse=True)[k]
    return {key: n - least for key, n in counters.items() if n > least}


def summaries(digests: DataFrame, k: int) -> DataFrame:
    """One Misra-Gries summary of at most k (digest, n) rows per partition."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters: dict[bytes, int] = {}
        for batch in batches:
            for key, n in batch["digest"].value_counts().items():
                counters[bytes(key)] = counters.get(bytes(key), 0) + int(n)
            counters = merge_counters(counters, k)
        yield pd.DataFrame({"digest": list(counters), "n": list(counters.values())}).astype({"n": "int64"})

    return digests.select("digest").mapInPandas(summarise, "digest binary, n long")


def heavy_winners(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """(digest, group_size, first) of each digest carried by more than one row in k + 1; at most k rows.

    digests has digest and first, a struct that orders the rows of a digest.
    """
    spark = digests.sparkSession
    merged = summaries(digests, k).groupBy("digest").agg(F.sum("n").alias("n"))
    top = merged.orderBy(F.desc("n"), "digest").limit(k + 1).collect()
    least = top[k]["n"] if len(top) > k else 0
    candidates = spark.createDataFrame([(r["digest"],) for r in top if r["n"] > least], "digest binary")
    total = digests.count()
    return (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.min("first").alias("first"))
        .where(F.col("group_size") * (k + 1) > total)
    )


def groups(docs: DataFrame, k: int = COUNTERS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text)).alias("digest"))
    first = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", F.monotonically_increasing_id().alias("row"))
    rows = cut(rows.select("digest", first.alias("first")))
    winners = heavy_winners(rows, k).withColumnsRenamed({"first": "heavy_first", "group_size": "heavy_size"})
    tagged = rows.join(F.broadcast(winners), "digest", "left")
    heavy = tagged.where("heavy_first is not null").select(
        "digest", "first", F.col("heavy_first").alias("keep"), F.col("heavy_size").alias("group_size")
    )
    same = Window.partitionBy("digest")
    light = tagged.where("heavy_first is null").select(
        "digest", "first", F.min("first").over(same).alias("keep"), F.count("*").over(same).alias("group_size")
    )
    return heavy.unionByName(light).select(
        F.col("first.doc_id").alias("doc_id"),
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("first") == F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with its columns.

    Digests and ids are grouped, not texts: heavy digests by their broadcast winners, the others by a shuffle. What
    has to go is then taken out of docs.
    """
    rows = cut(docs.select(digest(F.col("text")).alias("digest"), ordered_id().alias("first")))
    winners = heavy_winners(rows, k).select("digest", F.col("first").alias("keep"))
    known = rows.groupBy("digest", "first").agg(F.count("*").alias("times"))
    heavy = known.join(F.broadcast(winners), "digest")
    light = known.join(F.broadcast(winners), "digest", "left_anti")
    several = light.groupBy("digest").agg(F.min("first").alias("keep"), F.sum("times").alias("n")).where("n > 1").select("digest", "keep")
    marks = heavy.unionByName(light.join(several, "digest")).withColumn("gone", F.col("first") != F.col("keep"))
    return without_marked(docs, marks.where("gone or times > 1").select("digest", "first", "gone", "times"), digest)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
