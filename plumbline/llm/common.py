"""What several training-data operators share: word splitting, reading, and cutting lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of an Arrow batch.
TEXT_ROWS = 128
#: The white space of all word and text contracts: space, and tab to carriage return.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: Column) -> Column:
    """Array of the maximal runs without white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master may go without that setting; it gets a folder of its own in the
    machine's temporary folder, since driver and executors are then one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame, *replaces: DataFrame | None) -> DataFrame:
    """Compute df once into a table in the shared folder, and go on from the written rows.

    replaces are earlier results of cut that nothing reads once df is written; their tables are deleted then.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[written] = path
    forget(*replaces)
    return written


def forget(*frames: DataFrame | None) -> None:
    """Delete the tables of results of cut that nothing reads any more."""
    for frame in frames:
        if frame is not None and frame in _folders:
            delete(frame.sparkSession, _folders.pop(frame))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared folder, by the file system of its path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows up to which a side whose size was counted is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def bounded(side: DataFrame) -> DataFrame:
    """side, of narrow rows with distinct keys, as the side of a join that is held in memory: whole, or by shuffled parts."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side.hint("shuffle_hash")


def by_size(rows: DataFrame, side: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """The inner or left join of rows with side, which has distinct keys and in size at least how many of rows each key meets.

    Keys of more than one row in BROADCAST_ROWS, at most so many, are broadcast, so that no task gets all rows of a hot key;
    those of the others meet by a shuffle. side is read several times.
    """
    n, total = side.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), keys, how)
    often = F.col(size) * BROADCAST_ROWS > total
    hot = F.broadcast(side.where(often))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(side.where(~often).hint("shuffle_hash"), keys, how))


def ordered_id() -> Column:
    """What orders the rows of a group: doc_id, null last."""
    return F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id"))


def without_marked(docs: DataFrame, marks: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The rows of docs but those marked: marks has first (an ordered_id), digest, gone and times, a row for each first and digest.

    Of rows with a mark that isn't gone one stays of each first and digest; times counts them. Marks are never gathered by
    id, so many rows may share one or have none. A few marks are broadcast, and digests are taken only of the texts under a
    marked id. Of more, those of the most rows are broadcast, at most BROADCAST_ROWS; the others are shuffled with docs.
    """
    keys = ["first", "digest"]
    marks = cut(marks.select(*keys, "gone", "times"))
    n, marked_rows = marks.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0))).first()
    rows = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), ordered_id().alias("first"))
    if n <= BROADCAST_ROWS:
        ids = F.broadcast(marks.select("first", F.lit(True).alias("marked")).distinct())
        rows = rows.join(ids, "first", "left").select("__row", "first", F.when(F.col("marked"), digest(F.col("text"))).alias("digest"))
        rows = rows.join(F.broadcast(marks), keys, "left")
    else:
        rows = rows.select("__row", "first", digest(F.col("text")).alias("digest"))
        many = F.col("times") * BROADCAST_ROWS > marked_rows
        often = F.broadcast(marks.where(many))
        rows = rows.join(often, keys).unionByName(rows.join(often, keys, "left_anti").join(marks.where(~many).hint("shuffle_hash"), keys, "left"))
    repeated = rows.where("not gone").dropDuplicates(["digest", "first"]).select("__row.*")
    return rows.where("gone is null").select("__row.*").unionByName(repeated)


def hash_share(share: float, *columns: str) -> Column:
    """Whether a row is in a share of all rows, by the 64-bit hash of columns: shares down to 2^-63 are kept as they are."""
    if share >= 1:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(*columns), 1) < F.lit(int(share * 2.0**63))


def small_batches(spark: SparkSession) -> None:
    """Python tasks get at most TEXT_ROWS rows at a time: a batch of 10,000 long texts, Spark's default, fills a task's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver collects garbage, by default once in half an hour; a loop of small steps
    leaves thousands of small files before.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def blocks(batch: pa.RecordBatch, columns: Sequence[int], most_rows: int, most_chars: int) -> Iterator[pa.RecordBatch]:
    """Parts of batch of at most most_rows rows, and most_chars characters in its text columns (or one row)."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in columns:
        sizes += np.array([len(t) if t else 0 for t in batch.column(column).to_pylist()], np.int64)
    upto, low = np.cumsum(sizes), 0
    while low < batch.num_rows:
        high = int(np.searchsorted(upto, (upto[low - 1] if low else 0) + most_chars, "right"))
        high = min(max(high, low + 1), low + most_rows)
        yield batch.slice(low, high - low)
        low = high
