"""A prediction log as a stream: records are appended, and the newest of each row is the prediction.

Structured Streaming keeps in its checkpoint which log files are done, so a stopped run goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "row_index long, seed int, actual_class string, predicted_class string, response_valid boolean, written_at timestamp"


def read_log(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def first_of_each(log: DataFrame, key: str = "row_index", at: str = "written_at", late: str = "1 day") -> DataFrame:
    """Each row once: repeated records within the watermark are dropped, and state older than it is forgotten."""
    return log.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_coverage(log: DataFrame, at: str = "written_at", width: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """start, n, n_valid of each time window."""
    grouped = log.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count("*").alias("n"), F.count_if("response_valid").alias("n_valid"))
    return grouped.select(F.col("window.start").alias("start"), "n", "n_valid")


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there and stops; called again with the same checkpoint it takes only what is new."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
