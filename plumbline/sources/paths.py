"""Files and folders on any file system that Spark knows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all that is in it; one that isn't there is no error."""
    place, files = _place(spark, path)
    files.delete(place, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if it isn't there."""
    place, files = _place(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of its own that driver and executors share: below spark.checkpoint.dir, or local for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return f"{base}/{name}-{uuid.uuid4().hex}"
