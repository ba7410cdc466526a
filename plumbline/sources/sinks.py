"""Sinks: tables by Spark's commit protocol, small JSON objects by rename, prediction tables by seed."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """All of a table or nothing: readers see the folder's _SUCCESS once it is committed."""
    writer = rows.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def write_json(spark: SparkSession, value: Mapping, path: str) -> None:
    """A JSON object with sorted keys, written aside and renamed over an older one, on any file system Spark knows: readers see one or the other."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    target, aside = fs.Path(path), fs.Path(path + ".tmp")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = target.getFileSystem(conf)
    out = files.create(aside, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=2).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(aside), files.makeQualified(target), options)


def append_log(rows: DataFrame, path: str) -> None:
    """More records of a JSON-lines log."""
    rows.write.mode("append").json(path)


def prediction_rows(rows: DataFrame, classes: Sequence[str], probabilities: str = "probabilities") -> DataFrame:
    """seed, row_index, actual_class, predicted_class and probability_<i>_<label> columns from an array of probabilities."""
    return rows.select("seed", "row_index", "actual_class", "predicted_class", *[F.get(probabilities, F.lit(i)).alias(f"probability_{i}_{c}") for i, c in enumerate(classes)])


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("seed").parquet(path)


def write_artifacts(tables: Mapping[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    for name, rows in tables.items():
        write_table(rows, f"{folder}/{name}", kind)


def write_indices(rows: DataFrame, path: str, column: str = "row_index") -> None:
    """The whole numbers of a column as an index list, in order: CSV files whose names sort as their numbers do. Missing values raise."""
    checked = F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{column} has missing values")).cast("long")).otherwise(F.col(column).cast("long"))
    write_table(rows.select(checked.alias(column)).orderBy(column), path, "csv")
