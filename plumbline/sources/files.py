"""Table sources: strict CSV, seed-numbered CSV files, JSON objects, JSON-lines logs, index lists."""

from __future__ import annotations

import csv
import io
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.columns import parsed_datetime
from plumbline.operators.checks import Expectation, expect
from plumbline.schema import DataType, Schema, Semantic, source_names


class UnreadableCsv(ValueError):
    """A CSV source that doesn't exist, or whose header or cells break the declared schema."""


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The names in the first line as they stand; Spark's own reader renames repeated ones."""
    try:
        first = spark.read.text(path).limit(1).collect()
    except Exception as error:
        raise UnreadableCsv(f"{path} can't be read: {error}") from error
    if not first:
        raise UnreadableCsv(f"{path} is empty")
    return next(csv.reader(io.StringIO(first[0][0])))


def check_header(found: list[str], declared: list[str]) -> None:
    """Repeated, missing, unexpected and misplaced columns, each named."""
    repeated = sorted({c for c in found if found.count(c) > 1})
    lacking, extra = [c for c in declared if c not in found], [c for c in found if c not in declared]
    for names, what in ((repeated, "repeated"), (lacking, "missing"), (extra, "unexpected")):
        if names:
            raise UnreadableCsv(f"{what} columns: {', '.join(names)}")
    if found != declared:
        at = next(i for i, (a, b) in enumerate(zip(found, declared, strict=True)) if a != b)
        raise UnreadableCsv(f"column {at} is {found[at]}, not {declared[at]}")


def load_csv(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """The CSV as the schema declares it: header checked, columns renamed and cast strictly; bad cells raise when they are read."""
    declared = list(source_names(schema))
    check_header(header_of(spark, path), declared)
    text = T.StructType([T.StructField(f.label, T.StringType() if f.data_type is DataType.DATETIME or f.semantic is Semantic.BINARY else f.spark_type) for f in schema.features])
    reader = spark.read.schema(text).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST")
    rows = reader.option("positiveInf", "inf").option("negativeInf", "-inf").csv(path)
    columns = []
    for f in schema.features:
        value = F.col(f"`{f.label}`")
        if f.data_type is DataType.DATETIME:
            value = parsed_datetime(value, f.formats)
        elif f.semantic is Semantic.BINARY:
            value = value.cast("boolean")
        if f.domain:
            value = F.when(value.isNull() | value.isin(*f.domain), value).otherwise(F.raise_error(F.concat(F.lit(f"{f.label} is not in its domain: "), value)).cast("string"))
        columns.append(value.alias(f.label, metadata=f.field.metadata))
    return rows.select(*columns)


@dataclass(frozen=True)
class Partition:
    split: str
    frame: DataFrame
    path: str = ""


def load_bundle(spark: SparkSession, schema: Schema, **paths: str) -> dict[str, Partition]:
    """Partitions of one dataset by split (full, train, test); at least one."""
    if not paths or not set(paths) <= {"full", "train", "test"}:
        raise ValueError("name at least one path, as full, train or test")
    return {split: Partition(split, load_csv(spark, path, schema), path) for split, path in paths.items()}


def bundle_rows(bundle: dict[str, Partition]) -> DataFrame:
    """All partitions under each other, with their split."""
    out = None
    for part in bundle.values():
        rows = part.frame.withColumn("split", F.lit(part.split))
        out = rows if out is None else out.unionByName(rows)
    return out


def load_seed_files(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """CSV files named seed_<n>.csv (or folders of that name) under each other, with seed from the name."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(pattern)
    return rows.withColumn("seed", F.regexp_extract(F.col("_metadata.file_path"), r"seed_(\d+)", 1).cast("int"))


def load_json(spark: SparkSession, path: str) -> dict:
    """One JSON object."""
    found = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    if not isinstance(found, dict):
        raise ValueError(f"{path} doesn't hold an object")
    return found


def load_log(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """A JSON-lines log, blank lines skipped, bad ones raised; of the records of a key the one with the largest order."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return last_by(rows, key, order)


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key the one with the largest order; combined before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("__last")).select("__last.*")


def load_indices(spark: SparkSession, path: str, available: DataFrame, column: str = "row_index") -> DataFrame:
    """An index list: whole, unique, not null, not empty, and all of them in available."""
    texts = spark.read.option("header", True).csv(path).select(F.col(column).try_cast("double").alias("__v"))
    expect(
        texts,
        Expectation("rows", F.count("*") == 0),
        Expectation("missing or not numeric", F.count_if(F.col("__v").isNull()) > 0),
        Expectation("not whole", F.count_if(F.col("__v") != F.floor("__v")) > 0),
        Expectation("repeated", F.count("__v") > F.count_distinct("__v")),
    )
    wanted = texts.select(F.col("__v").cast("long").alias(column))
    unknown = wanted.join(available.select(column), column, "left_anti").count()
    if unknown:
        raise ValueError(f"{unknown} indices are not available")
    return wanted


def numbered_lines(rows: DataFrame) -> DataFrame:
    """rows of files of lines, not cut or filtered since they were read, plus position from 0 in order of file names and lines.

    Each split of a file is numbered where it is read; their sizes, a row for each, are summed up in order of files and
    offsets, and what comes before a split is added to the numbers in it. Nothing is sorted.
    """
    split = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__id": F.monotonically_increasing_id()}
    read = rows.select("*", *(c.alias(n) for n, c in split.items()))
    sizes = read.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__file", "__block", "__first", F.coalesce(before, F.lit(0)).alias("__start"))
    placed = read.join(F.broadcast(starts), ["__file", "__block"])
    return placed.select(*rows.columns, (F.col("__start") + F.col("__id") - F.col("__first")).alias("position"))


def selected_in_order(spark: SparkSession, path: str, rows: DataFrame, column: str = "row_index") -> DataFrame:
    """The rows that an index list names, with position, the place of each in the list; the list is checked as by load_indices."""
    load_indices(spark, path, rows, column)
    listed = numbered_lines(spark.read.schema(f"`{column}` string").option("header", True).csv(path))
    places = listed.select(F.col(column).cast("double").cast("long").alias(column), "position")
    return rows.join(places, column)
