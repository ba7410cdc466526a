"""Registry of the library's own queries: name -> callable(spark, sf_dir), and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "agg_5_numeric_profile"


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function as a query, with its SQL if there is any; doubles are rounded to 6 places, as the SQL rounds them."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


def rounded(rows: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show."""
    value: Callable[[T.StructField], Column] = lambda f: F.round(F.col(f"`{f.name}`"), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
    return rows.select(*map(value, rows.schema.fields))


from plumbline.plans import artifact_queries, evaluation_queries, file_queries, profile_queries, report_queries, run_queries, sampling_queries  # noqa: E402, F401
