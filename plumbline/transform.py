"""Declarative feature projection: one select of a schema's expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.schema import Schema


def project(rows: DataFrame, schema: Schema) -> DataFrame:
    """The features of schema, computed from rows; every column that a feature reads has to be there."""
    lacking = sorted({c for f in schema.features for c in f.reads} - set(rows.columns))
    if lacking:
        raise ValueError(f"columns that features read are missing: {', '.join(lacking)}")
    return rows.select(*[f.column.cast(f.spark_type).alias(f.label, metadata=f.field.metadata) for f in schema.features])
