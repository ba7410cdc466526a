"""Signatures of runs: digests of the rows and options that made what a folder holds.

A digest of rows doesn't depend on their order or partitions: each row has two 64-bit hashes, and their sums (in
three parts, so that no long overflows below 2^41 rows) and their exclusive ors are aggregates, combined in each
task before the shuffle. Rows that repeat count each, and nulls, columns and values that change places change it.

A folder keeps what its run was made from by name, so that a run that differs can say in what. An unfinished run
goes on only under the same signature; under another one it is refused, or starts anew where that is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.experiment import canonical
from plumbline.sources import files, sinks
from plumbline.sources.paths import delete, exists

#: Changes of what signatures mean: runs of another version are other runs.
VERSION = 1
_SALTS = (11, 1_000_003)


def _hashed(field: T.StructField) -> list[Column]:
    """What of a column goes into a row's hash: whether it is null, and its value, that of nested types as text."""
    column = F.col(f"`{field.name}`")
    nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
    return [column.isNull(), F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"}) if nested else column]


def row_hashes(rows: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """Two hashes of a row's columns, in order of their names."""
    fields = sorted((f for f in rows.schema if columns is None or f.name in columns), key=lambda f: f.name)
    lacking = set(columns or ()) - {f.name for f in fields}
    if lacking:
        raise ValueError(f"the rows have no {', '.join(sorted(lacking))}")
    values = [value for field in fields for value in _hashed(field)]
    return [F.xxhash64(F.lit(salt), *values) for salt in _SALTS]


def digests(rows: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """keys, n, digest of the rows of each group: 64 hexadecimal digits, the same for any order of the rows.

    columns are those that count, by default all; their names and types are part of the digest.
    """
    kinds = canonical(sorted((f.name, f.dataType.simpleString()) for f in rows.schema if columns is None or f.name in columns))
    hashed = rows.select(*keys, *(h.alias(f"__h{i}") for i, h in enumerate(row_hashes(rows, columns))))
    parts = []
    for name in ("__h0", "__h1"):
        h, low = F.col(name), F.lit((1 << 22) - 1)
        parts += [F.sum(F.shiftright(h, 44)), F.sum(F.shiftright(h, 22).bitwiseAND(low)), F.sum(h.bitwiseAND(low)), F.bit_xor(h)]
    found = hashed.groupBy(*keys).agg(F.count("*").alias("n"), *(p.alias(f"__p{i}") for i, p in enumerate(parts)))
    whole = F.concat_ws(":", F.lit(kinds), "n", *(F.coalesce(F.col(f"__p{i}"), F.lit(0)) for i in range(len(parts))))
    return found.select(*keys, "n", F.sha2(whole, 256).alias("digest"))


def digest(rows: DataFrame, columns: Sequence[str] | None = None) -> str:
    """The digest of all rows."""
    return digests(rows, (), columns).first()["digest"]


def signature(parts: Mapping[str, object]) -> dict[str, str]:
    """By name the SHA-256 of what a run is made from: DataFrames by their digest, everything else by its canonical JSON."""
    held = {name: digest(value) if isinstance(value, DataFrame) else hashlib.sha256(canonical(value).encode()).hexdigest() for name, value in parts.items()}
    return held | {"version": str(VERSION)}


class ChangedRun(ValueError):
    """The folder holds a run that was made from something else."""


def differences(spark: SparkSession, folder: str, name: str, signed: Mapping[str, str]) -> list[str] | None:
    """The names in which the stored signature differs from signed; None if there is none stored."""
    path = f"{folder}/{name}.json"
    if not exists(spark, path):
        return None
    held = files.load_json(spark, path)
    return sorted(k for k in held.keys() | signed.keys() if held.get(k) != signed.get(k))


def begin(spark: SparkSession, folder: str, name: str, parts: Mapping[str, object], owned: Sequence[str], changed: str = "raise") -> bool:
    """Whether the run called name goes on in folder; False if it begins there. Its signature is stored before anything else.

    owned are the files and folders that the run writes there. With changed = "raise" a run of another signature is
    refused, and so are owned ones without any signature; with "restart" they are deleted. They go before the new
    signature is stored, so a stop between leaves less of the old run, and never old results under the new signature.
    """
    if changed not in ("raise", "restart"):
        raise ValueError(f"changed is raise or restart, not {changed}")
    signed = signature(parts)
    other = differences(spark, folder, name, signed)
    if other == []:
        return True
    there = [o for o in owned if exists(spark, f"{folder}/{o}")]
    if changed == "raise" and other:
        raise ChangedRun(f"{folder} holds a run of other {', '.join(other)}; take another folder, or restart it")
    if changed == "raise" and there:
        raise ChangedRun(f"{folder} holds {', '.join(there)} without a signature; take another folder, or restart it")
    for o in there:
        delete(spark, f"{folder}/{o}")
    sinks.write_json(spark, signed, f"{folder}/{name}.json")
    return False
