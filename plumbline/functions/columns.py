"""Scalar functions as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest numbers of the registered and dynamic port ranges.
WELL_KNOWN, REGISTERED, DYNAMIC = 1023, 49151, 65535


def finite(value: Column) -> Column:
    """value where it is a finite number, else NULL (NaN, infinities and NULL alike)."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def infinite(value: Column) -> Column:
    """Whether value is an infinity; false for NaN and NULL."""
    return F.coalesce(F.abs(value) == float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(value), F.lit(False))


def missing(value: Column, numeric: bool = False) -> Column:
    """NULL, or NaN in a numeric column."""
    return value.isNull() | F.coalesce(F.isnan(value), F.lit(False)) if numeric else value.isNull()


def sentinel_to_null(value: Column, sentinel: float) -> Column:
    return F.nullif(value.cast("double"), F.lit(float(sentinel)))


def infinite_to_null(value: Column) -> Column:
    """Infinities become NULL; NaN and NULL stay as they are."""
    return F.when(~infinite(value), value)


def lenient(value: Column, kind: str = "double") -> Column:
    """A cast that gives NULL where strict casts raise."""
    return value.try_cast(kind)


def ratio(part: Column, whole: Column, otherwise: float = 0.0) -> Column:
    """part / whole, or otherwise where whole is 0 or NULL."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(otherwise))


def any_true(*flags: Column) -> Column:
    """Three-valued OR."""
    out = flags[0]
    for flag in flags[1:]:
        out = out | flag
    return out


def mapped(value: Column, names: Mapping[object, str]) -> Column:
    """The name of a code; NULL for codes without one."""
    out = F.lit(None).cast("string")
    for code, name in reversed(list(names.items())):
        out = F.when(value == F.lit(code), F.lit(name)).otherwise(out)
    return out


def port_group(port: Column, named: Mapping[int, str]) -> Column:
    """not_applicable for 0, the name of a listed port, else its range; ports above 65535 raise, NULL stays NULL."""
    ranges = F.when(port <= WELL_KNOWN, "well_known").when(port <= REGISTERED, "registered").when(port <= DYNAMIC, "dynamic")
    ranges = ranges.when(port.isNotNull(), F.raise_error(F.concat(F.lit("port out of range: "), port.cast("string"))).cast("string"))
    return F.when(port == 0, "not_applicable").otherwise(F.coalesce(mapped(port, named), ranges))


def parsed_datetime(text: Column, formats: Sequence[str], strict: bool = True) -> Column:
    """The timestamp (without zone) by the first format that fits; text that none fits raises, or is NULL if not strict."""
    found = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")
    if not strict:
        return found
    return F.when(found.isNull() & text.isNotNull(), F.raise_error(F.concat(F.lit("unparsable datetime: "), text)).cast("timestamp_ntz")).otherwise(found)


def class_index(label: Column, classes: Sequence[str]) -> Column:
    """Position of a label among classes, from 0; unknown labels raise."""
    at = F.array_position(F.array(*map(F.lit, classes)), label) - 1
    return F.when(at < 0, F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(label, F.lit("NULL")))).cast("long")).otherwise(at)


def domain_order(value: Column, domain: Sequence[str]) -> Column:
    """Sort key that puts values in the order of domain; others come last."""
    at = F.array_position(F.array(*map(F.lit, domain)), value)
    return F.when(at > 0, at).otherwise(F.lit(len(domain) + 1))


def normalized(text: Column) -> Column:
    """Lower case with single spaces and none around."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def parsed_label(response: Column, classes: Sequence[str]) -> tuple[Column, Column]:
    """The class that a response names exactly after normalisation, and else the error code."""
    plain = normalized(response)
    found = F.lit(None).cast("string")
    for label in classes:
        found = F.when(plain == " ".join(label.lower().split()), F.lit(label)).otherwise(found)
    error = F.when(response.isNull() | (plain == ""), "empty_response").when(found.isNull(), "unrecognized_label")
    return found, error


def general(value: Column, digits: int = 15) -> Column:
    """Floating-point numbers with so many significant digits, without trailing zeros, as C's %g writes them.

    Java rounds the shortest decimal form of a number instead of the number, which differs where that ends in 5, so this is
    done in Arrow batches.
    """

    def write(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else format(v, f".{digits}g"))

    return F.pandas_udf(write, "string")(value.cast("double"))


def serialized(value: Column, kind: str) -> Column:
    """A cell of a prompt: NA for missing and non-finite values, true/false, floating-point numbers to 15 digits, text on one line."""
    if kind in ("double", "float"):
        text = general(finite(value))
    elif kind == "boolean":
        text = F.when(value, "true").when(~value, "false")
    elif kind == "string":
        text = F.regexp_replace(value, r"[\r\n]+", " ")
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("NA"))


def csv_cell(text: Column) -> Column:
    """Quoted only where a separator, quote or line break makes it necessary."""
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_row(cells: Sequence[Column]) -> Column:
    return F.concat_ws(",", *map(csv_cell, cells))


def named_lines(names: Sequence[str], cells: Sequence[Column]) -> Column:
    """`name: value` lines."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), c) for n, c in zip(names, cells, strict=True)])


def mean_std(mean: Column, std: Column, digits: int = 5) -> Column:
    return F.format_string(f"%.{digits}f ± %.{digits}f", mean.cast("double"), std.cast("double"))


def parsed_mean_std(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, " ± ")
    return F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")


#: Axis transforms and their inverses.
TRANSFORMS = {
    "linear": (lambda c: c.cast("double"), lambda c: c),
    "sqrt": (F.sqrt, lambda c: c * c),
    "cbrt": (F.cbrt, lambda c: c * c * c),
    "log1p": (F.log1p, F.expm1),
}


def draw(seed: int, key: Column) -> Column:
    """The order of a seeded draw: an md5 that any engine computes alike."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
