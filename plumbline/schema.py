"""Declared schemas: typed features with roles and domains, carried in the metadata of a StructType."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DataType(str, Enum):
    INTEGER = "integer"
    FLOAT = "float"
    STRING = "string"
    DATETIME = "datetime"


class Semantic(str, Enum):
    NUMERIC = "numeric"
    BINARY = "binary"
    CATEGORICAL = "categorical"
    DATETIME = "datetime"


class Role(str, Enum):
    PREDICTOR = "predictor"
    TARGET = "target"
    IDENTIFIER = "identifier"
    METADATA = "metadata"


SPARK_TYPES = {DataType.INTEGER: T.LongType(), DataType.FLOAT: T.DoubleType(), DataType.STRING: T.StringType(), DataType.DATETIME: T.TimestampNTZType()}


@dataclass(frozen=True)
class Feature:
    """A column: its label, types and role, the source column, and for derived ones the expression and what it reads."""

    label: str
    data_type: DataType
    semantic: Semantic
    role: Role
    source: str = ""
    name: str = ""
    description: str = ""
    domain: tuple[str, ...] = ()
    formats: tuple[str, ...] = ()
    reads: tuple[str, ...] = ()
    expression: Callable[[], Column] | None = None

    def __post_init__(self) -> None:
        faults = [
            (not self.label.strip(), "a label is needed"),
            ((self.data_type is DataType.DATETIME) != bool(self.formats), "datetimes, and only they, have formats"),
            (self.semantic is Semantic.NUMERIC and self.data_type not in (DataType.INTEGER, DataType.FLOAT), "numeric features are integers or floats"),
            (self.semantic is Semantic.DATETIME and self.data_type is not DataType.DATETIME, "a datetime meaning needs a datetime type"),
            (bool(self.domain) and self.semantic is not Semantic.CATEGORICAL, "only categorical features have a domain"),
            (len(set(self.domain)) != len(self.domain), "a domain lists each value once"),
            (self.expression is not None and not self.reads, "a derived feature names the columns it reads"),
        ]
        for fault, why in faults:
            if fault:
                raise ValueError(f"{self.label or 'feature'}: {why}")

    @property
    def spark_type(self) -> T.DataType:
        return T.BooleanType() if self.semantic is Semantic.BINARY else SPARK_TYPES[self.data_type]

    @property
    def field(self) -> T.StructField:
        notes = {"data_type": self.data_type.value, "semantic": self.semantic.value, "role": self.role.value, "domain": list(self.domain), "name": self.name or self.label}
        return T.StructField(self.label, self.spark_type, True, notes)

    @property
    def column(self) -> Column:
        return self.expression() if self.expression else F.col(f"`{self.label}`")


@dataclass(frozen=True)
class Schema:
    """Features of a table, one of them the target."""

    features: tuple[Feature, ...]

    def __post_init__(self) -> None:
        if not self.features:
            raise ValueError("a schema needs features")
        if len(set(self.labels)) != len(self.labels):
            raise ValueError("labels are not unique")
        if len(self.of_role(Role.TARGET)) != 1:
            raise ValueError("a schema has exactly one target")

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(f.label for f in self.features)

    @property
    def target(self) -> Feature:
        return self.of_role(Role.TARGET)[0]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([f.field for f in self.features])

    def of_role(self, *roles: Role) -> tuple[Feature, ...]:
        return tuple(f for f in self.features if f.role in roles)

    def of_semantic(self, *kinds: Semantic) -> tuple[Feature, ...]:
        return tuple(f for f in self.features if f.semantic in kinds)

    def retained(self, excluded: Sequence[str] = (), roles: Sequence[Role] = tuple(Role)) -> tuple[str, ...]:
        """The labels of roles without the excluded ones, in order; an excluded label that there isn't is an error."""
        if unknown := sorted(set(excluded) - set(self.labels)):
            raise ValueError(f"unknown labels: {', '.join(unknown)}")
        return tuple(f.label for f in self.of_role(*roles) if f.label not in excluded)

    def extended(self, *derived: Feature) -> Schema:
        """A schema with further features after its own."""
        return Schema((*self.features, *derived))

    def feature(self, label: str) -> Feature:
        for f in self.features:
            if f.label == label:
                return f
        raise KeyError(label)

    def inventory(self) -> list[tuple]:
        """(position, label, name, data_type, semantic, role, domain size) of each feature."""
        return [(n, f.label, f.name or f.label, f.data_type.value, f.semantic.value, f.role.value, len(f.domain)) for n, f in enumerate(self.features)]


def identity(feature: Feature) -> Feature:
    """The same feature, read from the table as it is."""
    return Feature(**{**feature.__dict__, "reads": (feature.label,), "expression": lambda: F.col(f"`{feature.label}`")})


def from_struct(struct: T.StructType, roles: dict[str, Role], default: Role = Role.PREDICTOR) -> Schema:
    """A schema for a table of plain columns: numbers are numeric, booleans binary, text categorical."""
    out = []
    for f in struct.fields:
        kind, semantic, formats = DataType.STRING, Semantic.CATEGORICAL, ()
        if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            kind, semantic = DataType.INTEGER, Semantic.NUMERIC
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            kind, semantic = DataType.FLOAT, Semantic.NUMERIC
        elif isinstance(f.dataType, T.BooleanType):
            kind, semantic = DataType.INTEGER, Semantic.BINARY
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            kind, semantic, formats = DataType.DATETIME, Semantic.DATETIME, ("yyyy-MM-dd HH:mm:ss",)
        elif not isinstance(f.dataType, T.StringType):
            raise TypeError(f"{f.name}: {f.dataType.simpleString()} columns are not supported")
        out.append(Feature(f.name, kind, semantic, roles.get(f.name, default), source=f.name, formats=formats))
    return Schema(tuple(out))


def source_names(schema: Schema) -> Sequence[str]:
    return [f.source or f.label for f in schema.features]
