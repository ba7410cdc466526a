"""Datasets by name: what schema, paths and derived features a name stands for.

A catalog only holds definitions. `frame` and `bundle` read a dataset when it is asked for, and `publish` makes each a
view of the session, so that SQL reads it by its name: <name> for all partitions with their split, and <name>_<split>.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from plumbline import transform
from plumbline.schema import Schema
from plumbline.sources import files


@dataclass(frozen=True)
class Dataset:
    """paths by split (full, train, test) of files that schema describes; features, if given, is what is made of their columns."""

    name: str
    schema: Schema
    paths: Mapping[str, str] = field(hash=False)
    features: Schema | None = None


class Catalog:
    """Datasets by name; case doesn't count."""

    def __init__(self) -> None:
        self._known: dict[str, Dataset] = {}

    def register(self, dataset: Dataset) -> None:
        """A name that isn't one of SQL, or that is taken by another definition, raises."""
        name = dataset.name.lower()
        if not re.fullmatch(r"[a-z_][a-z0-9_]*", name):
            raise ValueError(f"{dataset.name!r} can't be a view's name")
        if self._known.get(name, dataset) != dataset:
            raise ValueError(f"{dataset.name} is registered already, as something else")
        self._known[name] = dataset

    def names(self) -> list[str]:
        return sorted(self._known)

    def __getitem__(self, name: str) -> Dataset:
        if name.lower() not in self._known:
            raise KeyError(f"no dataset {name}; there are {', '.join(self.names()) or 'none'}")
        return self._known[name.lower()]

    def bundle(self, spark: SparkSession, name: str) -> dict[str, files.Partition]:
        """The partitions of a dataset by split, with its features."""
        dataset = self[name]
        found = files.load_bundle(spark, dataset.schema, **dataset.paths)
        if dataset.features is None:
            return found
        return {split: files.Partition(split, transform.project(part.frame, dataset.features), part.path) for split, part in found.items()}

    def frame(self, spark: SparkSession, name: str) -> DataFrame:
        """All partitions under each other, with their split."""
        return files.bundle_rows(self.bundle(spark, name))

    def publish(self, spark: SparkSession) -> list[str]:
        """Makes views of all datasets and their partitions; returns their names."""
        made = []
        for name in self.names():
            parts = self.bundle(spark, name)
            for view, rows in {name: files.bundle_rows(parts), **{f"{name}_{split}": part.frame for split, part in parts.items()}}.items():
                rows.createOrReplaceTempView(view)
                made.append(view)
        return made
