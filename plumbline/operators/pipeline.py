"""A classifier as one Spark ML pipeline: preparation of rows, balancing of training rows, model, decision.

`Pipeline(stages=[Preparation, Balanced, ...])` is fitted on raw rows and gives a PipelineModel that turns raw rows
into predicted_class and probabilities. `PipelineModel.save` writes all of it into one folder, and a new session
loads it with `PipelineModel.load`; nothing beside it is needed. Balancing acts in fitting alone: `Balanced` fits
its classifier on oversampled rows and leaves no stage of its own.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import class_index
from plumbline.operators import prepare, sampling


class _Named(Params):
    """The columns that a pipeline's stages share."""

    target = Param(Params._dummy(), "target", "column of the class", TypeConverters.toString)
    key = Param(Params._dummy(), "key", "column that tells rows apart", TypeConverters.toString)

    @keyword_only
    def __init__(self, **values) -> None:
        super().__init__()
        self._set(**values)


class Preparation(_Named, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns medians, modes, categories and classes of training rows."""

    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, numeric: Sequence[str] = (), categorical: Sequence[str] = (), target: str = "", key: str = "") -> None:
        super().__init__(numeric=list(numeric), categorical=list(categorical), target=target, key=key)

    def _fit(self, rows: DataFrame) -> PreparationModel:
        target = self.getOrDefault("target")
        ready = prepare.fit(rows, self.getOrDefault("numeric"), self.getOrDefault("categorical"))
        return PreparationModel.of(ready, prepare.classes_of(rows, target), target)


class PreparationModel(_Named, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds features, a vector, and label, the number of the class (null where the target is absent or unknown)."""

    learned = Param(Params._dummy(), "learned", "medians, modes, categories and classes, as JSON", TypeConverters.toString)

    @classmethod
    def of(cls, ready: prepare.Preprocessor, classes: Sequence[str], target: str) -> PreparationModel:
        held = {"medians": list(ready.medians.items()), "modes": ready.modes, "categories": [(c, list(v)) for c, v in ready.categories.items()], "classes": list(classes)}
        return cls(learned=json.dumps(held), target=target)

    @property
    def preprocessor(self) -> prepare.Preprocessor:
        held = json.loads(self.getOrDefault("learned"))
        return prepare.Preprocessor({c: float(m) for c, m in held["medians"]}, held["modes"], {c: tuple(v) for c, v in held["categories"]})

    @property
    def classes(self) -> list[str]:
        return json.loads(self.getOrDefault("learned"))["classes"]

    def _transform(self, rows: DataFrame) -> DataFrame:
        columns = self.preprocessor.columns()
        names, target = [f"__feature_{i}" for i in range(len(columns))], self.getOrDefault("target")
        label = class_index(F.col(f"`{target}`"), self.classes).cast("double") if target in rows.columns else F.lit(None).cast("double")
        wide = rows.select("*", *(c.alias(n) for c, n in zip(columns, names, strict=True)), label.alias("label"))
        return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)


class Balanced(_Named, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a classifier of a kind and options on its rows, oversampled first if options say so; gives the classifier's own model."""

    kind = Param(Params._dummy(), "kind", "kind of classifier", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "options of the classifier and the sampler, as JSON", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of draws", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, kind: str = "decision_tree", options: str = "{}", seed: int = 0, target: str = "", key: str = "") -> None:
        super().__init__(kind=kind, options=options, seed=seed, target=target, key=key)

    def _fit(self, rows: DataFrame) -> Model:
        from plumbline.operators.experiment import fit_classifier

        ranks = [c for c in rows.columns if c == "__nth"]  # of rows that are ranked already
        rows = rows.select(self.getOrDefault("key"), self.getOrDefault("target"), "label", "features", *ranks)
        options, seed = json.loads(self.getOrDefault("options")), self.getOrDefault("seed")
        if options.get("sampler") != "oversample":
            return fit_classifier(rows, self.getOrDefault("kind"), options, seed, self.getOrDefault("key"))
        balanced = sampling.oversampled(rows, self.getOrDefault("target"), seed, self.getOrDefault("key"))
        # Spark's trees read no key, and a class is its label
        balanced = balanced.select(*([self.getOrDefault("key")] if self.getOrDefault("kind") == "boosted_trees" else []), "label", "features").cache()
        try:
            return fit_classifier(balanced, self.getOrDefault("kind"), options, seed, self.getOrDefault("key"))
        finally:
            balanced.unpersist()


class Decision(_Named, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds predicted_class and probabilities, an array in the order of classes, from prediction and probability."""

    classes = Param(Params._dummy(), "classes", "labels in order", TypeConverters.toListString)

    def _transform(self, rows: DataFrame) -> DataFrame:
        label = F.get(F.array(*map(F.lit, self.getOrDefault("classes"))), F.col("prediction").cast("int"))
        return rows.withColumns({"predicted_class": label, "probabilities": vector_to_array("probability")})


def unfitted(kind: str, options: Mapping, numeric: Sequence[str], categorical: Sequence[str], target: str, key: str, seed: int) -> Pipeline:
    """Preparation and classifier; it can be saved too."""
    preparation = Preparation(numeric=numeric, categorical=categorical, target=target, key=key)
    return Pipeline(stages=[preparation, Balanced(kind=kind, options=json.dumps(dict(options), sort_keys=True), seed=seed, target=target, key=key)])


def fitted(rows: DataFrame, kind: str, options: Mapping, numeric: Sequence[str], categorical: Sequence[str], target: str, key: str, seed: int) -> PipelineModel:
    """The pipeline fitted on raw rows, with the decision at its end."""
    preparation, classifier = unfitted(kind, options, numeric, categorical, target, key, seed).fit(rows).stages
    return PipelineModel(stages=[preparation, classifier, Decision(classes=preparation.classes)])


def predictions(model: PipelineModel, rows: DataFrame, target: str, key: str) -> DataFrame:
    """key, actual_class, predicted_class, probabilities of raw rows."""
    return model.transform(rows).select(key, F.col(target).alias("actual_class"), "predicted_class", "probabilities")


def classes_of(model: PipelineModel) -> list[str]:
    return model.stages[0].classes


def importances(model: PipelineModel) -> list[tuple[str, str, float]]:
    """(transformed, original, importance) of each feature of a tree model, by the names that the pipeline keeps."""
    parts = model.stages[1].featureImportances
    return [(name, original, float(parts[i])) for i, (name, original) in enumerate(model.stages[0].preprocessor.outputs)]
