"""Gradient boosting of several classes on softmax, with histograms and guards of nodes.

A round adds a tree for each class, all fitted to the gradients of the same scores; the trees of a round grow
together, level by level. Features are cut into bins once. Rows then live in blocks (bins, labels, scores as
arrays), so that a task works on thousands of rows at a time. For a level each task adds up gradient, hessian and
rows by node, feature and bin; partial histograms meet by node, in two steps where there are many tasks, and the
best split of a node is found where its histogram is whole. The driver gets one small row a node.

Gradients are rounded to multiples of 2^-24, so their sums are exact in any order: partitions don't change the
trees. Scores are updated once a round and cached; every CUT_ROUNDS they are written to the shared folder, which
ends their lineage. A lost executor's blocks are computed again from there.

A split's gain is half of GL^2 / (HL + reg) + GR^2 / (HR + reg) - G^2 / (H + reg), where G and H are the sums of
gradients and hessians. A node is split if it has min_samples_split rows, each side has min_child_weight hessian
and min_samples_leaf rows, and the best gain is above min_gain; of equal gains the first feature and the lowest
bin count. A leaf adds -rate * G / (H + reg). Hessians are 2 p (1 - p), as is usual for softmax.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.paths import delete, scratch

#: Rows of a block.
BLOCK = 8192
#: Sums of gradients are in units of 2^-24.
UNIT = float(1 << 24)
#: Cells (node, feature, bin) of the histograms that a task holds at once; a level with more takes several passes.
MOST_CELLS = 1 << 22
#: Tasks from which partial histograms meet in two steps.
MANY_TASKS = 64
CUT_ROUNDS = 25

Batches = Iterator[pa.RecordBatch]
BLOCKS = "n int, bins binary, labels binary, draws binary, scores binary"


@dataclass
class Tree:
    """Nodes by number: the children of node i are left[i] and left[i] + 1; feature is -1 in leaves. Rows up to cut go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float) -> int:
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, len(self.feature), gain
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(0.0)
            self.gain.append(0.0)
        return self.left[node]

    def nodes_of(self, columns: np.ndarray) -> np.ndarray:
        """The node that each row ends in; columns holds a row of bins, or of values where cut holds thresholds, for each feature."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at, rows = np.zeros(columns.shape[1], np.int64), np.arange(columns.shape[1])
        while (inner := feature[at] >= 0).any():
            right = ~(columns[np.maximum(feature[at], 0), rows] <= cut[at])
            at = np.where(inner, left[at] + right, at)
        return at


def uniform(draws: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A number from 0 to 1 for each row in a round, mixed from its hash."""
    mixed = draws.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + (number + 1) * 0xD1B54A32D192ED03) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def gradients(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the softmax loss in units of 2^-24, a row for each class; scores has a row for each class."""
    powers = np.exp(scores - scores.max(axis=0))
    p = powers / powers.sum(axis=0)
    own = np.arange(len(scores))[:, None] == labels
    return np.rint((p - own) * UNIT), np.rint(np.maximum(2 * p * (1 - p), 1e-16) * UNIT)


def _unpacked(row: dict, n_features: int, wide: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = row["n"]
    return (
        np.frombuffer(row["bins"], wide).reshape(n_features, n), np.frombuffer(row["labels"], np.int32),
        np.frombuffer(row["draws"], np.int64), np.frombuffer(row["scores"], np.float64).reshape(-1, n),
    )


def _blocks(rows: DataFrame, cuts: Sequence[Sequence[float]], n_classes: int, wide: np.dtype) -> DataFrame:
    """rows (draw, label, x) as blocks of bins and empty scores."""
    thresholds = [np.array(c) for c in cuts]

    def block(labels: list, draws: list, x: list) -> pa.RecordBatch:
        label, draw, values = (np.concatenate(part) for part in (labels, draws, x))
        bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(thresholds, values.T, strict=True)]).astype(wide)
        parts = (bins, label.astype(np.int32), draw.astype(np.int64), np.zeros((n_classes, len(label))))
        return pa.RecordBatch.from_arrays([pa.array([len(label)], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["n", "bins", "labels", "draws", "scores"])

    def pack(batches: Batches) -> Batches:
        labels, draws, x, held = [], [], [], 0
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                part = batch.slice(low, BLOCK - held)
                draws.append(part.column(0).to_numpy())
                labels.append(part.column(1).to_numpy())
                x.append(part.column(2).flatten().to_numpy().reshape(part.num_rows, -1))
                held, low = held + part.num_rows, low + part.num_rows
                if held == BLOCK:
                    yield block(labels, draws, x)
                    labels, draws, x, held = [], [], [], 0
        if held:
            yield block(labels, draws, x)

    return rows.mapInArrow(pack, BLOCKS)


def _scored(blocks: DataFrame, trees: Sequence[Tree], n_features: int, wide: np.dtype) -> DataFrame:
    """blocks with the values of a round's trees added to their scores."""

    def add(batches: Batches) -> Batches:
        for batch in batches:
            scores = []
            for row in batch.to_pylist():
                bins, _, _, held = _unpacked(row, n_features, wide)
                scores.append((held + np.stack([np.array(t.value)[t.nodes_of(bins)] for t in trees])).tobytes())
            yield batch.set_column(batch.schema.get_field_index("scores"), "scores", pa.array(scores, pa.binary()))

    return blocks.mapInArrow(add, BLOCKS)


@dataclass(frozen=True)
class Rules:
    """What decides over splits and leaves."""

    rate: float
    reg: float
    min_gain: float
    min_child_weight: float
    min_samples_split: int
    min_samples_leaf: int
    subsample: float
    seed: int


def _partials(blocks: DataFrame, trees: Sequence[Tree], open_nodes: Sequence[tuple[int, int]], n_features: int, n_bins: int, wide: np.dtype, rules: Rules, number: int) -> DataFrame:
    """slot, part, histogram (whole numbers by feature, bin, and gradient, hessian, rows) of open_nodes, pairs of class and node."""
    slots = {k: {node: s for s, (c, node) in enumerate(open_nodes) if c == k} for k in {k for k, _ in open_nodes}}

    def add_up(batches: Batches) -> Batches:
        cells = n_features * n_bins
        found = np.zeros((3, len(open_nodes) * cells))
        offset = (np.arange(n_features) * n_bins)[:, None]
        for batch in batches:
            for row in batch.to_pylist():
                bins, labels, draws, scores = _unpacked(row, n_features, wide)
                g, h = gradients(scores, labels)
                drawn = uniform(draws, rules.seed, number) < rules.subsample
                for k, own in slots.items():
                    slot = np.full(len(trees[k].feature), -1)
                    slot[list(own)] = list(own.values())
                    at = slot[trees[k].nodes_of(bins)]
                    used = np.flatnonzero((at >= 0) & drawn)
                    place = (at[used] * cells + offset + bins[:, used]).ravel()
                    for channel, weights in enumerate((g[k, used], h[k, used], None)):
                        counted = np.bincount(place, None if weights is None else np.tile(weights, n_features), len(open_nodes) * cells)
                        found[channel] += counted
        whole = found.astype(np.int64).reshape(3, len(open_nodes), cells)
        for s in range(len(open_nodes)):
            if whole[2, s].any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([whole[:, s].tobytes()], pa.binary())], names=["slot", "part", "histogram"])

    return blocks.mapInArrow(add_up, "slot int, part int, histogram binary")


def _summed(table: pa.Table) -> np.ndarray:
    total = 0
    for histogram in table.column("histogram"):
        total = total + np.frombuffer(histogram.as_buffer(), np.int64)
    return total


def best_split(sums: np.ndarray, rules: Rules) -> tuple[int, int, float]:
    """(feature, cut, gain) of a node's histogram (gradient, hessian, rows; by feature and bin); feature -1 if it stays a leaf."""
    left = [np.cumsum(s, axis=1)[:, :-1] for s in sums]
    whole = [int(s[0].sum()) for s in sums]  # every feature's bins hold all rows of the node
    gl, hl, nl = left[0] / UNIT, left[1] / UNIT, left[2]
    gr, hr, nr = (whole[0] - left[0]) / UNIT, (whole[1] - left[1]) / UNIT, whole[2] - nl
    allowed = (hl >= rules.min_child_weight) & (hr >= rules.min_child_weight) & (nl >= max(1, rules.min_samples_leaf)) & (nr >= max(1, rules.min_samples_leaf))
    if whole[2] < rules.min_samples_split or not allowed.any():
        return -1, 0, 0.0
    parent = (whole[0] / UNIT) ** 2 / (whole[1] / UNIT + rules.reg)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, (gl**2 / (hl + rules.reg) + gr**2 / (hr + rules.reg) - parent) / 2, -np.inf)
    at = int(gain.argmax())
    feature, cut = divmod(at, gain.shape[1])
    return (feature, cut, float(gain.flat[at])) if gain.flat[at] > rules.min_gain else (-1, 0, 0.0)


def leaf(g: int, h: int, rules: Rules) -> float:
    """What a leaf of these sums adds to a score."""
    return -rules.rate * (g / UNIT) / (h / UNIT + rules.reg) if h or rules.reg else 0.0


def _splits(partials: DataFrame, n_tasks: int, n_features: int, n_bins: int, rules: Rules) -> DataFrame:
    """slot, feature, cut, gain, and the sums of gradients and hessians of the node and of its left side."""

    def meet(table: pa.Table) -> pa.Table:
        return pa.table({"slot": table.column("slot").slice(0, 1), "part": table.column("part").slice(0, 1), "histogram": pa.array([_summed(table).tobytes()], pa.binary())})

    def choose(table: pa.Table) -> pa.Table:
        sums = _summed(table).reshape(3, n_features, n_bins)
        feature, cut, gain = best_split(sums, rules)
        g, h = (int(sums[i, 0].sum()) for i in range(2))
        gl, hl = (int(sums[i, feature, : cut + 1].sum()) if feature >= 0 else 0 for i in range(2))
        values = (("feature", feature, pa.int32()), ("cut", cut, pa.int32()), ("gain", gain, pa.float64()), ("g", g, pa.int64()), ("h", h, pa.int64()), ("gl", gl, pa.int64()), ("hl", hl, pa.int64()))
        return pa.table({"slot": table.column("slot").slice(0, 1), **{name: pa.array([v], kind) for name, v, kind in values}})

    if n_tasks > MANY_TASKS:
        partials = partials.withColumn("part", F.col("part") % MANY_TASKS).groupBy("slot", "part").applyInArrow(meet, "slot int, part int, histogram binary")
    return partials.groupBy("slot").applyInArrow(choose, "slot int, feature int, cut int, gain double, g long, h long, gl long, hl long")


def _round(blocks: DataFrame, n_tasks: int, n_classes: int, n_features: int, n_bins: int, wide: np.dtype, max_depth: int, rules: Rules, number: int) -> list[Tree]:
    """The trees of a round, one for each class."""
    trees = [Tree() for _ in range(n_classes)]
    open_nodes, most = [(k, 0) for k in range(n_classes)], max(1, MOST_CELLS // (n_features * n_bins))
    for level in range(max(1, max_depth)):
        grown: list[tuple[int, int]] = []
        found: list[tuple[int, int, object]] = []
        for low in range(0, len(open_nodes), most):
            own = open_nodes[low : low + most]
            partials = _partials(blocks, trees, own, n_features, n_bins, wide, rules, number)
            found += [(*own[r["slot"]], r) for r in _splits(partials, n_tasks, n_features, n_bins, rules).collect()]
        for k, node, r in sorted(found, key=lambda f: f[:2]):
            trees[k].value[node] = leaf(r["g"], r["h"], rules)
            if r["feature"] < 0 or not max_depth:
                continue
            at = trees[k].split(node, r["feature"], r["cut"], r["gain"])
            trees[k].value[at], trees[k].value[at + 1] = leaf(r["gl"], r["hl"], rules), leaf(r["g"] - r["gl"], r["h"] - r["hl"], rules)
            grown += [(k, at), (k, at + 1)]
        open_nodes = grown
        if not open_nodes or level + 1 >= max_depth:
            break
    return trees


def cut_points(rows: DataFrame, n_features: int, max_bins: int, together: int = 200) -> list[list[float]]:
    """Up to max_bins - 1 thresholds of each feature: quantiles of x, without the largest value."""
    shares, found = [i / max_bins for i in range(max_bins + 1)], []
    for low in range(0, n_features, together):
        names = [f"f{i}" for i in range(low, min(low + together, n_features))]
        columns = rows.select(*(F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names, low)))
        found += columns.approxQuantile(names, shares, 1 / (4 * max_bins))
    return [sorted(set(f))[:-1] for f in found]


class _Options(Params):
    rounds = Param(Params._dummy(), "rounds", "trees of each class", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of a tree's values that counts", TypeConverters.toFloat)
    reg = Param(Params._dummy(), "reg", "what is added to sums of hessians", TypeConverters.toFloat)
    minGain = Param(Params._dummy(), "minGain", "gain from which a node is split", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least sum of hessians of a child", TypeConverters.toFloat)
    minSamplesSplit = Param(Params._dummy(), "minSamplesSplit", "least rows of a node that is split", TypeConverters.toInt)
    minSamplesLeaf = Param(Params._dummy(), "minSamplesLeaf", "least rows of a child", TypeConverters.toInt)
    subsample = Param(Params._dummy(), "subsample", "share of rows that a round draws", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of draws", TypeConverters.toInt)
    key = Param(Params._dummy(), "key", "column that draws are made by", TypeConverters.toString)


class BoostedTrees(_Options, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits trees on features (a vector), label (0, 1 ...) and key; all rows have a label."""

    @keyword_only
    def __init__(
        self, *, rounds: int = 100, maxDepth: int = 6, rate: float = 0.3, reg: float = 1.0, minGain: float = 1e-6, minChildWeight: float = 1.0, minSamplesSplit: int = 2,
        minSamplesLeaf: int = 1, subsample: float = 1.0, maxBins: int = 256, seed: int = 0, key: str = "id",
    ) -> None:
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(rounds=100, maxDepth=6, rate=0.3, reg=1.0, minGain=1e-6, minChildWeight=1.0, minSamplesSplit=2, minSamplesLeaf=1, subsample=1.0, maxBins=256, seed=0, key="id")

    def _fit(self, rows: DataFrame) -> BoostedTreesModel:
        get, spark = self.getOrDefault, rows.sparkSession
        if not 2 <= get("maxBins") <= 65_536:
            raise ValueError("maxBins is from 2 to 65536")
        x = rows.select(F.xxhash64(F.col(f"`{get('key')}`")).alias("draw"), F.col("label").cast("int").alias("label"), vector_to_array("features").alias("x"))
        first, most = x.select(F.size("x")).first(), x.agg(F.max("label"), F.count_if(F.col("label").isNull())).first()
        if first is None or most[1]:
            raise ValueError("there are no rows" if first is None else f"{most[1]} rows have no label")
        n_features, n_classes = first[0], most[0] + 1
        cuts = cut_points(x, n_features, get("maxBins"))
        n_bins = max(map(len, cuts), default=0) + 1
        wide = np.dtype(np.uint8 if n_bins <= 256 else np.uint16)
        rules = Rules(get("rate"), get("reg"), get("minGain"), get("minChildWeight"), get("minSamplesSplit"), get("minSamplesLeaf"), get("subsample"), get("seed"))
        blocks = _blocks(x, cuts, n_classes, wide).cache()
        n_tasks, trees, written, older = blocks.rdd.getNumPartitions(), [], None, None
        try:
            for number in range(get("rounds")):
                trees.append(_round(blocks, n_tasks, n_classes, n_features, n_bins, wide, get("maxDepth"), rules, number))
                if older is not None:  # the first level has cached the scores that came after
                    older.unpersist()
                if number + 1 == get("rounds"):
                    break
                older, blocks = blocks, _scored(blocks, trees[-1], n_features, wide)
                if (number + 1) % CUT_ROUNDS == 0:
                    path, before = scratch(spark, "scores"), written
                    blocks.write.parquet(path)
                    blocks, written = spark.read.parquet(path), path
                    if before:
                        delete(spark, before)
                blocks = blocks.cache()
        finally:
            for held in (blocks, older):
                if held is not None:
                    held.unpersist()
            if written:
                delete(spark, written)
        for group in trees:
            for tree in group:
                tree.cut = [cuts[f][c] if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut, strict=True)]
        return BoostedTreesModel(trees, n_features)


class BoostedTreesModel(Model, MLWritable, MLReadable):
    """Adds probability, a vector by class, and prediction, the likeliest class (of several the first)."""

    def __init__(self, trees: list[list[Tree]] | None = None, n_features: int = 0) -> None:
        super().__init__()
        self.trees, self.n_features = trees or [], n_features

    def scores(self, x: np.ndarray) -> np.ndarray:
        """A row of scores for each class; x has a row of values for each feature."""
        return np.stack([sum((np.array(group[k].value)[group[k].nodes_of(x)] for group in self.trees), np.zeros(x.shape[1])) for k in range(len(self.trees[0]))])

    def _transform(self, rows: DataFrame) -> DataFrame:
        held = rows.sparkSession.sparkContext.broadcast((self.trees, self.n_features))

        def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = BoostedTreesModel(*held.value)
            for x in batches:
                scores = model.scores(np.stack(x.to_numpy()).T) if len(x) else np.zeros((1, 0))
                powers = np.exp(scores - scores.max(axis=0)) if len(x) else scores
                yield pd.Series(list((powers / powers.sum(axis=0)).T)) if len(x) else pd.Series([], dtype=object)

        share = F.pandas_udf(shares, "array<double>")
        found = rows.withColumn("__shares", share(vector_to_array("features")))
        return found.withColumns({"probability": array_to_vector("__shares"), "prediction": (F.array_position("__shares", F.array_max("__shares")) - 1).cast("double")}).drop("__shares")

    @property
    def featureImportances(self) -> SparseVector:
        """The mean gain of each feature's splits, as shares of their sum."""
        gains: dict[int, list[float]] = {}
        for group in self.trees:
            for tree in group:
                for f, gain in zip(tree.feature, tree.gain, strict=True):
                    if f >= 0:
                        gains.setdefault(f, []).append(gain)
        means = {f: sum(g) / len(g) for f, g in sorted(gains.items())}
        return Vectors.sparse(self.n_features, {f: m / sum(means.values()) for f, m in means.items()})

    def write(self) -> MLWriter:
        return _TreesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreesReader(cls)


class _TreesWriter(MLWriter):
    """Metadata, and a table of nodes."""

    def __init__(self, model: BoostedTreesModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model, spark = self.model, SparkSession.active()
        DefaultParamsWriter.saveMetadata(model, path, spark, extraMetadata={"nFeatures": model.n_features})
        nodes = [
            (number, k, node, float(cut), *values)
            for number, group in enumerate(model.trees)
            for k, tree in enumerate(group)
            for node, (cut, *values) in enumerate(zip(tree.cut, tree.feature, tree.left, tree.value, tree.gain, strict=True))
        ]
        spark.createDataFrame(nodes, "round int, class int, node int, cut double, feature int, left int, value double, gain double").coalesce(1).write.parquet(f"{path}/data")


class _TreesReader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BoostedTreesModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        trees: dict[tuple[int, int], Tree] = {}
        for r in spark.read.parquet(f"{path}/data").orderBy("round", "class", "node").collect():
            tree = trees.setdefault((r["round"], r["class"]), Tree([], [], [], [], []))
            for name in ("feature", "cut", "left", "value", "gain"):
                getattr(tree, name).append(r[name])
        n_rounds, n_classes = (max(k[i] for k in trees) + 1 for i in range(2))
        model = self.cls([[trees[i, k] for k in range(n_classes)] for i in range(n_rounds)], metadata["nFeatures"])
        model._resetUid(metadata["uid"])
        return model
