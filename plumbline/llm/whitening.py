"""Whitened embeddings from an exact scatter matrix in residue numbers.

An entry c becomes the whole number x = floor(SCALE * c) + OFFSET. With n vectors and sums S, the numbers
y = n * x - S are centred without rounding. Each partition multiplies their residues by several primes as
matrices of doubles, in blocks of so few rows that every sum stays below 2^53 and is exact; the residues are
added up over the partitions, and Chinese remaindering gives the exact scatter of y, of which the covariance
divisor n is n^3 times smaller. So many primes are taken that their product passes twice the largest scatter
that n and the range of y allow. Only the dimensions squared, never the rows, bound what reaches the driver.
One eigendecomposition in doubles gives the components.

Vectors that are null, or that hold a null or an entry that isn't finite, are left out, and so are those of
another length than most have (of lengths as frequent, the largest). Equal rows count each; null ids are kept.
A component whose variance is below the precision of doubles can't be scaled: its whitened is null and it has
no part in identity_error. Entries for which x, n * x or the sum of squares pass 64 bits raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from plumbline.llm.common import cut, forget, read

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Primes are below this; residues are taken between minus and plus half of it.
BELOW = 1 << 21
#: Rows multiplied together: BLOCK * (BELOW / 2)^2 is 2^53, up to which doubles add whole numbers exactly.
BLOCK = 1 << 13
#: Entries beyond it have no place in a long.
MOST_ENTRY = 2.0**56

Batches = Iterator[pa.RecordBatch]


def primes(over: int) -> list[int]:
    """The largest primes below BELOW whose product is larger than over."""
    found, product, candidate = [], 1, BELOW - 1
    while product <= over:
        if all(candidate % d for d in range(3, math.isqrt(candidate) + 1, 2)):
            found.append(candidate)
            product *= candidate
        candidate -= 2
        if candidate < 3:
            raise ValueError("the scatter is too large for the primes there are")
    return found


def crt(residues: list[int], moduli: list[int]) -> int:
    """The whole number nearest zero with these residues."""
    product, total = math.prod(moduli), 0
    for r, p in zip(residues, moduli, strict=True):
        rest = product // p
        total += int(r) % p * rest * pow(rest, -1, p)
    total %= product
    return total - product if 2 * total > product else total


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and lengths of the vectors without null or infinite entries, and all entries of these, one after the other."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    good = column.is_valid().to_numpy(zero_copy_only=False)
    good[owner[~np.isfinite(entries)]] = False  # null entries come as nan
    at = np.flatnonzero(good)
    return at, lengths[at], entries[good[owner]]


def of_length(batches: Batches, dimension: int, column: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the vectors of this length in each batch, and their entries as whole numbers x, a row each."""
    for batch in batches:
        at, lengths, entries = whole_vectors(batch.column(column))
        same = lengths == dimension
        yield at[same], scaled(entries[np.repeat(same, lengths)]).reshape(-1, dimension)


def scaled(entries: np.ndarray) -> np.ndarray:
    if len(entries) and np.abs(entries).max() > MOST_ENTRY:
        raise OverflowError("an entry is too large for whole numbers of 64 bits")
    return np.floor(SCALE * entries).astype(np.int64) + OFFSET


@dataclass(frozen=True)
class Whitening:
    """What was fitted on n vectors: exact sums by dimension, and components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    #: eigenvectors[k] is the unit vector of component k + 1.
    eigenvectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        return _centred(x, self.n, self.sums)

    def projected(self, y: np.ndarray) -> np.ndarray:
        """Whitened values of rows of y = n * x - S; nan for components without variance."""
        scale = np.where(self.usable, np.sqrt(np.maximum(self.eigenvalues, np.finfo(float).tiny)), np.nan)
        return (y / self.n) @ self.eigenvectors.T / scale

    @property
    def usable(self) -> np.ndarray:
        return self.eigenvalues > self.dimension * np.finfo(float).eps * max(self.trace, 0.0)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    middle = [s // n for s in sums]  # moved first, so that products stay small
    rest = np.array([s - n * m for s, m in zip(sums, middle, strict=True)], np.int64)
    moved = x - np.array(middle, np.int64)
    if moved.size and int(np.abs(moved).max()) >= (1 << 62) // n:
        raise OverflowError("n * x - S passes 64 bits")
    return n * moved - rest


def _totals(vectors: DataFrame) -> tuple[int, tuple[int, ...], int]:
    """Number of vectors of the commonest length, and by dimension their sums; the largest distance of an entry from the mean."""

    def sums(batches: Batches) -> Batches:
        found: dict[int, list] = {}
        for batch in batches:
            _, lengths, entries = whole_vectors(batch.column(0))
            for size in np.unique(lengths).tolist():
                x = scaled(entries[np.repeat(lengths == size, lengths)]).reshape(int((lengths == size).sum()), size)
                n, total, low, high = found.setdefault(size, [0, np.zeros(size, object), np.full(size, 2**62), np.full(size, -(2**62))])
                # halves of 32 bits keep sums of any entries exact
                total = total + (x >> 32).sum(axis=0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                found[size] = [n + len(x), total, np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))]
        for size, (n, total, low, high) in found.items():
            rows = size or 1
            columns = [[size] * rows, list(range(rows)), [n] * rows]
            values = ([str(t) for t in total], low.tolist(), high.tolist()) if size else (["0"], [0], [0])
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), *map(pa.array, values, kinds)], names=["size", "d", "n", "total", "low", "high"])

    parts = vectors.mapInArrow(sums, "size long, d long, n long, total string, low long, high long")
    sums_of = [F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high")]
    known = cut(parts.groupBy("size", "d").agg(*sums_of))
    most = known.where("d = 0").orderBy(F.desc("n"), F.desc("size")).first()
    rows = sorted(known.where(F.col("size") == most["size"]).collect(), key=lambda r: r["d"]) if most and most["size"] else []
    forget(known)
    if not rows:
        return 0, (), 0
    n = most["n"]
    totals = tuple(int(r["total"]) for r in rows)
    return n, totals, max(max(n * r["high"] - t, t - n * r["low"]) for r, t in zip(rows, totals, strict=True))


def _residues(n: int, sums: tuple[int, ...], moduli: list[int], batches: Batches) -> Batches:
    """By prime and dimension a row of the scatter of y, as residues summed over the partition."""
    size = len(sums)
    added = np.zeros((len(moduli), size, size), np.int64)
    for _, x in of_length(batches, size):
        for low in range(0, len(x), BLOCK):
            y = _centred(x[low : low + BLOCK], n, sums)
            for k, p in enumerate(moduli):
                r = y % p
                r = np.where(r > p // 2, r - p, r).astype(float)
                added[k] = (added[k] + (r.T @ r).astype(np.int64)) % p
    if not added.any():
        return
    for k, p in enumerate(moduli):
        rows = pa.FixedSizeListArray.from_arrays(pa.array(added[k].ravel()), size).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([p] * size, pa.int64()), pa.array(range(size), pa.int64()), rows], names=["prime", "i", "residues"])


def exact_scatter(vectors: DataFrame, n: int, sums: tuple[int, ...], reach: int) -> list[list[int]]:
    """The scatter of y = n * x - S over the vectors, in whole numbers of any size; reach is the largest absolute y."""
    moduli = primes(2 * n * reach * reach + 1)
    parts = vectors.mapInArrow(partial(_residues, n, sums, moduli), "prime long, i long, residues array<long>")
    cells = parts.select("prime", "i", F.posexplode("residues").alias("j", "r")).where("j >= i")
    rows = cells.groupBy("i", "j").pivot("prime", moduli).agg(F.sum("r")).collect()
    size = len(sums)
    scatter = [[0] * size for _ in range(size)]
    for row in rows:
        scatter[row["i"]][row["j"]] = scatter[row["j"]][row["i"]] = crt([row[str(p)] or 0 for p in moduli], moduli)
    return scatter


def fitted(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors of embeddings; None where there is no vector."""
    vectors = embeddings.select(F.col(vector).alias("v"))
    n, sums, reach = _totals(vectors)
    if not n:
        return None
    scatter = exact_scatter(vectors, n, sums, reach)
    # quotients of whole numbers are rounded once
    covariance = np.array([[cell / n**3 for cell in row] for row in scatter])
    values, eigenvectors = np.linalg.eigh(covariance)
    kept = np.argsort(-values, kind="stable")[:components]
    axes = eigenvectors.T[kept]
    axes = axes * np.sign(axes[np.arange(len(kept)), np.abs(axes).argmax(axis=1)])[:, None]
    return Whitening(n, sums, axes, values[kept], sum(scatter[i][i] for i in range(len(sums))) / n**3)


def identity_error(embeddings: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the covariance of whitened vectors minus the identity, over the components with variance.

    A partition centres its own rows before it multiplies; means and products of partitions are then put together
    by the usual update for two parts, one after the other as they come in.
    """
    used = np.flatnonzero(model.usable)
    if not len(used):
        return 0.0

    def moments(batches: Batches) -> Batches:
        n, mean, products = 0, np.zeros(len(used)), np.zeros((len(used), len(used)))
        for _, x in of_length(batches, model.dimension):
            if len(x):
                w = model.projected(model.centred(x))[:, used]
                n, mean, products = joined((n, mean, products), (len(w), (own := w.mean(axis=0)), (w - own).T @ (w - own)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "mean", "products"])

    def together(batches: Batches) -> Batches:
        n, mean, products = 0, np.zeros(len(used)), np.zeros((len(used), len(used)))
        for batch in batches:
            for row in batch.to_pylist():
                n, mean, products = joined((n, mean, products), (row["n"], np.array(row["mean"]), np.array(row["products"]).reshape(products.shape)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "mean", "products"])

    schema = "n long, mean array<double>, products array<double>"
    parts = embeddings.select(F.col(vector).alias("v")).mapInArrow(moments, schema)
    # a row for each partition, put together in some dozen tasks and then on the driver
    some = parts.repartition(16).mapInArrow(together, schema)
    n, mean, products = 0, np.zeros(len(used)), np.zeros((len(used), len(used)))
    for row in some.collect():
        n, mean, products = joined((n, mean, products), (row["n"], np.array(row["mean"]), np.array(row["products"]).reshape(products.shape)))
    return float(np.abs(products / n - np.eye(len(used))).max())


def joined(a: tuple, b: tuple) -> tuple:
    """Number, mean and centred products of two parts together."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def whitened(embeddings: DataFrame, model: Whitening, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id, deviation (exact sum of squares of n * x - S) and whitened, an array of the components, of each vector."""

    def project(batches: Batches) -> Batches:
        for batch in batches:
            for at, x in of_length([batch], model.dimension, 1):
                y = model.centred(x)
                if len(y) and float((y.astype(float) ** 2).sum(axis=1).max()) >= 2.0**62:
                    raise OverflowError("a sum of squares of n * x - S passes 64 bits")
                w = model.projected(y)
                flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
                rows = pa.FixedSizeListArray.from_arrays(flat, w.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array((y * y).sum(axis=1), pa.int64()), rows], names=["vec_id", "deviation", "whitened"])

    vectors = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("v"))
    schema = vectors.select("vec_id").schema.add("deviation", "long").add("whitened", ArrayType(DoubleType()))
    return vectors.mapInArrow(project, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    model = fitted(rows)
    if model is None:
        return spark.createDataFrame([], rows.select("vec_id").schema.add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double"))
    shares = [float(v / model.trace) if model.trace else None for v in model.eigenvalues]
    explained = F.array(*(F.lit(s).cast("double") for s in shares))
    found = whitened(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(identity_error(rows, model)).alias("identity_error"),
    )
