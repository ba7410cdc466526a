"""op12 against whole-number arithmetic of Python, row by row."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from plumbline.llm import whitening


def plain_fit(vectors):
    """n, sums, exact scatter of n * x - S and the numbers x, by whole numbers of Python."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, size = len(x), len(x[0])
    sums = [sum(row[d] for row in x) for d in range(size)]
    y = [[n * row[d] - sums[d] for d in range(size)] for row in x]
    scatter = [[sum(r[i] * r[j] for r in y) for j in range(size)] for i in range(size)]
    return n, tuple(sums), scatter, y


def whole(rows, size):
    return [(r["vec_id"], v) for r in rows if (v := r["embedding"]) is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]


@given(st.lists(st.integers(-(10**40), 10**40), min_size=1, max_size=5))
def test_remainders_give_the_number_back(numbers):
    moduli = whitening.primes(2 * max(map(abs, numbers)) + 1)
    assert all(whitening.crt([v % p for p in moduli], moduli) == v for v in numbers)
    assert len(set(moduli)) == len(moduli) and math.prod(moduli) > 2 * max(map(abs, numbers))


def test_sums_of_a_block_are_exact():
    assert whitening.BLOCK * (whitening.BELOW // 2) ** 2 <= 2**53


@pytest.mark.parametrize("parts", [1, 5])
def test_scatter_is_exact_for_large_numbers(spark, parts, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    draw = np.random.default_rng(5)
    vectors = (draw.normal(size=(60, 4)) * 10.0 ** draw.integers(-3, 9, (60, 1))).tolist()
    rows = spark.createDataFrame([(v,) for v in vectors], "v array<double>").repartition(parts)
    n, sums, scatter, y = plain_fit(vectors)
    found = whitening._totals(rows)
    assert found == (n, sums, max(abs(v) for r in y for v in r))
    assert len(whitening.primes(2 * n * found[2] ** 2 + 1)) >= 4
    assert whitening.exact_scatter(rows, *found) == scatter


def check(rows, source, components=whitening.COMPONENTS):
    size = len(source[0][1])
    n, sums, scatter, y = plain_fit([v for _, v in source])
    covariance = np.array([[c / n**3 for c in row] for row in scatter])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    expected = {}
    for (vec_id, _), own in zip(source, y, strict=True):
        for k, at in enumerate(order, 1):
            w = float(np.array(own) / n @ vectors[:, at] / math.sqrt(values[at]))
            expected.setdefault((vec_id, k, sum(c * c for c in own)), []).append(w)
    found = {}
    for r in rows:
        assert r["n"] == n and r["identity_error"] <= 1e-9 and r["identity_error"] == rows[0]["identity_error"]
        assert r["explained"] == pytest.approx(values[order[r["component"] - 1]] / np.trace(covariance), rel=1e-9)
        found.setdefault((r["vec_id"], r["component"], r["deviation"]), []).append(r["whitened"])
    assert found.keys() == expected.keys() and len(rows) == len(source) * min(size, components)
    for k in range(1, min(size, components) + 1):
        keys = [key for key in found if key[1] == k]
        mine = np.array([x for key in keys for x in sorted(found[key])])
        sign = 1 if abs(sum(found[key][0] * expected[key][0] for key in keys)) == sum(found[key][0] * expected[key][0] for key in keys) else -1
        theirs = np.array([x for key in keys for x in sorted(sign * w for w in expected[key])])
        assert np.allclose(mine, theirs, rtol=0, atol=1e-7)


def test_rows_of_the_query(spark):
    folder = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    check(whitening.op12_whitening(spark, folder).collect(), whole(source, 64))


def test_odd_rows(spark, odd_dir):
    """Nulls, null and infinite entries and other lengths are left out; repeated rows and ids count each."""
    source = whole(spark.read.parquet(f"{odd_dir}/embeddings.parquet").collect(), 3)
    assert len(source) == 7
    check(whitening.op12_whitening(spark, odd_dir).collect(), source)


def test_components_without_variance(spark):
    vectors = [(i, [float(i), 2.0 * i, 5.0]) for i in range(4)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    model = whitening.fitted(rows)
    assert model.usable.tolist() == [True, False, False]
    found = whitening.whitened(rows, model).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in found)
    assert whitening.identity_error(rows, model) < 1e-12


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[3.0, 4.0]] * 5])
def test_one_point(spark, vectors):
    rows = spark.createDataFrame([(1, v) for v in vectors], "vec_id long, embedding array<double>")
    model = whitening.fitted(rows)
    assert model.n == len(vectors) and model.trace == 0 and not model.usable.any()
    assert all(r["deviation"] == 0 and r["whitened"] == [None, None] for r in whitening.whitened(rows, model).collect())
    assert whitening.identity_error(rows, model) == 0.0


def test_only_unusable_vectors(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, 1.0])], "vec_id long, embedding array<double>")
    assert whitening.fitted(rows) is None


def test_numbers_beyond_64_bits_raise(spark):
    for vectors in ([[1e30, 0.0], [0.0, 1.0]], [[1e9, 0.0], [-1e9, 1.0]] * 3):
        rows = spark.createDataFrame([(1, v) for v in vectors], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            whitening.whitened(rows, whitening.fitted(rows)).collect()


def test_partitions_change_nothing(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    one, many = whitening.fitted(rows.coalesce(1)), whitening.fitted(rows.repartition(7))
    assert one.sums == many.sums and (one.eigenvectors == many.eigenvectors).all() and (one.eigenvalues == many.eigenvalues).all()
