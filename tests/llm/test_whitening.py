"""Whitening against numpy's dense eigenvectors, and FEAST on matrices with known spectra."""

import numpy as np
import pytest

from vesselflow.llm import whitening
from vesselflow.llm.whitening import above, feast, inertia, leading, whiten

RANDOM = np.random.default_rng(3)


def turned(values):
    q = np.linalg.qr(RANDOM.standard_normal((len(values), len(values))))[0]
    matrix = q @ np.diag(values) @ q.T
    return (matrix + matrix.T) / 2


def frame(spark, vectors):
    rows = [(i, v, 9, 9.0, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, _x double, n string")


def brute(vectors):
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    matrix = centred.T @ centred / n
    values, turn = np.linalg.eigh(matrix)
    return n, ((n * x - sums) ** 2).sum(axis=1), values[::-1], turn[:, ::-1], x - sums / n, np.trace(matrix)


def check(spark, vectors, components):
    n, deviation, values, turn, centred, trace = brute(vectors)
    rows = whiten(frame(spark, vectors).repartition(3)).toPandas()
    assert len(rows) == len(vectors) * components and (rows.n == n).all()
    first = rows[rows.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == deviation.tolist()
    for k in range(components):
        part = rows[rows.component == k + 1].sort_values("vec_id")
        theirs = centred @ turn[:, k] / np.sqrt(values[k])
        sign = np.sign(theirs @ part.whitened.to_numpy())
        assert np.allclose(part.whitened * sign, theirs, atol=1e-8)
        assert np.allclose(part.explained, values[k] / trace, rtol=1e-9)
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-9


def test_against_dense_eigenvectors(spark):
    vectors = (RANDOM.standard_normal((300, 20)) * np.linspace(0.2, 3, 20)).tolist()
    check(spark, [*vectors, *vectors[:100], vectors[0]], 16)


def test_fewer_dimensions_than_components(spark):
    check(spark, RANDOM.standard_normal((50, 3)).tolist(), 3)


def test_rank_below_the_dimensions(spark):
    base = np.round(RANDOM.standard_normal((60, 4)) * 5)
    vectors = np.concatenate([base, base, np.full((60, 3), 0.25)], axis=1)
    check(spark, vectors.tolist(), 4)


def test_nulls_infinities_other_lengths_and_one_vector(spark):
    good = RANDOM.standard_normal((20, 4)).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0], [1.0, float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [float("-inf")] * 4, [1.0]]
    rows = whiten(frame(spark, [*good, *bad])).toPandas()
    assert set(rows.vec_id) == set(range(20)) and len(rows) == 80
    assert whiten(frame(spark, [[0.5, 0.25]] * 5)).count() == 0
    assert whiten(frame(spark, [None, [None]])).count() == 0
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, [[], []])).count() == 0


def test_null_and_repeated_keys(spark):
    vectors = RANDOM.standard_normal((10, 2)).tolist()
    rows = [(None if i < 3 else 7, v) for i, v in enumerate(vectors)]
    found = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sum(r.vec_id is None for r in found) == 6 and sum(r.vec_id == 7 for r in found) == 14


def test_entries_beyond_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="does not fit a long"):
        whiten(frame(spark, [[1e30, 0.0], [0.0, 1.0]])).collect()


def test_deviations_beyond_a_long_are_an_error():
    model = whitening.Whitening(1, 2**20, [0], np.ones(1), np.eye(1), 1.0)
    assert model.deviations(np.array([[2**11 - 1]])) == [((2**11 - 1) * 2**20) ** 2]
    with pytest.raises(OverflowError):
        model.deviations(np.array([[2**12]]))


SPECTRA = {
    "apart": np.arange(1.0, 41),
    "falling by nine": 9.0 ** -np.arange(30),
    "all alike": np.full(40, 3.0),
    "two heights": np.r_[np.full(20, 5.0), np.ones(20)],
    "crowded": np.r_[1e6, np.linspace(1, 1.0001, 39)],
    "nearly alike": np.r_[100 + np.arange(15) * 1e-10, 50, 50, 50, np.ones(20)],
    "mostly zero": np.r_[4.0, 2.0, np.zeros(30)],
    "one": np.array([2.5]),
}


@pytest.mark.parametrize("name", list(SPECTRA))
def test_feast_on_known_spectra(name):
    values = np.sort(SPECTRA[name])[::-1]
    matrix = turned(values)
    found, vectors = leading(matrix, 16)
    known = values[:16][values[:16] > whitening.ZERO * values[0]]
    assert len(found) == len(known) and np.allclose(found, known, rtol=0, atol=1e-13 * values[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)
    assert np.linalg.norm(matrix @ vectors - vectors * found) < 1e-12 * values[0]


def test_feast_finds_exactly_the_interval():
    matrix = turned(np.arange(1.0, 31))
    values, vectors = feast(matrix, 10.5, 14.5, above(matrix, 10.5) - above(matrix, 14.5))
    assert np.allclose(np.sort(values), [11, 12, 13, 14], atol=1e-12) and vectors.shape == (30, 4)


def test_inertia():
    for _ in range(50):
        values = RANDOM.integers(-4, 5, RANDOM.integers(1, 25)) + 0.5
        assert inertia(turned(values)) == (values > 0).sum()
    assert inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1 and inertia(np.zeros((3, 3))) == 0


def test_no_variance():
    values, vectors = leading(np.zeros((5, 5)))
    assert len(values) == 0 and vectors.shape == (5, 0)
