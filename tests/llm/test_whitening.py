import math

import numpy as np
import pytest

from gavelspark.llm import whitening
from gavelspark.llm.queries import ALL

SCHEMA = "vec_id long, embedding array<float>, component string, n double"


def brute(vectors):
    """numpy's symmetric eigensolver on the same integers."""
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], dtype=np.int64)
    n, s = len(x), x.sum(0)
    v = ((x - s / n).T @ (x - s / n)) / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)
    return x, n, s, values[order], vectors[:, order], np.trace(v)


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_pivoted_cholesky_and_jacobi_give_numpys_eigenpairs():
    rng = np.random.default_rng(7)
    for d, rank in [(12, 12), (9, 4), (1, 1)]:
        b = rng.normal(size=(50, rank)) @ rng.normal(size=(rank, d))
        values, vectors = whitening.eigen(b.T @ b)
        expected = np.sort(np.linalg.eigvalsh(b.T @ b))[::-1][:rank]
        assert len(values) == rank
        assert np.allclose(values, expected, rtol=1e-10, atol=1e-9 * expected[0])
        assert np.allclose(vectors @ vectors.T, np.eye(rank), atol=1e-12)
        assert np.allclose((b.T @ b) @ vectors.T, vectors.T * values, atol=1e-8 * expected[0])


def test_rows_match_brute_force_and_odd_rows_go(spark):
    rng = np.random.default_rng(3)
    good = [[float(c) for c in rng.normal(size=5) * (1 + k % 3)] for k in range(40)]
    data = [(k, v, "x", 1.0) for k, v in enumerate(good)]
    data += [(40, None, None, None), (41, [1.0, None, 2.0, 3.0, 4.0], None, None), (42, [float("nan")] * 5, None, None),
             (43, [float("inf"), 0.0, 0.0, 0.0, 0.0], None, None), (44, [1.0, 2.0], None, None), (None, good[0], None, None),
             (3, good[3], None, None)]
    got = whitening.report(rows(spark, data)).toPandas()
    kept = good + [good[0], good[3]]
    x, n, s, values, vectors, trace = brute(kept)
    assert set(got.vec_id.dropna()) == set(range(40)) and got.vec_id.isna().sum() == 5
    assert (got.n == n).all() and sorted(got.component.unique()) == [1, 2, 3, 4, 5]
    assert got.identity_error.iloc[0] < 1e-9
    for row in got.itertuples():
        k = row.component - 1
        assert math.isclose(row.explained, values[k] / trace, rel_tol=1e-9)
    first = got[(got.vec_id == 7)].sort_values("component")
    expected = (x[7] - s / n) @ vectors / np.sqrt(values)
    assert np.allclose(np.abs(first.whitened.values), np.abs(expected), atol=1e-9)
    assert first.deviation.iloc[0] == int(((n * x[7] - s) ** 2).sum())


def test_signs_are_the_same_for_every_row(spark):
    data = [(k, [float(k), float(2 * k % 7), 1.0], None, None) for k in range(20)]
    got = whitening.report(rows(spark, data)).toPandas()
    x, n, s, values, vectors, _ = brute([d[1] for d in data])
    for k in sorted(got.component.unique()):
        part = got[got.component == k].sort_values("vec_id").whitened.values
        expected = (x - s / n) @ vectors[:, k - 1] / np.sqrt(values[k - 1])
        assert np.allclose(part, expected, atol=1e-9) or np.allclose(part, -expected, atol=1e-9)


@pytest.mark.parametrize("data", [[], [(1, None, None, None)], [(1, [0.5, 0.25], None, None)], [(1, [0.5, 0.25], None, None)] * 3])
def test_no_components_without_spread(spark, data):
    assert whitening.report(rows(spark, data)).count() == 0


def test_query_on_the_table(spark):
    got = ALL["op11_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    assert sorted(got.columns)[:3] == ["component", "deviation", "explained"]
    assert got.identity_error.max() <= 1e-4 and got.component.max() <= 8
