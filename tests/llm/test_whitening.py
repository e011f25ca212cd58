"""Whitening against numpy's eigenvectors and plain integers."""

import math

import numpy as np
import pytest

from threadstats.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, component int, n string"


def _table(spark, rows, first=0):
    data = [(first + i, None if r is None else [None if x is None else float(x) for x in r], 0, 7, "clash")
            for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def _plain(rows, scale=1024, shift=100_000):
    """x, exact sums, eigenvalues and eigenvectors of the covariance, by plain integers and numpy."""
    x = [[math.floor(scale * float(np.float32(c))) + shift for c in r] for r in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, sums, values[::-1], axes[:, ::-1], centred


@pytest.mark.parametrize("width", [5, 12, 33])
def test_whitened_rows_equal_the_plain_computation(spark, width):
    rng = np.random.default_rng(width)
    rows = rng.normal(size=(300, width)) * np.linspace(3, 0.2, width) + rng.normal(size=(300, 1))
    x, sums, values, axes, centred = _plain(rows)
    got = whitening.whiten(_table(spark, rows).repartition(4)).collect()
    count = min(8, width)
    assert len(got) == 300 * count
    for r in got:
        i, c = r["vec_id"], r["component"] - 1
        assert r["n"] == 300
        assert int(r["deviation"]) == sum((300 * a - s) ** 2 for a, s in zip(x[i], sums))
        assert abs(abs(r["whitened"]) - abs(centred[i] @ axes[:, c]) / math.sqrt(values[c])) < 1e-8
        assert abs(r["explained"] - values[c] / values.sum()) < 1e-9
        assert r["identity_error"] < 1e-9
    sign = {(r["component"], np.sign(r["whitened"] * (centred[r["vec_id"]] @ axes[:, r["component"] - 1])))
            for r in got if abs(r["whitened"]) > 1e-6}
    assert len(sign) == count  # one sign for all rows


def test_the_factor_is_triangular_and_its_rotation_diagonal():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 9)) @ np.diag([1e3, 1e2, 10, 1, 1, 1, 0.1, 0.01, 1e-3])
    scatter = a.T @ a
    g = whitening.pivoted_cholesky(scatter)
    assert np.allclose(g @ g.T, scatter, rtol=1e-10)
    places = np.argsort(-(g == 0).sum(1), kind="stable")
    assert np.allclose(np.triu(g[places], 1), 0)
    turned = whitening.rotated_columns(g)
    cosines = turned / np.linalg.norm(turned, axis=0)
    assert np.abs(cosines.T @ cosines - np.eye(9)).max() < 1e-13
    values, axes = whitening.principal(scatter)
    assert np.allclose(values, np.linalg.eigvalsh(scatter)[::-1], rtol=1e-6)


def test_components_without_variance_are_left_out(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(2, 6))
    rows = [base.T @ rng.normal(size=2) for _ in range(50)]
    rows = np.round(np.array(rows) * 1024) / 1024  # x then is a lattice of its own rank
    flat = np.hstack([rows[:, :2], np.full((50, 4), 0.25)])
    got = whitening.whiten(_table(spark, flat)).collect()
    assert {r["component"] for r in got} == {1, 2}
    assert got[0]["identity_error"] < 1e-9
    assert whitening.whiten(_table(spark, [[0.5, 0.5]] * 3)).count() == 0
    assert whitening.whiten(_table(spark, [[0.5, 0.25]])).count() == 0


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [list(r) for r in rng.normal(size=(40, 4))]
    odd = [None, [], [float("nan")] * 4, [1.0, None, 1.0, 1.0], [float("inf"), 0, 0, 0], [1.0] * 3, [1e30, 0, 0, 0]]
    data = _table(spark, rows).union(_table(spark, odd, 1000)).union(_table(spark, [rows[0], rows[0]], 0))
    data = data.union(spark.createDataFrame([(None, [0.5, 0.5, 0.5, 0.5], 0, 7, "clash")], SCHEMA))
    got = whitening.whiten(data).collect()
    assert {r["vec_id"] for r in got} == {None, *range(40)}
    assert sum(r["vec_id"] == 0 for r in got) == 2 * 4  # one of the repeats stands under id 1
    assert {r["n"] for r in got} == {43}
    assert whitening.whiten(data.limit(0)).count() == 0
    assert whitening.whiten(data.limit(0)).columns == whitening.whiten(data).columns


def test_large_integers_stay_exact(spark):
    rows = [[float(1 << 38), 0.0], [-float(1 << 38), 1.0], [0.0, 3.0]]
    x, sums, *_ = _plain(rows)
    got = whitening.whiten(_table(spark, rows)).collect()
    for r in got:
        assert int(r["deviation"]) == sum((3 * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums))
