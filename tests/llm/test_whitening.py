"""Whitening against NumPy's eigenvectors, with rows that go, ties and degenerate tables."""

import math

import numpy as np
import pytest

from saccade.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, w string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "w") for i, v in rows], SCHEMA)


def clustered(n, d, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((5, d))
    out = centers[rng.integers(0, 5, n)] + 0.4 * rng.standard_normal((n, d)) * np.linspace(1, 2, d)
    return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def whole(v):
    return np.floor(1024.0 * np.asarray(v, np.float32).astype(np.float64)).astype(np.int64) + 100_000


def test_whitening_against_eigh(spark):
    data = clustered(400, 24)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    rows += [(i + 400, rows[0][1]) for i in range(200)] + [(None, rows[1][1]), (3, rows[3][1])]  # a common vector, a null id, a repeated row
    gone = [(900, None), (901, []), (902, [None] + rows[0][1][1:]), (903, [math.nan] + rows[0][1][1:]), (904, [math.inf] + rows[0][1][1:]), (905, rows[0][1][:5])]
    got = whitening.whiten(table(spark, rows + gone).repartition(5)).collect()
    x = np.array([whole(v) for _, v in rows])
    n, sums = len(x), x.sum(0)
    z = (x * n - sums) / n
    e, vectors = np.linalg.eigh(z.T @ z / n)
    e, vectors = e[::-1][:8], vectors[:, ::-1][:, :8]
    want = z @ vectors / np.sqrt(e)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    ids = [i for i, _ in rows]
    for k in range(8):
        column = by[k + 1]
        ours = np.array([column[i][0].whitened for i in ids])
        sign = np.sign(ours @ want[:, k])
        assert np.abs(ours * sign - want[:, k]).max() < 1e-8
        assert column[0][0].explained == pytest.approx(e[k] / (z * z).sum() * n, rel=1e-9)
    for i, row in zip(ids, x, strict=True):
        assert by[1][i][0].deviation == sum(int(n * a - s) ** 2 for a, s in zip(row.tolist(), sums.tolist(), strict=True))
    assert len(by[1][3]) == 2 and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_lobpcg_needs_few_products_and_certifies():
    """Many dimensions, close eigenvalues behind the wanted ones, an offset far above the spread."""
    rng = np.random.default_rng(3)
    d = 300
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = np.concatenate([np.linspace(10, 6, 8), np.linspace(5.5, 0.1, d - 8)])
    matrix = (basis * values) @ basis.T
    found = whitening.lobpcg(lambda block: matrix @ block, d)
    assert found.rounds < 150 and found.residuals.max() < 1e-11
    assert np.abs(found.values - values[:8]).max() < 1e-11
    assert np.abs(np.abs((basis[:, :8] * found.vectors).sum(0)) - 1).max() < 1e-11
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda block: matrix @ block, d, rounds=3)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_no_vectors_no_rows(spark, rows):
    out = whitening.whiten(table(spark, rows))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_components_without_variance(spark):
    same = whitening.whiten(table(spark, [(i, [0.5, 0.25, 0.0]) for i in range(4)])).collect()
    assert len(same) == 12 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error is None for r in same)
    line = whitening.whiten(table(spark, [(i, [i / 4, i / 2, 0.0]) for i in range(5)])).collect()
    first = {r.vec_id: r.whitened for r in line if r.component == 1}
    assert sorted(abs(v) for v in first.values()) == pytest.approx([0, 2**-0.5, 2**-0.5, 2**0.5, 2**0.5], abs=1e-12)
    assert all(r.whitened is None for r in line if r.component > 1) and line[0].identity_error < 1e-12


def test_deviation_beyond_a_long():
    at = whitening.Center(10**10, np.array([10**15, 10**15]))
    x = np.array([[100_300, 99_000]])
    assert whitening.deviation(x, at) == [(10**10 * 300) ** 2 + (10**10 * 1000) ** 2]
