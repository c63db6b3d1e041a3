"""Weighted moments: digits, merging, groups, gaps."""

import numpy as np
import pytest

from saccade.operators import regression


def two_pass(x, y, w):
    mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
    return (w * (x - mx) * (y - my)).sum() / (w * (x - mx) ** 2).sum()


@pytest.mark.parametrize("offset,step", [(1.7e15, 1e3), (1.7e9, 10.0), (0.0, 1.0)])
def test_line_far_from_zero(spark, offset, step):
    """Microseconds of our days: a slope to 1e-9, whatever the rows are spread over."""
    rows = [(i, offset + i * step, (offset + i * step) / 2, 1.0 + i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, x double, y double, w double")
    for parts in (1, 7):
        got = regression.weighted_line(df.repartition(parts), "x", "y", "w", []).first()
        assert got.slope == pytest.approx(0.5, abs=1e-9) and got.n == 1000
        assert got.intercept == pytest.approx(0, abs=1e-9 * max(offset, 1))


def test_line_against_two_passes(spark, monkeypatch):
    """States merged in trees, and handed on early, give what two passes give."""
    rng = np.random.default_rng(1)
    n = 4000
    x, w = 1.7e15 + rng.integers(0, 10**7, n), rng.random(n)
    y = 3e-4 * (x - 1.7e15) + rng.normal(0, 5, n)
    g = rng.integers(0, 5, n)
    df = spark.createDataFrame([(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(g, x, y, w, strict=True)], "g int, x double, y double, w double")
    monkeypatch.setattr(regression, "FAN", 3)
    for parts, held in ((11, 50_000), (3, 2)):
        monkeypatch.setattr(regression, "GROUPS", held)
        got = {r.g: r for r in regression.weighted_line(df.repartition(parts), "x", "y", "w", ["g"]).collect()}
        for k in range(5):
            at = g == k
            assert got[k].slope == pytest.approx(two_pass(x[at], y[at], w[at]), rel=1e-9)
            assert got[k].n == at.sum() and got[k].total == pytest.approx(w[at].sum())


def test_plane_far_from_zero(spark):
    rng = np.random.default_rng(2)
    rows = [(float(1e9 + u), float(-1e8 + v), float(2 * u - 0.25 * v + 7), 1.0) for u, v in rng.normal(0, 10, (500, 2))]
    got = regression.weighted_plane(spark.createDataFrame(rows, "u double, v double, y double, w double").repartition(5), "u", "v", "y", "w", []).first()
    assert got.slope_u == pytest.approx(2, abs=1e-6) and got.slope_v == pytest.approx(-0.25, abs=1e-6)
    same = [(float(i), float(2 * i), float(i), 1.0) for i in range(50)]
    got = regression.weighted_plane(spark.createDataFrame(same, "u double, v double, y double, w double"), "u", "v", "y", "w", []).first()
    assert got.slope_u is None and got.slope_v is None and got.n == 50
    # nearly dependent is not dependent
    near = [(float(i), float(i) + 1e-4 * (i % 3), float(i) + 5e-5 * (i % 3), 1.0) for i in range(60)]
    got = regression.weighted_plane(spark.createDataFrame(near, "u double, v double, y double, w double"), "u", "v", "y", "w", []).first()
    assert got.slope_u == pytest.approx(0.5, abs=1e-3) and got.slope_v == pytest.approx(0.5, abs=1e-3)


def test_gaps_ties_and_empty(spark):
    rows = [(None, 1.0, 2.0, 1), (None, 3.0, 6.0, 1), ("a", 1.0, 1.0, 0), ("a", None, 9.0, 1), ("a", 2.0, None, 1), ("b", 5.0, 1.0, 2), ("b", 5.0, 3.0, 2), ("c", 1.0, 1.0, 1), ("c", 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, x double, y double, w int")
    got = {r.g: r for r in regression.weighted_line(df.repartition(4), "x", "y", "w", ["g"]).collect()}
    assert got[None].slope == 2 and got[None].intercept == 0
    assert got["a"].n == 1 and got["a"].total == 0 and got["a"].slope is None
    assert got["b"].slope is None and got["b"].n == 2 and got["c"].slope is None
    assert regression.weighted_line(df.limit(0), "x", "y", "w", ["g"]).count() == 0
    assert regression.weighted_line(df, "x", "y", "w", ["g"], least=2).count() == 3


def test_merge_is_the_state_of_both():
    rng = np.random.default_rng(4)
    v, w = 1e12 + rng.normal(0, 1, (60, 3)), rng.random(60)
    one = lambda a: tuple(x[0] for x in regression.group_states(v[a], w[a], np.zeros(len(v[a]), int), 1))
    whole, parts = one(slice(None)), regression.merged_states(one(slice(0, 20)), one(slice(20, None)))
    for a, b in zip(whole, parts, strict=True):
        assert np.allclose(a, b, rtol=1e-3 if a is whole[3] else 1e-12)
