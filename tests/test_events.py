"""Event-engine operators on hand-made rows and against NumPy."""

import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccade import params, schema
from saccade.functions import geometry as G
from saccade.functions import pixels as P
from saccade.functions import random as R
from saccade.operators import asof, calibration, cloud, frames, histogram, intervals, ordered, regression, roi, simulate, spectrum, voxel
from saccade.plans import catalog, lens
from saccade.sources import frames as sources
from saccade.streaming import events as streams


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.mark.parametrize("partitions", [1, 7])
def test_intervals(spark, partitions):
    rows = [(t, x, 0, p) for t, x, p in [(5, 0, 1), (5, 0, 0), (9, 0, 1), (1, 1, 1), (4, 2, 1), (2, 2, 0), (104, 2, 1)]]
    events = spark.createDataFrame(rows, schema.EVENTS).repartition(partitions)
    assert sorted(values(intervals.intervals(events), "x", "t", "tau")) == [(0, 9, 4), (2, 4, 2), (2, 104, 100)]
    assert sorted(values(intervals.intervals(events, longest=100), "x", "tau")) == [(0, 4), (2, 2)]
    assert sorted(values(intervals.intervals(events, ("p", "x", "y")), "p", "x", "tau")) == [(1, 0, 4), (1, 2, 100)]
    assert values(intervals.intervals(events, least=4), "tau") == []


def test_luminance_intervals(spark):
    rows = [(1, 0, 0, 1, 10.0, 14.0, 5), (3, 0, 0, 1, 20.0, 20.0, 5), (4, 0, 0, 0, 1.0, 1.0, 5), (13, 0, 0, 1, 9.0, 9.0, 7)]
    events = spark.createDataFrame(rows, schema.EVENTS_WITH_LUMINANCE)
    assert values(intervals.luminance_intervals(events, 10), "tau", "lbar", "dl", "dt") == [(2, 12.0, 4.0, 5)]


def test_fits(spark):
    rng = np.random.default_rng(1)
    tau = rng.wald(3.0, 12.0, 20000)
    got = intervals.fit(spark.createDataFrame([(float(v),) for v in tau], "tau double")).first()
    assert got["mean"] == pytest.approx(3.0, rel=0.03) and got["shape"] == pytest.approx(12.0, rel=0.05)
    assert got["levy_scale"] == pytest.approx(len(tau) / (1 / tau).sum())
    same = intervals.fit(spark.createDataFrame([(4.0,), (4.0,)], "tau double")).first()
    assert same["shape"] is None and same["mu"] == 0.0 and same["sigma"] == 0.5
    assert intervals.fit(spark.createDataFrame([], "tau double")).first()["mu"] is None


@pytest.mark.parametrize("data", [[0.0, 100.0, 56.0, 58.0, 100.1, -1.0, 2.0, 99.999], [3.0] * 4, list(np.linspace(0, 100, 51)), []])
def test_histogram_like_numpy(spark, data):
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    want, edges = np.histogram(data, 50, (0.0, 100.0))
    got = sorted(values(histogram.histogram(df, "v", 50, 0.0, 100.0), "bin", "count", "left", "right"))
    assert [g[1] for g in got] == want.tolist()
    assert [g[2] for g in got] == pytest.approx(edges[:-1]) and [g[3] for g in got] == pytest.approx(edges[1:])


def test_valid_range_and_buckets(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, 4000), rng.normal(5, 2, 4000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    h, ex, ey = np.histogram2d(x, y, bins=10)
    i, j = np.where(h > 100)
    got = histogram.valid_range(df, "x", "y", 10, 100).first()
    assert tuple(got) == pytest.approx((ex[i].min(), ex[i + 1].max(), ey[j].min(), ey[j + 1].max()))
    none = histogram.valid_range(df, "x", "y", 10, 10**6).first()
    assert tuple(none) == pytest.approx((x.min(), x.max(), y.min(), y.max()))


def boxes(spark, times):
    return spark.createDataFrame([(t, float(t)) for t in times], "t long, v double")


@pytest.mark.parametrize("times", [[10, 20, 30, 45], [10], [5, 5, 9]])
def test_asof_like_searchsorted(spark, times):
    facts = [0, 5, 9, 10, 11, 20, 29, 30, 44, 45, 46, 1000]
    out = asof.asof_interpolated(spark.createDataFrame([(t,) for t in facts], "t long"), boxes(spark, times))
    unique = np.unique(times)
    want = set()
    for t in facts:
        i = int(np.searchsorted(unique, t, "right"))
        a, b = unique[max(i - 1, 0)], unique[min(i, len(unique) - 1)]
        want.add((t, a, b, (t - a) / (b - a) if 0 < i < len(unique) else 0.0))
    assert set(values(out.select("t", F.col("prev.t").alias("a"), F.col("next.t").alias("b"), "alpha"), "t", "a", "b", "alpha")) == want
    bracket = asof.asof_bracket(spark.createDataFrame([(t,) for t in facts], "t long"), boxes(spark, times))
    left = set()
    for t in facts if len(unique) > 1 else []:
        i = int(np.clip(np.searchsorted(unique, t, "left"), 1, len(unique) - 1))
        left.add((t, unique[i - 1], unique[i]))
    assert set(values(bracket.select("t", F.col("prev.t").alias("a"), F.col("next.t").alias("b")), "t", "a", "b")) == left


def test_asof_keys_and_union(spark):
    rng = random.Random(1)
    facts = [("ab"[rng.randrange(2)], rng.randrange(100)) for _ in range(80)]
    dim = [("ab"[rng.randrange(2)], rng.randrange(100)) for _ in range(30)]
    f, d = spark.createDataFrame(facts, "k string, t long"), spark.createDataFrame([(k, t, float(t)) for k, t in dim], "k string, t long, v double")
    want = sorted((k, t, max((u for j, u in dim if j == k and u <= t), default=None)) for k, t in facts)
    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2])
    got = asof.asof_union(f, d, ["k"]).select("k", "t", F.col("prev.t").alias("u"))
    assert sorted(values(got, "k", "t", "u"), key=key) == sorted(want, key=key)
    assert asof.asof_interpolated(f, d, ["k"]).count() == len(facts)
    none = d.limit(0)
    assert asof.asof_interpolated(f, none, ["k"]).count() == 0
    assert asof.asof_interpolated(f, none, ["k"], how="left").where("prev is null").count() == len(facts)


def test_clock_offset(spark):
    real, other = [0, 10, 10, 30, 60], [100, 115, 120, 141, 170]
    got = asof.clock_offset(spark.createDataFrame([(t,) for t in real], "t long"), spark.createDataFrame([(t,) for t in other], "t long")).first()
    assert tuple(got) == (4, 29 / 30, 111)


def test_angles_and_points(spark):
    row = spark.range(1)
    lit = lambda v: F.lit(float(v))
    for a, b, want in [(350, 10, 360), (10, 350, 0), (-170, 170, -180), (0, 180, -90)]:
        assert row.select(G.blend_angle(lit(a), lit(b), lit(0.5)).alias("v")).first().v == pytest.approx(want)
    square = [(lit(x), lit(y)) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))]
    inside = lambda x, y, q=square: row.select(G.in_quad((lit(x), lit(y)), q).alias("v")).first().v
    assert inside(0, 0) and inside(10, 5) and inside(5, 5, square[::-1]) and not inside(10.1, 5) and not inside(-1, -1)
    x, y = G.canonical((lit(5.2), lit(5.7)), (lit(5), lit(5)), lit(0), 4)
    assert tuple(row.select(x.alias("a"), y.alias("b")).first()) == (2, 2)
    far = G.canonical((lit(50), lit(-50)), (lit(5), lit(5)), lit(0), 4)
    assert tuple(row.select(far[0].alias("a"), far[1].alias("b")).first()) == (3, 0)
    flat = [(lit(1), lit(1))] * 4
    assert row.select(G.rescale(flat, (lit(2), lit(2)), 5)[0][0].alias("v")).first().v == 2.0
    region = G.tag_region([(lit(0), lit(10)), (lit(28.7), lit(10)), (lit(28.7), lit(-18.7)), (lit(0), lit(-18.7))])
    got = row.select(*[region[i][k].alias(f"c{i}{k}") for i in range(4) for k in range(2)]).first()
    assert tuple(got) == pytest.approx((-94.3, 10, -8.2, 10, -8.2, -76.1, -94.3, -76.1))
    assert row.select(G.tag_region([(lit(1), lit(1))] * 4)[0][0].alias("v")).first().v is None


def rotated_box(t, angle, cx=50.0, cy=50.0, half=20.0):
    a = math.radians(angle)
    return (t, [(cx + dx * math.cos(a) - dy * math.sin(a), cy + dx * math.sin(a) + dy * math.cos(a)) for dx, dy in ((-half, half), (half, half), (half, -half), (-half, -half))], float(angle), (cx, cy))


def test_roi_filter(spark):
    rows = spark.createDataFrame([rotated_box(0, 30), rotated_box(1000, 30), (2000, None, None, None)], schema.BOXES)
    rng = random.Random(8)
    events = [(rng.randrange(0, 1000), rng.randrange(100), rng.randrange(100), 1) for _ in range(500)]
    got = roi.filter_events(spark.createDataFrame(events, schema.EVENTS), rows, size=40)
    want = []
    for t, x, y, p in events:
        a = math.radians(-30)
        u = (x - 50) * math.cos(a) - (y - 50) * math.sin(a)
        v = (x - 50) * math.sin(a) + (y - 50) * math.cos(a)
        if abs(u) <= 20 + 1e-9 and abs(v) <= 20 + 1e-9:
            want.append((t, int(min(39, max(0, math.floor(u + 20)))), int(min(39, max(0, math.floor(v + 20)))), p))
    assert sorted(values(got, "t", "x", "y", "p")) == sorted(want)
    twice = roi.filter_events(spark.createDataFrame(events, schema.EVENTS), rows, size=40, double_rotation=True)
    assert twice.count() != len(want)
    assert roi.filter_events(spark.createDataFrame(events, schema.EVENTS), rows.limit(0)).count() == 0
    assert roi.target_size(rows).first().size == 60


def test_naive_events(spark):
    lum = {0: [0, 0, 0, 0], 1: [20, 21, -20, -21], 2: [40000, 21, 0, 0], 4: [0, 0, 0, 0]}
    pixels = spark.createDataFrame([(f, f * 10, x, 0, float(v)) for f, row in lum.items() for x, v in enumerate(row)], schema.PIXELS)
    got = sorted(values(frames.naive_events(pixels, 20), "t", "x", "p"))
    assert got == [(10, 1, 1), (10, 3, 0), (20, 0, 1), (20, 3, 1)]
    stats = {r.frame_idx: r for r in frames.frame_statistics(pixels, 255.0).collect()}
    assert stats[1]["mean"] == 0 and stats[1]["variance"] == pytest.approx(np.var(lum[1]) / 255**2) and stats[4]["range"] == 0
    drawn = frames.event_map(spark.createDataFrame([(1, 0, 0, 1), (1, 0, 0, 0), (2, 1, 0, 0), (3, 1, 0, 1)], schema.EVENTS))
    assert sorted(values(drawn, "x", "value")) == [(0, -1), (1, 1)]


def test_voxel_grid(spark):
    rows = [(0, 1, 2, 1), (5, 1, 2, 0), (10, 0, 0, 1), (7, 3, 1, 1)]
    got = {(b, y, x): v for b, y, x, v in values(voxel.voxel_grid(spark.createDataFrame(rows, schema.EVENTS), 5), "bin", "y", "x", "val")}
    want = np.zeros((6, 3, 4))
    for t, x, y, p in rows:
        tau = 4 * t / 10
        i, s = int(tau), 1 if p else -1
        want[i, y, x] += s * (1 - tau + i)
        want[i + 1, y, x] += s * (tau - i)
    for b in range(5):
        for y in range(3):
            for x in range(4):
                assert got.get((b, y, x), 0.0) == pytest.approx(want[b, y, x])
    assert voxel.voxel_grid(spark.createDataFrame([(3, 0, 0, 1)], schema.EVENTS), 4).where("val <> 0").count() == 1


def test_spectrum(spark):
    rng = np.random.default_rng(3)
    t = np.sort(np.concatenate([rng.integers(0, 2_000_000, 3000), np.repeat(np.arange(0, 2_000_000, 50_000), 50), [0, 2_000_000]]))
    events = spark.createDataFrame([(int(v), 0, 0, 1) for v in t], schema.EVENTS)
    counts, _ = np.histogram(t, 2000, (t.min(), t.max()))
    want = np.abs(np.fft.rfft(counts / (2.0 / 2000))) * 2 / 2000
    want[0] /= 2
    got = sorted(values(spectrum.spectrum(events, 1000, 100), "k", "magnitude", "hz"))
    assert [g[1] for g in got] == pytest.approx(want[: len(got)].tolist()) and got[-1][2] == pytest.approx(100)
    best = int(np.argmax(want[1 : len(got)])) + 1
    assert spectrum.spectrum_statistics(spectrum.spectrum(events)).first().dominant_hz == pytest.approx(got[best][2])
    small = sorted(values(spectrum.rate_dft(events, 16), "k", "magnitude"))
    counts, _ = np.histogram(t, 16, (t.min(), t.max()))
    want = np.abs(np.fft.rfft(counts / (2.0 / 16))) * 2 / 16
    want[0] /= 2
    assert [g[1] for g in small] == pytest.approx(want.tolist())
    assert spectrum.spectrum(events.limit(9)).count() == 0


@pytest.mark.parametrize(("n", "block", "longest"), [(1024, 64, 1 << 20), (900, 7, 1 << 20), (1013, 1 << 18, 1 << 20), (1013, 64, 100), (2 * 509, 50, 100)])
def test_dft_of_any_length_in_blocks(spark, monkeypatch, n, block, longest):
    monkeypatch.setattr(spectrum, "BLOCK", block)
    monkeypatch.setattr(spectrum, "LONGEST", longest)
    rng = np.random.default_rng(n)
    held = rng.random(n) < 0.4
    x = np.where(held, rng.normal(size=n) + 1j * rng.normal(size=n), 0)
    series = spark.createDataFrame([(int(j), float(x[j].real), float(x[j].imag)) for j in np.flatnonzero(held)], "j long, re double, im double")
    got = {r.k: complex(r.re, r.im) for r in spectrum.dft(series, n).collect()}
    assert set(got) <= set(range(n))
    assert np.allclose([got.get(k, 0) for k in range(n)], np.fft.fft(x), atol=1e-9)


def test_spectrum_transforms_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(spectrum, "BLOCK", 256)
    events = spark.createDataFrame([(int(v), 0, 0, 1) for v in np.random.default_rng(4).integers(0, 4_000_000, 5000)], schema.EVENTS)
    lines = spectrum.spectrum(events)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 2 and "SinglePartition" not in plan and "Coalesce" not in plan
    assert lines.where("k = 0").first().magnitude == pytest.approx(1250, rel=0.01)


def test_regression_and_recovery(spark):
    rng = np.random.default_rng(5)
    x, w = rng.normal(0, 3, 50), rng.integers(1, 9, 50)
    y = 2 * x - 1 + rng.normal(0, 0.1, 50)
    a, b = np.polyfit(x, y, 1, w=np.sqrt(w))
    rows = spark.createDataFrame([("g", float(p), float(q), int(r)) for p, q, r in zip(x, y, w)] + [("c", 1.0, 2.0, 1), ("c", 1.0, 3.0, 1)], "g string, x double, y double, w long")
    got = {r.g: r for r in regression.weighted_line(rows, "x", "y", "w", ["g"]).collect()}
    assert got["g"].slope == pytest.approx(a) and got["g"].intercept == pytest.approx(b) and got["c"].slope is None
    constants = {r.p: r for r in calibration.sensor_constants(calibration.synthetic_fits(spark, 20, noise=False)).collect()}
    for p in (0, 1):
        r = constants[p]
        assert (r.k1, r.k2, r.k1_check) == pytest.approx((5.0, 20.0, 5.0), rel=1e-6)
        assert (r.k4, r.k5) == pytest.approx((1e-7, 5e-9), rel=1e-3)


def test_calibration_driver(spark):
    rng = np.random.default_rng(6)
    rows, t = [], 0
    for i in range(3000):
        t += int(rng.wald(100, 400)) + 1
        rows.append((t, 0, 0, i % 2, float(rng.integers(0, 100)), float(rng.integers(0, 100)), 16667))
    fits = calibration.calibrate(spark.createDataFrame(rows, schema.EVENTS_WITH_LUMINANCE), 10_000, bins=3, least=20).collect()
    assert fits and all(r["count"] >= 20 and (r.mu < 0) == (r.p == 1) for r in fits)


def test_luminance_attachment(spark):
    pixels = spark.createDataFrame([(f, f * 100, x, 0, float(10 * f + x)) for f in range(3) for x in range(2)], schema.PIXELS)
    events = spark.createDataFrame([(0, 0, 0, 1), (100, 1, 0, 1), (101, 0, 0, 0), (999, 1, 0, 1), (50, 7, 7, 1)], schema.EVENTS)
    got = sorted(values(calibration.attach_luminance(events, pixels), "t", "x", "prev_lum", "next_lum", "frame_dt"))
    assert got == [(0, 0, 0.0, 10.0, 100), (100, 1, 1.0, 11.0, 100), (101, 0, 10.0, 20.0, 100), (999, 1, 11.0, 21.0, 100)]


def test_normal_functions(spark):
    z = [-7.0, -3.0, -0.5, 0.0, 1.0, 2.5, 5.0]
    df = spark.createDataFrame([(v,) for v in z], "z double").select("z", P.normal_cdf(F.col("z")).alias("c"))
    assert all(r.c == pytest.approx(float(R.normal_cdf(np.array([r.z]))[0]), abs=1e-9) for r in df.collect())
    p = np.array([1e-6, 0.1, 0.5, 0.9])
    assert R.normal_cdf(R.normal_quantile(p)) == pytest.approx(p)


def test_first_barrier(spark):
    cases = [(0.5, 1.0, 0.2), (-0.5, 1.0, 0.2), (0.0, 1.0, 0.5), (1e4, 0.01, -0.9), (-1e4, 0.01, 0.9)]
    df = spark.createDataFrame(cases, "mu double, s double, r double")
    got = df.select(P.first_barrier_probability(F.col("mu"), F.col("s"), F.col("r")).alias("p")).collect()
    mu, s, r = (np.array(c) for c in zip(*cases))
    kernel = simulate.on_probability(mu, s, r)
    assert [g.p for g in got] == pytest.approx(kernel.tolist())
    k = 2 * 0.5
    assert kernel[0] == pytest.approx((math.exp(k * 1.2) - 1) / (math.exp(k * 1.2) - math.exp(-k * 0.8)))
    assert kernel[2] == 0.75 and kernel[3] == pytest.approx(1) and kernel[4] == pytest.approx(0)
    assert simulate.on_probability(mu, s, r, True)[2] == 0.5


def test_first_barrier_is_its_formula_to_the_last_bit(spark):
    rows = [(i, (-1) ** i * (1 + i * 0.618 % 1) / 1000, (i % 16 - 8) / 16) for i in range(20_000)]
    df = spark.createDataFrame(rows, "i int, mu double, r double")
    got = {g.i: g.p for g in df.select("i", P.first_barrier_probability(F.col("mu"), F.lit(1.0), F.col("r")).alias("p")).collect()}

    def formula(mu, r):
        k, a, b = 2 * mu, 1 - r, 1 + r
        return (1 - math.exp(-k * b)) / (1 - math.exp(-k * 2)) if mu > 0 else (math.exp(k * a) - math.exp(k * 2)) / (1 - math.exp(k * 2))

    assert got == {i: formula(mu, r) for i, mu, r in rows}
    odd = spark.createDataFrame([(None, 0.5), (math.nan, 0.5), (math.inf, 0.5)], "mu double, r double")
    null, nan, ever = (g.p for g in odd.select(P.first_barrier_probability(F.col("mu"), F.lit(1.0), F.col("r")).alias("p")).collect())
    assert null == 0.75 and math.isnan(nan) and ever == 1.0


def test_samplers():
    keys = R.keys(1, np.arange(200_000))
    ig = R.first_passage(np.ones(200_000), np.full(200_000, 0.5), np.full(200_000, 0.7), keys, 0)
    assert ig.mean() == pytest.approx(2.0, rel=0.02)
    lv = R.first_passage(np.ones(200_000), np.zeros(200_000), np.ones(200_000), keys, 0)
    assert np.median(lv) == pytest.approx(2.198, rel=0.02)
    away = {s: np.median(R.first_passage(np.ones(200_000), np.full(200_000, -0.3), np.ones(200_000), keys, 0, s)) for s in ("reference", "exact")}
    assert away["reference"] == pytest.approx(0.645, rel=0.03) and away["exact"] == pytest.approx(1.301, rel=0.03)


def clip(spark, levels, size=40):
    return spark.createDataFrame([(f, f * 8333, x, y, float(v + x)) for f, v in enumerate(levels) for x in range(size) for y in range(3)], schema.PIXELS)


def test_simulator(spark):
    up = simulate.dvs_events(clip(spark, [50, 150, 150]), "DVS346", seed=3)
    rows = sorted(values(up, "t", "x", "y", "p"))
    assert rows and all(0 < t <= 2 * 8333 for t, *_ in rows) and all(p == 1 for t, _, _, p in rows if t < 8333)
    again = simulate.dvs_events(clip(spark, [50, 150, 150]).repartition(5), "DVS346", seed=3)
    assert sorted(values(again, "t", "x", "y", "p")) == rows
    assert simulate.dvs_events(clip(spark, [50, 50]), "DVS346").count() == 0
    assert simulate.dvs_events(clip(spark, [150, 50]), "DVS346").where("p = 1").count() == 0
    assert simulate.dvs_events(clip(spark, [50, 150, 150]), "DVS346", skip_first_frame=True).count() <= len(rows)
    with pytest.raises(ValueError):
        simulate.step(simulate.State(np.zeros(1), 5, np.zeros(1)), np.zeros(1), 5, np.zeros(1), np.zeros(1), 0, 1, simulate.Options(params.preset("DVS346")))
    with pytest.raises(KeyError):
        params.preset("none")


def test_stream_equals_batch(spark, tmp_path):
    pixels = clip(spark, [50, 150, 20, 90], 35)
    for f in range(4):
        pixels.where(F.col("frame_idx") == f).coalesce(1).write.parquet(str(tmp_path / f"in/f{f}"))
    want = sorted(values(simulate.dvs_events(pixels, "DVS346", seed=2), "t", "x", "y", "p"))
    stream = spark.readStream.schema(schema.PIXELS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = streams.simulated_stream(stream, "DVS346", seed=2).writeStream.format("memory").queryName("sim").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(values(spark.table("sim"), "t", "x", "y", "p")) == want


def test_stream_window_and_cutoff(spark, tmp_path):
    rows = [(1, 0, 0, 1), (1, 0, 0, 1), (40_000, 0, 0, 0), (70_000, 1, 0, 1), (5, 1, 0, 1)]
    events = spark.createDataFrame(rows, schema.EVENTS)
    assert sorted(values(streams.tumbling_counts(events), "start_us", "events", "on_events")) == [(0, 3, 3), (33000, 1, 0), (66000, 1, 1)]
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = streams.event_stream(spark, str(tmp_path / "e"), schema.EVENTS)
    q = streams.only_later(stream, "x, y").writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(values(spark.table("late"), "t", "x")) == [(1, 0), (5, 1), (40_000, 0), (70_000, 1)]


def test_accumulator(spark):
    rows = [(0, 0, 0, 1), (100_000, 0, 0, 1), (0, 1, 0, 0), *[(i, 2, 0, 1) for i in range(9)]]
    got = {x: v for x, v in values(streams.accumulate(spark.createDataFrame(rows, schema.EVENTS)), "x", "level")}
    assert got[0] == pytest.approx(0.9) and got[1] == 0.25 and got[2] == 1.0
    later = {x: v for x, v in values(streams.accumulate(spark.createDataFrame(rows, schema.EVENTS), until=10**7), "x", "level")}
    assert set(later.values()) == {0.5}


def test_distance_and_search(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, b = rng.random((60, 3)), rng.random((50, 3))
    wa, wb = np.full(60, 1 / 60), np.full(50, 1 / 50)
    d = cloud.sinkhorn_divergence
    assert abs(d(a, wa, a, wa)) < 1e-9
    assert d(a, wa, b, wb) == pytest.approx(d(b, wb, a, wa), rel=1e-6)
    assert d(a, wa, a + 0.5, wa) > d(a, wa, a + 0.1, wa) > 0
    assert d(a, wa, b[:0], wb[:0]) == math.inf
    events = spark.createDataFrame([(int(t * 1000), int(x * 50), int(y * 50), 1) for t, x, y in a], schema.EVENTS)
    assert abs(cloud.cloud_distance(events, events)) < 1e-9
    assert cloud.cloud_distance(events, events, most=10) == math.inf
    calls = []
    score = lambda s: calls.append(s) or s.k1
    store = str(tmp_path / "trials")
    cloud.search(spark, score, 3, store)
    best = cloud.search(spark, score, 5, store).collect()
    assert len(calls) == 5 and len(best) == 5 and best[0].distance == min(s.k1 for s in calls)


def test_frame_sources(spark, tmp_path):
    stack = np.arange(3 * 4 * 5, dtype="<u2").reshape(3, 4, 5)
    (tmp_path / "raw.dat").write_bytes(stack.tobytes() + b"\x01\x02\x03")
    np.save(tmp_path / "raw.npy", stack)
    for name in ("raw.dat", "raw.npy"):
        rows = sources.pixel_rows(sources.read_frames(spark, str(tmp_path / name), 4, 5)).collect()
        assert len(rows) == 60 and all(r.lum == stack[r.frame_idx, r.y, r.x] for r in rows)
    rgba = np.random.default_rng(1).integers(0, 255, (2, 4, 5, 4)).astype(np.uint8)
    (tmp_path / "rgb.dat").write_bytes(rgba.tobytes())
    rows = sources.pixel_rows(sources.read_frames(spark, str(tmp_path / "rgb.dat"), 4, 5, 4), 4).collect()
    assert all((r.c0, r.c1, r.c2, r.c3) == tuple(rgba[r.frame_idx, r.y, r.x]) for r in rows)


def test_metadata_sources(spark, tmp_path):
    kind = np.dtype([("s", "<f8"), ("r", "S30")])
    np.array([(1.9, b"2024-01-01 00:00:01.000002"), (2.5, b"")], kind).tofile(tmp_path / "m.dat")
    rows = sources.read_metadata(spark, str(tmp_path / "m.dat")).orderBy("frame_idx").collect()
    assert [(r.sensor_ts, r.real_us) for r in rows] == [(1.9, 1704067201000002), (2.5, None)]
    np.array([1.0, 7.0]).tofile(tmp_path / "o.dat")
    assert [r.t for r in sources.timestamps(sources.read_metadata(spark, str(tmp_path / "o.dat"), "sensor_only")).collect()] == [1, 7]
    (tmp_path / "m.csv").write_text("timestamp,SensorTimestamp\n5,9.9\n")
    assert sources.timestamps(sources.read_metadata(spark, str(tmp_path / "m.csv"))).first().t == 9
    with pytest.raises(ValueError):
        sources.read_metadata(spark, "x.bin")


def test_event_text_and_sessions(spark, tmp_path):
    rows = [(5, 1, 2, 1), (-3, 0, 0, 0), (2, 1, 1, 0)]
    events = spark.createDataFrame(rows, schema.EVENTS)
    sources.write_event_text(events, str(tmp_path / "e.txt"))
    part = next(p for p in os.listdir(tmp_path / "e.txt") if p.startswith("part"))
    assert (tmp_path / "e.txt" / part).read_text() == "-3 0 0 0\n2 1 1 0\n5 1 2 1\n"
    assert sorted(values(sources.read_events(spark, str(tmp_path / "e.txt")), "t", "x", "y", "p")) == sorted(rows)
    prepared, width, height = sources.prepare_recording(events)
    assert [r.t for r in prepared.collect()] == [2, 5] and (width, height) == (2, 3)
    with pytest.raises(ValueError):
        sources.prepare_recording(events.where("t < 0"))
    for n in ("dv_output_7.aedat4", "metadata_7.dat", "rgb_frames_7.dat"):
        (tmp_path / n).write_text("")
    with pytest.raises(FileNotFoundError):
        sources.session_files(spark, str(tmp_path), "_7")
    (tmp_path / "raw_frames_7.dat").write_text("")
    assert sources.session_files(spark, str(tmp_path), "_7").count() == 4


def test_tags_and_detector(spark):
    frames_ = spark.createDataFrame([(0, 1, 2, b"\x01\x00\x02\x00"), (1, 1, 2, b"\x00\x00\x00\x00")], "t long, height int, width int, px binary")
    found = sources.detect(frames_, lambda image: [(0, [(0, 10), (28.7, 10), (28.7, -18.7), (0, -18.7)])] if image.max() else [])
    got = {r.t: r for r in roi.boxes_from_tags(found).collect()}
    assert got[1].polygon is None and got[0].angle == pytest.approx(0.0) and got[0].center.y == pytest.approx(-33.05)


def test_schema_check(spark):
    with pytest.raises(ValueError):
        schema.require(spark.range(1), "id", "t")


def test_pixel_functions_of_every_event(spark, tmp_path):
    rng = random.Random(4)
    rows = [(lens.ORIGIN + rng.randrange(31 * lens.DAY), rng.randrange(160), rng.random() * 1100) for _ in range(500)]
    rows += [(lens.ORIGIN, 0, 0.0), (lens.ORIGIN + 999, 1, 1023.0), (lens.ORIGIN + 1501, 2, 500.5), (lens.ORIGIN + 2000, 3, 65.0)]
    events = spark.createDataFrame(rows, "us long, user_id long, value double")
    events.select(F.timestamp_micros("us").alias("ts"), "user_id", F.lit("click").alias("event_type"), "value").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["pixel_functions"](spark, str(tmp_path))
    want = []
    for t, user, value in rows:
        v = int(value)
        luma = 299 * v + 587 * (v % 256) + 114 * (v % 7)
        want.append((t, user % 16, user // 16, v * 255 // 1023, v >> 6 & 1023, (luma + 500) // 1000, (t - lens.ORIGIN) // 1000))
    assert sorted(values(got, "t", "x", "y", "eight", "bits", "gray", "us")) == sorted(want)


def test_simulator_draws_until_no_event_is_left(spark):
    sensor = params.Sensor(100, 1e-7, 1e-7, 1e-8, 1e-13, 1e-7)
    rows = [(f, f * 8333, x, 0, v) for f, v in enumerate([0.0, 200.0, 0.0]) for x in range(2)]
    got = simulate.dvs_events(spark.createDataFrame(rows, schema.PIXELS), sensor).collect()
    for x in range(2):
        ups, downs = ([r.t for r in got if r.x == x and r.p == p] for p in (1, 0))
        assert 198 <= len(ups) <= 201 and 198 <= len(downs) <= 201
        assert max(ups) <= 8333 < min(downs) and max(ups) > 8333 - 100 and max(downs) > 2 * 8333 - 100
    apart = simulate.step(simulate.State(np.full(1, 100.0), 0, np.zeros(1)), np.full(1, 100.0), 10**9, np.zeros(1, int), np.zeros(1, int), 0, 1, simulate.Options(params.preset("DVS240")))
    assert 5000 <= len(apart[1]) <= 5200


def test_simulator_names_pixels_it_cannot_finish():
    state, o = simulate.State(np.zeros(2), 10**15, np.zeros(2)), simulate.Options(params.Sensor(1e9, 1e-7, 1e-4, 1e-7, 1e-9, 1e-4))
    with pytest.raises(ValueError, match=r"frame 7.*\[\(5, 6\)\]"):
        simulate.step(state, np.array([0.0, 100.0]), 10**15 + 8333, np.array([4, 5]), np.array([6, 6]), 0, 7, o)


def test_asof_over_a_long_gap(spark):
    times = [i * 8333 for i in range(50)] + [3 * 10**13 + i * 8333 for i in range(50)]
    facts = [5, 8333 * 20 + 1, 10**12, 3 * 10**13 - 1, 3 * 10**13 + 8333 * 7 + 4]
    f, d = spark.createDataFrame([(t,) for t in facts], "t long"), boxes(spark, times)
    got = {r.t: (r.prev.t, r.next.t) for r in asof.asof_interpolated(f, d).collect()}
    want = {t: (max(x for x in times if x <= t), min(x for x in times if x > t)) for t in facts}
    assert got == want
    assert {r.t: (r.prev.t, r.next.t) for r in asof.asof_bracket(f, d).collect()} == want
    assert {r.t: (r.prev.t, r.next.t) for r in asof.asof_left(f, d).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_asof_of_uneven_rows(spark, seed):
    rng = random.Random(seed)
    dim = [(k, int(10 ** rng.uniform(0, 9)), 1.0) for k in "ab" for _ in range(60)]
    facts = [(rng.choice("abc"), int(10 ** rng.uniform(0, 9.3))) for _ in range(300)] + [("a", None)]
    f, d = spark.createDataFrame(facts, "k string, t long"), spark.createDataFrame(dim, "k string, t long, v double")
    times = {k: sorted({t for j, t, _ in dim if j == k}) for k in "ab"}
    want = []
    for k, t in facts:
        if k in times and t is not None:
            i = int(np.searchsorted(times[k], t, "right"))
            want.append((k, t, times[k][max(i - 1, 0)], times[k][min(i, len(times[k]) - 1)]))
    got = asof.asof_interpolated(f, d, ["k"], how="left").select("k", "t", F.col("prev.t").alias("a"), F.col("next.t").alias("b")).collect()
    assert sorted(tuple(r) for r in got if r.a is not None) == sorted(want)
    assert len(got) == len(facts)


def test_order_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "WINDOW_ROWS", 40)
    rng = random.Random(2)
    values_ = rng.sample(range(10**6), 300)
    df = spark.createDataFrame([(v, v % 3) for v in values_], "t long, k long")
    ranked = sorted(values_)
    assert {r.t: r.idx for r in ordered.numbered(df, "t").collect()} == {v: i + 1 for i, v in enumerate(ranked)}
    assert {(r.t, r.part) for r in ordered.strided(df, 7, "t").collect()} == {(v, i % 7) for i, v in enumerate(ranked)}
    for keys in ([], ["k"]):
        for r in ordered.neighbours(df, "t", keys).collect():
            own = ranked if not keys else [v for v in ranked if v % 3 == r.k]
            i = own.index(r.cur.t)
            assert (r.before.t if r.before else None, r.after.t if r.after else None) == (own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None)
    assert ordered.median(df, "t").first()[0] == pytest.approx(np.median(values_))
    assert {r.k: r["median"] for r in ordered.median(df, "t", ("k",)).collect()} == {k: pytest.approx(np.median([v for v in values_ if v % 3 == k])) for k in range(3)}


def test_subsample_and_union(spark):
    df = spark.range(100)
    some = {r.id for r in ordered.subsample(df, 10, 1).collect()}
    assert len(some) == 10 and some == {r.id for r in ordered.subsample(df.repartition(7), 10, 1).collect()} and some != {r.id for r in ordered.subsample(df, 10, 2).collect()}
    both = ordered.union_all([df, spark.createDataFrame([(5, "x")], "id long, s string")])
    assert both.count() == 101 and both.where("s is null").count() == 100


def test_either_box(spark):
    rows = spark.createDataFrame([rotated_box(0, 10), rotated_box(100, 190), (200, None, None, None), (300, None, None, None), rotated_box(400, 40)], schema.BOXES)
    events = spark.createDataFrame([(t, 0, 0, 1) for t in (-5, 0, 50, 100, 150, 250, 350, 400, 500)], schema.EVENTS)
    got = {r.t: r.angle for r in roi.with_either_box(events, rows).collect()}
    assert got == {-5: 10, 0: 10, 50: pytest.approx(100), 100: pytest.approx(190), 150: 190, 250: None, 350: 40, 400: 40, 500: 40}


def test_inverse_gaussian_functions(spark):
    from statistics import NormalDist

    cases = [(0.5, 1.0, 2.0), (2.0, 1.0, 2.0), (1.0, 0.01, 50.0), (1e-3, 1e-3, 900.0), (3.0, 2.0, 1e4), (5.0, 40.0, 0.1)]
    df = spark.createDataFrame(cases, "t double, m double, s double").select("t", "m", "s", P.inverse_gaussian_cdf(F.col("t"), F.col("m"), F.col("s")).alias("c"), P.inverse_gaussian_interval(F.col("t") / 2, F.col("t"), F.col("m"), F.col("s")).alias("i"))
    for r in df.collect():
        grid = np.linspace(1e-9, r.t, 400_001)
        pdf = np.sqrt(r.s / (2 * np.pi * grid**3)) * np.exp(-r.s * (grid - r.m) ** 2 / (2 * r.m**2 * grid))
        assert r.c == pytest.approx(np.trapezoid(pdf, grid), abs=2e-3) and 0 <= r.c <= 1
        half = grid >= r.t / 2
        assert r.i == pytest.approx(np.trapezoid(pdf[half], grid[half]), abs=2e-3)
    p = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.99999, 0.0, 1.0]
    got = spark.createDataFrame([(v,) for v in p], "p double").select(P.normal_quantile(F.col("p")).alias("z")).collect()
    assert [r.z for r in got[:6]] == pytest.approx([NormalDist().inv_cdf(v) for v in p[:6]], abs=1e-6) and got[6].z is None and got[7].z is None


def test_simulator_probes_in_batch_and_stream(spark, tmp_path):
    """Every event of a pixel is drawn: the counts do not stop at a number of draws."""
    bright = params.Sensor(100, 20, 1e-4, 1e-7, 5e-9, 1e-5)
    for name, sensor, frames_, least, most in (("step", bright, [(0, 0, 20.0), (1, 8333, 240.0)], 140, 200), ("gap", params.preset("DVS346"), [(0, 0, 100.0), (1, 600_000_000, 100.0)], 340, 380)):
        pixels = spark.createDataFrame([(i, t, 0, 0, v) for i, t, v in frames_], schema.PIXELS)
        batch = sorted(values(simulate.dvs_events(pixels, sensor), "t", "p"))
        assert least <= len(batch) <= most
        pixels.coalesce(1).write.parquet(str(tmp_path / name))
        q = streams.simulated_stream(streams.event_stream(spark, str(tmp_path / name), schema.PIXELS), sensor).writeStream.format("memory").queryName(f"probe_{name}").option("checkpointLocation", str(tmp_path / f"c_{name}")).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(values(spark.table(f"probe_{name}"), "t", "p")) == batch


def test_events_of_one_time_stay(spark, tmp_path):
    spark.createDataFrame([(4, 0, 0, 1), (4, 0, 0, 0), (4, 0, 0, 1), (2, 0, 0, 1)], schema.EVENTS).coalesce(1).write.parquet(str(tmp_path / "e"))
    q = streams.only_later(streams.event_stream(spark, str(tmp_path / "e"), schema.EVENTS), "x, y").writeStream.format("memory").queryName("same").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(values(spark.table("same"), "t", "p")) == [(2, 1), (4, 0), (4, 1)]


def test_accumulator_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(10**6), rng.randrange(3), 0, rng.randrange(2)) for _ in range(300)] + [(5, 9, 9, 1)]
    events = spark.createDataFrame(rows, schema.EVENTS)
    want = {(r.x, r.y): (r.level, r.t) for r in streams.accumulate(events, until=2 * 10**6).collect()}
    monkeypatch.setattr(streams, "PIECE", 30)
    assert {(r.x, r.y): (pytest.approx(r.level), r.t) for r in streams.accumulate(events, until=2 * 10**6).collect()} == want


def test_scan_names_broken_sessions(spark, tmp_path):
    good = spark.createDataFrame([(1, 0, 0, 1, 1.0, 2.0, 5), (2, 0, 0, 1, 1.0, 2.0, 5)], schema.EVENTS_WITH_LUMINANCE)
    good.coalesce(1).write.parquet(str(tmp_path / "s1"))
    (tmp_path / "s2").mkdir()
    (tmp_path / "s2" / "bad.parquet").write_bytes(b"not a table")
    spark.createDataFrame([(1,)], "t long").coalesce(1).write.parquet(str(tmp_path / "s3"))
    got = sources.scan_sessions(spark, str(tmp_path)).collect()
    assert sorted((r.session, r.t) for r in got if r.error is None) == [("s1", 1), ("s1", 2)]
    assert sorted(r.session for r in got if r.error) == ["s2", "s3"]

    def work(pdf):
        if pdf["n"].iloc[0] < 0:
            raise ValueError("negative")
        return pdf[["n"]] * 2

    done = {r.session: (r.n, r.error) for r in sources.by_session(spark.createDataFrame([("a", 1), ("b", -1)], "session string, n long"), work, "n long").collect()}
    assert done == {"a": (2, None), "b": (None, "ValueError: negative")}


def test_more_metadata_and_fits(spark, tmp_path):
    rows = np.array([(1.9, b"x"), (7.2, b"y")], np.dtype([("SensorTimestamp", "<f8"), ("RealTime", "S30")]))
    np.save(tmp_path / "m.npy", rows)
    got = sources.read_metadata(spark, str(tmp_path / "m.npy"))
    assert [(r.frame_idx, r.SensorTimestamp, r.RealTime) for r in got.orderBy("frame_idx").collect()] == [(0, 1.9, "x"), (1, 7.2, "y")]
    assert sorted(r.t for r in sources.timestamps(got).collect()) == [1, 7]
    np.save(tmp_path / "raw.npy", np.zeros((2, 3, 4)))
    with pytest.raises(Exception, match="float64"):
        sources.read_frames(spark, str(tmp_path / "raw.npy"), 3, 4).collect()
    (tmp_path / "fits.csv").write_text("P,MeanMin,MeanMax,DiffMin,DiffMax,Mu,Sigma,Count\n1,0.5,1.5,2,3,1e-5,0.1,300\n")
    r = sources.read_fits(spark, str(tmp_path / "fits.csv")).first()
    assert (r.p, r.mean_max, r.mu, r["count"], r.mu_hat) == (1, 1.5, 1e-5, 300, None)
    fits = calibration.synthetic_fits(spark, 3).select("*", F.lit(None).cast("double").alias("mu_hat"), F.lit(None).cast("double").alias("lambda_hat")).select(*schema.FITS.names)
    sources.write_table(fits, str(tmp_path / "own"), "csv")
    assert sorted(map(tuple, sources.read_fits(spark, str(tmp_path / "own")).select("p", "count", "mu").collect())) == sorted(map(tuple, fits.select("p", "count", "mu").collect()))


def test_recordings_through_a_stand_in(spark, tmp_path):
    """AEDAT4 readers against a module of the library's name: the format itself needs the library."""
    (tmp_path / "dv_processing.py").write_text(
        "import numpy as np\n"
        "class Frame:\n    def __init__(self, i): self.image = np.full((2, 3, 3) if i else (2, 3), 100 + i, np.uint8); self.timestamp = 10 * i\n"
        "class Batch:\n    def __init__(self, i): self.rows = np.array([(i, 1, 2, 1)], [('timestamp', 'i8'), ('x', 'i2'), ('y', 'i2'), ('polarity', 'i1')])\n"
        "    def numpy(self): return self.rows\n    def __len__(self): return len(self.rows)\n"
        "class MonoCameraRecording:\n    def __init__(self, path): self.e, self.f = iter(range(3)), iter(range(2))\n"
        "    def isEventStreamAvailable(self): return True\n    def isFrameStreamAvailable(self): return True\n"
        "    def getNextEventBatch(self): return next((Batch(i) for i in self.e), None)\n    def getNextFrame(self): return next((Frame(i) for i in self.f), None)\n"
        "class io: MonoCameraRecording = MonoCameraRecording\n"
    )
    (tmp_path / "a.aedat4").write_bytes(b"x")
    sys.path.insert(0, str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "dv_processing.py"))
    try:
        assert sorted(values(sources.read_events(spark, str(tmp_path / "a.aedat4")), "t", "x", "y", "p")) == [(0, 1, 2, 1), (1, 1, 2, 1), (2, 1, 2, 1)]
        got = sources.read_recorded_frames(spark, str(tmp_path / "a.aedat4")).orderBy("frame_idx").collect()
        assert [(r.frame_idx, r.t, r.height, r.width, set(r.px)) for r in got] == [(0, 0, 2, 3, {100}), (1, 10, 2, 3, {101})]
    finally:
        sys.path.remove(str(tmp_path))
        sys.modules.pop("dv_processing", None)


def test_recorder(spark, tmp_path):
    kind = "frame_idx int, sensor_ts double, height int, width int, px binary"
    rows = [(i, 1.5 * i, 1, 2, np.array([i, 1023], "<u2").tobytes()) for i in range(5)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sources.record(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), most=4, gray=True)
    q.processAllAvailable()
    q.stop()
    frames_ = spark.read.parquet(str(tmp_path / "out" / "frames")).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.px, r.gray) for r in frames_] == [(i, rows[i][4], bytes([i * 255 // 1023, 255])) for i in range(4)]
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "metadata")).where("FrameIndex = 3 and SensorTimestamp = 4.5").count() == 1


def test_rotated_crops(spark):
    image = np.arange(30 * 40, dtype="<u2").reshape(30, 40)
    square = [(10.0, 20.0), (20.0, 20.0), (20.0, 10.0), (10.0, 10.0)]
    kind = "t long, height int, width int, px binary, polygon array<struct<x:double,y:double>>, angle double, center struct<x:double,y:double>"
    rows = [(0, 30, 40, image.tobytes(), square, 0.0, (15.0, 15.0)), (1, 30, 40, image.tobytes(), square, 90.0, (15.0, 15.0)), (2, 30, 40, image.tobytes(), None, None, None)]
    got = {r.t: r for r in sources.rotated_crops(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {0, 1}
    assert (np.frombuffer(got[0].px, "<u2").reshape(got[0].height, got[0].width) == image[10:20, 10:20]).all()
    turned = np.frombuffer(got[1].px, "<u2").reshape(got[1].height, got[1].width)
    assert got[1].left == got[1].top == 10
    for y in range(got[1].height):
        for x in range(got[1].width):
            assert turned[y, x] == image[x + 10, 30 - (y + 10)]


def test_distance_of_large_clouds(spark, monkeypatch):
    rng = np.random.default_rng(0)
    a, b = rng.random((400, 3)), rng.random((300, 3)) ** 1.3
    events = [spark.createDataFrame([(int(t * 10**6), int(x * 1000), int(y * 1000), 1) for t, x, y in c], schema.EVENTS) for c in (a, b)]
    exact = cloud.cloud_distance(*events, blur=0.05, scaling=0.5)
    monkeypatch.setattr(cloud, "LOCAL_PAIRS", 1000)
    assert cloud.cloud_distance(*events, blur=0.05, scaling=0.5) == pytest.approx(exact, rel=1e-9)
    monkeypatch.setattr(cloud, "MOST_POINTS", 350)
    assert cloud.cloud_distance(*events, blur=0.05, scaling=0.5) == pytest.approx(exact, rel=0.05)
    near = [spark.createDataFrame([(0, 0, 0, 1), (10**6, 1000, 1000, 1), (int(5e5 + d), 500, 500, 1)], schema.EVENTS) for d in (0, 20_000)]
    assert cloud.cloud_distance(*near) > 1e-5


def test_simulated_distances(spark):
    pixels = clip(spark, [50, 150, 60, 150], 12)
    real = simulate.dvs_events(pixels, cloud.proposals(4, 3)[2], seed=3)
    rows = {r.trial: r for r in cloud.simulated_distances(pixels, real, 4, seed=3).collect()}
    assert set(rows) == set(range(4)) and abs(rows[2].distance) < 1e-6
    assert all(r.distance == math.inf if r.events == 0 else r.distance > -1e-6 for r in rows.values())


def test_trials_are_drawn_together_and_counted_in_their_tasks(spark):
    rows = [(f, f * 8333, x, y, 50.0 + 3 * x + (f * y) % 70) for f in range(9) for x in range(40) for y in range(3) if (f + x) % 5]
    pixels = spark.createDataFrame(rows, "frame_idx int, t long, x int, y int, lum double")
    sensors = cloud.proposals(11, 3)  # more than are stacked
    pdf = simulate.tiled(pixels, None, 60.0).where("_tx = 0").toPandas()
    got = [set() for _ in sensors[:5]]
    for own, t, x, y in simulate.simulate_trials(pdf, sensors[:5], 7, 60.0):
        for k, *event in zip(own.tolist(), t.tolist(), x.tolist(), y.tolist(), strict=True):
            got[k].add(tuple(event))
    want = [simulate.simulate_tile(pdf, simulate.Options(s, 7), 0, 60.0) for s in sensors[:5]]
    assert got == [set(zip(w.t, w.x, w.y, strict=True)) for w in want] and any(got)
    events = [simulate.dvs_events(pixels, s, seed=7, fill=60.0).toPandas() for s in sensors]
    spans = {r.trial: r for r in cloud._spans(simulate.tiled(pixels, None, 60.0), sensors, 7, 60.0).collect()}
    assert {k: (r.events, r.lo_t, r.hi_t, r.lo_x, r.hi_x, r.lo_y, r.hi_y) for k, r in spans.items()} == {
        k: (len(e), e.t.min(), e.t.max(), e.x.min(), e.x.max(), e.y.min(), e.y.max()) for k, e in enumerate(events) if len(e)
    }
    # trials above the bound are counted, and no event of theirs is drawn again
    most = sorted(len(e) for e in events)[5]
    found = {r.trial: r for r in cloud.simulated_distances(pixels, pixels, 11, seed=3, most=most, fill=60.0).collect()}
    again = {r.trial: r for r in cloud.simulated_distances(pixels, pixels, 11, seed=3, most=0, fill=60.0).collect()}
    assert all((r.distance == math.inf) == (not r.events or r.events > most) for r in found.values())
    assert all(r.distance == math.inf and r.events == found[k].events for k, r in again.items())


def test_trials_of_any_number_of_events_are_compared(spark):
    rows = [(f, f * 8333, x, y, 50.0 + 3 * x + (f * y) % 70) for f in range(9) for x in range(40) for y in range(3) if (f + x) % 5]
    pixels = spark.createDataFrame(rows, "frame_idx int, t long, x int, y int, lum double")
    real = simulate.dvs_events(pixels, "DVS346", seed=5, fill=60.0)
    found = {r.trial: r for r in cloud.simulated_distances(pixels, real, 5, seed=3, fill=60.0).collect()}
    there = cloud.points_of(cloud.quantized(cloud.normalized(real), 12))
    some = 0
    for k, sensor in enumerate(cloud.proposals(5, 3)):
        events = simulate.dvs_events(pixels, sensor, seed=3, fill=60.0)
        want = cloud.sinkhorn_divergence(*cloud.points_of(cloud.quantized(cloud.normalized(events), 12)), *there, blur=0.05)
        assert found[k].distance == pytest.approx(want, rel=1e-9)
        some += found[k].events > 0
    assert some > 1
    # more than the 5,000,000 events that were the bound
    fixed = {"k1": (1500.0, 1500.0), "k2": (1e-7, 1e-7), "k3": (1e-8, 1e-8), "k4": (1e-8, 1e-8), "k5": (1e-13, 1e-13), "k6": (1e-3, 1e-3)}
    (many,) = cloud.simulated_distances(clip(spark, [10, 110] * 3, 700), real, 1, ranges=fixed).collect()
    assert many.events > 5_000_000 and 0 < many.distance < 1
    long = spark.range(5_000_001).select(F.col("id").alias("t"), (F.col("id") % 7).cast("int").alias("x"), (F.col("id") % 5).cast("int").alias("y"))
    assert 0 <= cloud.cloud_distance(long, long.where("t % 2 = 0"), blur=0.2, scaling=0.5, points=100) < 0.1


def test_simulator_against_a_plain_recursion(spark):
    """One pixel after the other, event by event, with the same random numbers."""
    o = simulate.Options(params.preset("DVS346"), 7)
    levels = [50.0, 150.0, 20.0, 90.0, 90.0]
    pixels = [(f, f * 8333, x, y, v + 3 * x + y) for f, v in enumerate(levels) for x in range(33) for y in range(2) if (f + x) % 6]
    filled = {(f, x, y): v for f, _, x, y, v in pixels}
    want = []
    for x in range(33):
        for y in range(2):
            residual, before = 0.0, None
            for f in range(len(levels)):
                lum, t = filled.get((f, x, y), 60.0), float(f * 8333)
                if before is not None:
                    last, now = before
                    mean, k = (lum + last) / 2, o.sensor
                    mu = k.k1 * (lum - last) / (t - now) / (mean + k.k2) + k.k4 + k.k5 * mean
                    sigma = k.k3 * math.sqrt(mean) / (mean + k.k2) + k.k6
                    key, draw = R.keys(o.seed, 0, np.array([x]), np.array([y]), f), 0
                    while True:
                        one = lambda v: np.array([v])
                        on = R.uniform(key, 8 * draw)[0] <= simulate.on_probability(one(mu), one(sigma), one(residual))[0]
                        distance = max(1 - residual if on else 1 + residual, 1e-12)
                        wait = R.first_passage(one(distance), one(mu if on else -mu), one(sigma), key, 8 * draw + 1)[0]
                        if now + wait >= t:
                            residual = min(1.0, max(-1.0, residual + (distance if on else -distance) * (t - now) / wait))
                            break
                        now, residual, draw = now + wait, 0.0, draw + 1
                        want.append((round(now), x, y, int(on)))
                before = (lum, t)
    got = simulate.dvs_events(spark.createDataFrame(pixels, schema.PIXELS), "DVS346", seed=7, fill=60.0)
    assert len(want) > 100 and sorted(values(got, "t", "x", "y", "p")) == sorted(want)
