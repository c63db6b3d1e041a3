"""Point clouds of events: normalization, Sinkhorn divergence, parameter search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Sensor
from ..storage import written
from . import simulate


def normalized(df: DataFrame, columns: tuple[str, ...] = ("t", "x", "y")) -> DataFrame:
    """df with the columns scaled to [0, 1]; a constant column becomes 0. One row of bounds is joined."""
    bounds = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    joined = df.crossJoin(F.broadcast(bounds))
    scaled = {c: F.coalesce((F.col(c) - F.col(f"_lo_{c}")) / F.nullif((F.col(f"_hi_{c}") - F.col(f"_lo_{c}")).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    return joined.withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def within_time_of(events: DataFrame, other: DataFrame) -> DataFrame:
    """events between the first and last time of other, both included."""
    bounds = other.agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    return events.join(F.broadcast(bounds), F.col("t").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


#: Points of a cloud that a distance works on at most; clouds with more distinct points are counted in cells.
MOST_POINTS = 20_000
#: Cells per axis that are tried, finest first; the last is taken where no other has few enough points.
CELLS = (1024, 512, 256, 128, 64, 32, 27, 20, 16, 12)
#: Pairs of points up to which a step is done without a job.
LOCAL_PAIRS = 4_000_000


def _cell(c: str, cells: int) -> Column:
    return F.least(F.floor(F.col(c) * cells), F.lit(cells - 1))


def resolution_for(df: DataFrame, points: int, columns: tuple[str, ...] = ("t", "x", "y")) -> int | None:
    """Cells per axis with at most about that many occupied ones; None if the distinct points are few enough."""
    counts = [F.approx_count_distinct(F.struct(*columns), 0.02).alias("n0"), *[F.approx_count_distinct(F.struct(*[_cell(c, g) for c in columns]), 0.02).alias(f"n{g}") for g in CELLS[:-1]]]
    most = df.agg(*counts).first()
    return next((g or None for g in (0, *CELLS[:-1]) if (most[f"n{g}"] or 0) <= points * 0.9), CELLS[-1])


def quantized(df: DataFrame, cells: int | None, columns: tuple[str, ...] = ("t", "x", "y"), keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, columns, n: the mean point of each occupied cell of normalized points; without cells, the distinct points."""
    if cells is None:
        return df.groupBy(*keys, *columns).agg(F.count("*").alias("n"))
    at = [_cell(c, cells).alias(f"_{c}") for c in columns]
    return df.groupBy(*keys, *at).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("n")).drop(*[f"_{c}" for c in columns])


def points_of(rows: DataFrame, columns: tuple[str, ...] = ("t", "x", "y")) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights of a quantized cloud, of which there are MOST_POINTS at most."""
    table = rows.select(*columns, "n").toArrow()
    weights = table.column("n").to_numpy().astype(float)
    return np.stack([table.column(c).to_numpy().astype(float) for c in columns], 1), weights / max(weights.sum(), 1.0)


def _soft_min(eps: float, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
    """-eps * log sum_j exp(h_j - |x_i - y_j|^2 / 2 eps), in blocks of x."""
    out = np.empty(len(x))
    block = max(1, LOCAL_PAIRS // max(1, len(y)))
    for lo in range(0, len(x), block):
        z = h[None, :] - ((x[lo : lo + block, None, :] - y[None, :, :]) ** 2).sum(-1) / (2 * eps)
        top = z.max(1, keepdims=True)
        out[lo : lo + block] = -eps * (top[:, 0] + np.log(np.exp(z - top).sum(1)))
    return out


def _soft_mins(spark: SparkSession | None, eps: float, problems: list[tuple]) -> list[np.ndarray]:
    """_soft_min of each (x, y, h): by Spark tasks over blocks of x, with the bounded points and potentials broadcast, if there are many pairs."""
    if spark is None or sum(len(x) * len(y) for x, y, _ in problems) <= LOCAL_PAIRS:
        return [_soft_min(eps, *p) for p in problems]
    shared = spark.sparkContext.broadcast(problems)
    blocks = [(k, lo, min(lo + 512, len(p[0]))) for k, p in enumerate(problems) for lo in range(0, len(p[0]), 512)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x, y, h = shared.value[k]
                value = _soft_min(eps, x[lo:hi], y, h)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(value), pa.int32()), pa.array(range(lo, hi), pa.int32()), pa.array(value)], names=["k", "i", "value"])

    rows = spark.createDataFrame(blocks, "k int, lo int, hi int").repartition(min(len(blocks), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "k int, i int, value double").toArrow()
    shared.unpersist()
    k, i, value = (rows.column(c).to_numpy() for c in ("k", "i", "value"))
    out = [np.empty(len(p[0])) for p in problems]
    for j in range(len(problems)):
        out[j][i[k == j]] = value[k == j]
    return out


def sinkhorn_divergence(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, blur: float = 0.01, scaling: float = 0.5, spark: SparkSession | None = None) -> float:
    """Debiased Sinkhorn divergence with squared distances, by annealing from the clouds' diameter to blur; empty: infinite."""
    if not len(a) or not len(b):
        return math.inf
    both = np.concatenate([a, b])
    size = max(float(np.linalg.norm(both.max(0) - both.min(0))), blur)
    steps = [size**2]
    while steps[-1] > blur**2:
        steps.append(max(steps[-1] * scaling**2, blur**2))
    steps += [blur**2] * 3
    la, lb = np.log(wa), np.log(wb)
    f, g, p, q = (np.zeros(len(x)) for x in (a, b, a, b))
    for eps in steps:
        f_new, g_new, p_new, q_new = _soft_mins(spark, eps, [(a, b, lb + g / eps), (b, a, la + f / eps), (a, a, la + p / eps), (b, b, lb + q / eps)])
        f, g, p, q = (f + f_new) / 2, (g + g_new) / 2, (p + p_new) / 2, (q + q_new) / 2
    return float(wa @ (f - p) + wb @ (g - q))


def cloud_distance(one: DataFrame, two: DataFrame, blur: float = 0.01, scaling: float = 0.9, most: int | None = None, points: int | None = None) -> float:
    """Divergence of two event streams, each normalized to the unit cube; with most, infinite above that many events.

    Clouds of at most points (default MOST_POINTS) distinct points are compared exactly, larger ones by the mean points of the finest cells that
    are few enough; points move by less than a cell's diagonal then.
    """
    if most is not None and max(one.limit(most + 1).count(), two.limit(most + 1).count()) > most:
        return math.inf
    clouds = []
    for df in (normalized(one), normalized(two)):
        clouds += points_of(quantized(df, resolution_for(df, points or MOST_POINTS)))
    return sinkhorn_divergence(*clouds, blur=blur, scaling=scaling, spark=one.sparkSession)


# fixed values: search ranges of k1 to k6, all on a logarithmic scale
SEARCH_RANGES = {"k1": (1e-1, 1e2), "k2": (1e-8, 1e-6), "k3": (1e-8, 1e-4), "k4": (1e-8, 1e-6), "k5": (1e-13, 1e-5), "k6": (1e-7, 1e-3)}


def proposals(trials: int, seed: int = 42, ranges: dict[str, tuple[float, float]] | None = None) -> list[Sensor]:
    """Log-uniform proposals, the same for the same seed."""
    ranges = ranges or SEARCH_RANGES
    u = np.random.default_rng(seed).random((trials, len(ranges)))
    return [Sensor(**{k: float(lo * (hi / lo) ** v) for (k, (lo, hi)), v in zip(ranges.items(), row, strict=True)}) for row in u]


def search(spark: SparkSession, score: Callable[[Sensor], float], trials: int, store: str, seed: int = 42, ranges: dict | None = None, timeout_s: float | None = None) -> DataFrame:
    """trial, k1..k6, distance of all proposals, nearest first. Done trials in store (Parquet) are kept, so a search resumes."""
    import time

    schema = "trial int, k1 double, k2 double, k3 double, k4 double, k5 double, k6 double, distance double"
    spark.createDataFrame([], schema).write.mode("append").parquet(store)
    done = {r.trial for r in spark.read.schema(schema).parquet(store).select("trial").collect()}
    began = time.monotonic()
    for i, sensor in enumerate(proposals(trials, seed, ranges)):
        if i in done:
            continue
        if timeout_s is not None and time.monotonic() - began > timeout_s:
            break
        row = (i, *map(float, vars(sensor).values()), float(score(sensor)))
        spark.createDataFrame([row], schema).write.mode("append").parquet(store)
    return spark.read.schema(schema).parquet(store).orderBy("distance", "trial")


#: Proposals whose pixels one step of the simulator takes together.
STACK = 8
#: Tasks that tiles are dealt to, at most.
MOST_TASKS = 10_000


def _spans(keyed: DataFrame, sensors: list[Sensor], seed: int, fill: float | None) -> DataFrame:
    """trial, events, lo_t .. hi_y of each trial that has events; a task gives a row per tile and trial, and no events leave it."""
    names = [f"{n}_{c}" for c in "txy" for n in ("lo", "hi")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for first in range(0, len(sensors), STACK):
            some = sensors[first : first + STACK]
            count, bounds = np.zeros(len(some), np.int64), np.full((6, len(some)), np.iinfo(np.int64).max)
            for own, *columns in simulate.simulate_trials(pdf, some, seed, fill):
                count += np.bincount(own, minlength=len(some))
                for i, c in enumerate(columns):
                    np.minimum.at(bounds[2 * i], own, c)
                    np.minimum.at(bounds[2 * i + 1], own, -c)
            rows += [(first + k, int(count[k]), *(int(v) for pair in bounds[:, k].reshape(3, 2) for v in (pair[0], -pair[1]))) for k in np.flatnonzero(count)]
        return pd.DataFrame(rows, columns=["trial", "events", *names])

    found = keyed.groupBy("_tx", "_ty").applyInPandas(run, f"trial int, events long, {', '.join(f'{n} long' for n in names)}")
    return found.groupBy("trial").agg(F.sum("events").alias("events"), *[(F.min if n.startswith("lo") else F.max)(n).alias(n) for n in names])


def _cells_of(trials: list[int], sensors: list[Sensor], bounds: dict[int, tuple], cells: int, seed: int, fill: float | None) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """For a tile: trial, cell, n, t, x, y: the events of each trial in each cell of its normalized cloud, and the sums of their coordinates.

    bounds: lo and hi of t, x and y of each trial. A frame's events are counted and forgotten, so a trial may have any number of them.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for first in range(0, len(trials), STACK):
            some = trials[first : first + STACK]
            lo, hi = (np.array([bounds[i][k::2] for i in some]).T for k in (0, 1))
            n, sums = np.zeros(len(some) * cells**3, np.int64), np.zeros((3, len(some) * cells**3))
            for own, *columns in simulate.simulate_trials(pdf, [sensors[i] for i in some], seed, fill):
                at, unit = own, []
                for c, a, b in zip(columns, lo, hi, strict=True):
                    u = (c - a[own]) / np.where(b > a, b - a, 1)[own]
                    at = at * cells + np.minimum((u * cells).astype(np.int64), cells - 1)
                    unit.append(u)
                here, inverse = np.unique(at, return_inverse=True)
                n[here] += np.bincount(inverse, minlength=len(here))
                for total, u in zip(sums, unit, strict=True):
                    total[here] += np.bincount(inverse, u, len(here))
            used = np.flatnonzero(n)
            parts.append((np.array(some)[used // cells**3], used % cells**3, n[used], *sums[:, used]))
        return pd.DataFrame(dict(zip(("trial", "cell", "n", "t", "x", "y"), (np.concatenate(c) for c in zip(*parts, strict=True)), strict=True))).astype({"trial": "int32", "cell": "int32"})

    return run


def simulated_distances(pixels: DataFrame, real: DataFrame, trials: int, seed: int = 42, ranges: dict | None = None, blur: float = 0.05, most: int | None = None, cells: int = 12, fill: float | None = None) -> DataFrame:
    """trial, k1..k6, events, distance of all proposals: each is simulated on pixels and compared with the real events.

    Every tile is simulated by itself, for all trials together. A first pass counts each trial's events and finds their bounds within the
    tasks. A second one draws them again and counts them in cells, within the tasks too, so no event leaves them, however many a trial has;
    the distance to the real cloud (cells per axis, so cells ** 3 points at most, broadcast) is found in a task for each. No events: infinite;
    with most, also for a trial with more events.
    """
    spark = pixels.sparkSession
    sensors = proposals(trials, seed, ranges)
    table = spark.createDataFrame([(i, *map(float, vars(s).values())) for i, s in enumerate(sensors)], "trial int, k1 double, k2 double, k3 double, k4 double, k5 double, k6 double")
    cloud = spark.sparkContext.broadcast(points_of(quantized(normalized(real), cells)))
    keyed = written(simulate.tiled(pixels, None, fill))
    # tiles cost much and alike: one or few to a task
    keyed = keyed.repartition(max(1, min(MOST_TASKS, keyed.select("_tx", "_ty").distinct().count())), "_tx", "_ty")
    bounds = written(_spans(keyed, sensors, seed, fill))
    spans = {r.trial: tuple(r)[2:] for r in bounds.orderBy("trial").collect() if most is None or r.events <= most}  # a row per trial
    out = table.join(bounds.select("trial", "events"), "trial", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    if not spans:
        return out.withColumn("distance", F.lit(math.inf))
    parts = keyed.groupBy("_tx", "_ty").applyInPandas(_cells_of(list(spans), sensors, spans, cells, seed, fill), "trial int, cell int, n long, t double, x double, y double")
    counted = parts.groupBy("trial", "cell").agg(F.sum("n").alias("n"), *[(F.sum(c) / F.sum("n")).alias(c) for c in ("t", "x", "y")])

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        weights = pdf["n"].to_numpy(float)
        value = sinkhorn_divergence(pdf[["t", "x", "y"]].to_numpy(float), weights / weights.sum(), *cloud.value, blur=blur)
        return pd.DataFrame({"trial": [key[0]], "distance": [value]})

    found = counted.groupBy("trial").applyInPandas(compare, "trial int, distance double")
    return out.join(found, "trial", "left").withColumn("distance", F.coalesce("distance", F.lit(math.inf)))
