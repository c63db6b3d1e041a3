"""Stochastic event simulator: per pixel a drifted Brownian voltage between two barriers.

Pixels do not interact, so frames are cut into tiles and each tile is stepped by itself, in frame order. All random numbers
depend on (seed, clip, x, y, frame, draw) only: results are the same for any partitioning, and in batch and stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import random as R
from ..params import Sensor, preset

TILE = 32
IDLE = 1000
THRESHOLD = 1.0


@dataclass(frozen=True)
class Options:
    sensor: Sensor
    seed: int = 0
    sampler: str = "reference"
    zero_drift_half: bool = False
    skip_first_frame: bool = False


@dataclass(frozen=True)
class State:
    """Of a tile's pixels: last luminance, last time, residual voltage in [-1, 1]."""

    lum: np.ndarray
    t: int
    residual: np.ndarray


def on_probability(mu, sigma, residual, zero_drift_half: bool = False) -> np.ndarray:
    """Probability that the ON barrier is met first; see functions.pixels.first_barrier_probability."""
    a, b = THRESHOLD - residual, THRESHOLD + residual
    rate = 2 * np.abs(mu) / (sigma * sigma)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        up = -np.expm1(-rate * b) / -np.expm1(-rate * (a + b))
        out = np.where(mu > 0, up, np.exp(-rate * a) * up)
        still = np.full_like(a, 0.5) if zero_drift_half else b / (a + b)
    return np.where((mu == 0) | ~np.isfinite(out), still, out)


def step(state: State | None, lum: np.ndarray, t: int, x: np.ndarray, y: np.ndarray, clip: int, frame: int, o: Options):
    """(new state, event times, pixel numbers, polarities) of one frame.

    A pixel draws until its next event is past the frame. If no time has moved in IDLE passes (waits below the clock's
    resolution), an error names the pixels left.
    """
    lum = lum.astype(np.float64)
    none = np.empty(0)
    if state is None:
        return State(lum, t, np.zeros(len(lum))), none, none.astype(int), none.astype(int)
    if t <= state.t:
        raise ValueError(f"frame time {t} is not after {state.t}")
    k, dt = o.sensor, t - state.t
    mean = (lum + state.lum) / 2
    mu = k.k1 * (lum - state.lum) / dt / (mean + k.k2) + k.k4 + k.k5 * mean
    sigma = k.k3 * np.sqrt(mean) / (mean + k.k2) + k.k6
    keys = R.keys(o.seed, clip, x, y, frame)
    now, residual = np.full(len(lum), float(state.t)), state.residual.copy()
    times, pixels, signs = [], [], []
    active = np.arange(len(lum))
    draw = idle = 0
    while len(active):
        m, s, r, key = mu[active], sigma[active], residual[active], keys[active]
        on = R.uniform(key, 8 * draw) <= on_probability(m, s, r, o.zero_drift_half)
        distance = np.maximum(np.where(on, THRESHOLD - r, THRESHOLD + r), 1e-12)
        wait = R.first_passage(distance, np.where(on, m, -m), s, key, 8 * draw + 1, o.sampler)
        hit = now[active] + wait < t
        late = active[~hit]
        signed = np.where(on, distance, -distance)[~hit]
        residual[late] = np.clip(residual[late] + signed * (t - now[late]) / wait[~hit], -THRESHOLD, THRESHOLD)
        active, before = active[hit], now[active[hit]]
        now[active] += wait[hit]
        residual[active] = 0.0
        times.append(now[active].copy())
        pixels.append(active)
        signs.append(on[hit].astype(int))
        draw, idle = draw + 1, 0 if (now[active] > before).any() else idle + 1
        if len(active) and idle >= IDLE:
            raise ValueError(f"frame {frame}: events closer than the clock resolves at pixels {list(zip(x[active].tolist(), y[active].tolist(), strict=True))}")
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    return State(lum, t, residual), np.rint(join(times, float)), join(pixels, int), join(signs, int)


def _frames(pdf: pd.DataFrame, fill: float | None) -> Iterator[tuple]:
    """(frame, t, x, y, lum) of each frame of a tile's pixel rows, in order."""
    if fill is not None:
        inside = pdf.x.notna()
        grid = pdf[inside].pivot_table("lum", "frame_idx", ["y", "x"], aggfunc="last").reindex(sorted(pdf.frame_idx.unique())).fillna(fill)
        times = pdf.groupby("frame_idx").t.first()
        at = np.array(grid.columns.tolist()).reshape(-1, 2).astype(int)
        yield from ((f, int(times[f]), at[:, 1], at[:, 0], lum) for f, lum in zip(grid.index, grid.to_numpy(), strict=True))
    else:
        ordered = pdf.sort_values(["frame_idx", "y", "x"]).groupby("frame_idx")
        yield from ((f, int(rows.t.iloc[0]), rows.x.to_numpy(), rows.y.to_numpy(), rows.lum.to_numpy()) for f, rows in ordered)


def simulate_tile(pdf: pd.DataFrame, o: Options, clip: int, fill: float | None = None) -> pd.DataFrame:
    """Events of one tile's pixel rows (frame_idx, t, x, y, lum). With fill, rows without x name frames, and pixels that a frame lacks have that luminance."""
    out, state = [], None
    first = pdf.frame_idx.min() if len(pdf) else 0
    for frame, t, x, y, lum in _frames(pdf, fill):
        if o.skip_first_frame and frame == first:
            continue
        state, times_, at_, p = step(state, lum, t, x, y, clip, int(frame), o)
        out.append(pd.DataFrame({"t": times_.astype("int64"), "x": x[at_], "y": y[at_], "p": p}))
    return pd.concat(out) if out else pd.DataFrame({"t": [], "x": [], "y": [], "p": []})


def simulate_trials(pdf: pd.DataFrame, sensors: list[Sensor], seed: int, fill: float | None = None) -> Iterator[tuple]:
    """(sensor's place, t, x, y) of the events of one tile under each of sensors, frame by frame; those of simulate_tile() for each.

    The pixels of all sensors are stepped together, so a pass of step() works on long arrays.
    """
    state, n = None, len(sensors)
    for frame, t, x, y, lum in _frames(pdf, fill):
        o = Options(Sensor(**{k: np.repeat([getattr(s, k) for s in sensors], len(x)) for k in vars(sensors[0])}), seed)
        xs, ys, own = np.tile(x, n), np.tile(y, n), np.repeat(np.arange(n), len(x))
        state, times, at, _ = step(state, np.tile(lum, n), t, xs, ys, 0, int(frame), o)
        yield own[at], times.astype("int64"), xs[at], ys[at]


def tiled(pixels: DataFrame, clip: str | None = None, fill: float | None = None) -> DataFrame:
    """pixels with _clip and their tile _tx, _ty; with fill, also a row without x for every frame of each tile."""
    keyed = pixels.withColumn("_clip", F.col(clip) if clip else F.lit(0)).withColumn("_tx", F.floor(F.col("x") / TILE)).withColumn("_ty", F.floor(F.col("y") / TILE))
    if fill is None:
        return keyed
    # a row per tile and frame, not per pixel and frame: the pixels are filled in within the tile
    tiles, frames = keyed.select("_clip", "_tx", "_ty").distinct(), keyed.groupBy("_clip", "frame_idx").agg(F.min("t").alias("t"))
    marks = tiles.join(frames, "_clip")
    return keyed.unionByName(marks.withColumn(clip, F.col("_clip")) if clip else marks, allowMissingColumns=True)


def dvs_events(pixels: DataFrame, camera: str | Sensor = "Raw2DVS346", clip: str | None = None, seed: int = 0, ordered: bool = False, fill: float | None = None, **options) -> DataFrame:
    """Events (clip, t, x, y, p) of pixel rows (clip, frame_idx, t, x, y, lum); every pixel is in every frame, or has luminance fill where it is not.

    Default options: frame 0 counts, textbook Levy times, the limit at zero drift.
    """
    sensor = camera if isinstance(camera, Sensor) else preset(camera)
    o = replace(Options(sensor, seed), **options)
    keyed = tiled(pixels, clip, fill)
    names = f"{clip} {pixels.schema[clip].dataType.simpleString()}, " if clip else ""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(R.keys(*[ord(c) for c in str(key[0])]).astype(np.int64)) if clip else 0
        out = simulate_tile(pdf, o, number, fill).astype({"t": "int64", "x": "int32", "y": "int32", "p": "int8"})
        if clip:
            out.insert(0, clip, key[0])
        return out

    events = keyed.groupBy("_clip", "_tx", "_ty").applyInPandas(run, f"{names}t long, x int, y int, p tinyint")
    return events.orderBy("t", "x", "y", "p") if ordered else events
