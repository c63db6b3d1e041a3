"""Pixel and clock expressions on Columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# fixed values: luma weights of red, green and blue
LUMA = (0.299, 0.587, 0.114)


def gray(first: Column, second: Column, third: Column, order: str = "rgb") -> Column:
    """Luma of three channels in the given order, rounded to an integer; further channels (alpha) are not used."""
    weights = dict(zip("rgb", LUMA, strict=True))
    if sorted(order) != ["b", "g", "r"]:
        raise ValueError("order is a permutation of rgb")
    return F.round(sum((c * weights[k] for c, k in zip((first, second, third), order, strict=True)), F.lit(0.0))).cast("int")


def center_crop(df: DataFrame, width: int, height: int, crop_width: int, crop_height: int) -> DataFrame:
    """Pixels or events (x, y) inside the centered crop, in its coordinates."""
    left, top = width // 2 - crop_width // 2, height // 2 - crop_height // 2
    right, bottom = width // 2 + crop_width // 2, height // 2 + crop_height // 2
    inside = F.col("x").between(max(left, 0), min(right, width) - 1) & F.col("y").between(max(top, 0), min(bottom, height) - 1)
    return df.where(inside).withColumn("x", F.col("x") - max(left, 0)).withColumn("y", F.col("y") - max(top, 0))


def ten_to_eight_bits(v: Column) -> Column:
    return F.floor(v * 255 / 1023).cast("int")


def unpack_ten_bits(v: Column) -> Column:
    return F.shiftright(v, 6).bitwiseAND(F.lit(1023))


def sixteen_to_eight_bits(v: Column) -> Column:
    return F.floor(v / 256).cast("int")


def stretch_to_eight_bits(v: Column, frame_max: Column) -> Column:
    """v scaled so that the frame's maximum is 255; null for an all-zero frame."""
    return F.floor(v / F.nullif(frame_max.cast("double"), F.lit(0.0)) * 255).cast("int")


def to_microseconds(ts: Column, first: Column) -> Column:
    """Nanosecond sensor clock to whole microseconds since its first value, truncated."""
    return ((ts - first) / 1000).cast("long")


def video_time(frame_idx: Column, fps: float) -> Column:
    """Timestamps of decoded video frames: a truncated step in microseconds."""
    return frame_idx.cast("long") * int(1e6 / fps)


def signed_polarity(p: Column) -> Column:
    """Polarity as 1 or -1."""
    return F.when(p > 0, 1).otherwise(-1)


def in_rectangle(x: Column, y: Column, left: int, top: int, right: int, bottom: int) -> Column:
    """Whether the rounded point is in [left, right) x [top, bottom)."""
    rx, ry = F.rint(x), F.rint(y)
    return (rx >= left) & (rx < right) & (ry >= top) & (ry < bottom)


def mean_luminance(a: Column, b: Column) -> Column:
    return (a + b) / 2


def drift(mean: Column, change: Column, dt: Column, k) -> Column:
    """Drift of the pixel voltage: k1 * dL / dt / (L + k2) + k4 + k5 * L; null for dt = 0 or L + k2 = 0."""
    return k.k1 * change / F.nullif(dt.cast("double"), F.lit(0.0)) / F.nullif(mean + k.k2, F.lit(0.0)) + k.k4 + k.k5 * mean


def diffusion(mean: Column, k) -> Column:
    """Noise: k3 * sqrt(L) / (L + k2) + k6, used as a standard deviation."""
    return k.k3 * F.sqrt(mean) / F.nullif(mean + k.k2, F.lit(0.0)) + k.k6


@F.arrow_udf(DoubleType())
def c_exp(x: pa.Array) -> pa.Array:
    """exp of the C library, as DuckDB and numpy's scalars have it. The JVM's differs by a unit in the last place in some rows, which differences from 1 magnify."""
    values = x.to_numpy(zero_copy_only=False)
    found = np.fromiter(map(math.exp, np.minimum(values, 709.0)), np.float64, len(values))
    return pa.array(np.where(values > 709.0, np.inf, found), mask=np.asarray(x.is_null()))


def first_barrier_probability(mu: Column, sigma: Column, residual: Column, threshold: float = 1.0, zero_drift_half: bool = False) -> Column:
    """Probability that the ON barrier is met first, from a residual in [-threshold, threshold].

    A = threshold - residual up, B = threshold + residual down. Written with negative exponents, so it cannot overflow. Without drift it is
    B / (A + B), its limit; zero_drift_half gives 0.5 instead.
    """
    a, b = F.lit(threshold) - residual, F.lit(threshold) + residual
    rate = F.lit(2.0) * mu / F.nullif(sigma * sigma, F.lit(0.0))
    near, far = c_exp(F.when(mu > 0, -rate * b).otherwise(rate * a)), c_exp(F.when(mu > 0, -rate * (a + b)).otherwise(rate * (a + b)))
    still = F.lit(0.5) if zero_drift_half else b / (a + b)
    value = F.when(mu > 0, 1 - near).otherwise(near - far) / F.nullif(1 - far, F.lit(0.0))
    return F.when((mu > 0) | (mu < 0), F.coalesce(value, still)).otherwise(still)


def inverse_gaussian_pdf(t: Column, mean: Column, shape: Column) -> Column:
    return F.when(t > 0, F.sqrt(shape / (2 * 3.141592653589793 * t * t * t)) * F.exp(-shape * (t - mean) * (t - mean) / (2 * mean * mean * t))).otherwise(F.lit(0.0))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function.

    Within 6: 0.5 + pdf(z) * (z + z^3/3 + z^5/15 + ...), summed by Horner's rule; beyond, 0 or 1 to 1e-9.
    """
    s = z * z
    odds = F.array(*[F.lit(float(odd)) for odd in range(101, 1, -2)])
    total = F.aggregate(odds, F.lit(1.0), lambda sum_, odd: 1 + s / odd * sum_)
    inner = 0.5 + F.exp(-s / 2) / 2.5066282746310002 * z * total
    return F.when(z > 6, 1.0).when(z < -6, 0.0).otherwise(inner)


def normal_quantile(p: Column) -> Column:
    """Inverse of normal_cdf to about 1e-9 within (1e-9, 1 - 1e-9), by Newton steps from a logistic start; null outside (0, 1)."""
    start = F.log(p / (1 - p)) / 1.702
    steps = F.array(*[F.lit(i) for i in range(12)])

    def step(z: Column, _: Column) -> Column:
        moved = (normal_cdf(z) - p) / (F.exp(-z * z / 2) / 2.5066282746310002)
        return F.greatest(F.lit(-6.0), F.least(F.lit(6.0), z - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), moved))))

    return F.when((p > 0) & (p < 1), F.aggregate(steps, F.greatest(F.lit(-6.0), F.least(F.lit(6.0), start)), step))


def _mills(z: Column) -> Column:
    """(1 - normal_cdf(z)) * exp(z * z / 2) for z >= 0, without overflow."""
    s = z * z
    far = (1 - 1 / s + 3 / (s * s) - 15 / (s * s * s)) / (z * 2.5066282746310002)
    return F.when(z > 5.5, far).otherwise(normal_cdf(-z) * F.exp(F.least(s, F.lit(40.0)) / 2))


def inverse_gaussian_cdf(t: Column, mean: Column, shape: Column) -> Column:
    """Probability of a passage by t. The second term's exponents are joined, so a large shape / mean cannot overflow."""
    root, part = F.sqrt(shape / t), t / mean
    value = normal_cdf(root * (part - 1)) + F.exp(-shape * (part - 1) * (part - 1) / (2 * t)) * _mills(root * (part + 1))
    return F.when(t > 0, value).otherwise(0.0)


def inverse_gaussian_interval(start: Column, end: Column, mean: Column, shape: Column) -> Column:
    """Probability of a passage between start and end."""
    return inverse_gaussian_cdf(end, mean, shape) - inverse_gaussian_cdf(start, mean, shape)


def shifted_clock(t: Column, offset: Column | int) -> Column:
    """Times of one clock on another that is offset behind it, as found by clock_offset."""
    return t - offset
