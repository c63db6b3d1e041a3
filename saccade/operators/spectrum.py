"""Spectrum of the event rate."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import histogram

LEAST_EVENTS = 10
#: Values of a block that a task transforms at once, and of the longest single transform (16 bytes each).
BLOCK, LONGEST = 1 << 18, 1 << 20


def _magnitude(re, im, k, bins: int):
    return F.sqrt(re * re + im * im) * F.when(k == 0, 1.0).otherwise(2.0) / bins


def rate_dft(events: DataFrame, bins: int, highest_hz: float | None = None) -> DataFrame:
    """k, hz, magnitude of the rate's discrete Fourier transform, as sums of products; for small numbers of bins."""
    rates = histogram.rate_series(events, "t", bins)
    span = rates.agg(((F.max("right") - F.min("left")) / 1e6).alias("_s"))
    ks = events.sparkSession.range(bins // 2 + 1).withColumnRenamed("id", "k")
    angle = F.pmod(F.col("k") * F.col("bin"), F.lit(bins)) * (2 * math.pi / bins)
    # both sides are bounded by the number of bins
    sums = rates.crossJoin(F.broadcast(ks)).groupBy("k").agg(F.sum(F.col("rate") * F.cos(angle)).alias("re"), F.sum(-F.col("rate") * F.sin(angle)).alias("im"))
    out = sums.crossJoin(F.broadcast(span)).select("k", (F.col("k") / F.nullif(F.col("_s"), F.lit(0.0))).alias("hz"), _magnitude(F.col("re"), F.col("im"), F.col("k"), bins).alias("magnitude"))
    return out if highest_hz is None else out.where(F.col("hz") <= highest_hz)


def _split(n: int) -> tuple[int, int] | None:
    """Factors of n, the second at most LONGEST, as near to each other as they get; None if there are none."""
    first = next(f for f in range(math.isqrt(n), 0, -1) if n % f == 0)
    return (first, n // first) if n // first <= LONGEST else None


def _part(rows: DataFrame, length: int, turn: int, inverse: bool) -> DataFrame:
    """rows (group long, at long, re, im; absent ones are zero) with each group's transform of that length, times exp of turn-th parts of group * at."""
    wide = max(1, BLOCK // length)

    def run(table: pa.Table) -> pa.Table:
        group, at = table.column("group").to_numpy(), table.column("at").to_numpy()
        lowest = group.min() // wide * wide
        values = np.zeros((length, min(wide, int(group.max() - lowest) + 1)), complex)
        values[at, group - lowest] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
        values = np.fft.ifft(values, axis=0) * length if inverse else np.fft.fft(values, axis=0)
        groups, places = lowest + np.arange(values.shape[1]), np.arange(length)
        if turn:
            values *= np.exp((2j if inverse else -2j) * np.pi * (groups[None, :] * places[:, None]) / turn)
        flat = values.ravel()
        return pa.table({"group": np.tile(groups, length), "at": np.repeat(places, values.shape[1]), "re": flat.real, "im": flat.imag})

    return rows.groupBy(F.floor(F.col("group") / wide).alias("block")).applyInArrow(run, "group long, at long, re double, im double")


def _transform(series: DataFrame, factors: tuple[int, int], inverse: bool = False) -> DataFrame:
    """k, re, im: the discrete Fourier transform of series (j, re, im) of n1 * n2 values, absent ones zero.

    Four steps: transforms of length n1 along every n2-th value, a turn of each result, transforms of length n2 across those. A task
    holds blocks of BLOCK values, or one transform; absent groups stay absent, their transforms are zero.
    """
    n1, n2 = factors
    first = series.select((F.col("j") % n2).alias("group"), F.floor(F.col("j") / n2).alias("at"), "re", "im")
    along = _part(first, n1, n1 * n2, inverse)
    across = _part(along.select(F.col("at").alias("group"), F.col("group").alias("at"), "re", "im"), n2, 0, inverse)
    return across.select((F.col("group") + F.col("at") * n1).alias("k"), "re", "im")


def _times(re: Column, im: Column, other_re: Column, other_im: Column) -> list[Column]:
    return [(re * other_re - im * other_im).alias("re"), (re * other_im + im * other_re).alias("im")]


def _chirp(j: Column, n: int, sign: int) -> tuple[Column, Column]:
    """cos and sin of sign * pi * j**2 / n, of the exact remainder of j**2."""
    long = j.cast("decimal(19,0)")
    angle = ((long * long) % F.lit(2 * n).cast("decimal(19,0)")).cast("double") * (sign * math.pi / n)
    return F.cos(angle), F.sin(angle)


def dft(series: DataFrame, n: int) -> DataFrame:
    """k, re, im: the discrete Fourier transform of series (j long, re double, im double) of n values, absent ones zero.

    Lengths without factors of at most LONGEST (large primes) are a convolution with a chirp, whose length is a power of two.
    """
    factors = _split(n)
    if factors:
        return _transform(series, factors)
    bits = (2 * n - 1).bit_length()
    size, factors = 1 << bits, (1 << bits // 2, 1 << (bits - bits // 2))
    turned = series.select("j", *_times(F.col("re"), F.col("im"), *_chirp(F.col("j"), n, -1)))
    far = F.least(F.col("id"), size - F.col("id"))
    chirp = series.sparkSession.range(size).where(far < n).select(F.col("id").alias("j"), *[c.alias(a) for c, a in zip(_chirp(far, n, 1), ("re", "im"), strict=True)])
    one, two = _transform(turned, factors), _transform(chirp, factors).select("k", F.col("re").alias("re2"), F.col("im").alias("im2"))
    product = one.join(two, "k").select(F.col("k").alias("j"), *_times(F.col("re"), F.col("im"), F.col("re2"), F.col("im2")))
    back = _transform(product, factors, inverse=True).where(F.col("k") < n)
    return back.select("k", *_times(F.col("re") / size, F.col("im") / size, *_chirp(F.col("k"), n, -1)))


def spectrum(events: DataFrame, sampling_rate: float = 1000, highest_hz: float = 100) -> DataFrame:
    """As rate_dft by fast Fourier transform, with at least 1024 bins; no rows for fewer than ten events.

    Events are counted by bin; the counts are transformed in blocks by many tasks, see dft().
    """
    first = events.agg(F.count("*"), F.min("t"), F.max("t")).first()
    if first[0] < LEAST_EVENTS or first[1] == first[2]:
        return events.sparkSession.createDataFrame([], "k long, hz double, magnitude double")
    seconds = (first[2] - first[1]) * 1e-6
    bins = max(1024, int(sampling_rate * seconds))
    counted = events.select(histogram.bin_of(F.col("t"), F.lit(first[1]), F.lit(first[2]), bins).alias("j")).where("j is not null").groupBy("j").agg(F.count("*").alias("n"))
    series = counted.select("j", (F.col("n") / (seconds / bins)).alias("re"), F.lit(0.0).alias("im"))
    lines = dft(series, bins).where((F.col("k") <= bins // 2) & (F.col("k") / seconds <= highest_hz))
    return lines.select("k", (F.col("k") / seconds).alias("hz"), _magnitude(F.col("re"), F.col("im"), F.col("k"), bins).alias("magnitude"))


def spectrum_statistics(lines: DataFrame) -> DataFrame:
    """dominant_hz (the constant part excluded), mean_magnitude, max_magnitude, total_power."""
    m = F.col("magnitude")
    best = F.max_by("hz", F.when(F.col("k") > 0, F.struct(m, -F.col("k"))))
    return lines.agg(F.coalesce(best, F.lit(0.0)).alias("dominant_hz"), F.avg(m).alias("mean_magnitude"), F.max(m).alias("max_magnitude"), F.sum(m * m).alias("total_power"))
