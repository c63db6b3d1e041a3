"""Inter-event intervals per pixel, their statistics, frequencies and distribution fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import histogram, ordered


def busy_pixels(events: DataFrame, least: int, keys: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Events of pixels that have at least ``least`` events."""
    return ordered.counted(events, list(keys), least)


def intervals(events: DataFrame, keys: tuple[str, ...] = ("x", "y"), least: int = 0, longest: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """events with tau, the time since the pixel's previous event; only 0 < tau (< longest).

    carry: columns of which the previous event's value is wanted, as prev_<name>; one sort serves all. least: events that a pixel needs.
    A stuck pixel is no single task: pixels are split at ranges of time (ordered.lagged). Of events of one pixel and time all but
    one have tau 0 and go; which one stays is fixed by the other columns.
    """
    out = ordered.lagged(events, "t", list(keys), ("t", *carry))
    out = out.withColumn("tau", F.col("t") - F.col("prev_t")).drop("prev_t").where("tau > 0")
    if longest is not None:
        out = out.where(F.col("tau") < longest)
    return ordered.counted(out, list(keys), least, events) if least else out


def pool_statistics(df: DataFrame, value: str, keys: tuple[str, ...] = ("x", "y"), by: tuple[str, ...] = ()) -> DataFrame:
    """n, pixels, mean, median, std (population), min, max of the values. The exact median takes several passes, so what made the values is run once, for a table."""
    return _pool_statistics(written(df.select(*by, *keys, value)), value, keys, by)


def _pool_statistics(df: DataFrame, value: str, keys: tuple[str, ...] = ("x", "y"), by: tuple[str, ...] = ()) -> DataFrame:
    v = F.col(value).cast("double")
    out = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.countDistinct(F.struct(*keys)).alias("pixels"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    middle = ordered.median(df, value, by)
    joined = out.join(middle, list(by), "left") if by else out.join(F.broadcast(middle), F.lit(True), "left")
    return joined.select(*by, "n", "pixels", "mean", "median", "std", "min", "max")


def inverse_gaussian(tau: Column) -> tuple[Column, Column]:
    """Maximum likelihood mean and shape (lambda) of an inverse Gaussian with location 0, as aggregates."""
    mean = F.avg(tau)
    inverse = F.avg(1.0 / F.nullif(tau.cast("double"), F.lit(0.0)))
    return mean, 1.0 / F.nullif(inverse - 1.0 / F.nullif(mean, F.lit(0.0)), F.lit(0.0))


def levy(tau: Column) -> Column:
    """Maximum likelihood scale of a Levy distribution with location 0, as an aggregate."""
    return F.count(tau) / F.nullif(F.sum(1.0 / F.nullif(tau.cast("double"), F.lit(0.0))), F.lit(0.0))


def fit(df: DataFrame, tau: str = "tau", by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, shape, levy_scale, mu = 1/mean, sigma = 1/sqrt(shape); without a shape, mu 0 and the Levy scale's sigma."""
    mean, shape = inverse_gaussian(F.col(tau))
    out = df.groupBy(*by).agg(F.count(tau).alias("n"), mean.alias("mean"), shape.alias("shape"), levy(F.col(tau)).alias("levy_scale"))
    good = F.col("shape") > 0
    return out.withColumn("mu", F.when(good, 1.0 / F.col("mean")).when(F.col("levy_scale") > 0, 0.0)).withColumn(
        "sigma", F.when(good, 1.0 / F.sqrt("shape")).when(F.col("levy_scale") > 0, 1.0 / F.sqrt("levy_scale"))
    )


def interval_analysis(events: DataFrame, least: int = 10, longest: float | None = None, bins: int = 100) -> tuple[DataFrame, DataFrame]:
    """(fit with pixel count, density histogram of tau up to longest) over the pixels with at least ``least`` events."""
    taus = intervals(events, least=least)
    pixels = taus.agg(F.countDistinct("x", "y").alias("pixels"))
    shown = taus if longest is None else taus.where(F.col("tau") <= longest)
    return fit(taus).crossJoin(F.broadcast(pixels)), histogram.density(shown, "tau", bins)


def frequencies(events: DataFrame, least: int = 10, highest: float = 1000.0) -> DataFrame:
    """events with hz = 1e6 / tau, up to highest."""
    return intervals(events, least=least).withColumn("hz", 1e6 / F.col("tau")).where(F.col("hz") <= highest)


def frequency_spectrum(events: DataFrame, least: int = 10, highest: float = 1000.0, bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """(statistics, histogram over [0, highest]) of the instantaneous frequencies."""
    hz = written(frequencies(events.select("t", "x", "y"), least, highest).select("x", "y", "hz"))
    return _pool_statistics(hz, "hz"), histogram.histogram(hz, "hz", bins, 0.0, highest)


def luminance_intervals(events: DataFrame, longest: int) -> DataFrame:
    """Intervals per pixel and polarity with the previous event's luminance: tau, lbar, dl, dt, p.

    events: t, x, y, p, prev_lum, next_lum, frame_dt.
    """
    named = events.withColumnsRenamed({"prev_lum": "a", "next_lum": "b", "frame_dt": "dt"})
    out = intervals(named, ("p", "x", "y"), longest=longest, carry=("a", "b", "dt"))
    return out.select("p", "x", "y", "t", "tau", ((F.col("prev_a") + F.col("prev_b")) / 2).alias("lbar"), (F.col("prev_b") - F.col("prev_a")).alias("dl"), F.col("prev_dt").alias("dt"))
