"""Histograms with closed last bins, and two-dimensional bucketing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of counts that are broadcast.
FEW = 100_000


def edge(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    return lo + i * (hi - lo) / bins


def bin_of(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin 0 to bins-1 of v in [lo, hi], the last bin closed; null outside, and for an empty range all in the middle bin.

    The first guess multiplies before it divides and is then corrected against the bin's own edges.
    """
    lo, hi, v = lo.cast("double"), hi.cast("double"), v.cast("double")
    span = F.nullif(hi - lo, F.lit(0.0))
    guess = F.least(F.floor((v - lo) * bins / span), F.lit(bins - 1).cast("long"))
    fixed = F.when(v < edge(guess, lo, hi, bins), guess - 1).when((guess < bins - 1) & (v >= edge(guess + 1, lo, hi, bins)), guess + 1).otherwise(guess)
    return F.when((v >= lo) & (v <= hi), F.coalesce(fixed, F.lit(bins // 2).cast("long")))


def _range(df: DataFrame, value: str, lo: float | None, hi: float | None) -> DataFrame:
    if lo is not None and hi is not None:
        return df.withColumn("_lo", F.lit(float(lo))).withColumn("_hi", F.lit(float(hi)))
    bounds = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    return df.crossJoin(F.broadcast(bounds))


def histogram(df: DataFrame, value: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """bin, left, right, count for all bins, empty ones too; without lo and hi, over the data's range (one row of it is joined)."""
    ranged = _range(df.where(F.col(value).isNotNull()), value, lo, hi)
    counted = ranged.withColumn("bin", bin_of(F.col(value), F.col("_lo"), F.col("_hi"), bins)).where("bin is not null").groupBy("bin").agg(F.count("*").alias("count"))
    bounds = ranged.agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")) if lo is None or hi is None else df.sparkSession.range(1).select(F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi"))
    dense = df.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(bounds))
    # counted has at most bins rows; a long series is joined by Spark's own choice
    out = dense.join(F.broadcast(counted) if bins <= FEW else counted, "bin", "left")
    return out.select("bin", edge(F.col("bin"), F.col("_lo"), F.col("_hi"), bins).alias("left"), edge(F.col("bin") + 1, F.col("_lo"), F.col("_hi"), bins).alias("right"), F.coalesce("count", F.lit(0)).alias("count"))


def density(df: DataFrame, value: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """histogram() with density: count / (all counts * bin width)."""
    out = histogram(df, value, bins, lo, hi)
    total = out.agg(F.sum("count").alias("_n"))
    return out.crossJoin(F.broadcast(total)).withColumn("density", F.col("count") / F.nullif(F.col("_n") * (F.col("right") - F.col("left")), F.lit(0.0))).drop("_n")


def histogram2d(df: DataFrame, x: str, y: str, xbins: int, ybins: int, keys: list[str] | None = None) -> DataFrame:
    """i, j, count of the occupied cells over the data's range of both axes, per key, with the range."""
    keys = keys or []
    bounds = df.groupBy(*keys).agg(F.min(x).alias("x_lo"), F.max(x).alias("x_hi"), F.min(y).alias("y_lo"), F.max(y).alias("y_hi"))
    joined = df.join(bounds, keys) if keys else df.crossJoin(F.broadcast(bounds))
    i = bin_of(F.col(x), F.col("x_lo"), F.col("x_hi"), xbins)
    j = bin_of(F.col(y), F.col("y_lo"), F.col("y_hi"), ybins)
    return joined.groupBy(*keys, i.alias("i"), j.alias("j"), "x_lo", "x_hi", "y_lo", "y_hi").agg(F.count("*").alias("count"))


def valid_range(df: DataFrame, x: str, y: str, bins: int = 30, threshold: int = 100, keys: list[str] | None = None) -> DataFrame:
    """Per key x_min, x_max, y_min, y_max of the cells with more than threshold rows; without such cells, of the data."""
    cells = histogram2d(df, x, y, bins, bins, keys)
    full = F.col("count") > threshold

    def bound(f, axis: str, index: Column, fallback: str) -> Column:
        return F.coalesce(f(F.when(full, edge(index, F.col(f"{axis}_lo"), F.col(f"{axis}_hi"), bins))), F.first(fallback))

    return cells.groupBy(*(keys or [])).agg(
        bound(F.min, "x", F.col("i"), "x_lo").alias("x_min"),
        bound(F.max, "x", F.col("i") + 1, "x_hi").alias("x_max"),
        bound(F.min, "y", F.col("j"), "y_lo").alias("y_min"),
        bound(F.max, "y", F.col("j") + 1, "y_hi").alias("y_max"),
    )


def half_open_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of v in [lo, hi), null outside."""
    return F.when(v < hi, bin_of(v, lo, hi, bins))


def rate_series(df: DataFrame, t: str, bins: int | None = None) -> DataFrame:
    """bin, left, right, count, rate (events per second) over the data's time range in microseconds.

    Without bins there are as many as events per second times seconds, at least 1024.
    """
    if bins is None:
        n = df.count()
        bins = max(1024, n)
    out = histogram(df, t, bins)
    return out.withColumn("rate", F.col("count") / F.nullif((F.col("right") - F.col("left")) / 1e6, F.lit(0.0)))
