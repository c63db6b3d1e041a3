"""Sensor calibration: luminance attachment, bucketed interval fits, chained regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..storage import written
from . import asof, histogram, intervals, regression

FRAME_INTERVAL = 16667.0


def attach_luminance(events: DataFrame, pixels: DataFrame, rectangle: tuple[int, int, int, int] | None = None, keys: list[str] | None = None) -> DataFrame:
    """events with prev_lum, next_lum, frame_dt: the pixel's luminance in the frames around each event.

    pixels: (keys, frame_idx, t, x, y, lum). Events without the pixel in either frame go. rectangle: left, top, right, bottom.
    """
    keys = keys or []
    if rectangle:
        events = events.where(P.in_rectangle(F.col("x"), F.col("y"), *rectangle))
    frames = pixels.groupBy(*keys, "frame_idx").agg(F.min("t").alias("t"))
    near = asof.asof_bracket(events, frames, keys)
    near = near.select(*events.columns, F.col("prev.frame_idx").alias("_a"), F.col("next.frame_idx").alias("_b"), (F.col("next.t") - F.col("prev.t")).alias("frame_dt"))
    lums = needed_frames(near, pixels, keys).select(*keys, "frame_idx", "x", "y", F.col("lum").cast("double").alias("lum"))
    before = lums.withColumnsRenamed({"frame_idx": "_a", "lum": "prev_lum"})
    after = lums.withColumnsRenamed({"frame_idx": "_b", "lum": "next_lum"})
    out = near.join(before, [*keys, "_a", "x", "y"]).join(after, [*keys, "_b", "x", "y"])
    return out.select(*events.columns, "prev_lum", "next_lum", "frame_dt")


def needed_frames(near: DataFrame, pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The pixels of frames that some event needs: near has the frames before and after each event as _a and _b."""
    keys = keys or []
    wanted = near.select(*keys, F.explode(F.array("_a", "_b")).alias("frame_idx")).distinct()
    return pixels.join(wanted, [*keys, "frame_idx"], "left_semi")


def bucket_fits(rows: DataFrame, ranges: DataFrame | None = None, bins: int | tuple[int, int] = 50, least: int = 200, on_sign: int = -1, compat_lambda: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Interval fits per polarity and cell of (lbar, dl), in one pass: the columns of FITS. bins: of both, or of lbar and dl.

    ranges: per key x_min..y_max (default: valid_range of rows). on_sign is the sign of mu for ON events. compat_lambda takes shape / scale for lambda.
    """
    keys = keys or ["p"]
    across, along = bins if isinstance(bins, tuple) else (bins, bins)
    if ranges is None:
        joined = rows.join(histogram.valid_range(rows, "lbar", "dl", keys=keys), keys)
    else:
        joined = rows.join(F.broadcast(ranges) if ranges.limit(histogram.FEW + 1).count() <= histogram.FEW else ranges, keys)
    i = histogram.half_open_bin(F.col("lbar"), F.col("x_min"), F.col("x_max"), across)
    j = histogram.half_open_bin(F.col("dl"), F.col("y_min"), F.col("y_max"), along)
    cells = joined.withColumn("i", i).withColumn("j", j).where("i is not null and j is not null")
    mean, shape = intervals.inverse_gaussian(F.col("tau"))
    fitted = cells.groupBy(*keys, "i", "j", "x_min", "x_max", "y_min", "y_max").agg(F.count("*").alias("count"), mean.alias("mu_hat"), shape.alias("_shape"))
    fitted = fitted.where((F.col("count") >= least) & (F.col("_shape") > 0))
    lam = F.col("mu_hat") / F.col("_shape") / F.col("_shape") if compat_lambda else F.col("_shape")
    sign = F.when(F.col("p") == 1, on_sign).otherwise(-on_sign)
    edge = histogram.edge
    out = fitted.withColumn("lambda_hat", lam).withColumn("mu", sign / F.col("mu_hat")).withColumn("sigma", 1 / F.sqrt("lambda_hat"))
    return out.select(
        *keys,
        edge(F.col("i"), F.col("x_min"), F.col("x_max"), across).alias("mean_min"),
        edge(F.col("i") + 1, F.col("x_min"), F.col("x_max"), across).alias("mean_max"),
        edge(F.col("j"), F.col("y_min"), F.col("y_max"), along).alias("diff_min"),
        edge(F.col("j") + 1, F.col("y_min"), F.col("y_max"), along).alias("diff_max"),
        "mu_hat", "lambda_hat", "mu", "sigma", "count",
    )


def calibrate(events: DataFrame, longest: int = 1_000_000, keys: tuple[str, ...] = (), **options) -> DataFrame:
    """Fits of events with luminance (t, x, y, p, prev_lum, next_lum, frame_dt); keys such as a session keep apart."""
    rows = intervals.luminance_intervals(events, longest)
    return bucket_fits(rows, keys=[*keys, "p"], **options)


def bucket_features(fits: DataFrame, dt: float = FRAME_INTERVAL) -> DataFrame:
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    return fits.withColumn("lbar", mid("mean_min", "mean_max")).withColumn("dl", mid("diff_min", "diff_max")).withColumn("kdl", F.col("dl") / dt)


def slopes(features: DataFrame, least: int = 5) -> DataFrame:
    """First fit: per (p, lbar) with at least least buckets, mu ~ kdl: p, lbar, a, b, count."""
    return regression.weighted_line(features, "kdl", "mu", "count", ["p", "lbar"], least).select("p", "lbar", F.col("slope").alias("a"), F.col("intercept").alias("b"), F.col("total").alias("count"))


def gains(slopes_: DataFrame) -> DataFrame:
    """Second fit: per p, 1/a ~ lbar: k1 = 1/slope, k2 = intercept * k1."""
    rows = slopes_.where("a <> 0").withColumn("inverse", 1 / F.col("a"))
    line = regression.weighted_line(rows, "lbar", "inverse", "count", ["p"])
    return line.withColumn("k1", 1 / F.nullif(F.col("slope"), F.lit(0.0))).withColumn("k2", F.col("intercept") * F.col("k1")).select("p", "k1", "k2")


def offsets(features: DataFrame, slopes_: DataFrame, gains_: DataFrame, compat: bool = False) -> DataFrame:
    """Third fit: per p, mu ~ kdl/(lbar+k2) + lbar: k1_check, k5, k4, over the buckets that have a slope.

    compat joins the slopes on lbar alone and takes the last polarity's k2 for all.
    """
    on = ["lbar"] if compat else ["p", "lbar"]
    rows = features.join(slopes_.select(*on, "a"), on)
    if compat:
        rows = rows.crossJoin(F.broadcast(gains_.agg(F.max_by("k2", "p").alias("k2"))))
    else:
        rows = rows.join(gains_.select("p", "k2"), "p")
    rows = rows.withColumn("c", F.col("kdl") / F.nullif(F.col("lbar") + F.col("k2"), F.lit(0.0)))
    plane = regression.weighted_plane(rows, "c", "lbar", "mu", "count", ["p"])
    return plane.select("p", F.col("slope_u").alias("k1_check"), F.col("slope_v").alias("k5"), F.col("intercept").alias("k4"))


def sensor_constants(fits: DataFrame, dt: float = FRAME_INTERVAL) -> DataFrame:
    """p, k1, k2, k1_check, k4, k5 from bucket fits. The three regressions need the fits four times, so what made them is run once, for a table of a row per bucket."""
    features = written(bucket_features(fits, dt))
    first = written(slopes(features))
    second = gains(first)
    return second.join(offsets(features, first, second), "p")


def synthetic_fits(spark, levels: int = 50, noise: bool = True, seed: int = 0, k1=5.0, k2=20.0, k4=1e-7, k5=5e-9, dt: float = FRAME_INTERVAL) -> DataFrame:
    """Bucket fits with known constants, for both polarities: levels of lbar in [1, 100] times levels of dl ~ N(0, 20).

    noise: 5 % on mu, 10 % on sigma. Random numbers are hashes of the row's place.
    """

    def uniform(*salt):
        return (F.shiftright(F.xxhash64(F.lit(seed), *salt), 11).bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)

    def normal(name: str, *cols):
        return F.sqrt(-2 * F.log(uniform(F.lit(name + "r"), *cols))) * F.cos(2 * 3.141592653589793 * uniform(F.lit(name + "a"), *cols))

    rows = spark.range(levels * levels * 2).select((F.col("id") % 2).cast("tinyint").alias("p"), F.floor(F.col("id") / (2 * levels)).alias("i"), (F.floor(F.col("id") / 2) % levels).alias("j"))
    rows = rows.withColumn("l", 1 + 99 * uniform(F.lit("l"), "i")).withColumn("d", 20 * normal("d", "i", "j"))
    mu = k1 * F.col("d") / dt / (F.col("l") + k2) + k4 + k5 * F.col("l")
    sigma = 0.3 * F.sqrt("l") / (F.col("l") + k2) + 0.001
    factor = (lambda name, part: 1 + part * normal(name, "p", "i", "j")) if noise else (lambda name, part: F.lit(1.0))
    return rows.select(
        "p", (F.col("l") - 0.5).alias("mean_min"), (F.col("l") + 0.5).alias("mean_max"), (F.col("d") - 0.5).alias("diff_min"), (F.col("d") + 0.5).alias("diff_max"),
        (mu * factor("m", 0.05)).alias("mu"), (sigma * factor("s", 0.1)).alias("sigma"), (200 + F.floor(1800 * uniform(F.lit("c"), "p", "i", "j"))).cast("long").alias("count"),
    )
