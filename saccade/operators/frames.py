"""Frames: consecutive differences, naive events, statistics, event maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import ordered


def consecutive(pixels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """pixels (frame_idx, t, x, y, lum) with the same pixel's previous luminance and time (null in its first frame)."""
    return ordered.lagged(pixels, "frame_idx", [*keys, "x", "y"], ("lum", "t", "frame_idx")).withColumnRenamed("prev_frame_idx", "prev_idx")


def naive_events(pixels: DataFrame, threshold: float = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """Events where a pixel changed by more than threshold since the frame before; t is the later frame's.

    A pixel that the frame before does not have makes no event. Luminance differences are taken in full width.
    """
    diff = F.col("lum") - F.col("prev_lum")
    rows = consecutive(pixels, keys).where(F.col("prev_idx") == F.col("frame_idx") - 1)
    return rows.where(F.abs(diff) > threshold).select(*keys, "t", "x", "y", F.when(diff > 0, 1).otherwise(0).cast("tinyint").alias("p"))


def frame_statistics(pixels: DataFrame, full_scale: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per frame mean, population variance and range, each divided by full scale (variance by its square)."""
    v = F.col("lum").cast("double")
    return pixels.groupBy(*keys, "frame_idx").agg(
        (F.avg(v) / full_scale).alias("mean"),
        (F.var_pop(v) / (full_scale * full_scale)).alias("variance"),
        ((F.max(v) - F.min(v)) / full_scale).alias("range"),
    )


def event_map(events: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The raster's last value per pixel: -1 or 1; at equal times the OFF event is drawn last."""
    return events.groupBy(*keys, "x", "y").agg(F.max_by(F.when(F.col("p") > 0, 1).otherwise(-1), F.struct("t", 1 - F.col("p"))).alias("value"))


def resolution(events: DataFrame) -> DataFrame:
    return events.agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def prepared_events(events: DataFrame) -> DataFrame:
    """Events for a recording: boolean polarity, t >= 0 only, ordered by t."""
    return events.where("t >= 0").select("t", "x", "y", (F.col("p") > 0).alias("p")).orderBy("t", "x", "y", "p")


def late_cutoff(events: DataFrame, frame_t: str = "frame_t") -> DataFrame:
    """Of each pixel's events only those later than the last earlier frame that had events (batch form of the live cut-off)."""
    frames = ordered.neighbours(events.select(frame_t).distinct(), frame_t)
    before = frames.select(F.col(f"cur.{frame_t}").alias(frame_t), F.col(f"before.{frame_t}").alias("_cut"))
    return events.join(before, frame_t).where("_cut is null or t > _cut").drop("_cut")


def _broken(width: int, height: int) -> dict[str, Column]:
    """Conditions of rows that break the event schema."""
    return {
        "bad_time": F.col("t").isNull() | (F.col("t") < 0),
        "out_of_frame": ~F.col("x").between(0, width - 1) | ~F.col("y").between(0, height - 1),
        "bad_polarity": ~F.col("p").isin(0, 1),
    }


def validity_report(events: DataFrame, width: int, height: int) -> DataFrame:
    """Counts of rows that break the event schema."""
    return events.agg(F.count("*").alias("events"), *[F.count_if(c).alias(n) for n, c in _broken(width, height).items()])


def observed_validity(events: DataFrame, width: int, height: int, name: str = "validity") -> tuple[DataFrame, Observation]:
    """(events, observation): validity_report()'s counts, gathered by the pass that does the work on the returned events; no scan of their own.

    After the first action on what is made of the events, observation.get has the counts; that action has to read all of them (a limit does
    not). Streams: see streaming.events.observed_stream().
    """
    seen = Observation(name)
    return events.observe(seen, F.count(F.lit(1)).alias("events"), *[F.count_if(c).alias(n) for n, c in _broken(width, height).items()]), seen
