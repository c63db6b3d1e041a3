"""Voxel grids: events split bilinearly over time bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def voxel_grid(events: DataFrame, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sparse grid (bin, y, x, val) over the time range of the events; ON counts 1, OFF -1.

    An event between two bins gives each its share; nothing falls beyond the last bin.
    """
    bounds = events.groupBy(*keys).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    joined = events.join(bounds, list(keys)) if keys else events.crossJoin(F.broadcast(bounds))
    span = F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1))
    tau = (bins - 1) * (F.col("t") - F.col("_t0")) / span
    placed = joined.withColumn("_tau", tau).withColumn("_i", F.floor("_tau"))
    part = F.col("_tau") - F.col("_i")
    sign = F.when(F.col("p") > 0, 1.0).otherwise(-1.0)
    both = F.array(F.struct(F.col("_i").alias("bin"), (sign * (1 - part)).alias("val")), F.struct((F.col("_i") + 1).alias("bin"), (sign * part).alias("val")))
    split = placed.select(*keys, "x", "y", F.explode(both).alias("v")).where(F.col("v.bin") < bins)
    return split.groupBy(*keys, F.col("v.bin").alias("bin"), "y", "x").agg(F.sum("v.val").alias("val"))


def normalized_slices(grid: DataFrame, width: int, height: int) -> DataFrame:
    """grid with level: val scaled to [0, 1] within its bin, zero cells counted; null where a slice is constant."""
    cells = grid.groupBy("bin").agg(F.min("val").alias("lo"), F.max("val").alias("hi"), F.count("*").alias("n"))
    full = F.col("n") == width * height
    cells = cells.select("bin", F.when(full, F.col("lo")).otherwise(F.least("lo", F.lit(0.0))).alias("lo"), F.when(full, F.col("hi")).otherwise(F.greatest("hi", F.lit(0.0))).alias("hi"))
    return grid.join(cells, "bin").withColumn("level", (F.col("val") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).drop("lo", "hi")
