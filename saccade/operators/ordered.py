"""Order across a whole table without one task for all of it: neighbours, numbers and exact medians by ranges.

A table is cut into ranges of about ``WINDOW_ROWS`` rows by approximate quantiles. Windows then run within a range, and what crosses
from one range to the next comes from a table of one row per range (and key).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_ROWS = 1_000_000
#: Ranges that a table is cut into at most; beyond, the ranges get longer and their sorts spill.
MOST_RANGES = 10_000


def cuts(df: DataFrame, value: str) -> list:
    """Cuts between ranges of about WINDOW_ROWS rows; none for a table that is one range."""
    n = min(MOST_RANGES, df.count() // WINDOW_ROWS + 1)
    if n == 1:
        return []
    found = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10 * n)).first()[0]
    return sorted(set(found or []))


def range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most value, by binary search."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(b) for b in bounds])
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        below, go = F.get(array, mid) <= value, s.lo < s.hi
        return F.struct(F.when(go & below, mid + 1).otherwise(s.lo).alias("lo"), F.when(go & ~below, mid).otherwise(s.hi).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(steps, start, step, lambda s: s.lo)


def _beside(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined to edges (keys, _range, ...), where null keys are equal."""
    named = edges.withColumnsRenamed({k: f"_of_{k}" for k in (*keys, "_range")})
    match = F.col("_range") == F.col("_of__range")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(named, match, "left").drop(*[f"_of_{k}" for k in (*keys, "_range")])


def neighbours(df: DataFrame, t: str, keys: list[str] | None = None) -> DataFrame:
    """keys, cur, before, after: structs of df's other columns of each row, the one before and the one after it by t (null at the ends)."""
    keys = keys or []
    bounds = cuts(df, t)
    rows = df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias("cur"), range_of(F.col(t), bounds).alias("_range"))
    w = Window.partitionBy(*keys, "_range").orderBy(f"cur.{t}", "cur")  # rows of equal t stand by their other columns
    out = rows.withColumn("before", F.lag("cur").over(w)).withColumn("after", F.lead("cur").over(w))
    if bounds:
        edges = rows.groupBy(*keys, "_range").agg(F.min_by("cur", F.struct(f"cur.{t}", "cur")).alias("_first"), F.max_by("cur", F.struct(f"cur.{t}", "cur")).alias("_last"))
        along = Window.partitionBy(*keys).orderBy("_range")
        edges = edges.select(*keys, "_range", F.lag("_last").over(along).alias("_left"), F.lead("_first").over(along).alias("_right"))
        out = _beside(out, edges, keys).withColumn("before", F.coalesce("before", "_left")).withColumn("after", F.coalesce("after", "_right"))
    return out.select(*keys, "cur", "before", "after")


def lagged(df: DataFrame, t: str, keys: list[str], columns: tuple[str, ...], first: str | None = None) -> DataFrame:
    """df with prev_<c> of each of columns: the value in the key's row before, by t, then by df's other columns; null in its first row.

    A key with many rows is split at the ranges' bounds; over them the last row of a key's ranges is carried by a table of one row each.
    first: a column that orders equal t before the others.
    """
    bounds = cuts(df, t)
    rest = [c for c in df.columns if c not in keys and c not in (t, first)]
    order = [F.col(f"`{c}`") for c in (t, *([first] if first else []), *rest)]
    if not bounds:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})
    rows = df.withColumn("_range", range_of(F.col(t), bounds))
    w = Window.partitionBy(*keys, "_range").orderBy(*order)
    own = F.struct(*[F.col(c).alias(c) for c in columns])
    out = rows.withColumn("_prev", F.lag(own).over(w))
    lasts = rows.groupBy(*keys, "_range").agg(F.max_by(own, F.struct(*order)).alias("_last"))
    edges = lasts.select(*keys, "_range", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")).alias("_left"))
    out = _beside(out, edges, keys).withColumn("_prev", F.coalesce("_prev", "_left"))
    return out.withColumns({f"prev_{c}": F.col(f"_prev.{c}") for c in columns}).drop("_range", "_prev", "_left")


def counted(df: DataFrame, keys: list[str], least: int, of: DataFrame | None = None) -> DataFrame:
    """Rows of df whose key has least rows or more (in of, if given); keys are counted first, so none has to meet in one task."""
    many = (df if of is None else of).groupBy(*keys).count().where(F.col("count") >= least).select(*[F.col(c).alias(f"_of_{c}") for c in keys])
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return df.join(many, match, "left_semi")


def numbered(df: DataFrame, t: str, name: str = "idx") -> DataFrame:
    """df with the number of each row by t, then its other columns, from 1."""
    bounds = cuts(df, t)
    rows = df.withColumn("_range", range_of(F.col(t), bounds))
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(t, *[F.col(f"`{c}`") for c in df.columns if c != t])))
    if bounds:
        sizes = rows.groupBy("_range").count()
        earlier = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = _beside(out, sizes.select("_range", earlier.alias("_earlier")), []).withColumn(name, F.col(name) + F.col("_earlier")).drop("_earlier")
    return out.drop("_range")


def median(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, median (exact, the mean of the middle two) of value; nulls do not count.

    Only the ranges that hold the middle values are sorted.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    bounds = cuts(rows, "_v")
    if not bounds:
        return rows.groupBy(*by).agg(F.percentile("_v", F.lit(0.5)).alias("median"))
    rows = rows.withColumn("_range", range_of(F.col("_v"), bounds))
    along = Window.partitionBy(*by)
    sizes = rows.groupBy(*by, "_range").count().withColumn("_n", F.sum("count").over(along))
    sizes = sizes.withColumn("_until", F.sum("count").over(along.orderBy("_range"))).withColumn("_from", F.col("_until") - F.col("count"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    holds = ((F.col("_from") <= low) & (low < F.col("_until"))) | ((F.col("_from") <= high) & (high < F.col("_until")))
    inside = _beside(rows, sizes.where(holds).select(*by, "_range", "_n", "_from"), list(by)).where("_n is not null")
    at = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_v")) - 1 + F.col("_from")
    return inside.withColumn("_at", at).where((F.col("_at") == low) | (F.col("_at") == high)).groupBy(*by).agg(F.avg("_v").alias("median"))


def strided(df: DataFrame, parts: int, t: str) -> DataFrame:
    """df with part: every parts-th row by t belongs to the same one, from 0."""
    return numbered(df, t, "_idx").withColumn("part", F.pmod(F.col("_idx") - 1, F.lit(parts)).cast("int")).drop("_idx")


def _border(counts: DataFrame, most: int) -> tuple[int, int]:
    """Of counts (bucket, count; 2**16 buckets at most): the bucket in which the most-th row lies, and the rows before it."""
    found = counts.toArrow()
    order = np.argsort(found.column("bucket").to_numpy())
    buckets, until = found.column("bucket").to_numpy()[order], np.cumsum(found.column("count").to_numpy()[order])
    at = int(np.searchsorted(until, most, "left"))
    if at == len(buckets):
        return 1 << 16, int(until[-1]) if len(until) else 0
    return int(buckets[at]), int(until[at - 1]) if at else 0


def subsample(df: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """most rows of df at random, the same for the same rows and seed; all if there are fewer.

    Every row draws a hash of itself. Counts per range of draws, twice 2**16 of them, tell below which draw the rows are wanted; only those in
    the one range of 2**-32 of all draws that holds the border are put in order, equal rows as one with their number. Equal rows draw alike.
    """
    drawn = df.withColumn("_draw", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]))
    high, low = F.expr("shiftrightunsigned(_draw, 48)"), F.expr("shiftrightunsigned(_draw, 32) & 65535")
    b, before = _border(drawn.groupBy(high.alias("bucket")).count(), most)
    if b == 1 << 16:
        return df
    c, inside = _border(drawn.where(high == b).groupBy(low.alias("bucket")).count(), most - before)
    whole = drawn.where((high < b) | ((high == b) & (low < c))).drop("_draw")
    keys = [F.col(f"`{k}`") for k in df.columns]
    edge = drawn.where((high == b) & (low == c)).groupBy(*keys, "_draw").agg(F.count("*").alias("_n"))
    until = F.sum("_n").over(Window.orderBy("_draw", *keys).rowsBetween(Window.unboundedPreceding, 0))
    left = F.least(F.col("_n"), F.lit(most - before - inside) - (until - F.col("_n")))
    some = edge.withColumn("_left", left).where("_left > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_left").cast("int"))))
    return whole.unionByName(some.select(*keys))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts by column name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.select("*") for p in parts])
