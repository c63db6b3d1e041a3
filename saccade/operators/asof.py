"""As-of joins of a large fact with the intervals of a smaller, time-ordered dimension.

Spark plans a bare range condition as a nested loop, so the interval join is rewritten to an equi-join on time buckets. Every
interval has the level of its length: at level k buckets are 16**k wide, and an interval not longer than that touches two of
them at most, however long the gaps between dimension rows are. A fact row looks in its own bucket of each level that
is in use (one or two where rows come at a steady rate). The open ends are handled by clamping the fact's time to the
dimension's, so neither the first nor the last interval is listed without bound. A dimension small enough for Spark's broadcast
limit is broadcast, and then the fact is not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

BASE = 16


def _one_per_time(dim: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Of dimension rows with equal time, one (they would make empty intervals)."""
    return dim.where(F.col(t).isNotNull()).dropDuplicates([*keys, t])


def _width(level: Column) -> Column:
    return F.pow(F.lit(float(BASE)), level)


def _bucketed(fact: DataFrame, intervals: DataFrame, keys: list[str], t: str, inside: Column, end: Column, how: str) -> DataFrame:
    """fact joined to the interval (keys, lo, hi, payload) for which inside holds; _least and _most are the bounds of lo and end."""
    length = F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).cast("double")
    # the tenth keeps exact powers at their own level
    levelled = intervals.withColumn("_level", F.greatest(F.ceil(F.log(length) / F.log(F.lit(float(BASE))) - 1e-9), F.lit(0)).cast("int"))
    bounds = levelled.groupBy(*keys).agg(F.min("lo").alias("_least"), F.max(end).alias("_most"), F.collect_set("_level").alias("_levels"))
    named = bounds.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    held = fact.join(named if keys else F.broadcast(named), same, "inner" if how == "inner" else "left").drop(*[f"_k_{k}" for k in keys])
    known = held.where(F.col("_levels").isNotNull() & F.col(t).isNotNull()).withColumn("_level", F.explode("_levels"))
    clamped = F.greatest("_least", F.least("_most", F.col(t)))
    known = known.withColumn("_bucket", F.floor(clamped / _width(F.col("_level"))))
    listed = levelled.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("lo") / _width(F.col("_level"))), F.floor(F.col("hi") / _width(F.col("_level"))))))
    listed = listed.withColumnsRenamed({c: f"_k_{c}" for c in (*keys, "_level", "_bucket")})
    match = inside
    for k in (*keys, "_level", "_bucket"):
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = known.join(listed, match).drop("_level", "_bucket", *[f"_k_{k}" for k in (*keys, "_level", "_bucket")])
    if how == "left":
        joined = joined.unionByName(held.where(F.col("_levels").isNull() | F.col(t).isNull()), allowMissingColumns=True)
    return joined.drop("_levels")


def intervals_from(dim: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Each dimension row with the next one: keys, cur, nxt (structs of its columns), lo, hi; the last row's own time twice."""
    rows = ordered.neighbours(_one_per_time(dim, keys, t), t, keys)
    return rows.select(*keys, "cur", F.coalesce("after", "cur").alias("nxt"), F.col(f"cur.{t}").alias("lo"), F.coalesce(F.col(f"after.{t}"), F.col(f"cur.{t}")).alias("hi"))


def asof_interpolated(fact: DataFrame, dim: DataFrame, keys: list[str] | None = None, t: str = "t", how: str = "inner") -> DataFrame:
    """fact with prev, next (structs of dim's columns) and alpha, right-sided.

    The interval is [t_i, t_i+1): before the first row both are the first, from the last row on both are the last, alpha then 0. how="left"
    keeps fact rows without any dimension row, and those without a time.
    """
    keys = keys or []
    x, first, last = F.col(t), F.col("lo") == F.col("_least"), F.col("lo") == F.col("_most")
    inside = ((x >= F.col("lo")) | first) & ((x < F.col("hi")) | last)
    out = _bucketed(fact, intervals_from(dim, keys, t), keys, t, inside, F.col("lo"), how)
    before = first & (x < F.col("lo"))
    span = (F.col("hi") - F.col("lo")).cast("double")
    alpha = F.when(before | last, 0.0).otherwise((x - F.col("lo")) / F.nullif(span, F.lit(0.0)))
    out = out.withColumn("prev", F.col("cur")).withColumn("next", F.when(before, F.col("cur")).otherwise(F.col("nxt"))).withColumn("alpha", alpha)
    return out.drop("cur", "nxt", "lo", "hi", "_least", "_most")


def asof_bracket(fact: DataFrame, dim: DataFrame, keys: list[str] | None = None, t: str = "t") -> DataFrame:
    """fact with prev and next, left-sided: intervals (t_i-1, t_i], the first and last extended outward.

    A single dimension row has no interval, so nothing joins.
    """
    keys = keys or []
    x, first, last = F.col(t), F.col("lo") == F.col("_least"), F.col("hi") == F.col("_most")
    inside = ((x > F.col("lo")) | first) & ((x <= F.col("hi")) | last)
    out = _bucketed(fact, intervals_from(dim, keys, t).where("lo < hi"), keys, t, inside, F.col("hi"), "inner")
    return out.withColumn("prev", F.col("cur")).withColumn("next", F.col("nxt")).drop("cur", "nxt", "lo", "hi", "_least", "_most")


def asof_left(fact: DataFrame, dim: DataFrame, keys: list[str] | None = None, t: str = "t") -> DataFrame:
    """fact with prev, next and alpha, left-sided: intervals (t_i-1, t_i]; up to the first row both are the first, after the last both the last, alpha then 0."""
    keys = keys or []
    x, first, last = F.col(t), F.col("lo") == F.col("_least"), F.col("lo") == F.col("_most")
    inside = ((x > F.col("lo")) | first) & ((x <= F.col("hi")) | last)
    out = _bucketed(fact, intervals_from(dim, keys, t), keys, t, inside, F.col("lo"), "inner")
    before = x <= F.col("_least")
    alpha = F.when(before | last, 0.0).otherwise((x - F.col("lo")) / (F.col("hi") - F.col("lo")).cast("double"))
    out = out.withColumn("prev", F.col("cur")).withColumn("next", F.when(before, F.col("cur")).otherwise(F.col("nxt"))).withColumn("alpha", alpha)
    return out.drop("cur", "nxt", "lo", "hi", "_least", "_most")


def asof_union(fact: DataFrame, dim: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """fact with prev, the last dimension row at or before it (null before the first), for large keyed dimensions.

    Both sides are cut into ranges of time and merged by key and range, so one key is spread over as many tasks as it has ranges; the
    last dimension row of each range is carried on to the later ones of its key by a table with a row per key and range. Of dimension
    rows with equal key and time one counts; fact rows without a time have no prev; null keys are equal.
    """
    payload = [c for c in dim.columns if c not in keys]
    kind = dim.select(F.struct(*payload).alias("s")).schema["s"].dataType
    dims = _one_per_time(dim, keys, t)
    bounds = ordered.cuts(fact.select(F.col(t).alias("_t")).where("_t is not null"), "_t")
    place = lambda c: ordered.range_of(F.col(c), bounds)
    sides = fact.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*[c for c in fact.columns if c not in keys]).alias("_fact"), F.lit(None).cast(kind).alias("prev"))
    other = dims.select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(sides.schema["_fact"].dataType).alias("_fact"), F.struct(*payload).alias("prev"))
    both = sides.where("_t is not null").unionByName(other).withColumn("_range", place("_t"))
    w = Window.partitionBy(*keys, "_range").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = both.withColumn("prev", F.last("prev", ignorenulls=True).over(w)).where("_side = 1")
    if bounds:
        lasts = other.withColumn("_range", place("_t")).groupBy(*keys, "_range").agg(F.max_by("prev", "_t").alias("_last"))
        # ranges without a dimension row take the last one before them, so all ranges of a key with rows are asked
        asked = sides.where("_t is not null").select(*keys, place("_t").alias("_range")).distinct().withColumn("_last", F.lit(None).cast(kind))
        along = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        edges = lasts.unionByName(asked).groupBy(*keys, "_range").agg(F.first("_last", ignorenulls=True).alias("_last"))
        edges = edges.select(*keys, "_range", F.last("_last", ignorenulls=True).over(along).alias("_before")).where("_before is not null")
        merged = ordered._beside(merged, edges, keys).withColumn("prev", F.coalesce("prev", "_before")).drop("_before")
    out = merged.select(*keys, "_fact.*", "prev")
    return out.unionByName(sides.where("_t is null").select(*keys, "_fact.*", "prev"))


def clock_offset(real: DataFrame, other: DataFrame) -> DataFrame:
    """The shift between two clocks (t, in order): where the ratio of their intervals is nearest to 1, first index of ties.

    One row: idx, ratio, offset (other - real). Intervals of length 0 do not count.
    """
    def steps(clock: DataFrame, name: str) -> DataFrame:
        rows = ordered.neighbours(clock.select("t"), "t").select(F.col("cur.t").alias("t"), (F.col("after.t") - F.col("cur.t")).alias("d"))
        return ordered.numbered(rows, "t").select("idx", F.col("t").alias(name), F.col("d").alias(f"d{name}"))

    a, b = steps(real, "a"), steps(other, "b")
    rows = a.join(b, "idx").where("da > 0 and db is not null").withColumn("ratio", F.col("db") / F.col("da"))
    best = F.min_by(F.struct("idx", "ratio", (F.col("b") - F.col("a")).alias("offset")), F.struct(F.abs(F.col("ratio") - 1), "idx"))
    return rows.agg(best.alias("r")).select("r.*")
