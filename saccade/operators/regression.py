"""Weighted least squares from mergeable centered moments, with one or two regressors, in one pass.

A state holds the count, the weight, the means and the centered sums of products of some rows. Tasks make a state per group from
their rows, batch by batch; two states merge by the pairwise update of means and co-moments, within the tasks and then, in trees of
``FAN`` states, by an aggregate expression. Sums are only ever taken of differences from a mean, so an offset of 1e15 (microseconds of
our days) costs no digits of the slope.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups whose states a task keeps before it hands them on; states that one expression merges.
GROUPS, FAN = 50_000, 256
#: Two regressors depend on each other when what one leaves unexplained of the other is rounding.
ROUNDING = 16 * np.finfo(np.float64).eps


def _safe(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def group_states(values: np.ndarray, weights: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts, weights, means n x k, co-moments n x pairs) of rows values (rows x k) in groups 0..n-1."""
    k = values.shape[1]
    count, total = np.bincount(group, minlength=n), np.bincount(group, weights, n)
    first = np.full(n, -1)
    first[group[::-1]] = np.arange(len(group))[::-1]
    pivot = values[first]
    whole = np.where(total == 0, 1.0, total)
    means = np.stack([pivot[:, i] + np.bincount(group, weights * (values[:, i] - pivot[group, i]), n) / whole for i in range(k)], 1)
    off = values - means[group]
    # what rounding has left of the sum of differences is taken off again
    rest = [np.bincount(group, weights * off[:, i], n) for i in range(k)]
    moments = np.stack([np.bincount(group, weights * off[:, i] * off[:, j], n) - rest[i] * rest[j] / whole for i, j in _pairs(k)], 1)
    return count, total, means, moments


def merged_states(a: tuple, b: tuple) -> tuple:
    """The state of the rows of both: (count, weight, means, co-moments)."""
    weight = a[1] + b[1]
    if not b[1] or not weight:
        return a[0] + b[0], weight, a[2], a[3] + b[3]
    apart = b[2] - a[2]
    both = np.array([apart[i] * apart[j] for i, j in _pairs(len(apart))])
    return a[0] + b[0], weight, a[2] + apart * (b[1] / weight), a[3] + b[3] + both * (a[1] * b[1] / weight)


def _merge(a: Column, b: Column, k: int) -> Column:
    """merged_states() of two structs."""
    weight = a["w"] + b["w"]
    part = F.when((b["w"] == 0) | (weight == 0), F.lit(0.0)).otherwise(b["w"] / F.nullif(weight, F.lit(0.0)))
    apart = [b["m"][i] - a["m"][i] for i in range(k)]
    means = F.array(*[a["m"][i] + apart[i] * part for i in range(k)])
    moments = F.array(*[a["c"][at] + b["c"][at] + apart[i] * apart[j] * (a["w"] * part) for at, (i, j) in enumerate(_pairs(k))])
    return F.struct((a["n"] + b["n"]).alias("n"), weight.alias("w"), means.alias("m"), moments.alias("c"))


def moments(rows: DataFrame, columns: tuple[str, ...], weight: str, by: list[str]) -> DataFrame:
    """by, n, total, m_<a> (means), c_<a>_<b> (centered sums of products) of weighted rows.

    Rows with a null column or weight do not count; null keys are equal. The merge goes by task and group, so reruns over the same tasks agree.
    """
    k, pairs = len(columns), _pairs(len(columns))
    picked = rows.select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)], F.col(weight).cast("double").alias("_w"))
    picked = picked.where(" and ".join(f"_v{i} is not null" for i in range(k)) + " and _w is not null")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        kept: dict[tuple, pa.RecordBatch] = {}

        def hand_on() -> pa.RecordBatch:
            keys = pa.Table.from_batches(list(kept.values())).combine_chunks() if by else None
            states = list(held.values())
            at = np.arange(len(states) + 1, dtype=np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at * size), pa.array(np.concatenate([s[i] for s in states]))) for i, size in ((2, k), (3, len(pairs)))]
            columns_ = [*(keys.column(i).combine_chunks() for i in range(len(by))), pa.array([int(s[0]) for s in states]), pa.array([float(s[1]) for s in states]), *lists]
            return pa.RecordBatch.from_arrays(columns_, names=[*by, "n", "w", "m", "c"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pa.Table.from_batches([batch]).select(list(range(len(by))))
            group = keys.to_pandas().groupby(list(keys.column_names), dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(batch.num_rows, np.int64)
            n = int(group.max()) + 1
            values = np.stack([batch.column(len(by) + i).to_numpy() for i in range(k)], 1)
            found = group_states(values, batch.column(len(by) + k).to_numpy(), group, n)
            first = np.full(n, -1)
            first[group[::-1]] = np.arange(len(group))[::-1]
            names = list(zip(*(keys.column(i).take(pa.array(first)).to_pylist() for i in range(len(by))), strict=True)) if by else [()]
            for g, name in enumerate(names):
                state = tuple(part[g] for part in found)
                if name in held:
                    held[name] = merged_states(held[name], state)
                else:
                    held[name] = state
                    kept[name] = batch.select(list(range(len(by)))).slice(int(first[g]), 1) if by else None
            if len(held) >= GROUPS:
                yield hand_on()
                held, kept = {}, {}
        if held:
            yield hand_on()

    made = picked.mapInArrow(run, f"{kinds + ', ' if by else ''}n long, w double, m array<double>, c array<double>")
    state = F.struct("n", "w", "m", "c")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("w"), F.array(*[F.lit(0.0)] * k).alias("m"), F.array(*[F.lit(0.0)] * len(pairs)).alias("c"))

    def folded(states: DataFrame, keys: list) -> DataFrame:
        listed = states.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_task", "n", "w", "m", "c"))).alias("s"))
        # the first state opens the fold: means of nothing are no means
        rest = F.slice("s", 2, F.size("s"))
        opening = F.get("s", F.lit(0))
        first = F.struct(*[opening[c].alias(c) for c in ("n", "w", "m", "c")])
        return listed.select(*keys, F.aggregate(rest, F.when(F.size("s") > 0, first).otherwise(zero), lambda a, b: _merge(a, b, k)).alias("s"))

    tasks = made.withColumn("_task", F.spark_partition_id())
    tasks = tasks.withColumn("_bough", F.floor(F.col("_task") / FAN))
    boughs = folded(tasks, [*by, "_bough"]).select(*by, F.col("_bough").alias("_task"), "s.*")
    out = folded(boughs, by)
    named = [F.col("s.m")[i].alias(f"m_{c}") for i, c in enumerate(columns)] + [F.col("s.c")[at].alias(f"c_{columns[i]}_{columns[j]}") for at, (i, j) in enumerate(pairs)]
    return out.select(*by, F.col("s.n").alias("n"), F.col("s.w").alias("total"), *named)


def weighted_line(df: DataFrame, x: str, y: str, weight: str, by: list[str], least: int = 1) -> DataFrame:
    """by, n, total (weight), slope, intercept of y ~ x; groups with fewer than least rows go, a constant x gives nulls."""
    rows = df.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(weight).alias("_weight"))
    sums = moments(rows, ("_x", "_y"), "_weight", by).where(F.col("n") >= least)
    out = sums.withColumn("slope", _safe(F.col("c__x__y"), F.col("c__x__x")))
    return out.withColumn("intercept", F.col("m__y") - F.col("slope") * F.col("m__x")).select(*by, "n", "total", "slope", "intercept")


def weighted_plane(df: DataFrame, u: str, v: str, y: str, weight: str, by: list[str]) -> DataFrame:
    """by, n, slope_u, slope_v, intercept of y ~ u + v; nulls where the regressors depend on each other, as far as doubles tell."""
    rows = df.select(*by, F.col(u).alias("_u"), F.col(v).alias("_v"), F.col(y).alias("_y"), F.col(weight).alias("_weight"))
    c = {a + b: F.col(f"c__{a}__{b}") for a, b in ("uu", "uv", "uy", "vv", "vy")}
    det = c["uu"] * c["vv"] - c["uv"] * c["uv"]
    det = F.when(det > ROUNDING * c["uu"] * c["vv"], det)
    out = moments(rows, ("_u", "_v", "_y"), "_weight", by)
    out = out.withColumn("slope_u", (c["uy"] * c["vv"] - c["vy"] * c["uv"]) / det).withColumn("slope_v", (c["vy"] * c["uu"] - c["uy"] * c["uv"]) / det)
    return out.withColumn("intercept", F.col("m__y") - F.col("slope_u") * F.col("m__u") - F.col("slope_v") * F.col("m__v")).select(*by, "n", "slope_u", "slope_v", "intercept")
