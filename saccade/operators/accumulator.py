"""The leaky accumulator: a level per pixel that decays linearly to neutral and is pushed by events, as frames of time slices.

One event's effect on a level (soft decay over the time since the last one, a push, a clamp to [0, 1]) is a monotone piecewise-linear map with
slopes 0 and 1, and so is any chain of them. That is what makes a pixel's history foldable in parallel: events are range-sorted by
pixel and time, every task folds its part, and where a pixel goes on from one task to the next the later part is folded as a map of
the unknown level before it. Maps of a pixel's parts merge in trees of ``FAN``, the levels at the parts' begins come back down, and the rows
that waited for them are filled in. A map is constant as soon as it maps 0 and 1 to the same level, which a few events of one
polarity do; from there on a part does not depend on what was before.

Edge cases: a pixel is neutral at its first event; of events of equal time OFF comes first; rows with a null time, pixel or
polarity do not count; null keys are one key; equal events count each. No events, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

# fixed values: the live accumulator's contribution, neutral level and decay per microsecond
CONTRIBUTION, NEUTRAL, DECAY = 0.25, 0.5, 1e-6
#: Microseconds of a preview slice.
SLICE = 33_000
#: Events that are folded step by step, side by side with other pieces; parts of a pixel that one group merges.
PIECE, FAN = 64, 64


def decayed(level, dt, decay: float = DECAY):
    """Levels after dt without events."""
    away = level - NEUTRAL
    return NEUTRAL + np.sign(away) * np.maximum(np.abs(away) - decay * dt, 0.0)


def stepped(level, dt, p, contribution: float = CONTRIBUTION, decay: float = DECAY):
    """Levels after an event of polarity p, dt after the one before."""
    return np.clip(decayed(level, dt, decay) + np.where(np.asarray(p) > 0, contribution, -contribution), 0.0, 1.0)


class LevelMap:
    """A monotone piecewise-linear map of [0, 1] by its corners."""

    def __init__(self, xs: np.ndarray | None = None, ys: np.ndarray | None = None):
        self.xs = np.array([0.0, 1.0]) if xs is None else np.asarray(xs, float)
        self.ys = self.xs.copy() if ys is None else np.asarray(ys, float)

    @property
    def constant(self) -> bool:
        return self.ys[0] == self.ys[-1]

    def __call__(self, level):
        return np.interp(level, self.xs, self.ys)

    def _corner(self, y: float) -> LevelMap:
        """With a corner where the map passes y."""
        at = np.searchsorted(self.ys, y, "left")
        if at == 0 or at == len(self.ys) or self.ys[at] == y:
            return self
        return LevelMap(np.insert(self.xs, at, self.xs[at - 1] + (y - self.ys[at - 1])), np.insert(self.ys, at, y))

    def _simple(self) -> LevelMap:
        """Without corners that are none."""
        rise = np.diff(self.ys) > 0
        keep = np.ones(len(self.xs), bool)
        keep[1:-1] = rise[1:] != rise[:-1]
        return LevelMap(self.xs[keep], self.ys[keep])

    def then_decay(self, dt: float, decay: float = DECAY) -> LevelMap:
        low = self._corner(NEUTRAL - decay * dt)._corner(NEUTRAL + decay * dt)
        return LevelMap(low.xs, decayed(low.ys, dt, decay))._simple()

    def then_event(self, dt: float, p: int, contribution: float = CONTRIBUTION, decay: float = DECAY) -> LevelMap:
        after = self.then_decay(dt, decay)._corner(1 - contribution if p > 0 else contribution)
        return LevelMap(after.xs, np.clip(after.ys + (contribution if p > 0 else -contribution), 0.0, 1.0))._simple()

    def then(self, other: LevelMap) -> LevelMap:
        out = self
        for x in other.xs:
            out = out._corner(float(x))
        return LevelMap(out.xs, other(out.ys))._simple()


def fold(level: np.ndarray, starts: np.ndarray, sizes: np.ndarray, dt: np.ndarray, p: np.ndarray, contribution: float, decay: float) -> np.ndarray:
    """Levels (pieces x any) after the events of each piece: step j of all pieces at once."""
    level = level.copy()
    for j in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > j)
        at = starts[on] + j
        shape = (-1,) + (1,) * (level.ndim - 1)
        level[on] = stepped(level[on], dt[at].reshape(shape), p[at].reshape(shape), contribution, decay)
    return level


class _Part:
    """The events of one task, in order, batch by batch."""

    def __init__(self, keys: int, slice_: int | None, contribution: float, decay: float, piece: int):
        self.keys, self.slice, self.c, self.decay, self.piece = keys, slice_, contribution, decay, piece
        self.number = TaskContext.get().partitionId()
        self.pixel = None  # of the open run: its key
        self.level: float | None = None
        self.map: LevelMap | None = None  # while the level before the task's first run matters
        self.t = self.first_t = self.group = self.n = 0
        self.first_run, self.first_group = True, True
        self.rows: list[tuple] = []

    def _state(self) -> tuple:
        if self.map is not None and self.map.constant:
            self.level, self.map = float(self.map.ys[0]), None
        return (self.level, None, None) if self.map is None else (None, self.map.xs.tolist(), self.map.ys.tolist())

    def _close_group(self, last: bool = False) -> None:
        self.rows.append((*self.pixel, self.group, self.t, self.n, *self._state(), self.number, self.first_t, self.first_group or last, False))
        self.first_group, self.n = False, 0

    def _close_run(self, last: bool = False) -> None:
        if self.first_run or last:  # what the parts after this one, or before it, must know
            level, xs, ys = self._state()
            if level is not None:
                xs, ys = [0.0, 1.0], [level, level]
            self.rows.append((*self.pixel, None, self.t, 0, None, xs, ys, self.number, self.first_t, self.first_run, True))
        self.first_run = False

    def feed(self, columns: list[np.ndarray], t: np.ndarray, p: np.ndarray) -> None:
        n = len(t)
        new = np.zeros(n, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = self.pixel is None or self.pixel != tuple(c[0] for c in columns)
        group = t // self.slice if self.slice else np.zeros(n, np.int64)
        cut = new.copy()
        cut[1:] |= group[1:] != group[:-1]
        cut[0] |= group[0] != self.group
        dt = np.diff(t, prepend=t[0] if new[0] else self.t)
        dt[new] = 0
        # pieces: runs of one pixel and slice, cut after so many events
        starts = np.flatnonzero(cut | (np.arange(n) == 0))
        sizes = np.diff(np.append(starts, n))
        many = -(-sizes // self.piece)
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        starts = np.repeat(starts, many) + inner * self.piece
        sizes = np.diff(np.append(starts, n))
        ends = fold(np.tile([0.0, 1.0], (len(starts), 1)), starts, sizes, dt, p, self.c, self.decay)
        constant = ends[:, 0] == ends[:, 1]
        level = np.where(constant, ends[:, 0], np.nan)
        begin = np.full(len(starts), np.nan)
        begin[new[starts]] = NEUTRAL
        if new[0] and self.pixel is None:
            begin[0] = np.nan  # the task's first run: what was before is not known here
            self.map = LevelMap()
        elif not new[0]:
            begin[0] = np.nan if self.map is not None else self.level
        follows = ~new[starts]
        follows[0] = False
        while True:  # pieces that begin where a known one ends
            ready = np.flatnonzero(~np.isnan(begin) & np.isnan(level))
            if len(ready):
                level[ready] = fold(begin[ready], starts[ready], sizes[ready], dt, p, self.c, self.decay)
            after = np.flatnonzero(follows[1:] & np.isnan(begin[1:]) & ~np.isnan(level[:-1]) & np.isnan(level[1:])) + 1
            if not len(after):
                break
            begin[after] = level[after - 1]
        for i in range(len(starts)):
            a, b = int(starts[i]), int(starts[i] + sizes[i])
            if new[a]:
                if self.pixel is not None:
                    self._close_group()
                    self._close_run()
                    self.map = None
                self.pixel, self.first_t, self.group = tuple(c[a] for c in columns), int(t[a]), int(group[a])
            elif cut[a]:
                self._close_group()
                self.group = int(group[a])
            if not np.isnan(level[i]):
                self.level, self.map = float(level[i]), None
            elif self.map is None:  # the pieces before it together were constant
                self.level = float(fold(np.array([self.level]), starts[i : i + 1], sizes[i : i + 1], dt, p, self.c, self.decay)[0])
            else:
                for j in range(a, b):
                    self.map = self.map.then_event(float(dt[j]), int(p[j]), self.c, self.decay)
            self.t, self.n = int(t[b - 1]), self.n + b - a

    def finish(self) -> None:
        if self.pixel is not None:
            self._close_group(last=True)
            self._close_run(last=True)


def _fold_parts(events: DataFrame, pixel: list[str], slice_: int | None, contribution: float, decay: float, piece: int) -> DataFrame:
    """Rows of closed slices and of the ends of the tasks' parts; see accumulated()."""
    fields = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in pixel)
    schema = f"{fields}, slice long, t long, n long, level double, xs array<double>, ys array<double>, part int, first_t long, split boolean, edge boolean"
    names = [*pixel, "slice", "t", "n", "level", "xs", "ys", "part", "first_t", "split", "edge"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()]
    k = len(pixel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, types = _Part(k, slice_, contribution, decay, piece), None

        def out() -> pa.RecordBatch:
            columns = list(zip(*part.rows, strict=True))
            part.rows = []
            return pa.RecordBatch.from_arrays([pa.array([v.item() if isinstance(v, np.generic) else v for v in c], kind) for c, kind in zip(columns, [*types, *kinds], strict=True)], names=names)

        for batch in batches:
            if batch.num_rows:
                types = [batch.column(i).type for i in range(k)]
                columns = [batch.column(i).to_numpy(zero_copy_only=False) if not batch.column(i).null_count else np.array(batch.column(i).to_pylist(), object) for i in range(k)]
                part.feed(columns, batch.column(k).to_numpy(), batch.column(k + 1).to_numpy())
                if part.rows:
                    yield out()
        part.finish()
        if part.rows:
            yield out()

    order = [*pixel, "t", "p", "_i"]
    rows = events.where("t is not null and x is not null and y is not null and p is not null").select(*pixel, F.col("t").cast("long").alias("t"), (F.col("p") > 0).cast("int").alias("p"), F.monotonically_increasing_id().alias("_i"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*pixel, "t", "p").mapInArrow(run, schema)


def _starts(edges: DataFrame, pixel: list[str], decay: float, fan: int) -> DataFrame:
    """part, before, before_t: level and time before the first run of each part that continues a pixel, by a tree over the parts."""

    def maps(table: pa.Table) -> list[tuple[int, int, int, LevelMap]]:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "first_t", "t", "xs", "ys")), strict=True))
        return [(part, first, last, LevelMap(xs, ys)) for part, first, last, xs, ys in rows]

    def merge(table: pa.Table) -> pa.Table:
        rows = maps(table)
        _, first_t, t, whole = rows[0]
        for _, first, last, own in rows[1:]:
            whole, t = whole.then_decay(first - t, decay).then(own), last
        return pa.table({**{c: table.column(c).slice(0, 1) for c in (*pixel, "bough")}, "first_t": [first_t], "t": [t], "xs": pa.array([whole.xs.tolist()]), "ys": pa.array([whole.ys.tolist()]), "part": pa.array([rows[0][0]], pa.int32())})

    def scan(table: pa.Table) -> pa.Table:
        """Levels before each part of a group; the group's own begin is in before and before_t where it has one."""
        rows = maps(table)
        level, t = table.column("before")[0].as_py(), table.column("before_t")[0].as_py()
        numbers, levels, times = [], [], []
        for part, first, last, own in rows:
            numbers.append(part), levels.append(level), times.append(t)
            begin = NEUTRAL if level is None else float(decayed(level, first - t, decay))
            level, t = float(own(begin)), last
        return pa.table({**{c: table.column(c).slice(0, 1).combine_chunks().take(pa.array([0] * len(rows))) for c in (*pixel, "bough")}, "part": pa.array(numbers, pa.int32()), "before": pa.array(levels, pa.float64()), "before_t": pa.array(times, pa.int64())})

    kinds = ", ".join(f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in pixel)
    edges = edges.select(*pixel, "part", "first_t", "t", "xs", "ys", F.floor(F.col("part") / fan).alias("bough"))
    none = [F.lit(None).cast("double").alias("before"), F.lit(None).cast("long").alias("before_t")]
    boughs = edges.groupBy(*pixel, "bough").applyInArrow(merge, f"{kinds}, bough long, first_t long, t long, xs array<double>, ys array<double>, part int")
    above = boughs.select("*", *none).groupBy(*pixel).applyInArrow(scan, f"{kinds}, bough long, part int, before double, before_t long")
    named = above.select(*[F.col(c).alias(f"_k_{c}") for c in pixel], F.col("part").alias("_first"), "before", "before_t")
    # a bough is known by its first part, as the scan over boughs names them
    firsts = boughs.select(*pixel, "bough", F.col("part").alias("_begin"))
    same = F.col("_begin") == F.col("_first")
    for c in pixel:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    given = firsts.join(named, same).select(*[F.col(c).alias(f"_g_{c}") for c in pixel], F.col("bough").alias("_bough"), "before", "before_t")
    same = F.col("bough") == F.col("_bough")
    for c in pixel:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    below = edges.join(given, same).select(*edges.columns, "before", "before_t")
    return below.groupBy(*pixel, "bough").applyInArrow(scan, f"{kinds}, bough long, part int, before double, before_t long")


def _mapped(level: Column, xs: str, ys: str) -> Column:
    """The map (xs, ys) at level: slopes are 0 or 1, so a piece gives its begin and what the level is beyond it, up to its rise."""
    pieces = F.sequence(F.lit(0), F.size(xs) - 2)
    piece = lambda i: F.when(F.get(xs, i) <= level, F.get(ys, i) + F.least(level - F.get(xs, i), F.get(ys, i + 1) - F.get(ys, i)))
    return F.array_max(F.transform(pieces, piece))


def decayed_column(level: Column, dt: Column, decay: float = DECAY) -> Column:
    away = level - NEUTRAL
    return NEUTRAL + F.signum(away) * F.greatest(F.abs(away) - decay * dt, F.lit(0.0))


def accumulated(events: DataFrame, slice_: int | None = SLICE, keys: tuple[str, ...] = (), contribution: float = CONTRIBUTION, decay: float = DECAY, piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """keys, x, y, slice, n, t, level: per slice in which a pixel has events their number, the last one's time, and the level after it.

    slice counts spans of slice_ microseconds from time 0; None: all of time is slice 0.
    """
    pixel = [*keys, "x", "y"]
    local = written(_fold_parts(events, pixel, slice_, contribution, decay, piece))
    # at most two rows of a part are ends, and one run of it waits for what was before
    starts = _starts(local.where("edge"), pixel, decay, fan).select(F.col("part").alias("_part"), *[F.col(c).alias(f"_k_{c}") for c in pixel], "before", "before_t")
    rows = local.where("not edge")
    known = rows.where("level is not null").select(*pixel, "slice", "n", "t", "level", "part", "split")
    same = F.col("part") == F.col("_part")
    for c in pixel:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    waiting = rows.where("level is null").join(starts, same)
    begin = F.when(F.col("before").isNull(), F.lit(NEUTRAL)).otherwise(decayed_column(F.col("before"), F.col("first_t") - F.col("before_t"), decay))
    filled = waiting.withColumn("_begin", begin).select(*pixel, "slice", "n", "t", _mapped(F.col("_begin"), "xs", "ys").alias("level"), "part", "split")
    rows = known.unionByName(filled)
    # a slice that goes on in the next part: its last row has the level
    whole = rows.where("split").groupBy(*pixel, "slice").agg(F.sum("n").alias("n"), F.max("t").alias("t"), F.max_by("level", "part").alias("level"))
    columns = [*pixel, "slice", "n", "t", "level"]
    return rows.where("not split").select(*columns).unionByName(whole.select(*columns))


def slice_frames(events: DataFrame, slice_: int = SLICE, keys: tuple[str, ...] = (), decay: float = DECAY, **options) -> DataFrame:
    """accumulated() with end, the slice's end, and shown, the level decayed up to it: the pixels that a preview frame changes."""
    out = accumulated(events, slice_, keys, decay=decay, **options)
    end = (F.col("slice") + 1) * F.lit(slice_)
    return out.withColumn("end", end).withColumn("shown", decayed_column(F.col("level"), end - F.col("t"), decay))


def accumulate(events: DataFrame, until: int | None = None, keys: tuple[str, ...] = (), contribution: float = CONTRIBUTION, decay: float = DECAY, **options) -> DataFrame:
    """keys, x, y, level, t: the level in [0, 1] after each pixel's last event, at t, decayed up to until if it is given."""
    out = accumulated(events, None, keys, contribution, decay, **options)
    level = F.col("level") if until is None else decayed_column(F.col("level"), F.greatest(F.lit(until) - F.col("t"), F.lit(0)), decay)
    return out.select(*keys, "x", "y", level.alias("level"), "t")
