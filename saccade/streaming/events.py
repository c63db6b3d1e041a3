"""Structured Streaming over event and frame streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import accumulator, frames, simulate
from ..operators.accumulator import CONTRIBUTION, DECAY, PIECE, SLICE, accumulate  # noqa: F401
from ..params import Sensor, preset


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Events from a folder of Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def event_time(t: Column) -> Column:
    return F.timestamp_micros(t)


def tumbling_counts(events: DataFrame, width: str = "33 milliseconds", late: str | None = None, start: str | None = None) -> DataFrame:
    """start_us, events, on_events per tumbling window; batch or stream (late: the watermark). start shifts the windows' origin."""
    timed = events.withColumn("_time", event_time(F.col("t")))
    if late:
        timed = timed.withWatermark("_time", late)
    window = F.window("_time", width, width, start) if start else F.window("_time", width)
    out = timed.groupBy(window.alias("w")).agg(F.count("*").alias("events"), F.sum(F.when(F.col("p") > 0, 1).otherwise(0)).alias("on_events"))
    return out.select(F.unix_micros("w.start").alias("start_us"), "events", "on_events")


def only_later(events: DataFrame, keys: str = "x long, y long") -> DataFrame:
    """Per key the events later than all seen before; within a batch in time order. Late and repeated rows go; different events of one time stay."""
    names = [k.split()[0] for k in keys.split(", ")]
    fields = events.schema

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        if last is not None:
            rows = rows[rows.t > last]
        rows = rows.drop_duplicates()
        if len(rows):
            state.update((int(rows.t.iloc[-1]),))
            yield rows

    return events.groupBy(*names).applyInPandasWithState(run, fields, "last long", "append", GroupStateTimeout.NoTimeout)


def observed_stream(events: DataFrame, width: int, height: int, name: str = "validity") -> DataFrame:
    """A stream whose batches report frames.validity_report()'s counts as observed metrics of that name (see batch_validity())."""
    return events.observe(name, F.count(F.lit(1)).alias("events"), *[F.count_if(c).alias(n) for n, c in frames._broken(width, height).items()])


def batch_validity(query: StreamingQuery, name: str = "validity") -> list[dict]:
    """batch and the counts of the batches in a query's recent progress; batches without events count nothing."""
    out = []
    for progress in query.recentProgress:
        row = progress.observedMetrics.get(name)
        if row is not None:
            out.append({"batch": progress.batchId, **row.asDict()})
    return out


class _Slices(StatefulProcessor):
    """A pixel's level and the events of its open slices; a timer at the end of each slice folds it and gives its row."""

    def __init__(self, slice_: int, contribution: float, decay: float):
        self.slice, self.c, self.decay = slice_, contribution, decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "level double, t long")
        self.open = handle.getMapState("open", "slice long", "t array<long>, p array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            for slice_, part in pdf.groupby(pdf.t // self.slice):
                ms = self._timer(int(slice_))
                if ms <= closed:
                    continue  # too late: the slice's row is out
                at = (int(slice_),)
                t, p = self.open.getValue(at) if self.open.containsKey(at) else ([], [])
                if not len(t):
                    self.handle.registerTimer(ms)
                self.open.updateValue(at, ([*t, *part.t.astype(int).tolist()], [*p, *(part.p > 0).astype(int).tolist()]))
        return iter(())

    def _timer(self, slice_: int) -> int:
        """Milliseconds at which no event of the slice can come any more."""
        return -(-((slice_ + 1) * self.slice) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(k[0] for k in self.open.keys() if self._timer(k[0]) <= now)
        level, last = self.level.get() if self.level.exists() else (accumulator.NEUTRAL, None)
        out = []
        for slice_ in due:
            t, p = self.open.getValue((slice_,))
            for at, sign in sorted(zip(t, p, strict=True)):
                level = float(accumulator.stepped(level, 0 if last is None else at - last, sign, self.c, self.decay))
                last = at
            out.append((*key, slice_, len(t), last, level))
            self.open.removeKey((slice_,))
        if out:
            self.level.update((level, last))
            columns = list(zip(*out, strict=True))
            yield pd.DataFrame({n: c for n, c in zip([*self.names, "slice", "n", "t", "level"], columns, strict=True)})

    names: list[str] = ["x", "y"]

    def close(self) -> None:
        pass


def slice_stream(events: DataFrame, slice_: int = SLICE, late: str = "100 milliseconds", keys: tuple[str, ...] = (), contribution: float = CONTRIBUTION, decay: float = DECAY) -> DataFrame:
    """accumulator.accumulated() of a stream: keys, x, y, slice, n, t, level, a row when the watermark has passed the slice's end.

    Events may come in any order up to late; later ones than that go. The state of a pixel is its level and the events of its open
    slices. Keyed state with timers needs the RocksDB state store, which is set in the session here.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    pixel = [*keys, "x", "y"]
    timed = events.where("t is not null and p is not null").select(*pixel, F.col("t").cast("long").alias("t"), F.col("p").cast("int").alias("p"), event_time(F.col("t")).alias("_time"))
    processor = _Slices(slice_, contribution, decay)
    processor.names = pixel
    fields = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in pixel)
    return timed.withWatermark("_time", late).groupBy(*pixel).transformWithStateInPandas(processor, f"{fields}, slice long, n long, t long, level double", "Append", "EventTime")


def simulated_stream(pixels: DataFrame, camera: str | Sensor = "Raw2DVS346", seed: int = 0, on_disorder: str = "fail", **options) -> DataFrame:
    """Stochastic events of a stream of pixel rows (frame_idx, t, x, y, lum): state per tile, same draws as in batch.

    on_disorder: "fail", or "drop" frames that are not after the tile's last one.
    """
    sensor = camera if isinstance(camera, Sensor) else preset(camera)
    o = simulate.Options(sensor, seed, **options)
    keyed = pixels.withColumn("tx", F.floor(F.col("x") / simulate.TILE)).withColumn("ty", F.floor(F.col("y") / simulate.TILE))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tile = pickle.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["frame_idx", "y", "x"])
        for frame, part in rows.groupby("frame_idx"):
            t = int(part.t.iloc[0])
            if tile is not None and t <= tile.t and on_disorder == "drop":
                continue
            x, y = part.x.to_numpy(), part.y.to_numpy()
            tile, at, pixel, p = simulate.step(tile, part.lum.to_numpy(), t, x, y, 0, int(frame), o)
            if len(at):
                yield pd.DataFrame({"t": at.astype("int64"), "x": x[pixel].astype("int32"), "y": y[pixel].astype("int32"), "p": p.astype("int8")})
        state.update((pickle.dumps(tile),))

    return keyed.groupBy("tx", "ty").applyInPandasWithState(run, "t long, x int, y int, p tinyint", "tile binary", "append", GroupStateTimeout.NoTimeout)


def reset(state: GroupState) -> None:
    """Forgets a key: its next frame starts it anew."""
    if state.exists:
        state.remove()
