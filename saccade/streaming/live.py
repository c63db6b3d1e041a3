"""A live source: cameras append events to logs, a stream reads them with offsets, replay and a limit for each batch.

A log is a file of fixed records that only grows, one per camera, all in one folder. The stream's offset is the number of records taken
of each log, so a restarted query reads exactly what its checkpoint has not; a batch that was planned but not finished is planned again
with the same records. A batch takes ``limit`` events at most, shared evenly by the logs that have more than was taken; new logs join
when they appear. Tasks read ranges of records, so a backlog of one camera is read by many.

Playback is the same stream over recorded logs, a batch of ``limit`` events after the other (1000 as the player does it).

A record that is not complete yet waits for the next batch. A log that is shorter than what was taken of it is an error.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.sinks import Part, PartWriter, at

#: A record of a log.
RECORD = np.dtype([("t", "<i8"), ("x", "<u2"), ("y", "<u2"), ("p", "u1"), ("_", "V3")])
SUFFIX = ".elog"
#: Events of a batch; records of a task and of an Arrow batch.
LIMIT, PER_TASK, BLOCK = 1000, 1_000_000, 65_536
#: Streams that play a recording back side by side, at most; each holds about 50 MB of the driver's memory.
STREAMS = 3
SCHEMA = "camera string, t bigint, x int, y int, p tinyint, record bigint"


def append(path: str, t: np.ndarray, x: np.ndarray, y: np.ndarray, p: np.ndarray) -> None:
    """What a camera's process does: adds events to its log, a local file."""
    rows = np.zeros(len(t), RECORD)
    rows["t"], rows["x"], rows["y"], rows["p"] = t, x, y, p
    with open(path, "ab") as file:
        file.write(rows.tobytes())


class Records(InputPartition):
    def __init__(self, camera: str, path: str, first: int, last: int):
        self.camera, self.path, self.first, self.last = camera, path, first, last


class EventLog(DataSource):
    """Logs of a folder. Options: path, limit (events of a batch), per_task, stretches (JSON: the first record and the one after the last of each log to be read). Written, events (camera, t, x, y, p) become a log per camera."""

    @classmethod
    def name(cls) -> str:
        return "eventlog"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return _LogReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        return _LogWriter(dict(self.options), overwrite)


class _LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.limit, self.per_task = int(options.get("limit", LIMIT)), int(options.get("per_task", PER_TASK))
        if self.limit < 1 or self.per_task < 1:
            raise ValueError("limit and per_task are at least 1")
        self.stretches = json.loads(options["stretches"]) if options.get("stretches") else None
        self.planned: dict | None = None

    def logs(self) -> dict[str, int]:
        """Complete records of each log."""
        fs, base = at(self.path)
        if fs.get_file_info(base).type != pafs.FileType.Directory:
            return {}
        found = {f.base_name.removesuffix(SUFFIX): f.size // RECORD.itemsize for f in fs.get_file_info(pafs.FileSelector(base)) if f.is_file and f.base_name.endswith(SUFFIX)}
        if self.stretches is None:
            return found
        return {c: min(found.get(c, 0), last) for c, (_, last) in self.stretches.items()}

    def initialOffset(self) -> dict:
        return {} if self.stretches is None else {c: first for c, (first, _) in sorted(self.stretches.items())}

    def latestOffset(self) -> dict:
        """The offset of the next batch: at most limit records after the batch that was planned last."""
        taken, there = dict(self.planned or self.initialOffset()), self.logs()
        for camera, n in taken.items():
            if there.get(camera, 0) < n:
                raise ValueError(f"the log of {camera} has {there.get(camera, 0)} records; {n} were taken of it")
        left, waiting = self.limit, {c: n - taken.get(c, 0) for c, n in there.items() if n > taken.get(c, 0)}
        while left and waiting:
            share = max(1, left // len(waiting))
            for camera in sorted(waiting):
                n = min(share, waiting[camera], left)
                taken[camera] = taken.get(camera, 0) + n
                left -= n
                waiting[camera] -= n
            waiting = {c: n for c, n in waiting.items() if n}
        return dict(sorted(taken.items()))

    def partitions(self, start: dict, end: dict) -> list[Records]:
        # after a restart the last batch of the checkpoint is planned first, and says where the stream is
        self.planned = {c: max(n, (self.planned or {}).get(c, 0)) for c, n in end.items()}
        out = []
        for camera, last in end.items():
            first = start.get(camera, 0)
            out += [Records(camera, f"{self.path}/{camera}{SUFFIX}", i, min(i + self.per_task, last)) for i in range(first, last, self.per_task)]
        return out

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        fs, name = at(part.path)
        with fs.open_input_file(name) as file:
            file.seek(part.first * RECORD.itemsize)
            for lo in range(part.first, part.last, BLOCK):
                n = min(BLOCK, part.last - lo)
                rows = np.frombuffer(file.read(n * RECORD.itemsize), RECORD)
                if len(rows) != n:
                    raise ValueError(f"{part.path} ends before record {lo + n}")
                columns = [pa.array([part.camera] * n), pa.array(rows["t"].copy()), pa.array(rows["x"].astype(np.int32)), pa.array(rows["y"].astype(np.int32)), pa.array(rows["p"].astype(np.int8)), pa.array(np.arange(lo, lo + n))]
                yield pa.RecordBatch.from_arrays(columns, names=["camera", "t", "x", "y", "p", "record"])

    def commit(self, end: dict) -> None:
        if self.planned is None:
            self.planned = dict(end)

    def stop(self) -> None:
        pass


class _LogWriter(PartWriter):
    """A log per camera, from rows sorted by camera; a camera has one partition."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, part = at(self.path)[0], self.new_part()
        out, camera, rows = None, None, 0
        try:
            for batch in iterator:
                names = np.array(batch.column("camera").to_pylist(), object)
                block = np.zeros(batch.num_rows, RECORD)
                for c in ("t", "x", "y", "p"):
                    block[c] = batch.column(c).to_numpy()
                cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if names[a] != camera:
                        if out is not None:
                            out.close()
                        camera = names[a]
                        out = fs.open_output_stream(f"{self.staging}/{part.name}~{camera}", compression=None)
                    out.write(block[a:b].tobytes())
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return replace(part, rows=rows)

    def commit(self, messages: list) -> None:
        """Only files of tasks that have ended well become logs."""
        fs, _ = at(self.path)
        good = {m.name for m in messages if m is not None and m.rows}
        for info in fs.get_file_info(pafs.FileSelector(self.staging)):
            name, _, camera = info.base_name.partition("~")
            if name in good:
                fs.move(info.path, f"{self.base}/{camera}{SUFFIX}")
        fs.delete_dir(self.staging)


def write_logs(events: DataFrame, path: str) -> None:
    """Recorded events (camera, t, x, y, p) as a log per camera in time order, for playback; a camera is written by one task, as it recorded."""
    events.sparkSession.dataSource.register(EventLog)
    rows = events.select(F.col("camera").cast("string").alias("camera"), F.col("t").cast("long").alias("t"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), (F.col("p") > 0).cast("int").alias("p"))
    bad = rows.where("camera is null or camera like '%/%' or t is null or x not between 0 and 65535 or y not between 0 and 65535 or x is null or y is null or p is null").limit(1).count()
    if bad:
        raise ValueError("a log needs a camera, a time, a polarity, and pixels from 0 to 65535")
    order = ["camera", "t", "x", "y", "p"]
    rows.repartition("camera").sortWithinPartitions(*order).write.format("eventlog").mode("append").option("path", path).save()


def live_events(spark: SparkSession, path: str, limit: int = LIMIT, per_task: int = PER_TASK, stretches: dict | None = None) -> DataFrame:
    """The stream of a folder's logs: camera, t, x, y, p, record (its number in the log). stretches: see EventLog."""
    spark.dataSource.register(EventLog)
    options = {} if stretches is None else {"stretches": json.dumps(stretches)}
    return spark.readStream.format("eventlog").options(path=path, limit=str(limit), per_task=str(per_task), **options).load()


def stretches(logs: dict[str, int], limit: int, streams: int = STREAMS) -> list[dict[str, tuple[int, int]]]:
    """The records of logs (camera: their number) dealt out: for each of at most streams the first record of a log and the one after its last.

    The stretches follow each other through the logs and differ by one batch at most, so one long log is shared as well.
    """
    total = sum(logs.values())
    n = min(streams, -(-total // limit))
    size = -(-total // max(1, n) // limit) * limit
    out: list[dict[str, tuple[int, int]]] = [{} for _ in range(n)]
    before = 0
    for camera, records in sorted(logs.items()):
        first = 0
        while first < records:
            k = (before + first) // size
            last = min(records, (k + 1) * size - before)
            out[k][camera] = (first, last)
            first = last
        before += records
    return [o for o in out if o]


def play_back(spark: SparkSession, path: str, out: str, limit: int = LIMIT, streams: int = STREAMS) -> DataFrame:
    """All records that a folder's logs have now, played back to tables below out in batches of limit at most.

    A batch costs a fixed time, however few events it has, so a long recording is cut into stretches that streams play side by side, each
    with its own checkpoint. A stream has a Python process in the driver's memory, and others while it is planned: the next one starts when
    those are free again, and one that has come to its end is stopped before the others are waited for.
    """
    found = stretches(_LogReader({"path": path}).logs(), limit, streams)
    schema, places = live_events(spark, path, limit).schema, [f"{out}/stretch={k}" for k in range(len(found))]
    queries = []
    try:
        for own, place in zip(found, places, strict=True):
            stream = live_events(spark, path, limit, stretches=own)
            queries.append(stream.writeStream.format("parquet").option("path", place).option("checkpointLocation", f"{out}-checkpoint/{place.rpartition('/')[2]}").start())
            while queries[-1].isActive and queries[-1].lastProgress is None:
                time.sleep(0.05)
        for query in queries:
            query.processAllAvailable()
            query.stop()
    finally:
        for query in queries:
            query.stop()
    # one by one: only then the sink's own list of its files counts
    return reduce(DataFrame.unionAll, [spark.read.schema(schema).parquet(place) for place in places], spark.createDataFrame([], schema))
