"""Frame, metadata and event files: Python data sources and readers.

Files are opened with ``pyarrow.fs`` by the tasks, in any file system that it reaches; a path without a scheme is a local one.
"""

from __future__ import annotations

import bisect
import json
import traceback
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .. import schema as S
from ..functions import pixels as P
from ..storage import written
from .sinks import INDEX, NO_TIME, FrameSink, at, read_event_text, read_manifest, write_event_text, write_frames  # noqa: F401

#: Frames of a task: at least these many, and these many bytes of small ones; bytes of a batch of them.
FRAMES_PER_TASK, TASK_BYTES, BATCH_BYTES = 32, 32 << 20, 8 << 20
RECORDS_PER_TASK = 1_000_000
#: Pixels of a batch of rows that frames are unpacked to; at least one frame.
PIXELS_PER_BATCH = 65_536
#: Tasks of a scan at most; beyond, a task reads several row groups.
MOST_TASKS = 100_000


def _open(path: str) -> pa.NativeFile:
    """The file at path, for reading at any place."""
    fs, name = at(path)
    return fs.open_input_file(name)


def _npy_header(file) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and begin of the data of an .npy file in row-major order."""
    version = np.lib.format.read_magic(file)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if fortran:
        raise ValueError("column-major stacks are not read")
    return shape, kind, file.tell()


class FrameRange(InputPartition):
    """Frames (or records) first to last - 1 of a file, counted from its begin."""

    def __init__(self, path: str, first: int, last: int, begin: int = 0, index: str | None = None):
        self.path, self.first, self.last, self.begin, self.index = path, first, last, begin, index


class Wanted:
    """What pushed filters leave of one whole-number column: a range and, where there is one, a set of values."""

    def __init__(self):
        self.lo, self.hi, self.values = None, None, None

    def push(self, f: Filter) -> bool:
        """Takes f in; False if it is of another kind."""
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, In):
            self._among({v for v in f.value if v is not None})
        elif f.value is None:
            return False
        elif isinstance(f, EqualTo):
            self._among({f.value})
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            low = f.value + isinstance(f, GreaterThan)
            self.lo = low if self.lo is None else max(self.lo, low)
        elif isinstance(f, LessThan | LessThanOrEqual):
            high = f.value - isinstance(f, LessThan)
            self.hi = high if self.hi is None else min(self.hi, high)
        else:
            return False
        return True

    def _among(self, values: set) -> None:
        self.values = values if self.values is None else self.values & values

    def meets(self, lo: int, hi: int) -> bool:
        """Whether a value of lo to hi can be wanted."""
        if (self.lo is not None and hi < self.lo) or (self.hi is not None and lo > self.hi):
            return False
        return self.values is None or any(lo <= v <= hi for v in self.values)

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        if self.lo is not None:
            out &= values >= self.lo
        if self.hi is not None:
            out &= values <= self.hi
        return out if self.values is None else out & np.isin(values, list(self.values))

    @property
    def any(self) -> bool:
        return self.lo is not None or self.hi is not None or self.values is not None


class RawFrames(DataSource):
    """Headerless pixel files, .npy stacks and folders written by sinks.write_frames() as packed frames.

    Options: path; height, width, channels (1: 16-bit little-endian, otherwise 8-bit) of files. A trailing partial frame is not read.
    metadata (and layout, see Metadata): the file with a record per frame, whose time in whole numbers becomes the column t; folders
    have it already. index_only: frame_idx and t without pixels, from the index or the metadata alone. ordered: the times ascend, so bounds of t are looked up in the metadata before anything is planned.

    wanted: bounds of frame_idx and t (see read_frames()). They select parts, then ranges of frames, and a task reads the bytes of wanted
    frames only. pushdown: filters of the query do the same. Spark 4.1 keeps the filters that were pushed last with the loaded
    relation, for all its uses, so a DataFrame with pushdown is good for one filter only; without it filters work on the rows that are read.
    """

    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self):
        if str(self.options.get("index_only", "")).lower() == "true":
            return S.FRAME_TIMES
        timed = "metadata" in self.options or read_manifest(self.options["path"]) is not None
        return S.FRAMES_WITH_TIME if timed else S.FRAMES

    def reader(self, schema):
        kind = _PushingReader if str(self.options.get("pushdown", "")).lower() == "true" else _RawReader
        return kind(dict(self.options))

    def writer(self, schema, overwrite: bool):
        return FrameSink(dict(self.options), overwrite)


class _RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.channels = options["path"], int(options.get("channels", 1))
        self.frames, self.times = Wanted(), Wanted()
        self.metadata, self.layout = options.get("metadata"), options.get("layout", "sensor_real")
        self.ascending = str(options.get("ordered", "")).lower() == "true"
        wanted = json.loads(options.get("wanted") or "{}")
        for column, bounds in ((self.frames, wanted.get("frames")), (self.times, wanted.get("times"))):
            if bounds is not None:
                column.lo, column.hi = bounds
        if wanted.get("only") is not None:
            self.frames.values = set(wanted["only"])
        self.index_only = str(options.get("index_only", "")).lower() == "true"
        self.begin = 0
        self.manifest = read_manifest(self.path)
        if self.manifest is not None:
            self.height, self.width, self.channels = self.manifest.height, self.manifest.width, self.manifest.channels
        self.size = 0
        if self.manifest is None:
            self._open(options)
        else:
            self.size = self.height * self.width * (2 if self.channels == 1 else self.channels)
        self.timed = self.manifest is not None or self.metadata is not None
        self.per_task = max(FRAMES_PER_TASK, TASK_BYTES // max(1, self.size))

    def _open(self, options: dict) -> None:
        channels = self.channels
        with _open(self.path) as file:
            if self.path.endswith(".npy"):
                shape, kind, self.begin = _npy_header(file)
                wanted = np.dtype("<u2") if channels == 1 else np.dtype(np.uint8)
                if kind != wanted or len(shape) != (3 if channels == 1 else 4) or (channels > 1 and shape[3] != channels):
                    raise ValueError(f"{self.path} holds {kind} of shape {shape}, not frames of {channels} channel(s) of {wanted}")
                self.n, self.height, self.width = shape[:3]
            else:
                self.height, self.width = int(options["height"]), int(options["width"])
            self.size = self.height * self.width * (2 if channels == 1 else channels)
            if not self.begin:
                self.n = file.size() // self.size

    def _blocks(self, path: str, n: int, first: int, index: str | None) -> Iterator[FrameRange]:
        """Ranges of a part whose frames count on from first."""
        lo = 0 if self.frames.lo is None else min(n, max(0, self.frames.lo - first))
        hi = n if self.frames.hi is None else max(0, min(n, self.frames.hi - first + 1))
        for i in range(lo - lo % self.per_task, hi, self.per_task):
            a, b = max(i, lo), min(i + self.per_task, hi)
            if a < b and self.frames.meets(first + a, first + b - 1):
                yield FrameRange(path, a, b, self.begin, index)

    def partitions(self) -> list[FrameRange]:
        if self.manifest is None:
            if self.ascending and self.metadata and self.times.any:
                self._by_time()
            return list(self._blocks(self.path, self.n, 0, None))
        out = []
        for part in self.manifest.parts:
            data, index = (f"{self.path.rstrip('/')}/{part.name}{s}" for s in (".dat", ".idx"))
            if not self.frames.meets(part.first, part.last) or (part.first_t is not None and not self.times.meets(part.first_t, part.last_t)):
                continue
            if part.last - part.first + 1 == part.rows:
                out += self._blocks(data, part.rows, part.first, index)
            else:  # numbers with gaps: the index tells
                out += [FrameRange(data, i, min(i + self.per_task, part.rows), 0, index) for i in range(0, part.rows, self.per_task)]
        return out

    def _by_time(self) -> None:
        """Narrows the range of frames to the bounds of t, by binary search in the metadata."""
        size = _record(self.layout).itemsize
        with _open(self.metadata) as file:
            n = min(self.n, file.size() // size)

            def time(i: int) -> int:
                file.seek(i * size)
                return int(np.frombuffer(file.read(8), "<f8")[0])

            values = self.times.values
            lo = max((v for v in (self.times.lo, min(values, default=None) if values else None) if v is not None), default=None)
            hi = min((v for v in (self.times.hi, max(values, default=None) if values else None) if v is not None), default=None)
            if lo is not None:
                self.frames.push(GreaterThanOrEqual(("frame_idx",), bisect.bisect_left(range(n), lo, key=time)))
            if hi is not None:
                self.frames.push(LessThan(("frame_idx",), bisect.bisect_right(range(n), hi, key=time)))

    def _index(self, part: FrameRange) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Numbers of the range's frames, their times, and which have none."""
        if part.index is not None:
            with _open(part.index) as file:
                file.seek(part.first * INDEX.itemsize)
                rows = np.frombuffer(file.read((part.last - part.first) * INDEX.itemsize), INDEX)
            return rows["frame_idx"], rows["t"], rows["t"] == NO_TIME
        numbers = np.arange(part.first, part.last)
        if self.metadata is None:
            return numbers, None, None
        kind = _record(self.layout)
        with _open(self.metadata) as file:
            file.seek(part.first * kind.itemsize)
            got = np.frombuffer(file.read((part.last - part.first) * kind.itemsize) or b"", np.uint8)
        rows = got[: len(got) // kind.itemsize * kind.itemsize].view(kind)["s"]
        times = np.full(len(numbers), NO_TIME)
        times[: len(rows)] = rows.astype(np.int64)
        return numbers, times, times == NO_TIME

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        numbers, times, none = self._index(part)
        wanted = self.frames.of(numbers)
        if self.times.any:
            wanted &= self.times.of(times) & ~none
        places = np.flatnonzero(wanted)
        if self.index_only:
            own = pa.nulls(len(places), pa.int64()) if times is None else pa.array(times[places], pa.int64(), mask=none[places])
            yield pa.RecordBatch.from_arrays([pa.array(numbers[places].astype(np.int32)), own], names=["frame_idx", "t"])
            return
        step = max(1, BATCH_BYTES // max(1, self.size))
        with _open(part.path) as file:
            for run in np.split(places, np.flatnonzero(np.diff(places) != 1) + 1):
                for lo in range(0, len(run), step):
                    at_ = run[lo : lo + step]
                    file.seek(part.begin + (part.first + int(at_[0])) * self.size)
                    raw, n = file.read(len(at_) * self.size), len(at_)
                    if len(raw) != n * self.size:
                        raise ValueError(f"{part.path} ends before frame {numbers[at_[-1]]}")
                    px = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * self.size).astype(np.int32)), pa.py_buffer(raw)])
                    columns = [pa.array(numbers[at_].astype(np.int32)), pa.array(np.full(n, self.height, np.int32)), pa.array(np.full(n, self.width, np.int32)), px]
                    names = ["frame_idx", "height", "width", "px"]
                    if self.timed:
                        columns, names = [*columns, pa.array(times[at_], pa.int64(), mask=none[at_])], [*names, "t"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)


class _PushingReader(_RawReader):
    """Takes the query's filters on frame_idx and t."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            taken = column == ("frame_idx",) and self.frames.push(f) or column == ("t",) and self.timed and self.times.push(f)
            if not taken or (isinstance(f, IsNotNull) and column == ("t",)):
                yield f


def _record(layout: str) -> np.dtype:
    """A metadata record; fixed values: its fields."""
    return np.dtype([("s", "<f8"), ("r", "S30")]) if layout == "sensor_real" else np.dtype([("s", "<f8")])


class Metadata(DataSource):
    """Metadata records: layout sensor_real (8-byte double and 30-byte local time) or sensor_only (8-byte double)."""

    @classmethod
    def name(cls) -> str:
        return "framemetadata"

    def schema(self):
        return "frame_idx int, sensor_ts double, real_ts string"

    def reader(self, schema):
        return _MetadataReader(dict(self.options))


class _MetadataReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layout = options["path"], options.get("layout", "sensor_real")
        if self.layout not in ("sensor_real", "sensor_only"):
            raise ValueError(f"unknown layout {self.layout!r}")
        self.size = 38 if self.layout == "sensor_real" else 8
        with _open(self.path) as file:
            self.n = file.size() // self.size

    def partitions(self):
        return [FrameRange(self.path, i, min(i + RECORDS_PER_TASK, self.n)) for i in range(0, self.n, RECORDS_PER_TASK)]

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        with _open(part.path) as file:
            file.seek(part.first * self.size)
            raw = file.read((part.last - part.first) * self.size)
        full = self.layout == "sensor_real"
        rows = np.frombuffer(raw, np.dtype([("s", "<f8"), ("r", "S30")]) if full else np.dtype([("s", "<f8")]))
        texts = pa.array(np.char.strip(np.char.decode(rows["r"], "ascii"), "\x00 ")) if full else pa.nulls(len(rows), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.last, dtype=np.int32)), pa.array(rows["s"].copy()), texts.cast(pa.string())], names=["frame_idx", "sensor_ts", "real_ts"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawFrames)
    spark.dataSource.register(Metadata)


def read_frames(spark: SparkSession, path: str, height: int = 520, width: int = 692, channels: int = 1, frames: tuple | list | None = None, times: tuple | None = None, metadata: str | None = None, layout: str = "sensor_real", ordered: bool = False, pushdown: bool = False) -> DataFrame:
    """Packed frames of a file or of a folder of sinks.write_frames().

    frames: a tuple of the first and last frame_idx, or a list of them; times: a tuple of the first and last t; None leaves an end
    open. Only what they select is opened. pushdown: filters of the query select too, for one use of the DataFrame (see RawFrames).
    """
    return _frames(spark, path, frames, times, {"height": height, "width": width, "channels": channels, "layout": layout, "ordered": ordered, "pushdown": pushdown, "metadata": metadata})


def frame_times(spark: SparkSession, path: str, frames: tuple | list | None = None, times: tuple | None = None, **options) -> DataFrame:
    """frame_idx and t of frames; their pixels are not read. options: as of read_frames()."""
    return _frames(spark, path, frames, times, {**options, "index_only": True})


def _frames(spark: SparkSession, path: str, frames: tuple | list | None, times: tuple | None, options: dict) -> DataFrame:
    register(spark)
    if options.get("pushdown"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    wanted = {"frames": list(frames) if isinstance(frames, tuple) else None, "only": sorted(set(frames)) if isinstance(frames, list) else None, "times": times}
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if v is not None}
    return spark.read.format("rawframes").options(path=path, wanted=json.dumps(wanted), **given).load()


def frames_at(wanted: DataFrame, path: str, height: int = 520, width: int = 692, channels: int = 1) -> DataFrame:
    """The packed frames whose frame_idx is in wanted, any number of them: tasks open the parts that hold theirs, and read those frames only.

    For needed frames that a join finds, which no filter of a scan can name. Of a folder the manifest, a line per part, goes to all tasks.
    """
    spark = wanted.sparkSession
    reader = _RawReader({"path": path, "height": height, "width": width, "channels": channels})
    if reader.manifest is None:
        parts = [(0, reader.n - 1, FrameRange(path, 0, reader.n, reader.begin))]
    else:
        parts = [(p.first, p.last, FrameRange(f"{path.rstrip('/')}/{p.name}.dat", 0, p.rows, 0, f"{path.rstrip('/')}/{p.name}.idx")) for p in reader.manifest.parts]
    shared = spark.sparkContext.broadcast((reader, sorted(parts, key=lambda p: p[:2])))
    schema = S.FRAMES_WITH_TIME if reader.timed else S.FRAMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader_, parts_ = shared.value
        for batch in batches:
            need = batch.column(0).to_numpy()
            for first, last, part in parts_:
                own = need[(need >= first) & (need <= last)]
                if not len(own):
                    continue
                reader_.frames = Wanted()
                reader_.frames.push(In(("frame_idx",), tuple(own.tolist())))
                span = range(int(own.min()) - first, int(own.max()) - first + 1) if last - first + 1 == part.last else range(part.last)
                for lo in range(span.start, span.stop, reader_.per_task):
                    yield from reader_.read(FrameRange(part.path, lo, min(lo + reader_.per_task, span.stop), part.begin, part.index))

    rows = wanted.where("frame_idx is not null").select(F.col("frame_idx").cast("int").alias("frame_idx")).distinct()
    return rows.repartitionByRange("frame_idx").sortWithinPartitions("frame_idx").mapInArrow(run, schema)


def packed_frames(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Frames (frame_idx, t, height, width, px of 16 bits) of pixel rows (frame_idx, t, x, y, lum); a pixel without a row is 0.

    A frame is put together in one task: height * width pixels. Rows outside go; of rows of one pixel the largest luminance counts.
    """

    def pack(table: pa.Table) -> pa.Table:
        image = np.zeros(height * width, np.int64)
        x, y, lum = (table.column(c).to_numpy() for c in ("x", "y", "lum"))
        np.maximum.at(image, y.astype(np.int64) * width + x, lum)
        raw = np.clip(image, 0, 0xFFFF).astype("<u2").tobytes()
        return pa.table({"frame_idx": table.column("frame_idx").slice(0, 1), "t": pa.array([pc.min(table.column("t")).as_py()], pa.int64()), "height": pa.array([height], pa.int32()), "width": pa.array([width], pa.int32()), "px": pa.array([raw], pa.binary())})

    inside = pixels.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    rows = inside.select(F.col("frame_idx").cast("int").alias("frame_idx"), F.col("t").cast("long").alias("t"), "x", "y", F.col("lum").cast("long").alias("lum"))
    return rows.groupBy("frame_idx").applyInArrow(pack, "frame_idx int, t bigint, height int, width int, px binary")


def real_time_us(text):
    """Microseconds of a local time text, null if it is none."""
    return F.unix_micros(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))


def read_metadata(spark: SparkSession, path: str, layout: str = "sensor_real") -> DataFrame:
    """frame_idx, sensor_ts, real_ts, real_us from .dat; the named columns, with frame_idx, of .npy, .csv and .txt files. Others are an error.

    Columns of text files get the types that their values have.
    """
    if path.endswith(".dat"):
        register(spark)
        rows = spark.read.format("framemetadata").options(path=path, layout=layout).load()
        return rows.withColumn("real_us", real_time_us(F.col("real_ts")))
    if path.endswith((".csv", ".txt")):
        return spark.read.option("header", True).option("inferSchema", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    if path.endswith(".npy"):
        return _npy_records(spark, path)
    raise ValueError(f"unknown metadata type: {path}")


def _npy_records(spark: SparkSession, path: str) -> DataFrame:
    """frame_idx and the fields of a structured array of numbers and texts."""
    with _open(path) as file:
        shape, kind, begin = _npy_header(file)
    if kind.names is None:
        raise ValueError("metadata has no named fields")
    schema = "frame_idx int, " + ", ".join(f"`{n}` {'string' if kind[n].kind in 'SU' else 'double' if kind[n].kind == 'f' else 'long'}" for n in kind.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                n = min(RECORDS_PER_TASK, shape[0] - first)
                with _open(path) as file:
                    file.seek(begin + first * kind.itemsize)
                    rows = np.frombuffer(file.read(n * kind.itemsize), kind)
                columns = [pa.array(np.arange(first, first + n, dtype=np.int32))]
                for name in kind.names:
                    value = np.ascontiguousarray(rows[name])
                    if kind[name].kind == "S":
                        value = np.char.strip(np.char.decode(value, "ascii"), "\x00 ")
                    text = kind[name].kind in "SU"
                    columns.append(pa.array(value.tolist(), pa.string()) if text else pa.array(value.astype(float if kind[name].kind == "f" else np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=["frame_idx", *kind.names])

    return spark.range(0, shape[0], RECORDS_PER_TASK).mapInArrow(run, schema)


def timestamps(metadata: DataFrame) -> DataFrame:
    """t of metadata, truncated to whole numbers: SensorTimestamp, sensor_ts or timestamp, whichever comes first."""
    for name in ("SensorTimestamp", "sensor_ts", "timestamp"):
        if name in metadata.columns:
            return metadata.select(F.col(name).cast("double").cast("long").alias("t"))
    raise ValueError("metadata has no timestamp column")


def pixel_rows(frames: DataFrame, channels: int = 1) -> DataFrame:
    """frame_idx, x, y and lum (or c0, c1, ... for several channels) of packed frames; row-major."""
    names = ["lum"] if channels == 1 else [f"c{i}" for i in range(channels)]
    width = 2 if channels == 1 else channels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, h, w = (batch.column(i).to_numpy() for i in range(3))
            ends = np.flatnonzero((h[1:] != h[:-1]) | (w[1:] != w[:-1])) + 1
            for lo, hi in zip([0, *ends], [*ends, len(idx)], strict=True):
                if lo == hi:
                    continue
                # frames of one size at a time, as many as make PIXELS_PER_BATCH pixels
                size = int(h[lo]) * int(w[lo])
                step, at = max(1, PIXELS_PER_BATCH // max(1, size)), np.arange(size, dtype=np.int32)
                if pc.any(pc.not_equal(pc.binary_length(batch.column(3).slice(lo, hi - lo)), size * width)).as_py():
                    raise ValueError(f"frames of {h[lo]} x {w[lo]} pixels have {size * width} bytes")
                for a in range(lo, hi, step):
                    n = min(step, hi - a)
                    values = np.frombuffer(b"".join(batch.column(3).slice(a, n).to_pylist()), "<u2" if channels == 1 else np.uint8).reshape(n * size, channels).astype(np.int32)
                    columns = [np.repeat(idx[a : a + n], size), np.tile(at % w[lo], n), np.tile(at // w[lo], n), *(np.ascontiguousarray(values[:, c]) for c in range(channels))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], names=["frame_idx", "x", "y", *names])

    fields = ", ".join(f"{n} int" for n in names)
    return frames.select("frame_idx", "height", "width", "px").mapInArrow(run, f"frame_idx int, x int, y int, {fields}")


def with_times(frames: DataFrame, metadata: DataFrame) -> DataFrame:
    """frames with t (truncated sensor time) by frame_idx."""
    return frames.join(metadata.select("frame_idx", F.col("sensor_ts").cast("long").alias("t")), "frame_idx")


def _session(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path of the files below folder that are not empty; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")


def row_groups(spark: SparkSession, folder: str, time: str | None = None) -> DataFrame:
    """path, group, rows, bytes, first, last (of the column time, null if not stated), error of the Parquet files below folder.

    Footers are read by tasks; a file without a readable one is a row with its error and no group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                try:
                    with _open(path) as file:
                        footer = pq.ParquetFile(file).metadata
                        names = [footer.schema.column(i).path for i in range(footer.num_columns)]
                        at_ = names.index(time) if time in names else None
                        for g in range(footer.num_row_groups):
                            group = footer.row_group(g)
                            stated = group.column(at_).statistics if at_ is not None else None
                            bounds = (stated.min, stated.max) if stated is not None and stated.has_min_max and not isinstance(stated.min, bytes) else (None, None)
                            rows.append((path, g, group.num_rows, sum(group.column(i).total_compressed_size for i in range(group.num_columns)), *bounds, None))
                except Exception as e:  # one bad file must not end the scan; it becomes a row
                    rows = [(path, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "group", "rows", "bytes", "first", "last", "error"])

    files = _listed(spark, folder, "*.parquet")
    spread = files.repartition(spark.sparkContext.defaultParallelism * 4, "path")
    return spread.mapInArrow(run, "path string, group int, rows bigint, bytes bigint, first bigint, last bigint, error string")


def scan_sessions(spark: SparkSession, folder: str, schema=S.EVENTS_WITH_LUMINANCE, columns: list[str] | None = None, times: tuple[int | None, int | None] | None = None) -> DataFrame:
    """The rows of all Parquet files below folder with session (the file's folder), path, group and error.

    Work is planned by row groups, from the files' footers: a large file is read by several tasks. columns: those of schema that are wanted;
    others are not read. times: bounds of t; groups whose statistics lie outside are not opened. A file or a group that cannot be
    read gives one row with its error and null columns, besides what was read of it before.
    """
    wanted = [f for f in schema if columns is None or f.name in columns]
    arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in wanted])
    names = arrow.names
    lo, hi = times or (None, None)

    def row(path: str, group: int | None, table: pa.RecordBatch | None, error: str | None) -> pa.RecordBatch:
        n = 1 if table is None else table.num_rows
        filled = [pa.nulls(n, f.type) if table is None else table.column(f.name).cast(f.type) for f in arrow]
        return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([group] * n, pa.int32()), pa.array([error] * n, pa.string()), *filled], names=["path", "group", "error", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, group, error in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if error is not None:
                    yield row(path, group, None, error)
                    continue
                try:
                    with _open(path) as file:
                        read = [*names, *(["t"] if times and "t" not in names else [])]
                        for part in pq.ParquetFile(file).iter_batches(row_groups=[group], columns=read):
                            if times:
                                t = part.column(part.schema.get_field_index("t"))
                                keep = pc.and_(pc.greater_equal(t, lo) if lo is not None else pc.is_valid(t), pc.less_equal(t, hi) if hi is not None else pc.is_valid(t))
                                part = part.filter(keep)
                            if part.num_rows:
                                yield row(path, group, part, None)
                except Exception as e:
                    yield row(path, group, None, f"{type(e).__name__}: {e}")

    groups = row_groups(spark, folder, "t" if times else None)
    if lo is not None:
        groups = groups.where(F.col("last").isNull() | (F.col("last") >= lo))
    if hi is not None:
        groups = groups.where(F.col("first").isNull() | (F.col("first") <= hi))
    plan = written(groups.select("path", "group", "error"))
    fields = "".join(f", {f.name} {f.dataType.simpleString()}" for f in wanted)
    rows = plan.repartition(max(1, min(MOST_TASKS, plan.count())), "path", "group").mapInArrow(run, f"path string, group int, error string{fields}")
    return rows.withColumn("session", _session(F.col("path")))


_ARROW = {"boolean": pa.bool_(), "long": pa.int64(), "tinyint": pa.int8(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def read_sessions(spark: SparkSession, folder: str, schema=S.EVENTS_WITH_LUMINANCE) -> DataFrame:
    """All Parquet files below folder with session, the file's folder; corrupt files are skipped (scan_sessions names them)."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    return rows.withColumn("session", _session(F.col("_metadata.file_path")))


def by_session(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "session") -> DataFrame:
    """work's rows (schema) for each session, with key and error; a session whose work fails gives one row with its error instead.

    work gets all rows of a session as one frame: for sessions that fit a task. Larger ones: fold_sessions().
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return work(pdf)[names].assign(**{key: keys[0], "error": None})
        except Exception as e:  # isolated: the other sessions go on
            return pd.DataFrame({**{n: [None] for n in names}, key: [keys[0]], "error": ["".join(traceback.format_exception_only(e)).strip()]})

    return rows.groupBy(key).applyInPandas(run, f"{schema}, {key} {rows.schema[key].dataType.simpleString()}, error string")


def fold_sessions(rows: DataFrame, start: Callable, step: Callable, finish: Callable, schema: str, key: str = "session") -> DataFrame:
    """finish's rows (schema) for each session, with key and error, from a state that batches of the session's rows are folded into.

    start() makes a state, step(state, batch) takes an Arrow batch in and gives the next state, finish(state) gives a dict of columns. Only
    the state and one batch are held, so a session may be larger than a task's memory. A session for which one of them fails gives one
    row with its error instead; the others go on. Batches come in no order.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    kind = rows.schema[key].dataType.simpleString()
    arrow = [pa.type_for_alias("string") if kind == "string" else _ARROW[kind]]
    given = rows.select(key, *[c for c in rows.columns if c != key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, error, name = None, None, None
        for batch in batches:
            name = batch.column(0)[0].as_py()
            if error is not None:
                continue  # the rest of the session is read over
            try:
                state = step(start() if state is None else state, batch)
            except Exception as e:  # isolated: the other sessions go on
                error = "".join(traceback.format_exception_only(e)).strip()
        columns: dict = {}
        if error is None:
            try:
                columns = finish(state)
            except Exception as e:
                error = "".join(traceback.format_exception_only(e)).strip()
        if error is not None:
            columns = {n: [None] for n in names}
        n = len(next(iter(columns.values())))
        yield pa.RecordBatch.from_arrays([*(pa.array(columns[c], _ARROW[k]) for c, k in kinds), pa.array([name] * n, arrow[0]), pa.array([error] * n, pa.string())], names=[*names, key, "error"])

    kinds = [(c, k) for c, k in ((part.split()[0], part.split()[1]) for part in schema.split(", "))]
    return given.groupBy(key).applyInArrow(run, f"{schema}, {key} {kind}, error string")


# fixed values: parts of the names of a session's files
ROLES = {"events": "dv_output", "metadata": "metadata", "rgb": "rgb_frames", "raw": "raw_frames"}


def session_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """role, path, session of the four files of a recording; a missing role is an error."""
    fs, base = at(folder)
    files = sorted((f.base_name, f.path) for f in fs.get_file_info(pafs.FileSelector(base)) if f.is_file)
    found = []
    for role, part in ROLES.items():
        match = next((path for name, path in files if part in name and name.rsplit(".", 1)[0].endswith(suffix)), None)
        if match is None:
            raise FileNotFoundError(f"no {role} file for {suffix!r} in {folder}")
        found.append((role, match, suffix))
    return spark.createDataFrame(found, "role string, path string, session string")


def read_events(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Events from Parquet, text (four integers a line) or AEDAT4 (needs the optional dv_processing library); most caps them exactly."""
    if path.endswith(".aedat4"):
        events = _aedat4(spark, path)
    elif path.endswith(".txt"):
        events = read_event_text(spark, path)
    else:
        events = spark.read.schema(S.EVENTS).parquet(path)
    return events.limit(most) if most is not None else events


def _recordings(spark: SparkSession, path: str, read: Callable, schema) -> DataFrame:
    """What read yields for the recordings that path (a file, folder or pattern) names, one task a file: the format has no index to split by."""
    try:
        import dv_processing  # noqa: F401
    except ImportError as e:
        raise RuntimeError("AEDAT4 files need the dv_processing library; convert to Parquet or text elsewhere") from e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import dv_processing as dv

        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from read(dv.io.MonoCameraRecording(name.removeprefix("file:")))

    files = _listed(spark, path, "*")
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, schema)


def _aedat4(spark: SparkSession, path: str) -> DataFrame:
    def read(recording) -> Iterator[pa.RecordBatch]:
        while recording.isEventStreamAvailable() and (part := recording.getNextEventBatch()) is not None and len(part):
            e = part.numpy()
            yield pa.RecordBatch.from_arrays([pa.array(e["timestamp"].astype("int64")), pa.array(e["x"].astype("int32")), pa.array(e["y"].astype("int32")), pa.array(e["polarity"].astype("int8"))], names=["t", "x", "y", "p"])

    return _recordings(spark, path, read, S.EVENTS)


def read_recorded_frames(spark: SparkSession, path: str) -> DataFrame:
    """frame_idx, t, height, width, px (one byte a pixel) of the frames in AEDAT4 files; color images become gray."""

    def read(recording) -> Iterator[pa.RecordBatch]:
        index = 0
        while recording.isFrameStreamAvailable() and (frame := recording.getNextFrame()) is not None:
            image = np.asarray(frame.image)
            if image.ndim == 3:
                image = np.floor(image[..., :3].astype(float) @ np.array(P.LUMA[::-1]) + 0.5)  # blue, green, red
            image = np.ascontiguousarray(image.astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([index], pa.int32()), pa.array([int(frame.timestamp)], pa.int64()), pa.array([image.shape[0]], pa.int32()), pa.array([image.shape[1]], pa.int32()), pa.array([image.tobytes()])], names=["frame_idx", "t", "height", "width", "px"])
            index += 1

    return _recordings(spark, path, read, "frame_idx int, t bigint, height int, width int, px binary")


#: Columns of fit results as other tools name them.
FIT_NAMES = {"P": "p", "MeanMin": "mean_min", "MeanMax": "mean_max", "DiffMin": "diff_min", "DiffMax": "diff_max", "MuHat": "mu_hat", "LambdaHat": "lambda_hat", "Mu": "mu", "Sigma": "sigma", "Count": "count"}


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """Fit results from CSV with header, under either naming; columns that the file lacks are null."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.withColumnsRenamed({k: v for k, v in FIT_NAMES.items() if k in rows.columns})
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast("double").cast(f.dataType).alias(f.name) for f in S.FITS])


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Fit results as CSV with header, other relations as Parquet."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def prepare_recording(events: DataFrame, width: int | None = None, height: int | None = None) -> tuple[DataFrame, int, int]:
    """(events t >= 0 in order with boolean polarity, width, height); no such events is an error."""
    from ..operators.frames import prepared_events, resolution

    rows = prepared_events(events)
    size = resolution(rows).first()
    if size.width is None:
        raise ValueError("no events with a time of at least 0")
    return rows, width or size.width, height or size.height


def detect(frames: DataFrame, detector) -> DataFrame:
    """t, tag_id, corners of frames (t, height, width, px): detector(array) gives (tag_id, four corners) pairs; none gives nulls."""
    schema = "t bigint, tag_id int, corners array<struct<x:double,y:double>>"

    def run(batches):
        for pdf in batches:
            rows = []
            for f in pdf.itertuples():
                hits = list(detector(np.frombuffer(f.px, "<u2").reshape(f.height, f.width)))
                rows += [(f.t, tag, [{"x": float(a), "y": float(b)} for a, b in corners]) for tag, corners in hits] or [(f.t, None, None)]
            import pandas as pd

            yield pd.DataFrame(rows, columns=["t", "tag_id", "corners"])

    return frames.select("t", "height", "width", "px").mapInPandas(run, schema)


def record(stream: DataFrame, path: str, checkpoint: str, most: int | None = None, gray: bool = False):
    """Starts a query that records a stream of packed frames (frame_idx, sensor_ts, height, width, px of 16 bits).

    path gets frames (Parquet) and metadata (CSV with FrameIndex and SensorTimestamp). most: frames with frame_idx below it only.
    gray also keeps each frame in 8 bits. Batches are written under their number, so a repeated batch replaces itself.
    """

    def eight(px: pd.Series) -> pd.Series:
        return px.map(lambda raw: (np.frombuffer(raw, "<u2").astype(np.uint32) * 255 // 1023).astype(np.uint8).tobytes())

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if most is None else batch.where(F.col("frame_idx") < most)
        if gray:
            rows = rows.withColumn("gray", F.pandas_udf(eight, "binary")("px"))
        rows.write.mode("overwrite").parquet(f"{path}/frames/batch={number}")
        rows.select(F.col("frame_idx").alias("FrameIndex"), F.col("sensor_ts").alias("SensorTimestamp")).write.mode("overwrite").option("header", True).csv(f"{path}/metadata/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def rotated_crops(frames: DataFrame) -> DataFrame:
    """t, left, top, height, width, px: each frame turned about center by angle and cut to its polygon's bounds there.

    frames: t, height, width, px (16 bits), polygon, angle, center; no polygon, no crop. Pixels are interpolated linearly, outside is 0.
    """
    schema = "t bigint, left int, top int, height int, width int, px binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_crop(f) for f in pdf.itertuples()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return frames.where("polygon is not null").select("t", "height", "width", "px", "polygon", "angle", "center").mapInPandas(run, schema)


def _crop(f) -> tuple:
    a, cx, cy = np.radians(f.angle), f.center["x"], f.center["y"]
    cos, sin = np.cos(a), np.sin(a)
    corners = np.array([(p["x"], p["y"]) for p in f.polygon]) - (cx, cy)
    turned = np.stack([corners[:, 0] * cos + corners[:, 1] * sin + cx, -corners[:, 0] * sin + corners[:, 1] * cos + cy], 1)
    left, top = np.maximum(turned.min(0), 0).astype(int)
    right, bottom = np.minimum(turned.max(0), (f.width, f.height)).astype(int)
    height, width = max(0, bottom - top), max(0, right - left)
    y, x = np.mgrid[top : top + height, left : left + width]
    sx, sy = (x - cx) * cos - (y - cy) * sin + cx, (x - cx) * sin + (y - cy) * cos + cy
    # a border of zeros around the image
    image = np.zeros((f.height + 2, f.width + 2))
    image[1:-1, 1:-1] = np.frombuffer(f.px, "<u2").reshape(f.height, f.width)
    sx, sy = np.clip(sx, -1, f.width), np.clip(sy, -1, f.height)
    ix, iy = np.minimum(np.floor(sx).astype(int), f.width - 1), np.minimum(np.floor(sy).astype(int), f.height - 1)
    fx, fy = sx - ix, sy - iy
    at = lambda dy, dx: image[iy + 1 + dy, ix + 1 + dx]
    value = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    return f.t, int(left), int(top), height, width, np.rint(value).astype("<u2").tobytes()
