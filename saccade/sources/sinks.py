"""Sinks in ordered parts, made visible by a manifest: event text and headerless frames.

The tasks of a job write to a staging folder below the target; task i's part is named by i, so the order of partitions is the order of
parts. When all have ended well the driver moves their parts to the target, writes the manifest, and removes the staging folder with
what lost attempts left in it: readers see listed parts only. If a task fails for good the staging folder goes, and target and manifest
stay as they were.

The manifest lists for each part its file, rows, bytes, and the byte at which it would begin if all parts stood in one file; for frames also
the first and last frame and time. Job names may be given: a job that is written again under its name replaces itself (streams).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "_manifest.json"
#: Index of a frame part: number and time of each frame.
INDEX = np.dtype([("frame_idx", "<i8"), ("t", "<i8")])
#: Time of a frame that has none.
NO_TIME = np.iinfo(np.int64).min


def at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of path and its name there; a path without a scheme is a local one."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Part(WriterCommitMessage):
    """A part: file, job, its place among the job's parts, rows, bytes, offset; first and last frame, first and last time."""

    name: str
    job: str
    place: int
    rows: int
    bytes: int
    offset: int = 0
    first: int | None = None
    last: int | None = None
    first_t: int | None = None
    last_t: int | None = None


@dataclass(frozen=True)
class Manifest:
    parts: tuple[Part, ...]
    height: int = 0
    width: int = 0
    channels: int = 1


def read_manifest(path: str) -> Manifest | None:
    """The manifest of a folder, None if it has none."""
    fs, base = at(path)
    name = f"{base.rstrip('/')}/{MANIFEST}"
    if fs.get_file_info(name).type != pafs.FileType.File:
        return None
    with fs.open_input_file(name) as file:
        found = json.loads(file.read())
    return Manifest(tuple(Part(**p) for p in found.pop("parts")), **found)


def _write_manifest(path: str, manifest: Manifest) -> None:
    """A complete file takes the place of the old one."""
    fs, base = at(path)
    name = f"{base.rstrip('/')}/{MANIFEST}"
    new = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(new, compression=None) as file:
        file.write(json.dumps({**asdict(manifest), "parts": [asdict(p) for p in manifest.parts]}).encode())
    fs.move(new, name)


class PartWriter(DataSourceArrowWriter):
    """What both sinks share: names, commit, abort."""

    suffixes: tuple[str, ...] = ("",)

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = options.get("job") or uuid.uuid4().hex
        fs, base = at(self.path)
        self.base = base.rstrip("/")
        self.staging = f"{self.base}/_staging-{self.job}-{uuid.uuid4().hex[:8]}"
        fs.create_dir(self.staging, recursive=True)

    def new_part(self) -> Part:
        place = TaskContext.get().partitionId()
        return Part(f"part-{place:07d}-{self.job}-{uuid.uuid4().hex[:8]}", self.job, place, 0, 0)

    def commit(self, messages: list) -> None:
        fs, _ = at(self.path)
        made = sorted((m for m in messages if m is not None and m.rows), key=lambda p: p.place)
        old = read_manifest(self.path)
        kept = [] if self.overwrite or old is None else [p for p in old.parts if p.job != self.job]
        parts, offset = [], 0
        for part in self.ordered([*kept, *made]):
            parts.append(replace(part, offset=offset))
            offset += part.bytes
        manifest = self.manifest(tuple(parts), old)
        for name in (p.name + s for p in made for s in self.suffixes):
            fs.move(f"{self.staging}/{name}", f"{self.base}/{name}")
        _write_manifest(self.path, manifest)
        listed = {p.name + s for p in parts for s in self.suffixes}
        for info in fs.get_file_info(pafs.FileSelector(self.base)):
            if info.is_file and info.base_name.startswith("part-") and info.base_name not in listed:
                fs.delete_file(info.path)
        fs.delete_dir(self.staging)

    def abort(self, messages: list) -> None:
        at(self.path)[0].delete_dir(self.staging)

    def ordered(self, parts: list[Part]) -> list[Part]:
        return parts

    def manifest(self, parts: tuple[Part, ...], old: Manifest | None) -> Manifest:
        return Manifest(parts)


class EventText(DataSource):
    """Lines of four integers (t, x, y, p), one part a partition, in the rows' order. Options: path, job."""

    @classmethod
    def name(cls) -> str:
        return "eventtext"

    def schema(self):
        return "t bigint, x int, y int, p tinyint"

    def writer(self, schema, overwrite: bool):
        return _TextWriter(dict(self.options), overwrite)


class _TextWriter(PartWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, part = at(self.path)[0], self.new_part()
        out, rows, size, first, last = None, 0, 0, None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    out = fs.open_output_stream(f"{self.staging}/{part.name}", compression=None)
                    first = batch.column("t")[0].as_py()
                columns = [batch.column(c).cast(pa.string()) for c in ("t", "x", "y", "p")]
                lines = pc.binary_join_element_wise(*columns, " ", null_handling="replace", null_replacement="")
                text = ("\n".join(lines.to_pylist()) + "\n").encode()
                out.write(text)
                rows, size, last = rows + batch.num_rows, size + len(text), batch.column("t")[-1].as_py()
        finally:
            if out is not None:
                out.close()
        return replace(part, rows=rows, bytes=size, first_t=first, last_t=last)


class FrameSink(PartWriter):
    """Headerless frames with an index beside them; all frames of a target have one size."""

    suffixes = (".dat", ".idx")

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.channels = int(options.get("channels", 1))
        self.height, self.width = int(options["height"]), int(options["width"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, part = at(self.path)[0], self.new_part()
        size = self.height * self.width * (2 if self.channels == 1 else self.channels)
        out, index = None, []
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                columns = [batch.column(c) for c in ("frame_idx", "height", "width", "px")]
                (idx, h, w), px = (c.to_numpy(zero_copy_only=False) for c in columns[:3]), columns[3]
                sizes = pc.fill_null(pc.binary_length(px), -1).to_numpy()
                bad = np.flatnonzero((h != self.height) | (w != self.width) | (sizes != size))
                if len(bad):
                    i = int(bad[0])
                    raise ValueError(f"frame {idx[i]} is {h[i]} x {w[i]} with {max(0, sizes[i])} bytes, not {self.height} x {self.width} with {size}")
                if columns[0].null_count:
                    raise ValueError("a frame needs a number")
                if out is None:
                    out = fs.open_output_stream(f"{self.staging}/{part.name}.dat", compression=None)
                out.write(b"".join(px.to_pylist()))
                rows = np.zeros(batch.num_rows, INDEX)
                rows["frame_idx"] = idx
                rows["t"] = pc.fill_null(batch.column("t").cast(pa.int64()), NO_TIME).to_numpy() if "t" in batch.schema.names else NO_TIME
                index.append(rows)
        finally:
            if out is not None:
                out.close()
        if not index:
            return part
        rows = np.concatenate(index)
        with fs.open_output_stream(f"{self.staging}/{part.name}.idx", compression=None) as file:
            file.write(rows.tobytes())
        known = rows["t"][rows["t"] != NO_TIME]
        span = (int(known.min()), int(known.max())) if len(known) == len(rows) else (None, None)
        return replace(part, rows=len(rows), bytes=len(rows) * size, first=int(rows["frame_idx"].min()), last=int(rows["frame_idx"].max()), first_t=span[0], last_t=span[1])

    def ordered(self, parts: list[Part]) -> list[Part]:
        return sorted(parts, key=lambda p: (p.first, p.place))

    def manifest(self, parts: tuple[Part, ...], old: Manifest | None) -> Manifest:
        size = (self.height, self.width, self.channels)
        if old is not None and not self.overwrite and old.parts and (old.height, old.width, old.channels) != size:
            raise ValueError(f"{self.path} holds frames of {old.height} x {old.width} x {old.channels}, not {size}")
        return Manifest(parts, *size)


def write_event_text(events: DataFrame, path: str, one_file: bool = False, overwrite: bool = True, job: str | None = None) -> None:
    """Events as lines of four integers, ordered by t (then x, y, p): in parts whose order is that of the rows.

    one_file joins the parts to the file path/events.txt afterwards, as a stream of bytes through the driver, for tools that need one.
    """
    events.sparkSession.dataSource.register(EventText)
    rows = events.select(F.col("t").cast("long"), F.col("x").cast("int"), F.col("y").cast("int"), F.col("p").cast("tinyint")).orderBy("t", "x", "y", "p")
    writer = rows.write.format("eventtext").mode("overwrite" if overwrite else "append").option("path", path)
    (writer.option("job", job) if job else writer).save()
    if one_file:
        join_parts(path, f"{path.rstrip('/')}/events.txt")


def part_paths(path: str) -> list[str] | None:
    """The files of a target's parts in order, None if it has no manifest."""
    found = read_manifest(path)
    return None if found is None else [f"{path.rstrip('/')}/{p.name}" for p in found.parts]


def join_parts(path: str, target: str, suffix: str = "", block: int = 1 << 22) -> int:
    """Copies a target's parts, in order, to one file; the bytes written."""
    (fs, base), (there, name), size = at(path), at(target), 0
    with there.open_output_stream(name, compression=None) as out:
        for part in (read_manifest(path) or Manifest(())).parts:
            with fs.open_input_stream(f"{base}/{part.name}{suffix}", compression=None) as file:
                while data := file.read(block):
                    out.write(data)
                    size += len(data)
    return size


def write_frames(frames: DataFrame, path: str, height: int, width: int, channels: int = 1, overwrite: bool = False, job: str | None = None) -> None:
    """Packed frames (frame_idx, height, width, px, and t if there is one) as headerless parts in the order of frame_idx."""
    from .frames import register

    register(frames.sparkSession)
    columns = ["frame_idx", "height", "width", "px", *(["t"] if "t" in frames.columns else [])]
    rows = frames.select(*columns).repartitionByRange("frame_idx").sortWithinPartitions("frame_idx")
    writer = rows.write.format("rawframes").mode("overwrite" if overwrite else "append").options(path=path, height=height, width=width, channels=channels)
    (writer.option("job", job) if job else writer).save()


def read_event_text(spark: SparkSession, path: str) -> DataFrame:
    """Events from text: a file, a folder of files, or the listed parts of a target of write_event_text()."""
    reader, parts = spark.read.schema("t bigint, x int, y int, p tinyint").option("sep", " "), part_paths(path)
    if parts is None:
        return reader.csv(path)
    return reader.csv(parts) if parts else spark.createDataFrame([], "t bigint, x int, y int, p tinyint")
