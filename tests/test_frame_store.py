"""Ordered, committed sinks and the frame scan that opens only what is wanted."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from saccade.operators import ordered  # noqa: F401
from saccade.sources import frames as sources
from saccade.sources import sinks

FRAMES = "frame_idx int, t long, height int, width int, px binary"


def image(i):
    return (np.arange(12, dtype=np.int64) * 7 + i).astype("<u2").tobytes()


def stored(spark, path, numbers, parts=4, **options):
    rows = [(i, None if options.get("no_time") else 1000 * i + i % 2, 3, 4, image(i)) for i in numbers]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_frames(spark.createDataFrame(rows, FRAMES).repartition(3), path, 3, 4, **{k: v for k, v in options.items() if k != "no_time"})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return sinks.read_manifest(path)


def test_frames_round_trip_in_order(spark, tmp_path):
    path = str(tmp_path / "f")
    found = stored(spark, path, range(40))
    assert sum(p.rows for p in found.parts) == 40 and len(found.parts) > 1
    assert [p.first for p in found.parts] == sorted(p.first for p in found.parts) and found.parts[1].offset == found.parts[0].bytes
    assert sinks.join_parts(path, str(tmp_path / "all.dat"), ".dat") == 40 * 24
    assert (tmp_path / "all.dat").read_bytes() == b"".join(image(i) for i in range(40))
    got = sources.read_frames(spark, path).collect()
    assert sorted((r.frame_idx, r.t, bytes(r.px)) for r in got) == [(i, 1000 * i + i % 2, image(i)) for i in range(40)]
    for part in found.parts:
        os.remove(f"{path}/{part.name}.dat")  # times come from the index alone
    times = sources.frame_times(spark, path)
    assert sorted(tuple(r) for r in times.where("t > 37000").collect()) == [(37, 37001), (38, 38000), (39, 39001)] and times.count() == 40
    # the joined file is a frame file as any other
    assert sources.read_frames(spark, str(tmp_path / "all.dat"), 3, 4).where("frame_idx in (3, 39)").count() == 2


def test_only_wanted_parts_are_opened(spark, tmp_path):
    """Every part that no filter needs is deleted first: the scan does not miss it."""
    path = str(tmp_path / "f")
    found = stored(spark, path, range(80), parts=8)
    keep = next(p for p in found.parts if p.first <= 30 <= p.last)
    for part in found.parts:
        if part != keep:
            os.remove(f"{path}/{part.name}.dat"), os.remove(f"{path}/{part.name}.idx")
    at = [keep.first, keep.last]
    numbers = lambda df: sorted(r.frame_idx for r in df.collect())
    read = lambda **bounds: numbers(sources.read_frames(spark, path, **bounds))
    assert read(frames=(at[0], at[0])) == [at[0]] and read(frames=[at[0], at[1], 999]) == sorted(set(at))
    assert read(frames=(at[0], at[1]), times=(1000 * at[0] + 2, None)) == list(range(at[0] + 1, at[1] + 1))
    assert read(times=(1000 * at[0], 1000 * at[1] + 999)) == list(range(at[0], at[1] + 1))
    assert read(frames=(1000, None)) == [] == read(frames=[])
    assert sources.read_frames(spark, path, frames=[at[0]]).rdd.getNumPartitions() == 1
    # filters of the query, if the scan is asked to take them; a new DataFrame each time
    where = lambda text: numbers(sources.read_frames(spark, path, pushdown=True).where(text))
    assert where(f"frame_idx = {at[0]}") == [at[0]] and where(f"frame_idx in ({at[0]}, {at[1]}, 999)") == sorted(set(at))
    assert where(f"frame_idx between {at[0]} and {at[1]} and t > {1000 * at[0] + 1}") == list(range(at[0] + 1, at[1] + 1))
    assert where(f"t >= {1000 * at[0]} and t < {1000 * (at[1] + 1)}") == list(range(at[0], at[1] + 1))
    assert where("frame_idx > 1000") == [] == where("frame_idx = 3 and frame_idx = 5")
    wanted = spark.createDataFrame([(at[0],), (at[1],), (at[1],), (None,)], "frame_idx int")
    assert sorted(r.frame_idx for r in sources.frames_at(wanted, path).collect()) == sorted(set(at))
    with pytest.raises(Exception):
        read(frames=[79 if keep.last < 79 else 0])


def test_bytes_of_a_file_are_pruned(spark, tmp_path, monkeypatch):
    """Reads of one file: counted bytes, by number, by time from the metadata, and by binary search in it."""
    monkeypatch.setattr(sources, "TASK_BYTES", 0)
    n = 320
    (tmp_path / "raw.dat").write_bytes(b"".join(image(i) for i in range(n)))
    kind = np.dtype([("s", "<f8"), ("r", "S30")])
    np.array([(1000.0 * i + 0.5, b"") for i in range(n)], kind).tofile(tmp_path / "meta.dat")
    options = {"path": str(tmp_path / "raw.dat"), "height": 3, "width": 4}

    def scan(filters, **more):
        reader = sources._PushingReader({**options, **more})
        assert list(reader.pushFilters(filters)) == []
        parts = reader.partitions()
        return len(parts), [i for p in parts for b in reader.read(p) for i in b.column("frame_idx").to_pylist()], sum(b.column("px").nbytes for p in parts for b in reader.read(p))

    idx, t = ("frame_idx",), ("t",)
    meta = {"metadata": str(tmp_path / "meta.dat")}
    assert scan([sources.GreaterThanOrEqual(idx, 100), sources.LessThan(idx, 103)])[:2] == (1, [100, 101, 102])
    tasks, got, size = scan([sources.In(idx, (5, 300, 9999))])
    assert (tasks, got) == (2, [5, 300]) and size < 200
    assert scan([sources.GreaterThan(t, 318_000)], **meta)[:2] == (10, [319])
    assert scan([sources.GreaterThan(t, 318_000)], ordered="true", **meta)[:2] == (1, [319])
    assert scan([sources.EqualTo(t, 64_000)], ordered="true", **meta)[:2] == (1, [64])
    assert scan([sources.GreaterThanOrEqual(t, 31_000), sources.LessThanOrEqual(t, 33_000)], ordered="true", **meta)[:2] == (2, [31, 32, 33])
    frames = sources.read_frames(spark, options["path"], 3, 4, metadata=meta["metadata"], ordered=True)
    assert [(r.frame_idx, r.t) for r in frames.where("t = 7000").collect()] == [(7, 7000)]
    # one DataFrame with several filters: none of them is pushed, so none of them meets another's
    assert frames.where("frame_idx < 5").union(frames.where("frame_idx >= 310")).count() == 15 and frames.count() == n


def test_gaps_appends_overwrites_and_named_jobs(spark, tmp_path):
    path = str(tmp_path / "f")
    stored(spark, path, [3, 9, 10, 50], no_time=True)
    stored(spark, path, [1, 70], job="late")
    numbers = lambda: sorted((r.frame_idx, r.t) for r in sources.read_frames(spark, path).where("frame_idx <> 9").select("frame_idx", F.coalesce("t", F.lit(-1)).alias("t")).collect())
    assert numbers() == [(1, 1001), (3, -1), (10, -1), (50, -1), (70, 70_000)]
    assert sources.read_frames(spark, path).where("t >= 0").count() == 2
    stored(spark, path, [2], job="late")  # the same job again replaces itself
    assert numbers() == [(2, 2000), (3, -1), (10, -1), (50, -1)]
    assert [r.frame_idx for r in sources.frames_at(spark.createDataFrame([(10,), (4,)], "frame_idx int"), path).collect()] == [10]
    stored(spark, path, [6], overwrite=True)
    assert numbers() == [(6, 6000)] and len([f for f in os.listdir(path) if f.endswith(".dat")]) == 1
    with pytest.raises(Exception, match="3 x 4"):
        sinks.write_frames(spark.createDataFrame([(1, 0, 2, 2, b"12345678")], FRAMES), path, 2, 2)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "f")
    stored(spark, path, range(10))
    before = sorted(os.listdir(path))
    bad = spark.createDataFrame([(20, 0, 3, 4, image(20)), (21, 0, 3, 4, b"short")], FRAMES)
    with pytest.raises(Exception, match="frame 21"):
        sinks.write_frames(bad, path, 3, 4)
    assert sorted(os.listdir(path)) == before and sources.read_frames(spark, path).count() == 10
    events = spark.range(5).select(F.col("id").alias("t"), F.lit(1).alias("x"), F.when(F.col("id") < 3, 2).otherwise(F.raise_error(F.lit("lost"))).cast("int").alias("y"), F.lit(1).alias("p"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_event_text(events, str(tmp_path / "e"))
    assert sinks.read_manifest(str(tmp_path / "e")) is None and [f for f in os.listdir(tmp_path / "e") if f.startswith("part")] == []


def test_event_text_in_ordered_parts(spark, tmp_path):
    path = str(tmp_path / "e.txt")
    rows = [((i * 7919) % 1000 - 5, i % 3, i % 5, i % 2) for i in range(1000)]
    events = spark.createDataFrame(rows, "t long, x int, y int, p tinyint").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_event_text(events, path, one_file=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sinks.read_manifest(path).parts
    assert len(parts) > 1 and sum(p.rows for p in parts) == 1000
    text = b"".join(open(f"{path}/{p.name}", "rb").read() for p in parts).decode()
    assert text == "".join(f"{t} {x} {y} {p}\n" for t, x, y, p in sorted(rows)) == open(f"{path}/events.txt").read()
    assert [p.offset for p in parts] == np.cumsum([0, *[p.bytes for p in parts]])[:-1].tolist()
    assert sorted(tuple(r) for r in sources.read_events(spark, path).collect()) == sorted(rows)
    sinks.write_event_text(events.limit(0), path)
    assert sources.read_events(spark, path).count() == 0 and [f for f in os.listdir(path) if f.startswith("part")] == []


def test_packed_frames_round_trip(spark):
    rows = [(i, 10 * i, x, y, 100 * i + 4 * y + x) for i in range(3) for x in range(4) for y in range(3) if (x, y) != (2, 1)] + [(1, 10, 0, 0, 999), (1, 10, 7, 0, 5)]
    packed = sources.packed_frames(spark.createDataFrame(rows, "frame_idx int, t long, x int, y int, lum int"), 3, 4)
    got = {(r.frame_idx, r.x, r.y): r.lum for r in sources.pixel_rows(packed).collect()}
    assert len(got) == 36 and got[2, 3, 2] == 211 and got[1, 2, 1] == 0 and got[1, 0, 0] == 999


def test_small_frames_are_unpacked_many_at_a_time():
    class Frames:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    def batch(rows):
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema({"frame_idx": pa.int32(), "height": pa.int32(), "width": pa.int32(), "px": pa.binary()}))

    run = sources.pixel_rows(Frames(), 4)
    rows = [{"frame_idx": i, "height": 1, "width": 1 + i // 5000, "px": bytes([i % 256, 1, 2, 3] * (1 + i // 5000))} for i in range(10_000)]
    got = list(run(iter([batch(rows[:0]), batch(rows)])))
    assert len(got) == 2  # one for each size of frames
    table = pa.Table.from_batches(got)
    assert table.column("frame_idx").to_pylist() == [*range(5000), *(i for i in range(5000, 10_000) for _ in range(2))]
    assert table.column("c0").to_pylist() == [i % 256 for i in table.column("frame_idx").to_pylist()] and set(table.column("c3").to_pylist()) == {3}
    assert table.column("x").to_pylist() == [0] * 5000 + [0, 1] * 5000 and set(table.column("y").to_pylist()) == {0}
    with pytest.raises(ValueError, match="4 bytes"):
        list(run(iter([batch([{**rows[0], "px": b"123"}, {**rows[1], "px": b"12345"}])])))


def test_a_part_that_is_cut_short_is_an_error(spark, tmp_path):
    path = str(tmp_path / "f")
    part = stored(spark, path, range(10), parts=1).parts[0]
    with open(f"{path}/{part.name}.dat", "r+b") as file:
        file.truncate(9 * 24 + 5)
    with pytest.raises(Exception, match="ends before frame 9"):
        sources.read_frames(spark, path).collect()
