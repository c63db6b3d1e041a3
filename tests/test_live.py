"""The live source: limits, restarts, growing logs, playback."""

import numpy as np
import pytest
from pyspark.sql.streaming.readwriter import DataStreamWriter

from saccade.streaming import live


def feed(folder, camera, first, n):
    t = np.arange(first, first + n)
    live.append(f"{folder}/{camera}.elog", 10 * t, t % 700, t % 500, t % 2)


def run(spark, folder, out, checkpoint, limit, batches=None):
    """Drains the stream into out; the sizes of its batches. batches: the batch at which it fails, before it is kept."""
    sizes = []

    def keep(df, number):
        rows = df.collect()
        if batches is not None and number == batches:
            raise RuntimeError("stopped")
        sizes.append(len(rows))
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = live.live_events(spark, folder, limit, per_task=7).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sizes


def got(spark, out):
    return sorted((r.camera, r.record, r.t, r.x, r.y, r.p) for r in spark.read.parquet(out).collect())


def want(*parts):
    return sorted((c, i, 10 * i, i % 700, i % 500, i % 2) for c, n in parts for i in range(n))


def test_limit_restart_and_new_logs(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("logs", "out", "check"))
    (tmp_path / "logs").mkdir()
    feed(folder, "a", 0, 25)
    feed(folder, "b", 0, 3)
    sizes = run(spark, folder, out, check, 10)
    assert sum(sizes) == 28 and max(sizes) == 10 and len(sizes) == 3
    assert got(spark, out) == want(("a", 25), ("b", 3))
    # stopped, grown, a new camera, a record that is written in part: restarted from the checkpoint
    feed(folder, "a", 25, 10)
    feed(folder, "c", 0, 5)
    with open(f"{folder}/c.elog", "ab") as file:
        file.write(b"\1\2\3")
    sizes = run(spark, folder, out, check, 10)
    assert sum(sizes[-2:]) == 15 and all(s <= 10 for s in sizes)
    assert got(spark, out) == want(("a", 35), ("b", 3), ("c", 5))


def test_a_batch_that_failed_is_read_again_as_it_was(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("logs", "out", "check"))
    (tmp_path / "logs").mkdir()
    feed(folder, "a", 0, 40)
    with pytest.raises(Exception, match="stopped"):
        run(spark, folder, out, check, 16, batches=1)
    feed(folder, "a", 40, 9)
    run(spark, folder, out, check, 16)
    assert got(spark, out) == want(("a", 49))


def test_fair_shares_and_a_shrunk_log(tmp_path):
    feed(str(tmp_path), "a", 0, 100)
    feed(str(tmp_path), "b", 0, 4)
    reader = live._LogReader({"path": str(tmp_path), "limit": "20"})
    end = reader.latestOffset()
    assert end == {"a": 16, "b": 4} == reader.latestOffset()  # asked twice, planned once
    parts = reader.partitions({}, end)
    assert [(p.camera, p.first, p.last) for p in parts] == [("a", 0, 16), ("b", 0, 4)]
    assert reader.latestOffset() == {"a": 36, "b": 4}
    (tmp_path / "a.elog").write_bytes(b"")
    with pytest.raises(ValueError, match="16 were taken"):
        reader.latestOffset()
    assert live._LogReader({"path": str(tmp_path / "none")}).latestOffset() == {}


def test_playback_of_written_logs(spark, tmp_path):
    rows = [("cam é" if i % 3 else "b", (i * 37) % 500, i % 16, i % 9, i % 2) for i in range(300)]
    events = spark.createDataFrame(rows, "camera string, t long, x int, y int, p int")
    live.write_logs(events.repartition(4), str(tmp_path / "logs"))
    assert sorted(p.name for p in (tmp_path / "logs").iterdir()) == ["b.elog", "cam é.elog"]
    run(spark, str(tmp_path / "logs"), str(tmp_path / "out"), str(tmp_path / "check"), 120)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.camera, r.t, r.x, r.y, r.p) for r in back) == sorted(rows)
    for camera in ("b", "cam é"):
        times = [r.t for r in sorted((r for r in back if r.camera == camera), key=lambda r: r.record)]
        assert times == sorted(times)
    with pytest.raises(ValueError):
        live.write_logs(spark.createDataFrame([(None, 1, 1, 1, 1)], "camera string, t long, x int, y int, p int"), str(tmp_path / "bad"))


def test_a_long_recording_is_played_by_streams_side_by_side(spark, tmp_path):
    assert live.stretches({}, 10) == [] and live.stretches({"a": 7}, 10) == [{"a": (0, 7)}]
    assert live.stretches({"a": 45, "b": 0, "c": 15}, 10, 3) == [{"a": (0, 20)}, {"a": (20, 40)}, {"a": (40, 45), "c": (0, 15)}]
    for logs, limit, streams in (({"a": 1001, "b": 3, "c": 77}, 10, 8), ({"a": 5, "b": 5}, 3, 8), ({f"c{i}": i for i in range(50)}, 4, 7)):
        found = live.stretches(logs, limit, streams)
        taken = sorted((c, i) for o in found for c, (a, b) in o.items() for i in range(a, b))
        assert taken == sorted((c, i) for c, n in logs.items() for i in range(n)) and len(found) <= streams
        assert max(sum(b - a for a, b in o.values()) for o in found) <= sum(logs.values()) / len(found) + limit * streams
    (tmp_path / "logs").mkdir()
    feed(tmp_path / "logs", "a", 0, 90)
    feed(tmp_path / "logs", "b", 0, 4)
    rows = live.play_back(spark, str(tmp_path / "logs"), str(tmp_path / "out"), 20, 3).collect()
    assert sorted((r.camera, r.record, r.t, r.x, r.y, r.p) for r in rows) == want(("a", 90), ("b", 4))
    folders = sorted(p for p in (tmp_path / "out").iterdir())
    assert len(folders) == 3
    for folder in folders:  # no batch is above the limit
        commits = [p for p in (tmp_path / "out-checkpoint" / folder.name / "commits").iterdir() if p.name.isdigit()]
        assert len(commits) == -(-spark.read.parquet(str(folder)).count() // 20)
    (tmp_path / "none").mkdir()
    assert live.play_back(spark, str(tmp_path / "none"), str(tmp_path / "nothing")).count() == 0


def test_streams_of_a_playback_are_few_and_planned_one_by_one(spark, tmp_path, monkeypatch):
    (tmp_path / "logs").mkdir()
    feed(tmp_path / "logs", "a", 0, 240)
    planned, start = [], DataStreamWriter.start

    def counted(self, *args, **kwargs):
        planned.append([q.lastProgress is not None for q in spark.streams.active])
        return start(self, *args, **kwargs)

    monkeypatch.setattr(DataStreamWriter, "start", counted)
    assert live.play_back(spark, str(tmp_path / "logs"), str(tmp_path / "out"), 20).count() == 240
    assert len(planned) <= 3 and all(all(p) for p in planned)
    assert not spark.streams.active
