"""The leaky accumulator: maps against plain folds, any chunking, slices, and the stream against the batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccade import schema
from saccade.operators import accumulator as A
from saccade.streaming import events as streams


def plain(rows, width, decay=A.DECAY):
    """(x, y, slice): (n, t, level) by a fold in time order."""
    state, out = {}, {}
    for t, x, y, p in sorted(rows, key=lambda r: (r[0], r[3])):
        level, last = state.get((x, y), (A.NEUTRAL, t))
        away = level - A.NEUTRAL
        level = A.NEUTRAL + np.sign(away) * max(abs(away) - decay * (t - last), 0)
        level = min(1.0, max(0.0, level + (A.CONTRIBUTION if p > 0 else -A.CONTRIBUTION)))
        state[x, y] = level, t
        n = out.get((x, y, t // width), (0,))[0]
        out[x, y, t // width] = n + 1, t, level
    return out


def made(seed, n=1500, hot=1200, alternate=0):
    rng = random.Random(seed)
    rows = [(rng.randrange(10**6), rng.randrange(6), rng.randrange(2), rng.randrange(2)) for _ in range(n)]
    rows += [(rng.randrange(10**6), 77, 0, rng.randrange(2)) for _ in range(hot)]
    return rows + [(i * 700, 99, 1, i % 2) for i in range(alternate)]


@pytest.mark.parametrize("seed", range(4))
def test_maps_are_what_folds_do(seed):
    rng = np.random.default_rng(seed)
    n = 60
    dt, p = rng.integers(0, 300_000, n).astype(float), rng.integers(0, 2, n)
    if seed == 3:
        dt, p = np.full(n, 3000.0), np.arange(n) % 2
    levels = np.linspace(0, 1, 401)
    want, whole, halves = levels.copy(), A.LevelMap(), [A.LevelMap(), A.LevelMap()]
    for i in range(n):
        want = A.stepped(want, dt[i], p[i])
        whole = whole.then_event(dt[i], p[i])
        halves[i >= n // 2] = halves[i >= n // 2].then_event(dt[i], p[i])
        assert np.abs(whole(levels) - want).max() < 1e-12
    assert np.abs(halves[0].then(halves[1])(levels) - want).max() < 1e-12
    assert (np.diff(whole.ys) >= 0).all() and len(whole.xs) < 2 * n + 2


@pytest.mark.parametrize("partitions,piece,fan,batch", [(1, 64, 64, 10_000), (9, 4, 2, 10_000), (23, 64, 3, 50), (40, 2, 2, 7)])
def test_any_chunking_gives_the_plain_fold(spark, partitions, piece, fan, batch):
    """A pixel over many tasks, with events of both polarities in turn, which keep a map from becoming constant."""
    rows = made(1, alternate=900) + [(5, 50, 0, 1)] * 3
    events = spark.createDataFrame(rows, schema.EVENTS).repartition(5)
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = {(r.x, r.y, r.slice): (r.n, r.t, r.level) for r in A.accumulated(events, 33_000, piece=piece, fan=fan).collect()}
        total = {(r.x, r.y): (r.t, r.level) for r in A.accumulate(events, piece=piece, fan=fan).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for k in list(settings)[1:]:
            spark.conf.unset(k)
    want = plain(rows, 33_000)
    assert got.keys() == want.keys()
    for k, (n, t, level) in want.items():
        assert got[k][:2] == (n, t) and got[k][2] == pytest.approx(level, abs=1e-9)
    for (x, y, _), (_, t, level) in plain(rows, 10**9).items():
        assert total[x, y] == (t, pytest.approx(level, abs=1e-9))


def test_keys_gaps_and_empty(spark):
    rows = [("s", 5, 0, 0, 1), (None, 6, 0, 0, 0), (None, 9, 0, 0, 0), ("s", None, 0, 0, 1), ("s", 7, None, 0, 1)]
    events = spark.createDataFrame(rows, "session string, t long, x int, y int, p int")
    got = {r.session: (r.n, r.level) for r in A.accumulated(events, keys=("session",)).collect()}
    assert got == {"s": (1, 0.75), None: (2, pytest.approx(0, abs=1e-5))}
    assert A.accumulated(events.limit(0), keys=("session",)).count() == 0
    shown = A.slice_frames(spark.createDataFrame([(1000, 0, 0, 1)], schema.EVENTS)).first()
    assert (shown.end, shown.level) == (33_000, 0.75) and shown.shown == pytest.approx(0.75 - 0.032)


def test_stream_gives_the_batch_per_slice(spark, tmp_path):
    rows = made(5, n=250, hot=80)
    # files in time order but for some events that come a file late
    ordered = sorted(rows)
    files = [ordered[i : i + 66] for i in range(0, len(ordered), 66)]
    for a, b in zip(files[:-1], files[1:], strict=True):
        b.append(a.pop(random.Random(1).randrange(len(a))))
    files.append([(10**7, 0, 0, 1)])
    for i, part in enumerate(files):
        spark.createDataFrame(part, schema.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f{i:03}"))
    source = spark.readStream.schema(schema.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = streams.slice_stream(source, late="400 milliseconds").writeStream.format("memory").queryName("slices").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.x, r.y, r.slice): (r.n, r.t, r.level) for r in spark.table("slices").collect()}
    batch = {(r.x, r.y, r.slice): (r.n, r.t, r.level) for r in A.accumulated(spark.createDataFrame(rows, schema.EVENTS)).collect()}
    assert got.keys() == batch.keys()
    assert all(got[k][:2] == batch[k][:2] and got[k][2] == pytest.approx(batch[k][2], abs=1e-9) for k in batch)
