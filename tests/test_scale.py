"""Scans by row groups, folds of sessions, subsamples, keyed as-of merges and observed counts."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from saccade import schema
from saccade.operators import asof, calibration, frames, intervals, ordered
from saccade.sources import frames as sources
from saccade.streaming import events as streams


def session_file(path, first, n, groups):
    path.parent.mkdir(parents=True, exist_ok=True)
    t = np.arange(first, first + n)
    table = pa.table({"t": t, "x": pa.array(t % 9, pa.int32()), "y": pa.array(t % 5, pa.int32()), "p": pa.array(t % 2, pa.int8()), "prev_lum": t * 1.0, "next_lum": t * 2.0, "frame_dt": t})
    pq.write_table(table, path, row_group_size=-(-n // groups), compression="none", use_dictionary=False)


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    session_file(tmp_path / "a" / "x.parquet", 0, 4000, 8)
    session_file(tmp_path / "b" / "y.parquet", 10_000, 10, 1)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "z.parquet").write_bytes(b"no parquet at all")
    groups = sources.row_groups(spark, str(tmp_path), "t").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.group, r.rows, r.first, r.last) for r in groups if r.error is None) == [("x.parquet", i, 500, 500 * i, 500 * i + 499) for i in range(8)] + [("y.parquet", 0, 10, 10_000, 10_009)]
    found = sources.scan_sessions(spark, str(tmp_path), columns=["t", "p"])
    assert found.columns == ["path", "group", "error", "t", "p", "session"]
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    good = [r for r in rows if r.error is None]
    assert sorted(r.t for r in good) == [*range(4000), *range(10_000, 10_010)] and {r.session for r in good} == {"a", "b"}
    assert len({r.task for r in good if r.session == "a"}) > 2
    assert [(r.session, r.t) for r in rows if r.error] == [("c", None)] and "Invalid" in next(r.error for r in rows if r.error)


def test_broken_groups_are_named_and_others_read(spark, tmp_path):
    """A group whose bytes are lost costs one row; by time only the groups that can hold it are opened."""
    path = tmp_path / "a" / "x.parquet"
    session_file(path, 0, 4000, 4)
    column = pq.ParquetFile(path).metadata.row_group(2).column(0)
    data = bytearray(path.read_bytes())
    at = column.data_page_offset
    data[at : at + column.total_compressed_size] = bytes(column.total_compressed_size)
    path.write_bytes(bytes(data))
    rows = sources.scan_sessions(spark, str(tmp_path)).collect()
    assert sorted(r.t for r in rows if r.error is None) == [*range(2000), *range(3000, 4000)]
    assert [r.group for r in rows if r.error] == [2]
    early = sources.scan_sessions(spark, str(tmp_path), columns=["x"], times=(990, 1010)).collect()
    assert len(early) == 21 and {r.group for r in early} == {0, 1} and not any(r.error for r in early)
    assert sources.scan_sessions(spark, str(tmp_path), times=(9000, None)).count() == 0


def test_sessions_are_folded_batch_by_batch(spark):
    rows = [("big", i, 1) for i in range(5000)] + [("bad", i, 1) for i in range(50)] + [("late", 5, 1), (None, 7, 1)]
    df = spark.createDataFrame(rows, "session string, t long, p int")

    def step(state, batch):
        if batch.num_rows > 100:
            raise MemoryError("a whole session at once")
        t = batch.column("t").to_pylist()
        if 5 in t and batch.column("session")[0].as_py() == "bad":
            raise ValueError("broken row")
        return state + sum(t)

    def finish(state):
        if state == 5:
            raise RuntimeError("too little")
        return {"total": [state]}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.session: (r.total, r.error) for r in sources.fold_sessions(df.repartition(3), lambda: 0, step, finish, "total long").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {"big": (sum(range(5000)), None), "bad": (None, "ValueError: broken row"), "late": (None, "RuntimeError: too little"), None: (7, None)}


@pytest.mark.parametrize("most", [0, 1, 37, 999, 1000, 5000])
def test_subsample_is_exact(spark, most):
    rows = [(i % 700, "a.b") for i in range(1000)]  # 300 rows twice
    df = spark.createDataFrame(rows, "id int, `a.b` string")
    some = [r.id for r in ordered.subsample(df, most, 2).collect()]
    again = [r.id for r in ordered.subsample(df.repartition(7), most, 2).collect()]
    assert len(some) == min(most, 1000) and sorted(some) == sorted(again)
    assert all(some.count(i) <= 2 for i in set(some))


def test_subsample_of_equal_rows(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(2,)] * 3, "id int")
    for most in (1, 100, 499, 502):
        assert ordered.subsample(df, most).count() == most
    plan = ordered.subsample(spark.range(10_000), 100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    kept = {r.id for r in ordered.subsample(spark.range(10_000), 2000, 5).collect()}
    assert len(kept) == 2000 and 800 < sum(i < 5000 for i in kept) < 1200


def test_keyed_asof_over_ranges(spark, monkeypatch):
    """One key over several ranges, ranges without a dimension row, ties, gaps: the same as the plain walk."""
    rng = random.Random(2)
    fact = [(rng.choice(["hot"] * 8 + ["b", None]), rng.randrange(2000), i) for i in range(900)] + [("hot", None, 900), ("none", 5, 901)]
    dim = [(k, t, t * 10) for k in ("hot", "b", None) for t in sorted(rng.sample(range(2000), 30 if k == "hot" else 3))] + [("hot", None, 1), ("unused", 4, 1)]
    want = {}
    for k, t, i in fact:
        before = [d for d in dim if d[0] == k and d[1] is not None and t is not None and d[1] <= t]
        want[i] = max(before, key=lambda d: d[1])[2] if before else None
    f = spark.createDataFrame(fact, "k string, t long, i int").repartition(3)
    d = spark.createDataFrame(dim, "k string, t long, v int")
    for size in (10**6, 60):
        monkeypatch.setattr(ordered, "WINDOW_ROWS", size)
        got = {r.i: r.prev and r.prev.v for r in asof.asof_union(f, d, ["k"]).collect()}
        assert got == want
    wide = asof.asof_union(f.where("k = 'hot'"), d, ["k"])
    joined = asof.asof_interpolated(f.where("k = 'hot' and t is not null"), d, ["k"])
    first = min(t for k, t, _ in dim if k == "hot" and t is not None)
    late = {r.i: r.prev.v for r in joined.where(F.col("t") >= first).collect()}
    assert {r.i: r.prev.v for r in wide.where(F.col("t") >= first).collect()} == late


def test_order_of_equal_times_is_fixed(spark):
    df = spark.createDataFrame([(5, i % 7, i) for i in range(50)], "t long, a int, b int")
    one = {(r.a, r.b): r.idx for r in ordered.numbered(df, "t").collect()}
    assert one == {(r.a, r.b): r.idx for r in ordered.numbered(df.repartition(6), "t").collect()} and sorted(one.values()) == list(range(1, 51))
    near = {r.cur.b: r.after and r.after.b for r in ordered.neighbours(df, "t").collect()}
    assert near == {r.cur.b: r.after and r.after.b for r in ordered.neighbours(df.repartition(6), "t").collect()}


def test_counts_are_observed_by_the_working_pass(spark, tmp_path):
    rows = [(1, 0, 0, 1), (-5, 1, 1, 0), (None, 1, 1, 1), (4, 99, 0, 1), (5, 0, 0, 7)]
    events = spark.createDataFrame(rows, schema.EVENTS)
    report = frames.validity_report(events, 16, 5).first().asDict()
    assert report == {"events": 5, "bad_time": 2, "out_of_frame": 1, "bad_polarity": 1}
    seen_rows, seen = frames.observed_validity(events, 16, 5)
    assert seen_rows.groupBy("x").count().count() == 3 and seen.get == report
    # in a stream: per batch, adding up to the same
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    source = spark.readStream.schema(schema.EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.observed_stream(source, 16, 5).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batches = streams.batch_validity(q)
    assert len(batches) == 2 and {k: sum(b[k] for b in batches) for k in report} == report


def test_a_stuck_pixel_is_split(spark, monkeypatch):
    """Intervals and frame differences with a hot pixel over many ranges are those of one window."""
    from saccade.operators import intervals

    rng = random.Random(4)
    rows = [(rng.randrange(3000), *(rng.choice([(7, 7)] * 6 + [(1, 0), (2, 0)])), rng.randrange(2)) for _ in range(1500)]
    events = spark.createDataFrame(rows, schema.EVENTS)
    pixels = spark.createDataFrame([(f, f * 10, x, 0, float((f * 7 + x) % 50)) for f in range(300) for x in range(3) if f % 9 != x], schema.PIXELS)
    many = lambda df: sorted(map(tuple, df.collect()))
    ask = lambda: (many(intervals.intervals(events, least=10, carry=("p",))), many(intervals.intervals(events, ("p", "x", "y"), longest=50)), many(frames.naive_events(pixels, 5)), many(intervals.busy_pixels(events, 300)))
    one = ask()
    monkeypatch.setattr(ordered, "WINDOW_ROWS", 70)
    assert ask() == one and len(one[0]) > 500 and len(one[3]) > 900


def _seen(df, counter):
    """df, whose rows are counted whenever they are made."""

    def run(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_sensor_constants_make_their_fits_once(spark):
    fits, made = calibration.synthetic_fits(spark, 20, noise=False), spark.sparkContext.accumulator(0)
    found = calibration.sensor_constants(_seen(fits, made)).collect()
    assert made.value == fits.count() == 800
    assert sorted(r.p for r in found) == [0, 1] and all(r.k1 == pytest.approx(5.0) and r.k2 == pytest.approx(20.0) for r in found)


def test_pool_statistics_make_their_values_once(spark, monkeypatch):
    monkeypatch.setattr(ordered, "WINDOW_ROWS", 40)
    made = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(i % 7, 0, ((i * 37) % 200) / 8) for i in range(200)], "x int, y int, v double")
    got = intervals.pool_statistics(_seen(rows, made), "v").collect()
    assert made.value == 200
    assert [(r.n, r.pixels, r.median, r.min, r.max) for r in got] == [(200, 7, 99.5 / 8, 0.0, 199 / 8)]
