"""Streams whose results go to files."""

import json
import os
import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur import catalog
from larkspur.sources import pages as page_source
from larkspur.streaming import monitor, streams

SF = "/root/testdata/sf0.001"
UNBOUNDED = ("stream_filter", "stream_latest_user", "stream_job_states", "stream_distinct_users")


@pytest.mark.parametrize("name", UNBOUNDED)
def test_unbounded_results_do_not_stay_in_the_driver(spark, name):
    before = {t.name for t in spark.catalog.listTables()}
    found = catalog.QUERIES[name](spark, SF)
    assert found.count() > 0 and found.inputFiles()
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_results_of_several_batches_and_of_none(spark, tmp_path, mode):
    source = tmp_path / "in"
    source.mkdir()
    rows = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).json(str(source))
    stream = rows if mode == "append" else rows.groupBy("k").agg(F.count("*").alias("n"))
    assert streams.run_to_files(stream, mode, str(tmp_path / "none")).collect() == []
    for i in range(3):
        (source / f"{i}.json").write_text(f'{{"k": {i}}}\n{{"k": 7}}\n')
    found = sorted(map(tuple, streams.run_to_files(stream, mode, str(tmp_path / "some")).collect()))
    assert found == ([(0,), (1,), (2,), (7,), (7,), (7,)] if mode == "append" else [(0, 1), (1, 1), (2, 1), (7, 3)])


def test_update_mode_has_no_files(spark, tmp_path):
    rows = spark.readStream.schema("k long").json(str(tmp_path))
    with pytest.raises(ValueError):
        streams.run_to_files(rows, "update", str(tmp_path / "out"))


def job_files(spark, tmp_path, *batches):
    source = tmp_path / "jobs"
    source.mkdir()
    stream = spark.readStream.schema("job long, kind string, ts timestamp, seq long").option("maxFilesPerTrigger", 1).json(str(source))

    def put(number, rows):
        lines = [f'{{"job": {job}, "kind": "{kind}", "ts": "2024-01-01T00:{minute:02d}:00Z", "seq": {i}}}' for i, (job, kind, minute) in enumerate(rows)]
        (source / f"{number}.json").write_text("\n".join(lines))
        os.utime(source / f"{number}.json", (1_700_000_000 + number,) * 2)  # files reach a stream in the order of their times

    for i, rows in enumerate(batches):
        put(i, rows)
    return stream, put


def test_job_machine_goes_on_after_a_restart(spark, tmp_path):
    stream, put = job_files(spark, tmp_path, [(1, "assign", 0), (1, "error", 2), (2, "assign", 1)], [(1, "requeue", 3), (2, "complete", 4)])
    machine = streams.job_machine(stream)
    folder = str(tmp_path / "out")
    found = sorted(map(tuple, streams.run_updates(machine, "job", folder).collect()))
    assert found == [(1, "queued", 1, 3), (2, "completed", 0, 2)]
    put(2, [(1, "assign", 6), (1, "error", 7), (3, "assign", 8)])
    again = sorted(map(tuple, streams.run_updates(streams.job_machine(stream), "job", folder).collect()))
    assert again == [(1, "error", 2, 5), (2, "completed", 0, 2), (3, "ongoing", 0, 1)]


def test_an_older_batch_that_comes_later_is_counted_alone(spark, tmp_path):
    stream, put = job_files(spark, tmp_path, [(1, "requeue", 3)])
    folder = str(tmp_path / "out")
    assert list(map(tuple, streams.run_updates(streams.job_machine(stream), "job", folder).collect())) == [(1, "queued", 0, 1)]
    put(1, [(1, "assign", 0), (1, "error", 2)])
    assert list(map(tuple, streams.run_updates(streams.job_machine(stream), "job", folder).collect())) == [(1, "queued", 1, 3)]


def test_lost_workers_jobs_are_queued_again(spark, tmp_path):
    stream, _ = job_files(spark, tmp_path, [(1, "assign", 0), (2, "assign", 0), (2, "complete", 1)], [(3, "assign", 40)], [(3, "complete", 41)])
    machine = streams.job_machine(stream.withWatermark("ts", "1 minute"), "10 minutes")
    found = sorted(map(tuple, streams.run_updates(machine, "job", str(tmp_path / "out")).collect()))
    assert found == [(1, "queued", 0, 1), (2, "completed", 0, 2), (3, "completed", 0, 2)]


def test_appended_files_after_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text('{"k": 1}\n')
    rows = spark.readStream.schema("k long").json(str(source))
    assert [r.k for r in streams.run_to_files(rows, "append", str(tmp_path / "out")).collect()] == [1]
    (source / "1.json").write_text('{"k": 2}\n')
    assert sorted(r.k for r in streams.run_to_files(rows, "append", str(tmp_path / "out")).collect()) == [1, 2]


def test_snapshots_by_processing_time(spark, tmp_path):
    import time

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    query = streams.snapshots(ticks.groupBy().agg(F.count("*").alias("n")), 1, str(tmp_path / "s"), str(tmp_path / "c"))
    try:
        end = time.time() + 60
        while time.time() < end and (query.lastProgress is None or query.lastProgress["batchId"] < 2):
            time.sleep(0.2)
    finally:
        query.stop()
    taken = spark.read.parquet(str(tmp_path / "s")).orderBy("snapshot").collect()
    assert len(taken) >= 2 and [r.n for r in taken] == sorted(r.n for r in taken)
    assert [r.taken for r in taken] == sorted(r.taken for r in taken)


def test_channels_gauges_and_upserts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text('{"name": "stats.a_b", "value": 3, "ts": "2024-01-01T00:00:00Z"}\n{"name": "other", "value": 4, "ts": "2024-01-01T00:00:01Z"}\n')
    events = streams.folder_stream(spark, str(source), "name string, value int, ts timestamp")
    rows = streams.gauges(streams.channel(events, "name", "stats.a_*"), "name", F.col("value") * 2, "ts")
    query = streams.append_files(rows, str(tmp_path / "out"), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert [(r.label, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("stats.a_b", 6)]
    seen = []
    query = streams.upsert_batches(events, str(tmp_path / "c2"), lambda batch, number: seen.append((number, batch.count())))
    query.processAllAvailable()
    query.stop()
    assert seen == [(0, 2)]


STREAMS = ("stream_filter", "stream_latest_user", "stream_job_states", "stream_distinct_users", "stream_window_counts", "stream_roll_ups", "stream_job_machine", "stream_timeline_pages")


def collected(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def folder_tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(3, "event_id").write.parquet(str(base / "events.parquet"))
    return str(base)


@pytest.mark.parametrize("name", STREAMS)
def test_a_table_of_several_files_streams_whole(spark, folder_tables, name):
    found = collected(catalog.QUERIES[name](spark, folder_tables))
    assert found and found == collected(catalog.QUERIES[name](spark, SF))


def test_a_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path_not_found|does not exist|FileNotFound"):
        streams.table_stream(spark, str(tmp_path), "events")


def test_late_users_count(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, (user, day) in enumerate([(1, "2024-06-01"), (2, "2020-01-01"), (1, "2019-01-01"), (3, "2018-01-01")]):
        (source / f"{i}.json").write_text(f'{{"user": {user}, "ts": "{day}T00:00:00Z"}}\n')
        os.utime(source / f"{i}.json", (1_700_000_000 + i,) * 2)
    rows = spark.readStream.schema("user long, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
    assert sorted(r.user for r in streams.run_to_files(streams.distinct_events(rows, "user"), "append", str(tmp_path / "out")).collect()) == [1, 2, 3]


def page_rows(spark, path, out, checkpoint):
    rows = page_source.page_stream(spark, path, "k long, name string", 10)
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_pages_come_once_each_across_restarts(spark, tmp_path):
    table, out, checkpoint = tmp_path / "t", str(tmp_path / "out"), str(tmp_path / "c")
    table.mkdir()

    def add(number, low, high):
        data = pa.table({"name": [f"n{k}" for k in range(low, high)], "k": pa.array(range(low, high), pa.int64())})
        pq.write_table(data, table / f"part-{number}.parquet", row_group_size=7)

    add(0, 0, 33)
    add(1, 33, 34)
    (table / "_SUCCESS").write_text("")
    page_rows(spark, str(table), out, checkpoint)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == list(range(34))
    add(2, 34, 90)
    page_rows(spark, str(table), out, checkpoint)
    page_rows(spark, str(table), out, checkpoint)
    assert sorted(map(tuple, spark.read.parquet(out).select("k", "name").collect())) == [(k, f"n{k}") for k in range(90)]


def test_pages_are_planned_and_read_again_alike(tmp_path):
    pq.write_table(pa.table({"k": list(range(25))}), tmp_path / "a.parquet", row_group_size=4)
    pq.write_table(pa.table({"k": list(range(25, 31))}), tmp_path / "b.parquet")
    reader = page_source.PageReader(str(tmp_path), ["k"], 10)
    assert (reader.initialOffset(), reader.latestOffset()) == ({"row": 0}, {"row": 31})
    again = page_source.PageReader(str(tmp_path), ["k"], 10)  # a restart whose last batch wasn't committed
    plan = again.partitions({"row": 15}, {"row": 28})
    assert [(p.low, p.high) for p in plan] == [(15, 25), (0, 3)]
    assert [[x for b in again.read(p) for x in b.column("k").to_pylist()] for p in plan] == [list(range(15, 25)), [25, 26, 27]]


def test_growth_does_not_depend_on_the_order_of_polls(spark, tmp_path):
    rng = random.Random(23)
    polls = [(rng.randint(1, 3), rng.choice([*range(30), None]), rng.choice([rng.randint(0, 5000), rng.randint(0, 5000), None])) for _ in range(400)]
    source = tmp_path / "in"
    source.mkdir()

    def put(number, rows):
        text = "\n".join(json.dumps({"user_id": u, "follower_id": f, "at": t}) for u, f, t in rows)
        (source / f"{number}.json").write_text(text)
        os.utime(source / f"{number}.json", (1_700_000_000 + number,) * 2)

    def run():
        rows = spark.readStream.schema("user_id long, follower_id long, at long").option("maxFilesPerTrigger", 1).json(str(source))
        rows = rows.select("user_id", "follower_id", F.timestamp_seconds("at").alias("ts"))
        monitor.store_changes(monitor.follower_changes(rows, 300, shares=3), str(tmp_path / "out")).awaitTermination()
        return monitor.stored_changes(spark, str(tmp_path / "out"))

    for i in range(3):
        put(i, polls[100 * i : 100 * i + 100])
    run()
    put(3, polls[300:])
    changes = run()  # goes on from the state of the first run
    first = {}
    for u, f, t in polls:
        if f is not None and t is not None:
            first[u, f] = min(first.get((u, f), t), t)
    assert sorted(map(tuple, monitor.followers_of(changes).collect())) == sorted((u, f, t // 300 * 300) for (u, f), t in first.items())
    want = []
    for u in (1, 2, 3):
        total = 0
        for bucket, n in sorted(Counter(t // 300 * 300 for (v, _), t in first.items() if v == u).items()):
            total += n
            want.append((u, bucket, n, total))
    assert sorted(map(tuple, monitor.growth(changes).collect())) == want


def test_growth_of_nothing(spark, tmp_path):
    assert monitor.growth(monitor.stored_changes(spark, str(tmp_path / "none"))).collect() == []


def test_followers_are_looked_up_a_share_at_a_time():
    """A batch of a share reads its state once and writes it once, and a follower that is kept for a time only is forgotten after it."""

    class State:
        value, calls = None, []

        def getValueState(self, *_):
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    class Timer:
        now = 0

        def getCurrentProcessingTimeInMs(self):
            return self.now

    state, timer = State(), Timer()
    fold = monitor.KnownFollowers(10, keep_ms=1000)
    fold.init(state)

    def batch(*rows):
        frames = [pd.DataFrame({"follower_id": [f], "at": [t * 1_000_000]}) for f, t in rows]
        return sorted((r.follower_id, r.bucket, r.fresh) for x in fold.handleInputRows((1, 0), iter(frames), timer) for r in x.itertuples())

    assert batch((5, 25), (3, 12), (5, 31)) == [(3, 10, 1), (5, 20, 1)]
    assert batch((5, 27)) == []  # later: nothing changes
    assert batch((5, 3), (3, 11), (9, 40)) == [(5, 0, 1), (5, 20, -1), (9, 40, 1)]
    timer.now = 2000
    assert batch((5, 50)) == [(5, 50, 1)]
    assert state.calls == ["update", "get", "get", "update", "get", "update"]
