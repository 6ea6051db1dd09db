"""Streams with keyed state, repeated batches, pass logs, retention by names."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from galespark.operators import catalog
from galespark.sinks import writers
from galespark.streaming import progress, streams

ARRIVAL = "model_name string, init_time timestamp, time_step int, member string, path string, is_marker boolean"
SCHEDULE = "model_name string, init_time timestamp, expected_files int, expected_members int"


def day(d):
    return datetime(2024, 1, d)


def run_parts(spark, root, parts, schedule):
    own = progress.stateful_session(spark)
    for rows in parts:
        spark.createDataFrame(rows, ARRIVAL).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = progress.run_progress(streams.files(own, f"{root}/in", ARRIVAL), own.createDataFrame(schedule, SCHEDULE))
        streams.run_to_end(stream, streams.append_batches(f"{root}/out"), f"{root}/state", "append")
    rows = spark.read.parquet(f"{root}/out").orderBy("model_name", "init_time", "version").collect()
    return [(r.model_name, r.init_time.day, r.version, r.status, r.n_files, r.n_members, r.n_steps) for r in rows]


def test_partial_redo_complete_and_given_up(spark, tmp_path):
    parts = [
        [("A", day(1), 0, "m1", "f1", False), ("A", day(1), 6, "m1", "f2", False), ("A", day(2), 0, "m1", "g1", False), ("B", day(1), 0, "m", "x", False), ("C", day(1), 0, "m", "y", False)],
        # a file twice and one known already change nothing; a marker completes what no schedule names
        [("A", day(1), 6, "m2", "f3", False), ("A", day(1), 6, "m2", "f3", False), ("A", day(2), 0, "m1", "g1", False), ("B", day(1), 6, "m", "x2", False), ("C", day(1), 0, "m", "_COMPLETE_", True)],
        [("A", day(1), 12, "m3", "f4", False), ("A", day(25), 0, "m1", "h", False)],
        [("B", day(1), 12, "m", "x3", False), ("A", day(26), 0, "m1", "i", False)],  # the first is late by now
    ]
    before = spark.conf.getAll
    got = run_parts(spark, tmp_path, parts, [("A", day(1), 3, 2), ("A", day(2), 2, 1), ("B", day(1), 99, 1), ("D", day(1), 1, 1)])
    assert got == [
        ("A", 1, 1, "partial", 2, 1, 2), ("A", 1, 2, "complete", 3, 2, 2),
        ("A", 2, 1, "partial", 1, 1, 1), ("A", 2, 2, "expired", 1, 1, 1),
        ("A", 25, 1, "partial", 1, 1, 1), ("A", 26, 1, "partial", 1, 1, 1),
        ("B", 1, 1, "partial", 1, 1, 1), ("B", 1, 2, "redo", 2, 1, 2), ("B", 1, 3, "expired", 2, 1, 2),
        ("C", 1, 1, "partial", 1, 1, 1), ("C", 1, 2, "complete", 1, 1, 1),
    ]
    assert spark.conf.getAll == before


DONE = "model_name string, init_time timestamp, status string"


def test_a_run_is_handed_over_in_one_batch_whatever_is_repeated(spark, tmp_path):
    handed, broken = [], []

    def job(runs):
        handed.append(sorted(r.model_name for r in runs.collect()))
        if broken:
            raise RuntimeError(broken.pop())

    sink = streams.hand_over(job, f"{tmp_path}/log")
    batch = lambda *names: spark.createDataFrame([(n, day(1), s) for n, s in names], DONE)
    sink(batch(("A", "partial"), ("B", "complete")), 0)
    sink(batch(("A", "complete"), ("B", "complete")), 1)  # B was handed over before
    sink(batch(("A", "complete"), ("B", "complete")), 1)  # repeated after its mark
    assert handed == [["B"], ["A"]]
    broken.append("lost after the job, before the mark")
    with pytest.raises(RuntimeError):
        sink(batch(("C", "complete"), ("D", "complete")), 2)
    sink(batch(("C", "complete"), ("D", "complete")), 2)  # the same runs again, for a job that replaces
    sink(batch(("C", "complete"), ("D", "complete"), ("E", "complete")), 3)
    assert handed[2:] == [["C", "D"], ["C", "D"], ["E"]]
    sink(batch(("F", "partial")), 4)
    assert len(handed) == 5


PASSES = "model_name string, init_time timestamp, satellite string, interp_id long"


def test_a_rerun_replaces_the_passes_of_its_runs(spark, tmp_path):
    runs = spark.createDataFrame([("A", day(1)), ("A", day(2)), ("B", day(1))], "model_name string, init_time timestamp")
    log = lambda r, rows: writers.log_passes(r, spark.createDataFrame(rows, PASSES), f"{tmp_path}/log")
    log(runs, [("A", day(1), "S", 1), ("A", day(1), "S", 2), ("A", day(2), "S", 3)])
    read = lambda: sorted((r.model_name, r.init_time.day, r.interp_id or 0) for r in spark.read.parquet(f"{tmp_path}/log").collect())
    assert read() == [("A", 1, 1), ("A", 1, 2), ("A", 2, 3), ("B", 1, 0)]
    for _ in range(2):  # a run without passes now, and one that has some
        log(runs.filter("day(init_time) = 1"), [("B", day(1), "S", 7)])
    assert read() == [("A", 1, 0), ("A", 2, 3), ("B", 1, 7)]


def test_retention_reads_names_once_a_day(spark, tmp_path):
    table = spark.createDataFrame([(d, day(d)) for d in range(1, 21)], "v int, t timestamp").withColumn("run", writers.run_name("t"))
    at = {"lead": f"{tmp_path}/lead", "other": f"{tmp_path}/other"}
    writers.append(table.filter("v <= 18"), at["lead"], ["run"])
    writers.append(table.withColumn("model_name", F.lit("a:b")), at["other"], ["model_name", "run"])
    gone = writers.retain(spark, at, "lead", f"{tmp_path}/ledger", date(2024, 2, 1), 10)
    assert {k: len(v) for k, v in gone.items()} == {"lead": 7, "other": 7} and gone["lead"][-1] == "2024-01-07T0000"
    assert sorted(r.v for r in spark.read.parquet(at["other"]).collect()) == list(range(8, 21))
    writers.append(table.filter("v = 1"), at["other"], ["run"])
    assert writers.retain(spark, at, "lead", f"{tmp_path}/ledger", date(2024, 2, 1), 10) is None
    assert writers.retain(spark, at, "lead", f"{tmp_path}/ledger", date(2024, 2, 2), 10) == {"lead": [], "other": ["2024-01-01T0000"]}
    assert writers.retain(spark, {"none": f"{tmp_path}/none"}, "none", f"{tmp_path}/ledger", date(2024, 2, 3)) == {}


def test_step_documents_skip_done_components(spark):
    schema = "model_name string, init_date timestamp, time_step int, component_id int, mslp double"
    points = lambda *rows: spark.createDataFrame([("A", day(d), s, c, float(p)) for d, s, c, p in rows], schema)
    stored = catalog.step_documents(points((1, 0, 0, 1000), (1, 6, 0, 999), (2, 0, 0, 990)), ["mslp"])
    merged = catalog.merge_step_documents(stored, points((1, 0, 0, 5), (1, 6, 1, 998), (1, 12, 1, 997), (3, 0, 2, 980)), ["mslp"])
    rows = [(r.init_date.day, r.time_step, r.component_id, r.mslp, r.done_components) for r in catalog.opened(merged).collect()]
    assert sorted(rows) == [(1, 0, 0, 1000, [0, 1]), (1, 6, 0, 999, [0, 1]), (1, 6, 1, 998, [0, 1]), (1, 12, 1, 997, [0, 1]), (3, 0, 2, 980, [2])]
    assert catalog.merge_step_documents(stored, points((1, 0, 0, 5)), ["mslp"]).collect() == []


def test_closed_sessions_leave_the_state(spark, tmp_path):
    events = "k string, ts timestamp"
    left = []
    for d in range(1, 6):
        rows = [("a", datetime(2024, 1, d, h, m)) for h in range(0, 24, 2) for m in (0, 5, 9)]
        spark.createDataFrame(rows, events).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        points = streams.files(spark, f"{tmp_path}/in", events).withWatermark("ts", "1 hour")
        sessions = streams.sensing_sessions(points, ["k"], "ts", "600 seconds").select("k", "w.start", "n")
        q = (
            sessions.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state")
            .foreachBatch(streams.append_batches(f"{tmp_path}/out")).start()
        )
        q.awaitTermination()
        left.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert spark.read.parquet(f"{tmp_path}/out").count() >= 59 and max(left) <= 3  # of 60 sessions


def test_state_is_one_value_written_only_when_it_changes():
    from types import SimpleNamespace as Made

    class Value:
        held, calls = None, []

        def __getattr__(self, name):
            return lambda *x: self.calls.append(name) or (setattr(self, "held", x[0]) if name == "update" else self.held if name == "get" else None)

    p, value = progress.Progress(), Value()
    p.init(Made(getValueState=lambda *_: value, registerTimer=lambda *_: value.calls.append("timer")))
    key, files = ("A", day(1)), lambda *names: [Made(is_marker=False, path=f, member=f[:1], time_step=len(f)) for f in names]
    p.handleInitialState(key, Made(expected_files=3, expected_members=2), None)
    got = [tuple(r) for rows in (files("a1", "a22"), files("a1"), files("b1"), files("c1")) for r in p.handleInputRows(key, rows, None)]
    assert got == [(*key, 1, "partial", 2, 1, 2), (*key, 2, "complete", 3, 2, 2)]
    # a repeated file and files after the end change nothing; state is asked for once per batch
    assert value.calls == ["update", "timer", "get", "update", "get", "get", "update", "get"]
    assert list(p.handleExpiredTimer(key, None, None)) == []
