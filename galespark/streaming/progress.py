"""Progress of forecast runs as their files arrive, in keyed state.

State of a run holds what it may come to: its files, members and steps. They
are lists bounded by what a run consists of, in one string, since state is
handed over value by value. A run is complete when a marker
file says so, or when as many files and members are there as the schedule
expects (a run that is not on the schedule completes by its marker only). Each
micro-batch that brings new files gives one row of an incomplete run: ``partial``
at first, ``redo`` later, ``complete`` once; files of a complete run change
nothing more. A timer in event time ends runs that the watermark has left
behind: an incomplete one gives a last row ``expired``, and the state goes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEYS = ["model_name", "init_time"]
OUT = "model_name string, init_time timestamp, version int, status string, n_files int, n_members int, n_steps int"
STATE = (
    "expected_files int, expected_members int, version int, status string, marked boolean, "
    "seen string"
)
NOTHING = "[[], [], []]"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT_SETTINGS = ["spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled"]


class Progress(StatefulProcessor):
    """``days`` after its start a run without completion is given up."""

    def __init__(self, days: int = 9):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", STATE)

    def _end(self, init_time) -> int:
        from datetime import timezone

        moment = init_time if init_time.tzinfo else init_time.replace(tzinfo=timezone.utc)
        return int(moment.timestamp() * 1000) + self.days * 86_400_000

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((initialState.expected_files, initialState.expected_members, 0, None, False, NOTHING))
        self.handle.registerTimer(self._end(key[1]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.state.get()
        want, members_wanted, version, status, marked, held = kept or (-1, -1, 0, None, False, NOTHING)
        if kept is None:
            self.handle.registerTimer(self._end(key[1]))
        seen, who, when = map(set, json.loads(held))
        before = len(seen), marked
        for r in rows:
            if r.is_marker:
                marked = True
            else:
                seen.add(r.path)
                who.add(r.member)
                when.add(r.time_step)
        if status != "complete" and (len(seen), marked) != before:
            counted = 0 <= want <= len(seen) and members_wanted <= len(who)
            status = "complete" if marked or counted else "redo" if version else "partial"
            version += 1
            yield Row(
                model_name=key[0], init_time=key[1], version=version, status=status,
                n_files=len(seen), n_members=len(who), n_steps=len(when),
            )
        if status == "complete":  # counts are all that is needed from now on
            seen, who, when = (), (), ()
        now = (want, members_wanted, version, status, marked, json.dumps([sorted(x, key=str) for x in (seen, who, when)]))
        if kept is None or now[2:] != tuple(kept)[2:]:
            self.state.update(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.state.get()
        if kept is not None:
            _, _, version, status, _, held = kept
            self.state.clear()
            if version and status != "complete":
                files, members, steps = json.loads(held)
                yield Row(
                    model_name=key[0], init_time=key[1], version=version + 1, status="expired",
                    n_files=len(files), n_members=len(members), n_steps=len(steps),
                )

    def close(self) -> None:
        pass


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own for a stream whose state lies in RocksDB; the
    settings of ``spark``, and of whoever else works with it, stay as they are."""
    own = spark.newSession()
    for name in KEPT_SETTINGS:
        value = spark.conf.get(name, None)
        if value is not None:
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def run_progress(arrivals: DataFrame, schedule: DataFrame, delay: str = "10 days", days: int = 9) -> DataFrame:
    """``arrivals(model_name, init_time, time_step, member, path, is_marker)`` as
    a stream of its :func:`stateful_session`; ``schedule(model_name, init_time,
    expected_files, expected_members)`` is what the state starts from."""
    rows = arrivals.select(*KEYS, "time_step", F.col("member").cast("string"), F.col("path").cast("string"), "is_marker")
    start = schedule.select(*KEYS, F.col("expected_files").cast("int"), F.col("expected_members").cast("int"))
    return rows.withWatermark("init_time", delay).groupBy(*KEYS).transformWithState(
        Progress(days), OUT, "Append", "EventTime", start.groupBy(*KEYS)
    )
