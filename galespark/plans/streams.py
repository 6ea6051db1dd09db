"""Streams run to the end of what is there, next to their batch equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from galespark.operators import passes
from galespark.plans import swaths
from galespark.plans.base import registry
from galespark.session import cut, scratch_path
from galespark.sinks import writers
from galespark.sources.adapters import VIEWS, view, with_views
from galespark.streaming import progress, streams

QUERIES, ORACLE, query = registry()

POINTS = with_views("track_points")


def points_of(spark, path, schema):
    """Track points derived from event files as they stream in; event time must carry a zone."""
    events = streams.files(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.sql(VIEWS["track_points"], events=events)


def arriving(spark, sf_dir):
    """The event table as it lies; a file source lists a folder, so a pattern names the one table."""
    return points_of(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema)


LATE = "event_id%97=0"


def in_parts(spark, sf_dir, build, sink, root, mode="update"):
    """Run a stream three times as files arrive: most events, some recent
    ones, then a part that comes late, some of it past every cut-off."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    recent = F.col("ts") > events.agg(F.timestamp_add("DAY", F.lit(-5), F.max("ts"))).scalar()
    second = F.expr("event_id%97=1") & recent
    for part in (events.filter(~second & ~F.expr(LATE)), events.filter(second), events.filter(LATE)):
        part.write.mode("append").parquet(f"{root}/in")
        streams.run_to_end(build(points_of(spark, f"{root}/in", events.schema)), sink, f"{root}/state", mode)


def finish(spark, stream, mode="append"):
    """Run a stream to its end and read what it wrote."""
    root = scratch_path(spark)
    streams.run_to_end(stream, streams.append_batches(f"{root}/out"), f"{root}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(*stream.columns)


def final_state(spark, sf_dir, build, keys, version, day):
    """Run an updating stream over files that arrive and keep the last row per
    key. The table is partitioned by day, and a batch rewrites only the days
    that it touches: what runs and cycles bring lies close in time."""
    root = scratch_path(spark)
    parted = lambda points: build(points).withColumn("part", F.date_format(day, "yyyyMMdd"))
    in_parts(spark, sf_dir, parted, streams.merge_latest(f"{root}/out", keys, version, "part"), root)
    return spark.read.parquet(f"{root}/out").drop("part")


@query("stream_files", POINTS + " select event_id, model_name, time_step from track_points")
def stream_files(spark, sf_dir):
    return finish(spark, arriving(spark, sf_dir).select("event_id", "model_name", "time_step"))


def progressing(spark, sf_dir, sink, root):
    """File arrivals in three parts through keyed state."""
    arrivals = view(spark, sf_dir, "file_arrivals")
    view(spark, sf_dir, "schedule").write.parquet(f"{root}/schedule")
    own = progress.stateful_session(spark)
    for part in (1, 2, 3):
        arrivals.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{root}/in")
        stream = streams.files(own, f"{root}/in", arrivals.drop("part").schema)
        runs = progress.run_progress(stream, own.read.parquet(f"{root}/schedule"), DELAY, GIVEN_UP)
        streams.run_to_end(runs, sink, f"{root}/state", "append")


DELAY, GIVEN_UP = "252 hours", 9  # the delay ends between two starts of runs
PROGRESS = with_views("file_arrivals", "schedule") + f""", marks as (select max(init_time) filter (part=1)-interval '{DELAY}' as w1,
    max(init_time) filter (part<=2)-interval '{DELAY}' as w2, max(init_time)-interval '{DELAY}' as w3 from file_arrivals),
  acc as materialized (select f.* from file_arrivals f, marks where part=1 or (part=2 and init_time>w1) or (part=3 and init_time>w2)),
  seen as (select model_name, init_time, p, count(distinct path) filter (not is_marker and part<=p) as n_files,
      count(distinct member) filter (not is_marker and part<=p) as n_members, count(distinct time_step) filter (not is_marker and part<=p) as n_steps,
      coalesce(bool_or(is_marker) filter (part<=p), false) as marked, coalesce(bool_or(is_marker) filter (part<p), false) as marked_before,
      count(*) filter (not is_marker and part=p) as fresh
    from acc, (select unnest([1, 2, 3]) as p) x group by 1,2,3),
  state as (select s.*, marked or coalesce(n_files>=expected_files and n_members>=expected_members, false) as done from seen s left join schedule using (model_name, init_time)),
  given as (select * from (select *, coalesce(bool_or(done) over (partition by model_name, init_time order by p rows between unbounded preceding and 1 preceding), false) as over
    from state) q where not over and (fresh>0 or (marked and not marked_before))),
  emitted as (select model_name, init_time, cast(row_number() over (partition by model_name, init_time order by p) as int) as version, done, n_files, n_members, n_steps from given),
  lost as (select model_name, init_time, max(version)+1 as version, max_by(n_files, version) as n_files, max_by(n_members, version) as n_members,
    max_by(n_steps, version) as n_steps from emitted, marks group by model_name, init_time, w3 having not bool_or(done) and init_time+interval '{GIVEN_UP}' day<=w3),
  steps as materialized (select model_name, init_time, version, case when done then 'complete' when version=1 then 'partial' else 'redo' end as status, n_files, n_members, n_steps
    from emitted union all select model_name, init_time, cast(version as int), 'expired', n_files, n_members, n_steps from lost)"""


@query(
    "stream_run_complete",
    PROGRESS + """ select model_name, init_time, status, n_files, n_members, n_steps, status='complete' as is_complete from (select *,
      row_number() over (partition by model_name, init_time order by version desc) as r from steps) t where r=1""",
)
def stream_run_complete(spark, sf_dir):
    """What each run has come to, by files, members and marker."""
    root = scratch_path(spark)
    keys = progress.KEYS
    sink = lambda df, n: streams.merge_latest(f"{root}/out", keys, "version", "part")(df.withColumn("part", F.date_format("init_time", "yyyyMMdd")), n)
    progressing(spark, sf_dir, sink, root)
    out = spark.read.parquet(f"{root}/out")
    return out.select(*keys, "status", "n_files", "n_members", "n_steps", (F.col("status") == "complete").alias("is_complete"))


@query("stream_reprocess", PROGRESS + " select * from steps")
def stream_reprocess(spark, sf_dir):
    """Early result, redone as more files come, and the end, one row each."""
    root = scratch_path(spark)
    progressing(spark, sf_dir, streams.append_batches(f"{root}/out"), root)
    return spark.read.parquet(f"{root}/out").drop("batch")


@query(
    "stream_watermark",
    POINTS + f""" select model_name, init_time, count(*) as n from track_points where not ({LATE})
      or init_time > (select max(init_time) from track_points where not ({LATE})) - interval '10' day group by 1,2""",
)
def stream_watermark(spark, sf_dir):
    """Of the part that comes late, what is ten days behind or more is left out (a watermark counts as late itself)."""
    runs = lambda points: streams.late_cutoff(points).groupBy("model_name", "init_time").agg(F.count(F.lit(1)).alias("n"))
    return final_state(spark, sf_dir, runs, ["model_name", "init_time"], "n", "init_time")


@query(
    "stream_tumbling",
    POINTS + " select model_name, time_bucket(interval '6' hour, ts, timestamp '2024-01-01 00:00:00') as cycle, count(*) as n, max(vmax) as vmax from track_points group by 1,2",
)
def stream_tumbling(spark, sf_dir):
    counts = lambda points: streams.cycle_counts(streams.late_cutoff(points, "ts", 40), 6)
    return final_state(spark, sf_dir, counts, ["model_name", "cycle"], "n", "cycle")


LAG = "6 hours"  # how far sensing and storm points may lag behind


@query(
    "stream_session",
    with_views("track_points", "storm_points") + f""", g as (select model_name, ts, coalesce(ts > lag(ts) over (partition by model_name order by ts) + interval '600' second, true) as st from track_points),
      i as (select model_name, ts, sum(st::int) over (partition by model_name order by ts rows unbounded preceding) as k from g),
      s as (select model_name, min(ts) as first, max(ts) + interval '600' second as closed, count(*) as n from i group by model_name, k),
      w as (select least((select max(ts) from track_points), (select max(valid_time) from storm_points)) - interval '{LAG}' as t)
      select s.model_name, first, closed, n, p.event_id, p.valid_time, p.vmax from s join w on closed<=t join storm_points p on p.model_name=s.model_name
        and p.valid_time between first - interval '30' minute and closed + interval '30' minute""",
)
def stream_session(spark, sf_dir):
    """Stretches of sensing that are closed, with the storm points next to them;
    both streams arrive in order, in three parts."""
    root = scratch_path(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    storms = view(spark, sf_dir, "storm_points").select("model_name", "event_id", "valid_time", "vmax")
    for low, high in ((None, 11), (11, 21), (21, None)):
        day = lambda c: (F.lit(low is None) | (F.col(c) >= f"2024-01-{low or 1}")) & (F.lit(high is None) | (F.col(c) < f"2024-01-{high or 1}"))
        events.filter(day("ts")).write.mode("append").parquet(f"{root}/events")
        storms.filter(day("valid_time")).write.mode("append").parquet(f"{root}/storms")
        points = points_of(spark, f"{root}/events", events.schema).withWatermark("ts", LAG)
        near = streams.files(spark, f"{root}/storms", storms.schema).withWatermark("valid_time", LAG)
        sessions = streams.sensing_sessions(points, ["model_name"], "ts", "600 seconds")
        hits = streams.storms_in_sessions(sessions, near, ["model_name"], "valid_time")
        streams.run_to_end(hits, streams.append_batches(f"{root}/out"), f"{root}/state", "append")
    return spark.read.parquet(f"{root}/out").drop("batch")


@query("stream_dedupe", POINTS + " select distinct model_name, init_time, time_step from track_points")
def stream_dedupe(spark, sf_dir):
    keys = ["model_name", "init_time", "time_step"]
    return finish(spark, streams.first_seen(arriving(spark, sf_dir), keys, "init_time", "40 days").select(*keys))


@query(
    "stream_trigger",
    PROGRESS + ", " + swaths.PREDICTED + """ select c.model_name, c.init_time, storm_no, satellite, pass_number, interp_id, round(vmax,3) as vmax
      from (select distinct model_name, init_time from steps where status='complete') c left join predicted p on p.model_name=c.model_name and p.init_time=c.init_time""",
)
def stream_trigger(spark, sf_dir):
    """Runs that complete have their passes predicted and logged, each in one batch."""
    root = scratch_path(spark)
    quads = cut(swaths.quads(spark, sf_dir, passes.span_of(view(spark, sf_dir, "storm_points"))))

    def predict(runs):
        points = view(spark, sf_dir, "storm_points").join(runs, progress.KEYS, "left_semi")
        writers.log_passes(runs, passes.dedupe_sensing(passes.sensed_tracks(points, quads)), f"{root}/passes")

    progressing(spark, sf_dir, streams.hand_over(predict, f"{root}/log"), root)
    log = spark.read.parquet(f"{root}/passes")
    return log.select(*progress.KEYS, "storm_no", "satellite", "pass_number", "interp_id", F.round("vmax", 3).alias("vmax"))


@query("stream_changed_only", "select concat('/data/', event_id) as path, ts as modificationTime from events where event_id%5=0 or event_id%5=1")
def stream_changed_only(spark, sf_dir):
    """Second listing: two files in five changed or new, the rest as before."""
    root = scratch_path(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.concat(F.lit("/data/"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("modificationTime")
    )
    first = e.filter("event_id%5<>1").withColumn(
        "modificationTime", F.when(F.col("event_id") % 5 == 0, F.timestamp_add("DAY", F.lit(-1), "modificationTime")).otherwise(F.col("modificationTime"))
    )
    out = lambda df: df.select("path", "modificationTime").write.mode("overwrite").parquet(f"{root}/out")
    streams.changed_only(first.drop("event_id"), f"{root}/seen", out)
    streams.changed_only(e.drop("event_id"), f"{root}/seen", out)
    return spark.read.parquet(f"{root}/out")
