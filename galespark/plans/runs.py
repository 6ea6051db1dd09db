"""Run catalogue: sinks as table changes, as-of queries, cycles, calendars."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from galespark.operators import catalog, ensemble, passes
from galespark.plans import swaths
from galespark.plans.base import registry
from galespark.session import cut, scratch_path
from galespark.sinks import writers
from galespark.sources import files
from galespark.sources.adapters import oracle_view, tables, view, with_views

QUERIES, ORACLE, query = registry()
T = "2024-01-20 12:00:00"


def at():
    return F.lit(T).cast("timestamp")


# ---------------------------------------------------------------- sinks


@query(
    "upsert_step",
    with_views("track_points")
    + """, fresh as (select * from track_points where event_id%3=0), kept as (select * from track_points o where event_id%3<>0
        and not exists (select 1 from fresh f where f.model_name=o.model_name and f.init_time=o.init_time and f.time_step=o.time_step)),
      merged as (select *, 1 as version from fresh union all select *, 0 from kept)
      select model_name, init_time, time_step, max(version) as version, count(*) as candidates, round(sum(mslp),3) as mslp_sum,
        (select count(distinct time_step) from merged b where b.model_name=a.model_name and b.init_time=a.init_time)=24 as is_complete
      from merged a group by 1,2,3""",
)
def upsert_step(spark, sf_dir):
    p = view(spark, sf_dir, "track_points")
    stored = p.filter("event_id%3<>0").withColumn("version", F.lit(0))
    fresh = p.filter("event_id%3=0").withColumn("version", F.lit(1))
    both = catalog.replace_steps(stored, fresh, ["model_name", "init_time", "time_step"])
    steps = both.groupBy("model_name", "init_time", "time_step").agg(
        F.max("version").alias("version"), F.count(F.lit(1)).alias("candidates"), F.round(F.sum("mslp"), 3).alias("mslp_sum")
    )
    done = catalog.step_completeness(steps, 24).withColumnRenamed("init_date", "init_time").select("model_name", "init_time", "is_complete")
    return steps.join(done, ["model_name", "init_time"])


@query(
    "insert_if_absent",
    with_views("tc_candidates")
    + """ select model_name, init_date, component_id, ws_max_10m from tc_candidates where component_id<2
      union all select model_name, init_date, component_id, ws_max_10m+100 from tc_candidates n where not exists
        (select 1 from tc_candidates e where e.component_id<2 and e.model_name=n.model_name and e.init_date=n.init_date and e.component_id=n.component_id)""",
)
def insert_if_absent(spark, sf_dir):
    """Every candidate comes in twice; the first of a key that is not stored stays."""
    t = view(spark, sf_dir, "tc_candidates").select("model_name", "init_date", "component_id", "ws_max_10m")
    stored = t.filter("component_id<2")
    again = [t.withColumn("ws_max_10m", F.col("ws_max_10m") + late) for late in (100, 200)]
    keys = ["model_name", "init_date", "component_id"]
    return stored.unionByName(catalog.insert_absent(stored, again[1].unionByName(again[0]), keys, ["ws_max_10m"]))


@query(
    "tc_by_step",
    with_views("track_points")
    + """, p as (select model_name, init_time as init_date, time_step, event_id%4 as component_id, event_id, mslp, extract(day from init_time)%5=0 as late from track_points),
      d as (select model_name, init_date, string_agg(distinct cast(component_id as varchar), ',' order by cast(component_id as varchar)) as done from p where not (late and component_id=3) group by 1,2)
      select model_name, init_date, time_step, component_id, event_id, mslp, done from p join d using (model_name, init_date) where not (late and component_id=3)""",
)
def tc_by_step(spark, sf_dir):
    """Documents of runs by step. They come in twice: first two components, then
    more of them, and the first again with other values, which change nothing."""
    path = scratch_path(spark)
    p = view(spark, sf_dir, "track_points").select(
        "model_name", F.col("init_time").alias("init_date"), "time_step", (F.col("event_id") % 4).alias("component_id"), "event_id", "mslp"
    )
    fields = ["event_id", "mslp"]
    put = lambda docs: writers.overwrite_partitions(docs.withColumn("run", writers.run_name("init_date")), path, ["run"])
    put(catalog.step_documents(p.filter("component_id<2"), fields))
    again = p.withColumn("mslp", F.when(F.col("component_id") < 2, F.col("mslp") + 100).otherwise(F.col("mslp")))
    again = again.filter("component_id<3 or dayofmonth(init_date)%5<>0")
    stored = spark.read.parquet(path)
    # partitions are replaced whole, so runs beside the changed ones in them go along
    merged = catalog.merge_step_documents(stored.drop("run"), again, fields)
    rest = stored.drop("run").join(merged, catalog.RUN, "left_anti")
    put(cut(merged.unionByName(rest)))
    out = catalog.opened(spark.read.parquet(path).drop("run"))
    return out.withColumn("done", F.concat_ws(",", F.transform("done_components", lambda c: c.cast("string")))).drop("done_components")


@query(
    "completed_append",
    with_views("runs_completed", "tc_candidates")
    + """ select model_name, init_date, completed_date from runs_completed union all
      select model_name, init_date, init_date + interval '6' hour from (select distinct model_name, init_date from tc_candidates) n
      where not exists (select 1 from runs_completed r where r.model_name=n.model_name and r.init_date=n.init_date)""",
)
def completed_append(spark, sf_dir):
    done = view(spark, sf_dir, "runs_completed")
    runs = view(spark, sf_dir, "tc_candidates").select("model_name", "init_date").distinct()
    new = catalog.insert_absent(done, runs, catalog.RUN)
    return done.unionByName(new.withColumn("completed_date", F.timestamp_add("HOUR", F.lit(6), "init_date")))


@query(
    "ens_status",
    with_views("track_points")
    + """ select ensemble_name, init_date, n as num_files_processed, coalesce(e, -1) as expected_num_files_processed, n=coalesce(e,-1) as completed from
      (select event_id%3 as k, concat('E', event_id%3) as ensemble_name, init_time as init_date, count(distinct time_step) as n,
        case when extract(day from init_time)%5<>0 then 24 end as e from track_points group by 1,2,3,5) t""",
)
def ens_status(spark, sf_dir):
    p = view(spark, sf_dir, "track_points")
    processed = p.select(
        F.concat(F.lit("E"), (F.col("event_id") % 3).cast("string")).alias("ensemble_name"), F.col("init_time").alias("init_date"),
        F.concat(F.lit("/run/f"), F.col("time_step").cast("string")).alias("path"),
    )
    expected = (
        processed.select("ensemble_name", "init_date").distinct()
        .filter(F.dayofmonth("init_date") % 5 != 0).withColumn("expected", F.lit(24))
    )
    return catalog.ensemble_status(processed, expected)


@query(
    "retention_by_data_time",
    with_views("tc_candidates", "runs_completed")
    + """ select 'tracks' as kind, model_name, init_date, component_id from tc_candidates
      where init_date >= (select max(init_date) from runs_completed) - interval '10' day
      union all select 'completed', model_name, init_date, null from runs_completed where init_date >= (select max(init_date) from runs_completed) - interval '10' day""",
)
def retention_by_data_time(spark, sf_dir):
    """Written tables of runs, pruned by the names of their partitions; the
    second call of the day finds its mark."""
    root = scratch_path(spark)
    rows = {"tracks": view(spark, sf_dir, "tc_candidates"), "completed": view(spark, sf_dir, "runs_completed").withColumn("component_id", F.lit(None).cast("int"))}
    at_ = {k: f"{root}/{k}" for k in rows}
    for k, t in rows.items():
        writers.append(t.select("model_name", "init_date", "component_id", writers.run_name("init_date").alias("run")), at_[k], ["run"])
    for _ in range(2):
        writers.retain(spark, at_, "completed", f"{root}/ledger", date(2024, 2, 1), 10)
    left = [spark.read.parquet(at_[k]).withColumn("kind", F.lit(k)) for k in rows]
    return left[0].unionByName(left[1]).select("kind", "model_name", "init_date", "component_id")


@query(
    "retention_files",
    """select concat('/data/', event_id, case when event_id%3=0 then '.idx' else '.grib2' end) as path from events
      where event_id%3<>0 and ts < timestamp '2024-01-30 00:00:00' - interval '48' hour""",
)
def retention_files(spark, sf_dir):
    e = tables(spark, sf_dir, "events")["events"].select(
        F.concat(F.lit("/data/"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, ".idx").otherwise(".grib2")).alias("path"),
        F.col("ts").alias("modificationTime"),
    )
    return files.older_than(e, F.lit("2024-01-30").cast("timestamp")).select("path")


DECK_LINE = """select concat('AL', ', ', substring(storm_id,2), ', ', {fmt}, ', 03, ', model_id, ', ', cast(tau as string)) as value from deck_points"""


def deck_text(spark, sf_dir):
    d = view(spark, sf_dir, "deck_points")
    return d.select(
        F.concat_ws(
            ", ", F.lit("AL"), F.substring("storm_id", 2, 10), F.date_format("init_time", "yyyyMMddHH"), F.lit("03"), "model_id",
            F.col("tau").cast("string"),
        ).alias("value")
    )


DECK_TEXT = with_views("deck_points") + ", text as (" + DECK_LINE.format(fmt="strftime(init_time, '%Y%m%d%H')") + ")"


@query(
    "adeck_build",
    DECK_TEXT + " select concat('AL', trim(split_part(value, ',', 2)), '2024') as atcf_id, trim(split_part(value, ',', 3)) as init_text, value from text",
)
def adeck_build(spark, sf_dir):
    return catalog.adeck_lines(deck_text(spark, sf_dir))


@query(
    "adeck_split_by_storm",
    DECK_TEXT + """ select concat('AL', trim(split_part(value, ',', 2)), '2024') as atcf_id, count(*) as n_lines, min(trim(split_part(value, ',', 3))) as first_run,
      max(trim(split_part(value, ',', 3))) as last_run from text group by 1""",
)
def adeck_split_by_storm(spark, sf_dir):
    lines = catalog.adeck_lines(deck_text(spark, sf_dir))
    return lines.groupBy("atcf_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("init_text").alias("first_run"), F.max("init_text").alias("last_run")
    )


# ---------------------------------------------------------------- as-of


@query(
    "tracks_as_of",
    with_views("tc_candidates", "runs_completed")
    + f""", latest as (select model_name, max(init_date) as init_date from runs_completed where init_date<=timestamp '{T}' group by 1)
      select model_name, init_date, component_id, start_valid_date, ws_max_10m from tc_candidates join latest using (model_name, init_date)""",
)
def tracks_as_of(spark, sf_dir):
    t = catalog.tracks_as_of(view(spark, sf_dir, "tc_candidates"), view(spark, sf_dir, "runs_completed"), at())
    return t.select("model_name", "init_date", "component_id", "start_valid_date", "ws_max_10m")


@query(
    "runs_unprocessed",
    with_views("tc_candidates", "runs_completed")
    + """ select distinct model_name, init_date from tc_candidates t where not exists
      (select 1 from runs_completed r where r.model_name=t.model_name and r.init_date=t.init_date)""",
)
def runs_unprocessed(spark, sf_dir):
    runs = view(spark, sf_dir, "tc_candidates").select("model_name", "init_date").distinct()
    return catalog.unprocessed(runs, view(spark, sf_dir, "runs_completed"))


@query(
    "missing_steps",
    with_views("track_points")
    + """ select model_name, init_date, time_step from (select distinct model_name, init_time as init_date from track_points) r,
        (select cast(range*6 as int) as time_step from range(24)) s
      where not exists (select 1 from track_points p where p.model_name=r.model_name and p.init_time=r.init_date and p.time_step=s.time_step)""",
)
def missing_steps(spark, sf_dir):
    done = view(spark, sf_dir, "track_points").withColumnRenamed("init_time", "init_date")
    return catalog.missing_steps(done, done.select("model_name", "init_date").distinct(), 138)


@query(
    "latest_n_runs",
    with_views("runs_completed")
    + """ select model_name, init_date, cast(r as int) as recency from (select *, row_number() over (partition by model_name order by init_date desc) as r
      from runs_completed) t where r<=3""",
)
def latest_n_runs(spark, sf_dir):
    return catalog.latest_runs(view(spark, sf_dir, "runs_completed"), 3)


NEIGHBOURS = f""", a as (select max(init_date) as t from runs_completed where init_date<=timestamp '{T}')
  select (select max(init_date) from runs_completed, a where init_date<a.t) as previous, a.t as at,
    (select min(init_date) from runs_completed, a where init_date>a.t) as next from a"""


@query("cycle_neighbours", with_views("runs_completed") + NEIGHBOURS)
def cycle_neighbours(spark, sf_dir):
    return catalog.cycle_neighbours(view(spark, sf_dir, "runs_completed"), at())


@query("latest_cycle", with_views("runs_completed") + ", n as (" + NEIGHBOURS.lstrip(", ").replace("a as", "with a as", 1) + ") select coalesce(n.next, n.\"at\") as cycle from n")
def latest_cycle(spark, sf_dir):
    return catalog.latest_cycle(view(spark, sf_dir, "runs_completed"), at())


STATE = f""", latest as (select model_name, max(init_date) as init_date, max(completed_date) as completed_date from runs_completed
    where init_date<=timestamp '{T}' group by 1),
  cycles as (select ensemble_name, init_date, max(completed_date) as completed_date from latest join members using (model_name) group by 1,2),
  done as (select ensemble_name, init_date from ens_status where completed and init_date<=timestamp '{T}'),
  silent as (select d.ensemble_name, max(d.init_date) as init_date, null::timestamp as completed_date from done d group by 1
    having max(d.init_date) > (select max(init_date) from cycles c where c.ensemble_name=d.ensemble_name)),
  known as (select k.*, case when d.init_date is not null then k.init_date end as done_at from (select * from cycles union all select * from silent) k
    left join done d on d.ensemble_name=k.ensemble_name and d.init_date=k.init_date),
  s as (select ensemble_name, count(*) as n_cycles, count(done_at) as n_done, min(done_at) as first_done, max(done_at) as last_done,
    max(completed_date) as completed_date from known group by 1),
  state as (select ensemble_name, n_cycles, n_done, (n_cycles=1 and n_done=1) or (n_cycles>1 and n_done>1) as complete,
    case when n_cycles>1 and n_done>1 then last_done else first_done end as earliest_cycle, last_done as latest_cycle,
    case when (n_cycles=1 and n_done=1) or (n_cycles>1 and n_done>1) then completed_date end as completed_date from s)"""
ENS_VIEWS = ("tc_candidates", "runs_completed", "ens_status", "members")


EVERY_MEMBER = f", members as materialized ({oracle_view('all_members')})"


def ens(spark, sf_dir, members="members"):
    return [view(spark, sf_dir, v) for v in ("runs_completed", "ens_status", members)]


@query("ensemble_status_query", with_views(*ENS_VIEWS[1:]) + STATE + " select * from state")
def ensemble_status_query(spark, sf_dir):
    return catalog.ensemble_state(*ens(spark, sf_dir), at())


@query(
    "tracks_current_ensemble",
    with_views(*ENS_VIEWS[:-1]) + EVERY_MEMBER + STATE
    + """ select t.model_name, t.init_date, component_id, ensemble_name, ws_max_10m from tc_candidates t join latest using (model_name, init_date)
      left join members m on m.model_name=t.model_name left join state using (ensemble_name) where not coalesce(complete and t.init_date<>latest_cycle, false)""",
)
def tracks_current_ensemble(spark, sf_dir):
    t = catalog.current_tracks(view(spark, sf_dir, "tc_candidates"), *ens(spark, sf_dir, "all_members"), at())
    return t.select("model_name", "init_date", "component_id", "ensemble_name", "ws_max_10m")


@query(
    "source_status",
    with_views(*ENS_VIEWS[1:]) + STATE
    + """ select case when ensemble_name is null then 'GLOBAL-DET' else 'ALL-TCGEN' end as source, model_name, ensemble_name, l.init_date, completed_date,
      exists (select 1 from ens_status e where e.completed and e.ensemble_name=m.ensemble_name and e.init_date=l.init_date) as ensemble_done
      from latest l left join members m using (model_name)""",
)
def source_status(spark, sf_dir):
    return catalog.status_of_sources(*ens(spark, sf_dir), at())


@query(
    "ensemble_cycles",
    with_views("runs_completed") + EVERY_MEMBER
    + """ select ensemble_name, count(distinct init_date) as n_cycles, count(distinct model_name) as n_members, min(init_date) as first_cycle,
      max(init_date) as last_cycle, max(completed_date) as last_completed from runs_completed join members using (model_name) group by 1""",
)
def ensemble_cycles(spark, sf_dir):
    return catalog.ensemble_cycles(view(spark, sf_dir, "runs_completed"), view(spark, sf_dir, "all_members"))


@query(
    "model_recency",
    with_views(*ENS_VIEWS[1:]) + STATE
    + """ select model_name, greatest(l.init_date, case when complete and n_cycles=1 then s.completed_date end) as recent,
      strftime(greatest(l.init_date, case when complete and n_cycles=1 then s.completed_date end), '%d/%HZ') as label
      from latest l left join members m using (model_name) left join state s using (ensemble_name)""",
)
def model_recency(spark, sf_dir):
    done, status, members = ens(spark, sf_dir)
    state = catalog.ensemble_state(done, status, members, at())
    return catalog.model_recency(done, state, members, at())


@query(
    "run_completeness",
    with_views("track_points")
    + " select model_name, init_time as init_date, count(distinct time_step) as n_steps, count(distinct time_step)=24 as is_complete from track_points group by 1,2",
)
def run_completeness(spark, sf_dir):
    return catalog.step_completeness(view(spark, sf_dir, "track_points"), 24)


# ---------------------------------------------------------------- reports and calendars


@query(
    "tracks_by_basin",
    with_views("tc_candidates")
    + """ select model_name, init_date, component_id, start_basin, ws_max_10m from tc_candidates where start_basin='AL'
      order by init_date desc, model_name, component_id limit 10""",
)
def tracks_by_basin(spark, sf_dir):
    t = catalog.tracks_by_basin(view(spark, sf_dir, "tc_candidates"), "AL")
    return t.select("model_name", "init_date", "component_id", "start_basin", "ws_max_10m")


CYCLE_RUNS = """select event_id, ts, cast(case when event_id%2=0 then 6 else 12 end as int) as hours from events"""


def cycle_runs(spark, sf_dir):
    return tables(spark, sf_dir, "events")["events"].select(
        "event_id", "ts", F.when(F.col("event_id") % 2 == 0, 6).otherwise(12).alias("hours")
    )


FLOOR = "date_trunc('day', ts) + interval '1' hour * cast(floor(extract(hour from ts)/hours)*hours as int)"


@query(
    "cycle_calendar",
    f"select event_id, {FLOOR} - interval '1' hour * cast(k*hours as int) as cycle from ({CYCLE_RUNS}) t, (select range as k from range(4))",
)
def cycle_calendar(spark, sf_dir):
    return catalog.latest_cycles(cycle_runs(spark, sf_dir), "ts", "hours", 3).select("event_id", "cycle")


@query(
    "cycle_lookback",
    f"""select event_id, {FLOOR} + interval '1' hour * cast(k*hours-48 as int) as cycle from ({CYCLE_RUNS}) t, (select range as k from range(20)) where k<=48/hours+1""",
)
def cycle_lookback(spark, sf_dir):
    return catalog.lookback_cycles(cycle_runs(spark, sf_dir), "ts", "hours").select("event_id", "cycle")


@query(
    "ens_dedupe_first",
    with_views("track_points")
    + """ select k as member, lat, lon, mslp, min(source_rank) as source_rank from (select event_id%50 as k, lat, lon, floor(mslp) as mslp,
      cast(case when event_id%3=0 then 0 else 1 end as int) as source_rank from track_points) t group by 1,2,3,4""",
)
def ens_dedupe_first(spark, sf_dir):
    p = view(spark, sf_dir, "track_points").select(
        "event_id", (F.col("event_id") % 50).alias("member"), "lat", "lon", F.floor("mslp").alias("mslp")
    )
    return ensemble.merge_first([p.filter("event_id%3=0"), p.filter("event_id%3<>0")], ["member", "lat", "lon", "mslp"])


@query(
    "run_documents",
    with_views("track_points")
    + """ select event_id, model_name, init_time as init_date, time_step, mslp as mslp_value, vmax as vmax10m_in_roci from track_points""",
)
def run_documents(spark, sf_dir):
    """Candidates as one JSON document per run and hour, and back again."""
    p = view(spark, sf_dir, "track_points").withColumnsRenamed({"init_time": "init_date", "mslp": "mslp_value", "vmax": "vmax10m_in_roci"})
    docs = catalog.run_documents(p, ["event_id", "mslp_value", "vmax10m_in_roci"])
    return catalog.from_documents(docs, "event_id: bigint, mslp_value: double, vmax10m_in_roci: double")


@query(
    "passes_log",
    "with " + swaths.PREDICTED + """ select r.model_name, r.init_time, p.storm_no, satellite, ascending, pass_number, interp_id, round(vmax,3) as vmax
      from (select distinct model_name, init_time from storm_points) r left join (select * from predicted where storm_no<>3 or extract(day from init_time)%3=1) p
        on p.model_name=r.model_name and p.init_time=r.init_time""",
)
def passes_log(spark, sf_dir):
    """Predicted passes by run. At first one storm is not known; when the runs
    of some days are done again with it, their log is reset, the rest stays."""
    path = scratch_path(spark)
    points = view(spark, sf_dir, "storm_points")
    runs = cut(points.select("model_name", "init_time").distinct())
    predicted = cut(passes.predict(points, view(spark, sf_dir, "nadir"), swaths.SWATHS))
    writers.log_passes(runs, predicted.filter("storm_no<>3"), path)
    writers.log_passes(runs.filter(F.dayofmonth("init_time") % 3 == 1), predicted, path)
    log = spark.read.parquet(path)
    return log.select("model_name", "init_time", "storm_no", "satellite", "ascending", "pass_number", "interp_id", F.round("vmax", 3).alias("vmax"))


@query(
    "pass_start_list",
    with_views("tc_candidates") + " select distinct start_basin, round(start_lon,1) as start_lon, round(start_lat,1) as start_lat from tc_candidates",
)
def pass_start_list(spark, sf_dir):
    t = view(spark, sf_dir, "tc_candidates")
    starts = t.select("start_basin", F.round("start_lon", 1).alias("start_lon"), F.round("start_lat", 1).alias("start_lat"))
    return starts.distinct().orderBy("start_lon", "start_lat")


@query(
    "ace_nsd_by_track",
    with_views("track_points")
    + """, k as (select model_name, init_time, cast(floor((lon+150)/80) as int) as component_id, time_step, event_id, vmax*1.94384e0 as kt from track_points)
      select model_name, init_time, component_id, round(sum(case when kt>=34 then 0.0001e0*kt*kt else 0 end),5) as ace,
        count(case when kt>=34 then 1 end)*0.25 as named_storm_days, max(time_step) as last_step, round(max(kt),4) as max_kt,
        case when max(time_step)<>138 then 'before end of run' when max_by(kt, {'t': time_step, 'k': kt})>=34 then 'at/above 34 kt at end of run'
          else 'below 34 kt at end of run' end as status from k group by 1,2,3""",
)
def ace_nsd_by_track(spark, sf_dir):
    p = view(spark, sf_dir, "track_points").withColumn("component_id", F.floor((F.col("lon") + 150) / 80).cast("int"))
    a = catalog.ace_by_track(p, ["model_name", "init_time", "component_id"], F.lit(138))
    return a.select(
        "model_name", "init_time", "component_id", F.round("ace", 5).alias("ace"), "named_storm_days", "last_step",
        F.round("max_kt", 4).alias("max_kt"), "status",
    )
