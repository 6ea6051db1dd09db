"""Forecast verification and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from galespark.operators import verify
from galespark.plans.base import azimuth, dest_lat, dest_lon, hav, registry
from galespark.sources.adapters import view, with_views

QUERIES, ORACLE, query = registry()

ORDER = ["line_no", "tau"]
VIEWS = with_views("advisories", "deck_points")
DEDUPE = """, dd as materialized (select storm_id, model_id, init_time, valid_time, lat, lon, vmax, mslp, dir, speed from (select *, row_number() over
  (partition by storm_id, model_id, init_time, valid_time order by line_no, tau, vmax, mslp, lat, lon, dir, speed) as r from deck_points) t where r=1)"""
WEIGHTS = """, dur as (select *, (epoch(lead(advisory_time) over (partition by storm_id order by advisory_time))
    - epoch(lag(advisory_time) over (partition by storm_id order by advisory_time)))/2 as duration from advisories),
  wt as materialized (select *, duration/sum(duration) over (partition by storm_id) as weight from dur)"""
BRACKET = """, ra as (select wt.*, r.model_id, r.init_time, r.t0, r.t1 from wt join
    (select storm_id, model_id, init_time, min(valid_time) as t0, max(valid_time) as t1 from dd group by 1,2,3) r using (storm_id)),
  pr as (select ra.*, p.valid_time as pt, p.lat as plat, p.lon as plon, p.vmax as pvmax, p.mslp as pmslp, p.dir as pdir, p.speed as pspeed
    from ra asof left join dd p on p.storm_id=ra.storm_id and p.model_id=ra.model_id and p.init_time=ra.init_time and ra.advisory_time>=p.valid_time),
  br as materialized (select pr.*, n.valid_time as nt, n.lat as nlat, n.lon as nlon, n.vmax as nvmax, n.mslp as nmslp, n.dir as ndir, n.speed as nspeed
    from pr asof left join dd n on n.storm_id=pr.storm_id and n.model_id=pr.model_id and n.init_time=pr.init_time and pr.advisory_time<n.valid_time)"""


def mix(c):
    return f"case when pt is null then n{c} when nt is null then p{c} else (1-late)*p{c}+late*n{c} end as f_{c}"


POS_LAT = f"case when pt is null then nlat when nt is null or d=0 then plat else {dest_lat('plat', 'az', 'd*late')} end"
POS_LON = f"case when pt is null then nlon when nt is null or d=0 then plon else {dest_lon('plat', 'plon', 'az', 'd*late')} end"
INTERP = f""", geo as (select *, case when pt is not null and nt is not null then (epoch(advisory_time)-epoch(pt))/(epoch(nt)-epoch(pt)) else 0 end as late,
    {hav('plat', 'plon', 'nlat', 'nlon')} as d, {azimuth('plat', 'plon', 'nlat', 'nlon')} as az from br),
  fc as materialized (select *, {', '.join(mix(c) for c in ('lat', 'lon', 'vmax', 'mslp', 'dir', 'speed'))}, {POS_LAT} as pos_lat, {POS_LON} as pos_lon from geo)"""
ERRORS = f""", err as materialized (
  select storm_id, model_id, init_time, advisory_time, duration, weight, 'position' as metric, {hav('pos_lat', 'pos_lon', 'lat', 'lon')} as diff from fc
  union all select storm_id, model_id, init_time, advisory_time, duration, weight, 'wind', f_vmax-vmax_kt from fc
  union all select storm_id, model_id, init_time, advisory_time, duration, weight, 'pressure', f_mslp-mslp_hpa from fc
  union all select storm_id, model_id, init_time, advisory_time, duration, weight, 'heading', f_dir-heading from fc
  union all select storm_id, model_id, init_time, advisory_time, duration, weight, 'speed', f_speed-speed_kt from fc)"""
STATS = """, st as materialized (select storm_id, model_id, init_time, metric, avg(abs(diff)) as mae, avg(diff) as bias, avg(diff*diff) as mse, sqrt(avg(diff*diff)) as rmse,
  count(*) as cases, sum(duration) as duration, sum(abs(diff*weight)) as w_mae, sum(diff*weight) as w_bias, sum(diff*diff*weight) as w_mse,
  sqrt(sum(diff*diff*weight)) as w_rmse from err group by 1,2,3,4)"""
CHAIN = VIEWS + DEDUPE + WEIGHTS + BRACKET + INTERP + ERRORS
LONG = """, lg as (select storm_id, model_id, init_time, metric, 'unweighted' as weighting, rmse from st
  union all select storm_id, model_id, init_time, metric, 'weighted', w_rmse from st)"""


def deck(spark, sf_dir):
    return verify.dedupe(view(spark, sf_dir, "deck_points"), [*verify.RUN, "valid_time"], ORDER)


def weighted(spark, sf_dir):
    return verify.advisory_weights(view(spark, sf_dir, "advisories"))


def forecasts(spark, sf_dir):
    return verify.interpolate(verify.bracket(deck(spark, sf_dir), weighted(spark, sf_dir)))


def stats(spark, sf_dir):
    return verify.run_statistics(forecasts(spark, sf_dir))


@query("deck_dedupe", VIEWS + DEDUPE + " select * from dd")
def deck_dedupe(spark, sf_dir):
    return deck(spark, sf_dir).select("storm_id", "model_id", "init_time", "valid_time", "lat", "lon", "vmax", "mslp", "dir", "speed")


@query(
    "ace_by_run",
    VIEWS + """ select storm_id, model_id, init_time, round(sum(case when tau%6=0 and vmax>=34 then vmax*vmax else 0 end)*0.0001e0,4) as ace from
      (select *, row_number() over (partition by storm_id, model_id, init_time, tau order by line_no, vmax) as r from deck_points) t where r=1 group by 1,2,3""",
)
def ace_by_run(spark, sf_dir):
    a = verify.ace_by_run(view(spark, sf_dir, "deck_points"), ["line_no"])
    return a.withColumn("ace", F.round("ace", 4))


@query(
    "storms_verifiable",
    VIEWS + " select distinct storm_id from deck_points where storm_id in (select storm_id from advisories)",
)
def storms_verifiable(spark, sf_dir):
    return verify.verifiable(view(spark, sf_dir, "deck_points"), view(spark, sf_dir, "advisories"))


@query("advisory_weight", VIEWS + WEIGHTS + " select storm_id, advisory_time, duration from wt")
def advisory_weight(spark, sf_dir):
    return weighted(spark, sf_dir).select("storm_id", "advisory_time", "duration")


@query("advisory_norm_weight", VIEWS + WEIGHTS + " select storm_id, advisory_time, round(weight,10) as weight from wt")
def advisory_norm_weight(spark, sf_dir):
    return weighted(spark, sf_dir).select("storm_id", "advisory_time", F.round("weight", 10).alias("weight"))


@query(
    "asof_bracket",
    VIEWS + DEDUPE + WEIGHTS + BRACKET
    + " select storm_id, model_id, init_time, advisory_time, coalesce(pt, t0) as prior_time, coalesce(nt, t1) as future_time from br",
)
def asof_bracket(spark, sf_dir):
    b = verify.bracket(deck(spark, sf_dir), weighted(spark, sf_dir))
    return b.select(*verify.RUN, "advisory_time", F.col("prior.valid_time").alias("prior_time"), F.col("future.valid_time").alias("future_time"))


INTERP_OUT = "storm_id, model_id, init_time, advisory_time, round(f_vmax,5) as vmax, round(f_mslp,5) as mslp, round(pos_lat,5) as lat, round(pos_lon,5) as lon"


@query("verify_interpolate", VIEWS + DEDUPE + WEIGHTS + BRACKET + INTERP + f" select {INTERP_OUT} from fc")
def verify_interpolate(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    return f.select(
        *verify.RUN, "advisory_time", F.round("f_vmax", 5).alias("vmax"), F.round("f_mslp", 5).alias("mslp"),
        F.round("pos_lat", 5).alias("lat"), F.round("pos_lon", 5).alias("lon"),
    )


@query(
    "verify_join",
    VIEWS + " select d.storm_id, model_id, init_time, tau, vmax, round(vmax_kt,6) as vmax_kt, round(vmax-vmax_kt,6) as diff from deck_points d join advisories a on a.storm_id=d.storm_id and a.advisory_time=d.valid_time",
)
def verify_join(spark, sf_dir):
    a = view(spark, sf_dir, "advisories").select("storm_id", F.col("advisory_time").alias("valid_time"), "vmax_kt")
    j = view(spark, sf_dir, "deck_points").join(a, ["storm_id", "valid_time"])
    return j.select("storm_id", "model_id", "init_time", "tau", "vmax", F.round("vmax_kt", 6).alias("vmax_kt"), F.round(F.col("vmax") - F.col("vmax_kt"), 6).alias("diff"))


@query(
    "verify_metrics_long",
    CHAIN + " select storm_id, model_id, init_time, metric, count(*) as cases, round(sum(diff),2) as total from err group by 1,2,3,4",
)
def verify_metrics_long(spark, sf_dir):
    e = verify.errors(forecasts(spark, sf_dir))
    return e.groupBy(*verify.RUN, "metric").agg(F.count(F.lit(1)).alias("cases"), F.round(F.sum("diff"), 2).alias("total"))


@query(
    "verify_unweighted",
    CHAIN + STATS + " select storm_id, model_id, init_time, metric, round(mae,4) as mae, round(bias,4) as bias, round(rmse,4) as rmse, cases, duration from st",
)
def verify_unweighted(spark, sf_dir):
    return stats(spark, sf_dir).select(
        *verify.RUN, "metric", *[F.round(c, 4).alias(c) for c in ("mae", "bias", "rmse")], "cases", "duration"
    )


@query(
    "verify_weighted",
    CHAIN + STATS + " select storm_id, model_id, init_time, metric, round(w_mae,4) as w_mae, round(w_bias,4) as w_bias, round(w_rmse,4) as w_rmse from st",
)
def verify_weighted(spark, sf_dir):
    return stats(spark, sf_dir).select(*verify.RUN, "metric", *[F.round(c, 4).alias(c) for c in ("w_mae", "w_bias", "w_rmse")])


@query(
    "verify_model_stats",
    CHAIN + STATS + LONG + """, pm as (select metric, weighting, model_id, min(rmse) as low, avg(rmse) as mean, max(rmse) as high, quantile_cont(rmse, 0.5) as median from lg group by 1,2,3)
      select metric, weighting, model_id, round(low,3) as low, round(mean,3) as mean, round(high,3) as high, round(median,3) as median from pm
      union all select metric, weighting, null, round(min(low),3), round(avg(mean),3), round(max(high),3), round(quantile_cont(median, 0.5),3) from pm group by 1,2""",
)
def verify_model_stats(spark, sf_dir):
    m = verify.model_statistics(stats(spark, sf_dir))
    return m.select("metric", "weighting", "model_id", *[F.round(c, 3).alias(c) for c in ("low", "mean", "high", "median")])


@query(
    "verify_best_run",
    CHAIN + STATS + LONG + """, ok as (select * from lg where not (metric in ('heading','speed') and model_id='H3')),
      pm as (select metric, weighting, model_id as of_model, model_id, init_time, storm_id, rmse from (select *, row_number() over
        (partition by metric, weighting, model_id order by rmse, init_time, storm_id) as r from ok) t where r=1)
      select metric, weighting, of_model, model_id, init_time, storm_id, round(rmse,4) as rmse from pm
      union all select metric, weighting, null, model_id, init_time, storm_id, round(rmse,4) from (select *, row_number() over
        (partition by metric, weighting order by rmse, model_id, init_time, storm_id) as r from pm) t where r=1""",
)
def verify_best_run(spark, sf_dir):
    b = verify.best_runs(stats(spark, sf_dir), {"heading": ["H3"], "speed": ["H3"]})
    return b.withColumn("rmse", F.round("rmse", 4))


@query(
    "verify_forecasts",
    CHAIN + STATS + """ select storm_id, model_id, init_time, metric, round(mae,4) as mae, round(rmse,4) as rmse, round(w_mae,4) as w_mae, round(w_rmse,4) as w_rmse, cases from st
      where storm_id in (select storm_id from deck_points) and storm_id in (select storm_id from advisories)""",
)
def verify_forecasts(spark, sf_dir):
    s = verify.verify(deck(spark, sf_dir), view(spark, sf_dir, "advisories"))
    return s.select(*verify.RUN, "metric", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "w_mae", "w_rmse")], "cases")
