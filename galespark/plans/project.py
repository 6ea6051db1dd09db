"""Row-wise rules: units, flags, bins, masks, labels, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from galespark.functions import geo, units
from galespark.functions import text as text_fn
from galespark.operators import ensemble, microwave, winds
from galespark.plans.base import registry, signed
from galespark.sources.adapters import tables, view, with_views

QUERIES, ORACLE, query = registry()

UNIT = "case event_id%4 when 0 then 'Pa' when 1 then 'knots' when 2 then 'hPa' else 'm/s' end"


@query(
    "unit_by_attr",
    with_views("track_points")
    + f""" select event_id, round(case event_id%4 when 0 then mslp*100*0.01e0 when 1 then vmax*0.514444e0 when 2 then mslp else vmax end,5) as value from track_points""",
)
def unit_by_attr(spark, sf_dir):
    p = view(spark, sf_dir, "track_points").withColumn("unit", F.expr(UNIT))
    raw = F.when(F.col("unit") == "Pa", F.col("mslp") * 100).when(F.col("unit") == "hPa", F.col("mslp")).otherwise(F.col("vmax"))
    return p.select("event_id", F.round(units.by_unit(raw, F.col("unit")), 5).alias("value"))


FLAGS = ["knmi_quality_control_fails", "some_portion_of_wvc_is_over_land", "rain_detected"]


@query(
    "qc_mask",
    with_views("wind_cells")
    + " select cell_id, rank_no, case when not (qc=16777215 or (qc & (131072+32768+32))<>0) then speed end as speed from wind_cells",
)
def qc_mask(spark, sf_dir):
    w = view(spark, sf_dir, "wind_cells")
    return w.select("cell_id", "rank_no", winds.mask_speed(F.col("speed"), F.col("qc"), FLAGS).alias("speed"))


@query(
    "qc_mask_named",
    with_views("wind_cells") + " select cell_id, rank_no, case when (qc & (65536+64))=0 then speed end as speed from wind_cells",
)
def qc_mask_named(spark, sf_dir):
    w = view(spark, sf_dir, "wind_cells")
    masks, meanings = F.array(*[F.lit(m) for m in (65536, 128, 64)]), F.lit("variational redundant distance")
    speed = winds.mask_speed_named(F.col("speed"), F.col("qc"), masks, meanings, ["variational", "distance"])
    return w.select("cell_id", "rank_no", speed.alias("speed"))


@query(
    "mw_pixel_qc",
    with_views("mw_samples")
    + " select scan, pixel, case when (pdq & 2)=0 then tb_v end as tb_89av, case when (pdq & 1)=0 then tb_h end as tb_89ah from mw_samples",
)
def mw_pixel_qc(spark, sf_dir):
    s = view(spark, sf_dir, "mw_samples").withColumnsRenamed({"tb_v": "tb_89av", "tb_h": "tb_89ah"})
    return microwave.pixel_quality(s, {"tb_89av": 2, "tb_89ah": 1}).select("scan", "pixel", "tb_89av", "tb_89ah")


@query(
    "mw_box_filter",
    with_views("mw_samples")
    + " select scan, pixel, lat, lon from mw_samples where lat between 15 and 25 and lon between -80 and -70 and (pdq & 3)=0",
)
def mw_box_filter(spark, sf_dir):
    s = microwave.pixel_quality(view(spark, sf_dir, "mw_samples"), {"tb_v": 2, "tb_h": 1})
    return microwave.box(s, F.lit(20.0), F.lit(-75.0)).select("scan", "pixel", "lat", "lon")


@query(
    "extent_filter",
    with_views("wind_cells")
    + """ select cell_id, rank_no, lat, lon from (select *, case when lon360>180 then lon360-360 else lon360 end as lon from wind_cells) t
      where lon between -100 and -20 and lat between 0 and 20""",
)
def extent_filter(spark, sf_dir):
    w = view(spark, sf_dir, "wind_cells").withColumn("lon", units.wrap_over_180(F.col("lon360")))
    return w.filter(winds.in_extent(F.col("lat"), F.col("lon"), (-100, -20, 0, 20))).select("cell_id", "rank_no", "lat", "lon")


@query(
    "nadir_crossings",
    with_views("nadir")
    + " select satellite, minute_id, lat from nadir where abs(lat-45)<0.1 or abs(lat)<0.1 or abs(lat+45)<0.1",
)
def nadir_crossings(spark, sf_dir):
    lat = F.col("lat")
    hit = (F.abs(lat - 45) < 0.1) | (F.abs(lat) < 0.1) | (F.abs(lat + 45) < 0.1)
    return view(spark, sf_dir, "nadir").filter(hit).select("satellite", "minute_id", "lat")


LEAD = "round(epoch(init_time + interval '1' hour * time_step)/3600 - epoch(timestamp '2024-01-05 00:00:00')/3600)"


def lead_hours(spark, sf_dir):
    """Whole hours from the chosen valid day to each point."""
    p = view(spark, sf_dir, "track_points")
    seconds = F.unix_timestamp(F.timestamp_add("HOUR", F.col("time_step"), F.col("init_time"))) - F.unix_timestamp(
        F.lit("2024-01-05").cast("timestamp")
    )
    return p.withColumn("hours_after", F.round(seconds / 3600).cast("int"))


@query(
    "lead_day_bin",
    with_views("track_points")
    + f""" select event_id, cast(h as int) as hours_after, cast(case when h<0 then -1 else least(floor(h/24),19) end as int) as day_bin
      from (select event_id, {LEAD} as h from track_points) t where h<456""",
)
def lead_day_bin(spark, sf_dir):
    p = lead_hours(spark, sf_dir)
    return p.withColumn("day_bin", units.lead_day_bin(F.col("hours_after"), 19)).filter("day_bin is not null").select("event_id", "hours_after", "day_bin")


@query(
    "lead_range_bin",
    with_views("track_points")
    + """ select event_id, case when time_step*3<=48 then '0-48' when time_step*3<=120 then '49-120' when time_step*3<=168 then '121-168'
      when time_step*3<=240 then '169-240' when time_step*3<=336 then '241-336' else '337+' end as lead_range from track_points""",
)
def lead_range_bin(spark, sf_dir):
    return view(spark, sf_dir, "track_points").select("event_id", units.lead_range(F.col("time_step") * 3).alias("lead_range"))


@query(
    "intensity_class",
    with_views("track_points")
    + """ select event_id, case when k<34 then 'TD' when k<64 then 'TS' when k<83 then 'Cat 1' when k<96 then 'Cat 2' when k<113 then 'Cat 3'
      when k<137 then 'Cat 4' else 'Cat 5' end as class from (select event_id, vmax*1.94384e0 as k from track_points) t""",
)
def intensity_class(spark, sf_dir):
    return view(spark, sf_dir, "track_points").select("event_id", units.intensity_class(units.ms_to_kt(F.col("vmax"))).alias("class"))


@query(
    "wind_band",
    with_views("wind_cells")
    + """ select cell_id, rank_no, cast((k>=0)::int+(k>=12)::int+(k>=25)::int+(k>=34)::int+(k>=50)::int+(k>=64)::int+(k>=100)::int+(k>=120)::int+(k>=200)::int as int) as band
      from (select cell_id, rank_no, speed*1.94384e0 as k from wind_cells) t""",
)
def wind_band(spark, sf_dir):
    return view(spark, sf_dir, "wind_cells").select("cell_id", "rank_no", units.wind_band(units.ms_to_kt(F.col("speed"))).alias("band"))


@query(
    "display_units",
    with_views("track_points")
    + """ select event_id, round(roci/1000.0e0,3) as roci_km, case when rmw-30000>0 then round((rmw-30000)/1000.0e0,3) end as rmw_km,
      round(vmax*1.94384e0,4) as vmax_kt, case when (event_id%5-2)*1.0e-5>0 then round((event_id%5-2)*1.0e-5*100000,4) end as rv850 from track_points""",
)
def display_units(spark, sf_dir):
    p = view(spark, sf_dir, "track_points")
    return p.select(
        "event_id", F.round(units.positive(F.col("roci")) / 1000, 3).alias("roci_km"),
        F.round(units.positive(F.col("rmw") - 30000) / 1000, 3).alias("rmw_km"),
        F.round(units.ms_to_kt(F.col("vmax")), 4).alias("vmax_kt"),
        F.round(units.positive((F.col("event_id") % 5 - 2) * F.lit(1e-5)) * 100000, 4).alias("rv850"),
    )


@query(
    "signed_lon",
    with_views("wind_cells") + f" select cell_id, rank_no, {signed('lon360*2')} as lon from wind_cells",
)
def signed_lon(spark, sf_dir):
    return view(spark, sf_dir, "wind_cells").select("cell_id", "rank_no", units.signed_lon(F.col("lon360") * 2).alias("lon"))


@query(
    "lon_repeat",
    with_views("track_points")
    + """ select event_id, lat, lon as lon from track_points union all select event_id, lat, lon-360 from track_points
      union all select event_id, lat, lon+360 from track_points""",
)
def lon_repeat(spark, sf_dir):
    p = view(spark, sf_dir, "track_points")
    shift = F.explode(F.array(F.lit(0.0), F.lit(-360.0), F.lit(360.0)))
    return p.withColumn("shift", shift).select("event_id", "lat", (F.col("lon") + F.col("shift")).alias("lon"))


PCT = "((1.0e0+0.818e0)*tb_v-0.818e0*tb_h)"
PCT36 = "((1.0e0+1.18e0)*tb_v-1.18e0*tb_h)"


@query(
    "mw_pct",
    with_views("mw_samples") + f" select scan, pixel, round({PCT},4) as pct_89, round({PCT36},4) as pct_36 from mw_samples",
)
def mw_pct(spark, sf_dir):
    s = view(spark, sf_dir, "mw_samples")
    pct = lambda f: F.round(microwave.corrected(F.col("tb_v"), F.col("tb_h"), F.lit(microwave.THETA[f])), 4)
    return s.select("scan", "pixel", pct(89).alias("pct_89"), pct(36).alias("pct_36"))


def clip(v, a, b):
    return f"least(greatest(({v}-{a})/{b - a}.0e0,0.0e0),1.0e0)"


@query(
    "mw_rgb",
    with_views("mw_samples")
    + f""" select scan, pixel, round(1-{clip(PCT, 220, 310)},6) as red, round({clip('tb_v', 270, 290)},6) as green, round({clip('tb_h', 240, 300)},6) as blue
      from mw_samples""",
)
def mw_rgb(spark, sf_dir):
    s = view(spark, sf_dir, "mw_samples")
    pct = microwave.corrected(F.col("tb_v"), F.col("tb_h"), F.lit(microwave.THETA[89]))
    rgb = microwave.colour(pct, F.col("tb_v"), F.col("tb_h"), 89)
    return s.select("scan", "pixel", *[F.round(c, 6).alias(n) for n, c in rgb.items()])


@query(
    "mw_scan_time",
    """select o_orderkey, timestamp '1993-01-01 00:00:00' + interval '1' second * cast(980000000+o_orderkey*60-37 as bigint) as utc,
      make_timestamp(2024, cast(o_orderkey%12+1 as int), cast(o_orderkey%28+1 as int), cast(o_orderkey%24 as int), 30, 15.5e0) as from_parts from orders""",
)
def mw_scan_time(spark, sf_dir):
    o = tables(spark, sf_dir, "orders")["orders"]
    k = F.col("o_orderkey")
    parts = F.make_timestamp(F.lit(2024), (k % 12 + 1).cast("int"), (k % 28 + 1).cast("int"), (k % 24).cast("int"), F.lit(30), F.lit(15.5).cast("decimal(8,6)"))
    return o.select("o_orderkey", microwave.tai93_to_utc(k * 60 + 980000000).alias("utc"), parts.alias("from_parts"))


MEMBER = """case event_id%7 when 0 then 'GFSO' when 1 then 'EE17' when 2 then 'NP03' when 3 then 'CP20' when 4 then 'GFS' when 5 then 'AP30' else 'ZZZZ' end"""


@query(
    "member_to_ensemble",
    with_views("track_points")
    + f""" select event_id, member, case member when 'GFSO' then 'GEFS-TCGEN' when 'GFS' then 'GEFS-TCGEN' when 'AP30' then 'GEFS-TCGEN' when 'EE17' then 'EPS-TCGEN'
      when 'NP03' then 'FNMOC-TCGEN' when 'CP20' then 'GEPS-TCGEN' end as ensemble_name from (select event_id, {MEMBER} as member from track_points) t""",
)
def member_to_ensemble(spark, sf_dir):
    p = view(spark, sf_dir, "track_points").selectExpr("event_id", f"{MEMBER} as member")
    return p.withColumn("ensemble_name", ensemble.ensemble_name(F.col("member")))


@query(
    "candidate_report",
    with_views("track_points")
    + """ select event_id, printf('%s lat %.1f lon %.1f mslp %.3f hPa roci %d km vmax %.3f m/s', model_name, lat, lon, mslp, cast(roci/1000 as bigint), vmax) as line from track_points""",
)
def candidate_report(spark, sf_dir):
    p = view(spark, sf_dir, "track_points")
    line = F.format_string(
        "%s lat %.1f lon %.1f mslp %.3f hPa roci %d km vmax %.3f m/s",
        "model_name", "lat", "lon", "mslp", (F.col("roci") / 1000).cast("long"), "vmax",
    )
    return p.select("event_id", line.alias("line"))


MODEL = "case event_id%4 when 0 then 'GFS' when 1 then 'ECM' when 2 then 'CMC' else 'NAV' end"


@query(
    "step_format",
    with_views("track_points")
    + f" select event_id, case when event_id%4=1 then cast(time_step as varchar) else lpad(cast(time_step as varchar),3,'0') end as step_text from track_points",
)
def step_format(spark, sf_dir):
    p = view(spark, sf_dir, "track_points").selectExpr("event_id", "time_step", f"{MODEL} as m")
    return p.select("event_id", text_fn.step_text(F.col("m"), F.col("time_step")).alias("step_text"))


@query(
    "run_max_step",
    with_views("track_points")
    + " select event_id, cast(case event_id%4 when 0 then 384 when 1 then 240 when 2 then 240 else 180 end as int) as last_step from track_points",
)
def run_max_step(spark, sf_dir):
    p = view(spark, sf_dir, "track_points").selectExpr("event_id", f"{MODEL} as m")
    return p.select("event_id", text_fn.last_step(F.col("m")).alias("last_step"))


@query(
    "wind_product_title",
    """select o_orderkey, concat(case o_orderkey%3 when 0 then 'METOP B' when 1 then 'METOP C' else 'Unknown' end, ' ',
      case when o_orderkey%2=0 then 'Ascending' else 'Descending' end, ' ', strftime(o_orderdate, '%Y%m%d')) as title from orders""",
)
def wind_product_title(spark, sf_dir):
    o = tables(spark, sf_dir, "orders")["orders"]
    k = F.col("o_orderkey")
    name = F.concat(
        F.lit("WM"), F.date_format("o_orderdate", "yyyyMMdd"),
        F.when(k % 3 == 0, "B").when(k % 3 == 1, "C").otherwise("X"), F.lit("_"), F.when(k % 2 == 0, "as").otherwise("ds"), F.lit(".nc"),
    )
    return o.select("o_orderkey", text_fn.wind_product_title(name).alias("title"))


@query(
    "pass_labels",
    with_views("nadir")
    + """ select satellite, minute_id, concat(satellite, ' ', case when lat>0 then 'Ascending' else 'Descending' end) as sat_str,
      concat('GFS_', strftime(date_trunc('day', valid_time), '%Y-%m-%d-%H-%M')) as folder,
      concat(strftime(valid_time, '%Y%m%d%H%M'), '_', satellite, '_', case when lat>0 then 'A' else 'D' end, '.png') as file_name from nadir""",
)
def pass_labels(spark, sf_dir):
    n = view(spark, sf_dir, "nadir")
    up = F.col("lat") > 0
    return n.select(
        "satellite", "minute_id", text_fn.pass_label(F.col("satellite"), up).alias("sat_str"),
        text_fn.pass_folder(F.lit("GFS"), F.date_trunc("day", "valid_time")).alias("folder"),
        text_fn.pass_file(F.col("satellite"), up, F.col("valid_time")).alias("file_name"),
    )


# ---------------------------------------------------------------- distances


def pairs(spark, sf_dir):
    p = view(spark, sf_dir, "track_points")
    return p.select("event_id", "lat", "lon", (F.col("lat") + 1.5).alias("lat2"), (F.col("lon") + F.col("event_id") % 9).alias("lon2"), "roci", "rmw")


@query(
    "m_to_deg",
    with_views("track_points")
    + " select event_id, round(roci/111320.0e0,8) as lat_deg, round(roci/(111320.0e0*cos(radians(lat))),8) as lon_deg from track_points",
)
def m_to_deg(spark, sf_dir):
    p = view(spark, sf_dir, "track_points")
    return p.select(
        "event_id", F.round(geo.metres_to_lat_degrees(F.col("roci")), 8).alias("lat_deg"),
        F.round(geo.metres_to_lon_degrees(F.col("lat"), F.col("roci")), 8).alias("lon_deg"),
    )
