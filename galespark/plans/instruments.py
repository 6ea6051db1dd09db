"""Wind extents and microwave products."""

from __future__ import annotations

from pyspark.sql import functions as F

from galespark.functions import units
from galespark.operators import microwave, winds
from galespark.plans.base import hav, registry
from galespark.session import cut
from galespark.sources.adapters import tables, view, with_views

QUERIES, ORACLE, query = registry()

# ---------------------------------------------------------------- winds

DAY = "date_trunc('month', obs_time)"
MASKED = f""", w as (select *, {DAY} as pass_month, pow(10.0e0, log10_likelihood) as likelihood, case when qc=16777215 or (qc & (131072+32))<>0 then null else speed*1.94384e0 end as kt,
    case when lon360>180 then lon360-360 else lon360 end as lon from wind_cells where rank_no=1)"""
BOX = "lon between -150 and 150 and lat between -25 and 25"
FLAGS = ["knmi_quality_control_fails", "rain_detected"]


def extent(spark, sf_dir):
    w = winds.select_ambiguity(view(spark, sf_dir, "wind_cells"), 1)
    w = w.withColumns(
        {
            "pass_month": F.date_trunc("month", "obs_time"), "lon": units.wrap_over_180(F.col("lon360")),
            "speed": units.ms_to_kt(winds.mask_speed(F.col("speed"), F.col("qc"), FLAGS)), "tie": F.col("sample_no"),
        }
    )
    return w.filter(winds.in_extent(F.col("lat"), F.col("lon"), (-150, 150, -25, 25)))


@query(
    "wind_extent_stats",
    with_views("wind_cells") + MASKED + f""" select pass_month, round(max(kt),4) as vmax, round(max_by(likelihood, (kt, sample_no)) filter (kt is not null),6) as vmax_likelihood,
      min(obs_time) as time_min, max(obs_time) as time_max from w where {BOX} group by 1""",
)
def wind_extent_stats(spark, sf_dir):
    s = winds.extent_stats(extent(spark, sf_dir), ["pass_month"])
    return s.withColumns({"vmax": F.round("vmax", 4), "vmax_likelihood": F.round("vmax_likelihood", 6)})


@query(
    "wind_top_or_threshold",
    with_views("wind_cells") + MASKED + f""", x as (select *, max(kt) over (partition by pass_month) as best, row_number() over (partition by pass_month order by kt desc nulls last, sample_no) as r
      from w where {BOX}) select cell_id, pass_month, round(kt,4) as speed, round(likelihood,6) as likelihood from x where kt is not null and
      case when best>=66 then kt>=66 else r<=20 end""",
)
def wind_top_or_threshold(spark, sf_dir):
    s = winds.strong_or_top(extent(spark, sf_dir), ["pass_month"], threshold=66.0)
    return s.select("cell_id", "pass_month", F.round("speed", 4).alias("speed"), F.round("likelihood", 6).alias("likelihood"))


@query(
    "swath_width_stats",
    with_views("mw_samples")
    + f""", e as (select cast(floor(scan/100) as bigint) as pass_no, scan, min_by(lat, pixel) as a1, min_by(lon, pixel) as o1, max_by(lat, pixel) as a2, max_by(lon, pixel) as o2 from mw_samples group by 1,2),
      d as (select pass_no, {hav('a1', 'o1', 'a2', 'o2')}/1000 as km from e)
      select pass_no, round(min(km),4) as min_km, round(max(km),4) as max_km, round(avg(km),4) as mean_km, count(*) as scans from d group by 1""",
)
def swath_width_stats(spark, sf_dir):
    s = view(spark, sf_dir, "mw_samples").withColumn("pass_no", F.floor(F.col("scan") / 100))
    out = winds.swath_width(s, ["pass_no"])
    return out.withColumns({c: F.round(c, 4) for c in ("min_km", "max_km", "mean_km")})


# ---------------------------------------------------------------- microwave

THETA = """, th as (select cast(l_partkey%23*5-55 as double) as tlat, cast(month(l_shipdate) as int) as month, round(avg(l_discount)*10,6) as theta from lineitem group by 1,2)"""


def theta(spark, sf_dir):
    lines = tables(spark, sf_dir, "lineitem")["lineitem"]
    return lines.groupBy(
        (F.col("l_partkey") % 23 * 5 - 55).cast("double").alias("lat"), F.month("l_shipdate").alias("month")
    ).agg(F.round(F.avg("l_discount") * 10, 6).alias("theta"))


@query(
    "nearest_lookup",
    with_views("mw_samples") + THETA + """ select scan, pixel, theta from (select s.scan, s.pixel, th.theta, row_number() over (partition by s.scan, s.pixel
      order by abs(tlat-s.lat), tlat desc) as r from mw_samples s join th on th.month=cast(s.scan%12+1 as int)) t where r=1""",
)
def nearest_lookup(spark, sf_dir):
    s = view(spark, sf_dir, "mw_samples").withColumn("month", (F.col("scan") % 12 + 1).cast("int"))
    return microwave.theta_lookup(s, theta(spark, sf_dir)).select("scan", "pixel", "theta")


FILE = "cast(floor(scan/1500) as bigint)"


@query(
    "nearest_sample",
    with_views("mw_samples") + f""" select file_no, scan, pixel from (select {FILE} as file_no, scan, pixel, row_number() over (partition by {FILE}
      order by pow(lat-20,2)+pow(lon+75,2), scan, pixel) as r from mw_samples) t where r=1""",
)
def nearest_sample(spark, sf_dir):
    s = view(spark, sf_dir, "mw_samples").withColumn("file_no", F.floor(F.col("scan") / 1500))
    return microwave.nearest_sample(s, ["file_no"], F.lit(20.0), F.lit(-75.0), ["scan", "pixel"])


def unit(s):
    la, lo = f"radians({s}lat)", f"radians({s}lon)"
    return f"cos({la})*cos({lo}) as {s}x, cos({la})*sin({lo}) as {s}y, sin({la}) as {s}z"


COREG = f""", pr as (select p.scan, cast(floor(p.pixel/2) as bigint) as pair, p.lat as plat, p.lon as plon, q.lat as qlat, q.lon as qlon from mw_samples p join mw_samples q
    on q.scan=p.scan and q.pixel=p.pixel+1 and p.pixel%2=0),
  un as (select *, {unit('p')}, {unit('q')} from pr),
  cr as (select *, py*qz-pz*qy as n1, pz*qx-px*qz as n2, px*qy-py*qx as n3 from un),
  nr as (select *, sqrt(n1*n1+n2*n2+n3*n3) as norm from cr),
  nn as (select * replace (n1/norm as n1, n2/norm as n2, n3/norm as n3) from nr),
  sd as (select *, n2*pz-n3*py as sx, n3*px-n1*pz as sy, n1*py-n2*px as sz, acos(greatest(-1.0e0,least(1.0e0,px*qx+py*qy+pz*qz))) as an from nn),
  rt as (select scan, pair, {', '.join(f"case when norm<1e-6 then p{k} else cos(an*0.25e0)*(cos(an*1.4e0)*p{k}+sin(an*1.4e0)*s{k})+sin(an*0.25e0)*n{i} end as r{k}" for i, k in enumerate('xyz', 1))} from sd),
  co as (select scan, pair, degrees(atan2(rz, sqrt(rx*rx+ry*ry))) as lat, degrees(atan2(ry, rx)) as lon from rt)"""


@query("mw_coregister", with_views("mw_samples") + COREG + " select scan, pair, round(lat,5) as lat, round(lon,5) as lon from co")
def mw_coregister(spark, sf_dir):
    c = microwave.coregister(view(spark, sf_dir, "mw_samples"), 1.4, 0.25)
    return c.select("scan", "pair", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query(
    "union_horns",
    with_views("mw_samples")
    + " select 'A' as horn, scan, pixel, tb_v from mw_samples where pixel%2=0 union all select 'B', scan, pixel, tb_v from mw_samples where pixel%2=1",
)
def union_horns(spark, sf_dir):
    s = view(spark, sf_dir, "mw_samples")
    horn = lambda n, r: s.filter(F.col("pixel") % 2 == r).select(F.lit(n).alias("horn"), "scan", "pixel", "tb_v")
    return horn("A", 0).unionByName(horn("B", 1))


MESH = 16


@query(
    "nearest_regrid",
    with_views("mw_samples") + f""", s as (select *, {FILE} as file_no from mw_samples),
      ex as (select file_no, min(lat) as lat0, max(lat) as lat1, min(lon) as lon0, max(lon) as lon1 from s group by 1),
      m as (select file_no, cast(a.i as int) as i, cast(b.j as int) as j, lat0+a.i*((lat1-lat0)/{MESH - 1}) as mlat, lon0+b.j*((lon1-lon0)/{MESH - 1}) as mlon from ex, range({MESH}) a(i), range({MESH}) b(j))
      select file_no, i, j, scan, pixel from (select m.file_no, m.i, m.j, s.scan, s.pixel, row_number() over (partition by m.file_no, m.i, m.j
        order by (s.lat-mlat)*(s.lat-mlat)+(s.lon-mlon)*(s.lon-mlon), s.scan, s.pixel) as r from m join s using (file_no)) t where r=1""",
)
def nearest_regrid(spark, sf_dir):
    s = cut(view(spark, sf_dir, "mw_samples").withColumn("file_no", F.floor(F.col("scan") / 1500)))
    mesh = microwave.mesh_of(s, ["file_no"], MESH, MESH)
    return microwave.regrid_nearest(s, mesh, ["file_no"], ["scan", "pixel"])


CLIP = lambda v, a, b: f"least(greatest(({v}-{a})/{b - a}.0e0,0.0e0),1.0e0)"


@query(
    "mw_product",
    with_views("mw_samples") + f""", q as (select scan, pixel, lat, lon, case when (pdq & 2)=0 then tb_v end as tb_v, case when (pdq & 1)=0 then tb_h end as tb_h from mw_samples),
      b as (select *, 1.818e0*tb_v-0.818e0*tb_h as pct from q where tb_v is not null and tb_h is not null and lat between 15 and 25 and lon between -80 and -70)
      select scan, pixel, round(pct,4) as pct, round(1-{CLIP('pct', 220, 310)},6) as red, round({CLIP('tb_v', 270, 290)},6) as green, round({CLIP('tb_h', 240, 300)},6) as blue from b""",
)
def mw_product(spark, sf_dir):
    """Quality, box, corrected temperature and colours of one scene."""
    p = microwave.product(view(spark, sf_dir, "mw_samples"), F.lit(20.0), F.lit(-75.0), 89, {"tb_v": 2, "tb_h": 1})
    return p.select("scan", "pixel", *[F.round(c, 4 if c == "pct" else 6).alias(c) for c in ("pct", "red", "green", "blue")])
