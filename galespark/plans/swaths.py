"""Geometry, passes, swaths and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from galespark.functions import geo, geodesic, units
from galespark.operators import passes
from galespark.operators.ranking import quantiles
from galespark.plans.base import azimuth, dest_lat, dest_lon, hav, registry, signed
from galespark.session import cut
from galespark.sinks import writers
from galespark.sources.adapters import oracle_view, view, with_views

QUERIES, ORACLE, query = registry()
SWATHS = {"SAT0": (336000, 550000), "SAT1": (0, 900000)}

# ---------------------------------------------------------------- points and rings

TP = with_views("track_points")


# a way of up to 19,970 km, the longest that is the shortest between its ends in every direction
WAY = "cast(case when event_id%3=0 then (event_id*7919)%19950*1000 else 19900000+(event_id*389)%70000 end as double)"


@query(
    "geo_distance",
    TP + f""" select event_id, round({hav('lat', 'lon', 'lat+1.5e0', 'lon+event_id%9')},3) as distance_m, round({azimuth('lat', 'lon', 'lat+1.5e0', 'lon+event_id%9')},8) as azimuth,
      {WAY} as way_m, 20003931.459e0 as opposite_m from track_points""",
)
def geo_distance(spark, sf_dir):
    """On the sphere; on the ellipsoid back from where a way leads to, most of
    them nearly to the other side of the globe; and to the opposite point."""
    p = view(spark, sf_dir, "track_points").withColumn("way", F.expr(WAY))
    p = p.withColumn("end", geodesic.wgs84_direct("lat", "lon", (F.col("event_id") % 360).cast("double"), "way"))
    a = [F.col("lat"), F.col("lon"), F.col("lat") + 1.5, F.col("lon") + F.col("event_id") % 9]
    back = geodesic.wgs84_inverse("lat", "lon", "end.lat", "end.lon")
    opposite = geodesic.wgs84_inverse("lat", "lon", -F.col("lat"), F.col("lon") + 180)
    return p.select(
        "event_id", F.round(geo.distance_m(*a), 3).alias("distance_m"), F.round(geo.azimuth_deg(*a), 8).alias("azimuth"),
        F.round(back["distance_m"], 3).alias("way_m"), F.round(opposite["distance_m"], 3).alias("opposite_m"),
    )


def along(g):
    """One step of the arc of the direct problem on the ellipsoid."""
    m = f"cos(2*s1+{g})"
    return f"arc+bb*sin({g})*({m}+bb/4*(cos({g})*(2*pow({m},2)-1)-bb/6*{m}*(4*pow(sin({g}),2)-3)*(4*pow({m},2)-3)))"


WGS_AXIS, WGS_FLAT = "6378137.0e0", "(1/298.257223563e0)"
# one step of the series per table: a name used again in one SELECT would be written out again and again
WGS_STEPS = [
    f"*, {WGS_AXIS}*(1-{WGS_FLAT}) as minor, atan((1-{WGS_FLAT})*tan(radians(lat))) as u1, radians(az) as al",
    "*, atan2(tan(u1), cos(al)) as s1, cos(u1)*sin(al) as sa, 1-pow(cos(u1)*sin(al),2) as ca",
    f"*, ca*({WGS_AXIS}*{WGS_AXIS}-minor*minor)/(minor*minor) as uu, {WGS_FLAT}/16*ca*(4+{WGS_FLAT}*(4-3*ca)) as cc",
    "*, 1+uu/16384*(4096+uu*(uu*(320-175*uu)-768)) as aa, uu/1024*(256+uu*(uu*(74-47*uu)-128)) as bb",
    "*, dist/(minor*aa) as arc, dist/(minor*aa) as g",
    *[f"* replace ({along('g')} as g)"] * 4,
    "*, cos(2*s1+g) as gm",
    f"""*, degrees(atan2(sin(u1)*cos(g)+cos(u1)*sin(g)*cos(al), (1-{WGS_FLAT})*sqrt(sa*sa+pow(sin(u1)*sin(g)-cos(u1)*cos(g)*cos(al),2)))) as wlat,
      degrees(atan2(sin(g)*sin(al), cos(u1)*cos(g)-sin(u1)*sin(g)*cos(al))-(1-cc)*{WGS_FLAT}*sa*(g+cc*sin(g)*(gm+cc*cos(g)*(2*gm*gm-1)))) as dlon""",
]


def wgs84_direct(start: str) -> str:
    """Tables ``w0`` to ``w`` of the direct problem on the ellipsoid."""
    names = [*(f"w{i}" for i in range(len(WGS_STEPS))), "w"]
    return f", w0 as materialized ({start})" + "".join(f", {b} as materialized (select {x} from {a})" for x, a, b in zip(WGS_STEPS, names, names[1:]))


@query(
    "geo_direct",
    TP + wgs84_direct("select *, cast(event_id%360 as double) as az, roci*40.0e0 as dist from track_points") + f"""
      select event_id, round({dest_lat('lat', 'event_id%360', 'roci')},8) as lat2, round({dest_lon('lat', 'lon', 'event_id%360', 'roci')},8) as lon2,
        round(wlat,6) as lat_wgs84, round({signed('lon+dlon')},6) as lon_wgs84 from w""",
)
def geo_direct(spark, sf_dir):
    """On the sphere, and forty times as far on the ellipsoid."""
    p = view(spark, sf_dir, "track_points")
    az, d = (F.col("event_id") % 360).cast("double"), F.col("roci")
    far = geodesic.wgs84_direct("lat", "lon", az, d * 40.0)
    return p.select(
        "event_id", F.round(geo.dest_lat(F.col("lat"), az, d), 8).alias("lat2"),
        F.round(geo.dest_lon(F.col("lat"), F.col("lon"), az, d), 8).alias("lon2"),
        F.round(far["lat"], 6).alias("lat_wgs84"), F.round(far["lon"], 6).alias("lon_wgs84"),
    )


@query(
    "circle_ring",
    TP + f" select event_id, k as pos, round({dest_lat('lat', '(k%24)*15', 'rmw')},7) as lat, round({dest_lon('lat', 'lon', '(k%24)*15', 'rmw')},7) as lon from track_points, (select range as k from range(25))",
)
def circle_ring(spark, sf_dir):
    p = view(spark, sf_dir, "track_points")
    ring = geo.circle_ring(F.col("lat"), F.col("lon"), F.col("rmw"))
    return p.select("event_id", F.posexplode(ring).alias("pos", "q")).select(
        "event_id", "pos", F.round("q.lat", 7).alias("lat"), F.round("q.lon", 7).alias("lon")
    )


CORNERS5 = [(-1, -1), (2, -1), (1, 1), (-1, 2), (-1, -1)]  # a quadrilateral, closed


@query(
    "ring_ccw",
    TP + ", way as (select event_id, lat, lon, k, dx, dy from track_points, (values "
    + ", ".join(f"({k},{x},{y})" for k, (x, y) in enumerate(CORNERS5))
    + """) c(k, dx, dy)),
      drawn as (select *, case when event_id%2=0 then k else 4-k end as nth, lon+dx as x, lat+dy as y from way),
      area as (select event_id, sum((x2-x)*(y2+y)) as a from (select *, lead(x) over w as x2, lead(y) over w as y2 from drawn window w as (partition by event_id order by nth)) q
        where x2 is not null group by 1)
      select event_id, cast(case when a<0 then nth else 4-nth end as int) as pos, round(x,4) as lon, round(y,4) as lat from drawn join area using (event_id)""",
)
def ring_ccw(spark, sf_dir):
    """Rings drawn either way round come out counter-clockwise, point by point."""
    p = view(spark, sf_dir, "track_points")
    ccw = F.array(*(F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat")) for x, y in CORNERS5))
    r = geo.counter_clockwise(F.when(F.col("event_id") % 2 == 0, ccw).otherwise(F.reverse(ccw)))
    return p.select("event_id", F.posexplode(r).alias("pos", "q")).select("event_id", "pos", F.round("q.lon", 4).alias("lon"), F.round("q.lat", 4).alias("lat"))


@query(
    "storm_bbox",
    TP + f""" select event_id, round({dest_lat('lat', '0', 'rmw')},7) as north, round({dest_lat('lat', '180', 'rmw')},7) as south,
      round(lon+rmw/(111320.0e0*cos(radians(lat))),7) as east, round(lon-rmw/(111320.0e0*cos(radians(lat))),7) as west from track_points""",
)
def storm_bbox(spark, sf_dir):
    p = view(spark, sf_dir, "track_points")
    box = passes.storm_box(F.col("lat"), F.col("lon"), F.col("rmw"))
    return p.select("event_id", *[F.round(c, 7).alias(n) for n, c in box.items()])


FAST = f""", fast as (select model_name, init_time, storm_no, time_step, lat, round({signed('lon+time_step*9')},4) as lon from storm_points)"""
PREV = """, pv as (select *, lag(lon) over w as plon, lag(lat) over w as plat from fast window w as (partition by model_name, init_time, storm_no order by time_step))"""


def fast(spark, sf_dir):
    p = view(spark, sf_dir, "storm_points")
    return p.select(*passes.TRACK, "time_step", "lat", F.round(units.signed_lon(F.col("lon") + F.col("time_step") * 9), 4).alias("lon"))


@query(
    "line_antimeridian",
    with_views("storm_points") + FAST + PREV + """, x as (select *, coalesce(abs(lon-plon)>180 and ((plon>0 and lon<0) or (plon<0 and lon>0)),false) as c from pv),
      y as (select *, sum(case when c then 1 else 0 end) over (partition by model_name, init_time, storm_no order by time_step rows unbounded preceding) as n,
        case when 360-abs(plon)-abs(lon)<>0 then plat+(lat-plat)*(180-abs(plon))/(180-abs(plon)+(180-abs(lon))) else 0 end as at from x)
      select model_name, init_time, storm_no, time_step, n as line_no, 2 as seq, lon, round(lat,6) as lat from y
      union all select model_name, init_time, storm_no, time_step, n-1, 0, case when plon>0 then 180 else -180 end, round(y.at,6) from y where c
      union all select model_name, init_time, storm_no, time_step, n, 1, case when plon>0 then -180 else 180 end, round(y.at,6) from y where c""",
)
def line_antimeridian(spark, sf_dir):
    return passes.cut_lines(fast(spark, sf_dir), passes.TRACK, "time_step").withColumn("lat", F.round("lat", 6))


@query(
    "lon_unwrap",
    with_views("storm_points") + FAST + PREV + """ select model_name, init_time, storm_no, time_step, lon,
      case when abs(plon-lon)>270 then case when plon<lon then plon+360 else plon-360 end else plon end as prev_lon from pv""",
)
def lon_unwrap(spark, sf_dir):
    return passes.unwrapped_previous(fast(spark, sf_dir), passes.TRACK, "time_step").drop("lat")


# ---------------------------------------------------------------- passes and swaths

STEPS = """, s0 as (select satellite, minute_id, valid_time, lat, lon, lag(minute_id) over w as minute0, lag(lat) over w as lat0, lag(lon) over w as lon0,
    sign(lat-lag(lat) over w) as way from nadir window w as (partition by satellite order by minute_id)),
  s1 as (select *, last_value(nullif(way,0) ignore nulls) over (partition by satellite order by minute_id rows between unbounded preceding and 1 preceding) as before
    from s0 where lat0 is not null),
  s2 as materialized (select *, sum(case when way<>0 and before<>way then 1 else 0 end) over (partition by satellite order by minute_id rows unbounded preceding) as pass_number,
    way>0 as ascending from s1)"""
NV = with_views("nadir")


@query(
    "pass_segments",
    NV + STEPS + """ select satellite, pass_number, ascending, minute_id, lat, lon from s2 union
      select satellite, pass_number, ascending, minute0, lat0, lon0 from s2""",
)
def pass_segments(spark, sf_dir):
    return passes.pass_points(view(spark, sf_dir, "nadir"))


def corner(lat, lon, turn, dist):
    d = f"(({dist})/6371008.8e0)"
    la = dest_lat(lat, f"(az+({turn}))", dist)
    lo = (
        f"({lon})+degrees(atan2(sin(radians(az+({turn})))*sin({d})*cos(radians({lat})), cos({d})-sin(radians({lat}))*sin(radians({la}))))"
    )
    return la, lo


def quad_select(sat, side, near_turn, near, far_turn, far):
    parts = []
    for k, (p, t, d) in {"a": ("0", near_turn, near), "b": ("0", far_turn, far), "c": ("1", far_turn, far), "d": ("1", near_turn, near)}.items():
        la, lo = corner(f"lat{p}", f"lon{p}", t, d)
        parts.append(f"{la} as {k}_lat, {lo} as {k}_lon")
    return (
        f"select satellite, pass_number, cast(ascending as int) as ascending, {side} as side, interp_id, valid_time, {', '.join(parts)} from q0 where satellite='{sat}'"
    )


QUADS = STEPS + f""", q0 as (select *, lat as lat1, lon0+{signed('lon-lon0')} as lon1, {azimuth('lat0', 'lon0', 'lat', 'lon')} as az,
    cast(epoch(valid_time)-epoch(timestamp '2024-01-01 00:00:00') as bigint) as interp_id from s2),
  quads as materialized ({quad_select('SAT0', 0, -90, 336000, -90, 886000)} union all {quad_select('SAT0', 1, 90, 336000, 90, 886000)}
    union all {quad_select('SAT1', 0, 90, 900000, -90, 900000)})"""
CORNER_COLS = [f"{k}_{c}" for k in "abcd" for c in ("lat", "lon")]


def quads(spark, sf_dir, during=None):
    return passes.swath_quads(view(spark, sf_dir, "nadir"), SWATHS, during=during)


@query(
    "swath_quads",
    NV + QUADS + " select satellite, pass_number, ascending, side, interp_id, " + ", ".join(f"round({c},5) as {c}" for c in CORNER_COLS) + " from quads",
)
def swath_quads(spark, sf_dir):
    q = quads(spark, sf_dir)
    return q.select("satellite", "pass_number", "ascending", "side", "interp_id", *[F.round(c, 5).alias(c) for c in CORNER_COLS])


CORNERS4 = ["l1", "l2", "l3", "l4"]


def _parts() -> str:
    """Parts of a convex quad by the meridian at 180 east or west: corners
    inside, two crossings, and the corner that closes the ring."""

    def inside(side):
        return "+".join(f"({c}{side})::int" for c in CORNERS4)

    def cuts(side):
        ends = zip(CORNERS4, CORNERS4[1:] + CORNERS4[:1])
        return "+".join(f"(({a}{side})<>({b}{side}))::int" for a, b in ends)

    def part(no, where, side, west, east):
        return (
            f"select satellite, side, interp_id, {no} as poly_num, {inside(side)}+{cuts(side)}+1 as n_points, {west} as west, {east} as east "
            f"from unrolled where {where}"
        )

    over, under = "low<180 and high>180", "low<-180 and high>-180"
    return " union all ".join([
        f"select satellite, side, interp_id, 0 as poly_num, 5 as n_points, low as west, high as east from unrolled where not ({over}) and not ({under})",
        part(0, over, "<=180", "low", "180.0e0"), part(1, over, ">=180", "-180.0e0", "high-360"),
        part(0, under, ">=-180", "-180.0e0", "high"), part(1, under, "<=-180", "low+360", "180.0e0"),
    ])


@query(
    "ring_antimeridian",
    NV + QUADS + f""", base as (select *, {signed('a_lon')} as l1 from quads),
  unrolled as (select *, least(l1,l2,l3,l4) as low, greatest(l1,l2,l3,l4) as high from (select satellite, side, interp_id, l1,
    {', '.join(f"{k}_lon+360.0e0*round((l1-{k}_lon)/360.0e0) as l{i}" for i, k in enumerate('bcd', 2))} from base) t)
  select satellite, side, interp_id, poly_num, cast(n_points as int) as n_points, round(west,5) as west, round(east,5) as east from ({_parts()}) p""",
)
def ring_antimeridian(spark, sf_dir):
    r = passes.split_rings(quads(spark, sf_dir))
    lons = F.transform("ring", lambda p: p["lon"])
    return r.select(
        "satellite", "side", "interp_id", "poly_num", F.size("ring").alias("n_points"),
        F.round(F.array_min(lons), 5).alias("west"), F.round(F.array_max(lons), 5).alias("east"),
    )


@query(
    "swath_time_window",
    NV + """ select satellite, minute_id from nadir where satellite='SAT1' and valid_time between timestamp '2024-01-03 00:00:00' and timestamp '2024-01-05 00:00:00'""",
)
def swath_time_window(spark, sf_dir):
    n = passes.time_window(view(spark, sf_dir, "nadir"), F.lit("2024-01-04").cast("timestamp"), 24, 24, ["SAT1"])
    return n.select("satellite", "minute_id")


@query(
    "swath_geojson",
    NV + QUADS + """ select satellite, interp_id, count(*) as features, max(ascending) as ascending, round(min(a_lon),5) as first_lon, round(max(a_lat),5) as first_lat,
      round(min(least(a_lat,b_lat,c_lat,d_lat)),5) as south from quads group by 1,2""",
)
def swath_geojson(spark, sf_dir):
    """Features written as JSON lines and counted by what they carry."""
    q = passes.ring(quads(spark, sf_dir)).withColumnRenamed("satellite", "satellite_name")
    lines = writers.swath_features(q)
    prop = lambda p: F.get_json_object("value", f"$.properties.{p}")
    ring = F.from_json(F.get_json_object("value", "$.geometry.coordinates[0]"), "array<array<double>>")
    point = lambda i: ring[0][i]
    return lines.groupBy(prop("satellite_name").alias("satellite"), prop("interp_id").cast("long").alias("interp_id")).agg(
        F.count(F.lit(1)).alias("features"), F.max(prop("ascending").cast("int")).alias("ascending"),
        F.round(F.min(point(0)), 5).alias("first_lon"), F.round(F.max(point(1)), 5).alias("first_lat"),
        F.round(F.min(F.array_min(F.transform(ring, lambda p: p[1]))), 5).alias("south"),
    )


@query(
    "swath_picks",
    NV + QUADS + """ select satellite, pass_number, min(interp_id) as interp_id from quads group by 1,2""",
)
def swath_picks(spark, sf_dir):
    """Each pass once, in order of time."""
    q = quads(spark, sf_dir)
    return q.groupBy("satellite", "pass_number").agg(F.min("interp_id").alias("interp_id")).orderBy("interp_id", "satellite")


# ---------------------------------------------------------------- minutes and sensing

SP = with_views("storm_points", "nadir")
MIN_PAIRS = f""", mp0 as (select *, lead(valid_time) over w as zt, lead(lat) over w as zlat, lead(lon) over w as zlon, lead(vmax) over w as zvmax, lead(rmw) over w as zrmw,
    lead(roci) over w as zroci from storm_points window w as (partition by model_name, init_time, storm_no order by valid_time)),
  mp as (select *, cast((epoch(zt)-epoch(valid_time))/60 as int) as n, {hav('lat', 'lon', 'zlat', 'zlon')} as dist, {azimuth('lat', 'lon', 'zlat', 'zlon')} as az from mp0 where zt is not null)"""


def minute_rows(where=""):
    return f""", mi as materialized (select model_name, init_time, storm_no, cast(epoch(valid_time)-epoch(timestamp '2024-01-01 00:00:00') as bigint)+i*60 as interp_id,
    case when dist>0 then {dest_lat('lat', 'az', 'dist*(i/n)')} else lat end as lat, case when dist>0 then {dest_lon('lat', 'lon', 'az', 'dist*(i/n)')} else lon end as lon,
    vmax+(i/n)*(zvmax-vmax) as vmax, rmw+(i/n)*(zrmw-rmw) as rmw, coalesce(roci,0)+(i/n)*(coalesce(zroci,0)-coalesce(roci,0)) as roci
    from mp, unnest(range(0, n)) u(i) {where})"""


@query(
    "track_minutes",
    with_views("storm_points") + MIN_PAIRS + minute_rows() + """ select model_name, init_time, storm_no, count(*) as n_minutes, min(interp_id) as first_id, max(interp_id) as last_id,
      round(sum(lat),4) as lat_sum, round(sum(lon),4) as lon_sum, round(sum(vmax),4) as vmax_sum, round(avg(roci),4) as roci_mean from mi group by 1,2,3""",
)
def track_minutes(spark, sf_dir):
    m = passes.minutes(view(spark, sf_dir, "storm_points"))
    return m.groupBy(*passes.TRACK).agg(
        F.count(F.lit(1)).alias("n_minutes"), F.min("interp_id").alias("first_id"), F.max("interp_id").alias("last_id"),
        F.round(F.sum("lat"), 4).alias("lat_sum"), F.round(F.sum("lon"), 4).alias("lon_sum"),
        F.round(F.sum("vmax"), 4).alias("vmax_sum"), F.round(F.avg("roci"), 4).alias("roci_mean"),
    )


def plane(k):
    return (
        f"({k}_lon+360.0e0*round((lon-a_lon)/360)-lon)*111320.0e0*cos(radians(lat)) as p{k}x, ({k}_lat-lat)*111320.0e0 as p{k}y"
    )


def edge(p, q):
    p, q = f"p{p}", f"p{q}"
    ux, uy = f"({q}x-{p}x)", f"({q}y-{p}y)"
    t = f"least(1.0e0,greatest(0.0e0,-({p}x*{ux}+{p}y*{uy})/greatest({ux}*{ux}+{uy}*{uy},1e-9)))"
    return f"(pow({p}x+{t}*{ux},2)+pow({p}y+{t}*{uy},2))"


EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]
CROSS = [f"(p{p}x*p{q}y-p{q}x*p{p}y)" for p, q in EDGES]
SENSED = QUADS + MIN_PAIRS + minute_rows(
    "where valid_time<(select max(valid_time) from nadir)"
) + f""", pl as (select *, {', '.join(plane(k) for k in 'abcd')} from mi join quads using (interp_id)),
  sensed as materialized (select * from pl where least({','.join(CROSS)})>=0 or greatest({','.join(CROSS)})<=0 or least({','.join(edge(*e) for e in EDGES)})<=rmw*rmw)"""


def matched(spark, sf_dir):
    points = view(spark, sf_dir, "storm_points")
    return passes.sensed_tracks(points, cut(quads(spark, sf_dir, passes.span_of(points))))


PASS_KEY = ["model_name", "init_time", "storm_no", "satellite", "pass_number"]


@query("pass_candidates", SP + SENSED + " select model_name, init_time, storm_no, satellite, pass_number, side, interp_id from sensed")
def pass_candidates(spark, sf_dir):
    return matched(spark, sf_dir).select(*PASS_KEY, "side", "interp_id")


CORNER_M = "least(" + ",".join(hav("lat", "lon", f"{k}_lat", f"{k}_lon") for k in "abcd") + ")"
DEDUPED = f""", cm as (select *, {CORNER_M} as corner_m from sensed),
  g as (select *, coalesce(interp_id-lag(interp_id) over (partition by model_name, init_time, storm_no, satellite, pass_number order by interp_id, side)<>60, true) as st from cm),
  il as (select *, sum(st::int) over (partition by model_name, init_time, storm_no, satellite, pass_number order by interp_id, side rows unbounded preceding) as island from g),
  best as (select *, row_number() over (partition by model_name, init_time, storm_no, satellite, pass_number, island order by round(corner_m,3), interp_id, side) as r,
    count(*) over (partition by model_name, init_time, storm_no, satellite, pass_number, island) as n_minutes from il)"""


# tables to go on with after another WITH clause
PREDICTED = ", ".join(f"{n} as materialized ({oracle_view(n)})" for n in ("storm_points", "nadir")) + SENSED + DEDUPED + """,
  predicted as materialized (select * from best where r=1)"""


@query(
    "dedupe_sensing",
    SP + SENSED + DEDUPED + " select model_name, init_time, storm_no, satellite, pass_number, interp_id, n_minutes, round(corner_m/1000,2) as corner_km from best where r=1",
)
def dedupe_sensing(spark, sf_dir):
    d = passes.dedupe_sensing(matched(spark, sf_dir))
    return d.select(*PASS_KEY, "interp_id", "n_minutes", F.round(F.col("corner_m") / 1000, 2).alias("corner_km"))


@query(
    "predict_passes",
    SP + SENSED + DEDUPED + " select model_name, init_time, storm_no, satellite, ascending, pass_number, interp_id, round(vmax,3) as vmax from best where r=1",
)
def predict_passes(spark, sf_dir):
    p = passes.predict(view(spark, sf_dir, "storm_points"), view(spark, sf_dir, "nadir"), SWATHS)
    return p.select("model_name", "init_time", "storm_no", "satellite", "ascending", "pass_number", "interp_id", F.round("vmax", 3).alias("vmax"))


@query(
    "passes_sorted",
    SP + SENSED + " select satellite, interp_id, count(*) as storms, min(side) as side from sensed group by 1,2",
)
def passes_sorted(spark, sf_dir):
    m = matched(spark, sf_dir).groupBy("satellite", "interp_id").agg(F.count(F.lit(1)).alias("storms"), F.min("side").alias("side"))
    return m.orderBy("interp_id", "satellite")


@query(
    "pass_member_stats",
    SP + SENSED + """ select satellite, pass_number, count(*) as cases, round(min(vmax),4) as low, round(quantile_cont(vmax,0.25),4) as q25, round(quantile_cont(vmax,0.5),4) as median,
      round(quantile_cont(vmax,0.75),4) as q75, round(max(vmax),4) as high, round(avg(vmax),4) as mean from sensed group by 1,2""",
)
def pass_member_stats(spark, sf_dir):
    m = cut(matched(spark, sf_dir).select("satellite", "pass_number", "vmax"))
    key = ["satellite", "pass_number"]
    plain = m.groupBy(*key).agg(
        F.count(F.lit(1)).alias("cases"), F.min("vmax").alias("low"), F.max("vmax").alias("high"), F.avg("vmax").alias("mean")
    )
    q = quantiles(m, key, "vmax", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return plain.join(q, key).select(*key, "cases", *[F.round(c, 4).alias(c) for c in ("low", "q25", "median", "q75", "high", "mean")])


@query(
    "pass_time_overlap",
    SP + STEPS + """, p as (select satellite, pass_number, min(valid_time) as p0, max(valid_time) as p1 from s2 group by 1,2),
      s as (select model_name, init_time, storm_no, min(valid_time) as s0, max(valid_time) as s1 from storm_points group by 1,2,3)
      select model_name, init_time, storm_no, count(*) as n_passes, min(p0) as first_pass from s join p on s0<=p1 and s1>=p0 group by 1,2,3""",
)
def pass_time_overlap(spark, sf_dir):
    steps = passes.steps(view(spark, sf_dir, "nadir"))
    p = steps.groupBy("satellite", "pass_number").agg(F.min("valid_time").alias("t0"), F.max("valid_time").alias("t1"))
    s = view(spark, sf_dir, "storm_points").groupBy(*passes.TRACK).agg(F.min("valid_time").alias("t0"), F.max("valid_time").alias("t1"))
    return passes.time_overlap(s, p).groupBy(*passes.TRACK).agg(F.count(F.lit(1)).alias("n_passes"), F.min("p0").alias("first_pass"))
