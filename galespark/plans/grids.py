"""Grid detection and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from galespark.operators import grid, regions
from galespark.plans.base import basin_case, registry
from galespark.plans.tracks import COAST, coast
from galespark.session import cut
from galespark.sources import dims
from galespark.sources.adapters import GRID_COLS, GRID_ROWS, view, with_views

QUERIES, ORACLE, query = registry()

GRID = grid.Grid(rows=GRID_ROWS, cols=GRID_COLS, lat0=11.5, dlat=-1.0, dlon=1.0)
NX, NY = GRID_ROWS, GRID_COLS
CELLS = with_views("grid_cells", recursive=True)
KEY = "model_name, init_time, time_step"


def same(a, b):
    return " and ".join(f"{a}.{k}={b}.{k}" for k in ("model_name", "init_time", "time_step"))


MINIMA = f""", rowmin as (select *, least(lag(mslp) over w, mslp, lead(mslp) over w) as m3, first_value(mslp) over (partition by {KEY}, x order by y) as f0,
    max_by(mslp, y) over (partition by {KEY}, x) as l0, y as yy from grid_cells window w as (partition by {KEY}, x order by y)),
  r3 as (select *, case when y=0 then least(m3, l0) when y={NY - 1} then least(m3, f0) else m3 end as rm from rowmin),
  box3 as (select *, least(rm, coalesce(lag(rm) over w, max_by(rm, x) over (partition by {KEY}, y)), coalesce(lead(rm) over w, min_by(rm, x) over (partition by {KEY}, y))) as bm
    from r3 window w as (partition by {KEY}, y order by x)),
  minima as materialized (select {KEY}, x, y, lat, lon, mslp from box3 where mslp<=bm)"""


def box(r, expr, source="grid_cells"):
    """Extreme over the box of each candidate row in ``cand``."""
    return (
        f"(select c.model_name, c.init_time, c.time_step, c.x, c.y, {expr} from cand c, range({-r},{r + 1}) dx(i), range({-r},{r + 1}) dy(j), {source} g "
        f"where {same('c', 'g')} and g.x=((c.x+dx.i)%{NX}+{NX})%{NX} and g.y=((c.y+dy.j)%{NY}+{NY})%{NY} group by 1,2,3,4,5)"
    )


VORT = f""", d as (select *, 6371008.8e0*radians(1.0e0) as dy, 6371008.8e0*radians(1.0e0)*cos(radians(lat)) as dx,
    lag(u) over wx as ua, lead(u) over wx as ub, lag(u,2) over wx as ua2, lead(u,2) over wx as ub2,
    lag(v) over wy as va, lead(v) over wy as vb, lag(v,2) over wy as va2, lead(v,2) over wy as vb2 from grid_cells
    window wx as (partition by {KEY}, y order by x), wy as (partition by {KEY}, x order by y)),
  vort as materialized (select {KEY}, x, y, lat, (case when y=0 then -3*v+4*vb-vb2 when y={NY - 1} then 3*v-4*va+va2 else vb-va end)/(2*dx)
    + (case when x=0 then -3*u+4*ub-ub2 when x={NX - 1} then 3*u-4*ua+ua2 else ub-ua end)/(2*dy) as vort from d)"""


def field_strips(spark, sf_dir, fields):
    return grid.strips(grid.derived(view(spark, sf_dir, "grid_cells")), ["lon", *fields])


def minima_of(spark, sf_dir, fields):
    """All minima of the fields, with the strips they came from."""
    f = cut(field_strips(spark, sf_dir, ["mslp", *fields]))
    return grid.local_minima(f), f


@query("grid_derived", CELLS + f" select {KEY}, x, y, round(gh250-gh850,4) as thickness, round(sqrt(u*u+v*v),6) as wind from grid_cells")
def grid_derived(spark, sf_dir):
    d = grid.derived(view(spark, sf_dir, "grid_cells"))
    return d.select(*grid.CELL, F.round("thickness", 4).alias("thickness"), F.round("wind", 6).alias("wind"))


@query("grid_local_minima", CELLS + MINIMA + " select * from minima")
def grid_local_minima(spark, sf_dir):
    return grid.local_minima(field_strips(spark, sf_dir, ["mslp"]))


@query(
    "grid_local_minima_inner",
    CELLS + MINIMA + f" select * from minima where x between 1 and {NX - 2} and y between 1 and {NY - 2}",
)
def grid_local_minima_inner(spark, sf_dir):
    return grid.local_minima(field_strips(spark, sf_dir, ["mslp"]), edges=False)


@query("grid_vorticity", CELLS + VORT + f" select {KEY}, x, y, round(vort*100000,6) as vort from vort")
def grid_vorticity(spark, sf_dir):
    v = grid.vorticity(field_strips(spark, sf_dir, ["u", "v"]), GRID)
    return v.select(*grid.RUN, "x", F.posexplode("vort").alias("y", "z")).select(
        *grid.CELL, F.round(F.col("z") * 100000, 6).alias("vort")
    )


CAND = ", cand as (select * from minima)"


@query(
    "box_vorticity",
    CELLS + MINIMA + VORT + CAND + f" select b.model_name, b.init_time, b.time_step, b.x, b.y, round((case when lat<0 then lo else hi end)*100000,6) as rv850max from {box(2, 'max(g.vort) as hi, min(g.vort) as lo, any_value(c.lat) as lat', 'vort')} b",
)
def box_vorticity(spark, sf_dir):
    c, f = minima_of(spark, sf_dir, ["u", "v"])
    out = grid.box_extreme(c, grid.vorticity(f, GRID), "vort", "rv850max", 2, NX, by_hemisphere=True)
    return out.select(*grid.CELL, F.round(F.col("rv850max") * 100000, 6).alias("rv850max"))


@query("box_thickness", CELLS + MINIMA + CAND + f" select * from {box(2, 'round(max(g.gh250-g.gh850),4) as thickness')} b")
def box_thickness(spark, sf_dir):
    c, f = minima_of(spark, sf_dir, ["thickness"])
    out = grid.box_extreme(c, f, "thickness", "best", 2, NX)
    return out.select(*grid.CELL, F.round("best", 4).alias("thickness"))


@query("box_wind925", CELLS + MINIMA + CAND + f" select * from {box(5, 'round(max(sqrt(g.u925*g.u925+g.v925*g.v925)),6) as vmax925')} b")
def box_wind925(spark, sf_dir):
    c, f = minima_of(spark, sf_dir, ["wind925"])
    out = grid.box_extreme(c, f, "wind925", "best", 5, NX)
    return out.select(*grid.CELL, F.round("best", 6).alias("vmax925"))


@query(
    "box_wind_roci",
    CELLS + MINIMA + f""" select c.model_name, c.init_time, c.time_step, c.x, c.y, round(max(sqrt(g.u10*g.u10+g.v10*g.v10)),6) as vmax10m from minima c
      left join (range(-3,4) dx(i) cross join range(-3,4) dy(j)) on abs(dx.i)<=(c.x+c.y)%4 and abs(dy.j)<=(c.x+c.y)%4 and (c.x+c.y)%4>0
      left join grid_cells g on {same('c', 'g')} and g.x=((c.x+dx.i)%{NX}+{NX})%{NX} and g.y=((c.y+dy.j)%{NY}+{NY})%{NY} group by 1,2,3,4,5""",
)
def box_wind_roci(spark, sf_dir):
    """Half-size from each candidate's own radius; none, no value."""
    c, f = minima_of(spark, sf_dir, ["wind10"])
    r = (F.col("x") + F.col("y")) % 4
    out = grid.box_extreme(c.withColumn("r_own", F.when(r > 0, r).cast("int")), f, "wind10", "best", "r_own", NX)
    return out.select(*grid.CELL, F.round("best", 6).alias("vmax10m"))


@query(
    "basin_assign",
    CELLS + ", " + with_views("coast_corners").removeprefix("with ") + MINIMA + f""", mb as materialized (select *, row_number() over () as id from (select {KEY}, x, y, lat, lon, {basin_case('lat', 'lon')} as basin from minima) t where basin is not null)"""
    + COAST.format(at="mb") + f" select {KEY}, x, y, basin, region from mb left join first_region using (id)",
)
def basin_assign(spark, sf_dir):
    """The fixed basin, without which a candidate goes, and the region of a layer."""
    c = grid.assign_basin(grid.local_minima(field_strips(spark, sf_dir, ["mslp"])))
    return regions.assign(c, coast(spark, sf_dir)).select(*grid.CELL, "basin", "region")


CLOSED = f""", cb as (select c.*, dx.i, dy.j, g.mslp as v from minima c, range(-5,6) dx(i), range(-5,6) dy(j), grid_cells g
    where {same('c', 'g')} and g.x=((c.x+dx.i)%{NX}+{NX})%{NX} and g.y=((c.y+dy.j)%{NY}+{NY})%{NY}),
  low as materialized (select {KEY}, x, y, i, j from cb where v-mslp-2<0),
  fl as (select {KEY}, x, y, 0::bigint as i, 0::bigint as j from minima union select l.model_name, l.init_time, l.time_step, l.x, l.y, l.i, l.j from fl f join low l
    on {same('l', 'f')} and l.x=f.x and l.y=f.y and abs(l.i-f.i)+abs(l.j-f.j)=1),
  open_ as (select distinct {KEY}, x, y from fl where abs(i)=5 or abs(j)=5)"""


@query(
    "grid_closed_isobar",
    CELLS + MINIMA + CLOSED + f" select {KEY}, x, y, mslp from minima m where not exists (select 1 from open_ o where {same('o', 'm')} and o.x=m.x and o.y=m.y)",
)
def grid_closed_isobar(spark, sf_dir):
    c, f = minima_of(spark, sf_dir, [])
    return grid.closed_isobar(c, f, GRID).select(*grid.CELL, "mslp")


@query(
    "grid_closed_isobar_touching",
    CELLS + MINIMA + CLOSED + f", near as (select distinct {KEY}, x, y from fl where abs(i)>=4 or abs(j)>=4) select {KEY}, x, y, mslp from minima m where not exists (select 1 from near o where {same('o', 'm')} and o.x=m.x and o.y=m.y)",
)
def grid_closed_isobar_touching(spark, sf_dir):
    c, f = minima_of(spark, sf_dir, [])
    return grid.closed_isobar(c, f, GRID, touching=True).select(*grid.CELL, "mslp")


def outer(r: int, cand: str) -> str:
    """CTE ``ob``: outermost whole-number isobar of the rows of ``cand``, flooded
    threshold by threshold in boxes of half-size r, and the mean of 576 rays."""
    me = f"{KEY}, x, y"
    ray = f"list_reduce(list_concat([{r}.0e0], list_transform(range(k), lambda z: {{}}(2*pi()/576*a))), lambda p, q: p+q)"
    at = "o.model_name={0}.model_name and o.init_time={0}.init_time and o.time_step={0}.time_step and o.x={0}.x and o.y={0}.y"
    end = f"({GRID.lat0}e0+({GRID.dlat}e0)*((mass_x+ex-{r}+{NX})%{NX}))"
    start = f"({GRID.lat0}e0+({GRID.dlat}e0)*mass_x)"
    return f""", wb as (select c.*, dx.i, dy.j, g.mslp as v from {cand} c, range({-r},{r + 1}) dx(i), range({-r},{r + 1}) dy(j), grid_cells g
    where {same('c', 'g')} and g.x=((c.x+dx.i)%{NX}+{NX})%{NX} and g.y=((c.y+dy.j)%{NY}+{NY})%{NY}),
  wl as materialized (select {me}, t, i, j from wb, range(1,21) th(t) where v-mslp-t<0),
  wf as (select {me}, t, 0::bigint as i, 0::bigint as j from {cand}, range(1,21) th(t) union select l.model_name, l.init_time, l.time_step, l.x, l.y, l.t, l.i, l.j
    from wf f join wl l on {same('l', 'f')} and l.x=f.x and l.y=f.y and l.t=f.t and abs(l.i-f.i)+abs(l.j-f.j)=1),
  wfm as materialized (select * from wf),
  od as (select {me}, count(*) filter (where not reached) as delta from (select {me}, t, bool_or(abs(i)>={r - 1} or abs(j)>={r - 1}) as reached from wfm group by all) q group by all),
  oc as (select {me}, (x+cast(round_even(avg(i+{r}),0) as int)-{r}+{NX})%{NX} as mass_x, (y+cast(round_even(avg(j+{r}),0) as int)-{r}+{NY})%{NY} as mass_y
    from wfm where t=1 group by 1,2,3,4,5),
  o1 as materialized (select * from od join oc using (model_name, init_time, time_step, x, y)),
  rays as materialized (select a, k, {ray.format('cos')} as px, {ray.format('sin')} as py from range(576) r1(a), range(1,{2 * r + 3}) r2(k)),
  cellray as materialized (select a, k, cast(trunc(px) as int)-{r} as i, cast(trunc(py) as int)-{r} as j, px>-1 and py>-1 as ok from rays),
  filled as materialized (select f.* from wfm f join o1 o on {at.format('f')} and f.t=o.delta),
  lit as (select o.model_name, o.init_time, o.time_step, o.x, o.y, a, k from cellray c join filled o on c.i=o.i and c.j=o.j where c.ok),
  legs as (select {me}, a, max(k) filter (where k=n) as legs from (select *, row_number() over (partition by {me}, a order by k) as n from lit) q group by all),
  ends as (select o.*, s.a, coalesce(legs,0) as legs, coalesce(c.i,0)+{r} as ex, coalesce(c.j,0)+{r} as ey from o1 o cross join range(576) s(a)
    left join legs l on {at.format('l')} and l.a=s.a left join cellray c on c.a=s.a and c.k=legs where delta>=2),
  ob as (select o.model_name, o.init_time, o.time_step, o.x, o.y, case when o.delta>=2 then cast(o.delta as int) end as closed_isobar_delta, o.mass_x, o.mass_y, e.roci, e.roci_grid_units
    from o1 o left join (select {me}, avg(2*6371008.8e0*asin(least(1.0e0, sqrt(pow(sin(radians({end}-{start})/2),2)+cos(radians({start}))*cos(radians({end}))
      *pow(sin(radians((((mass_y+ey-{r}+{NY})%{NY})-mass_y)*{GRID.dlon}e0)/2),2))))) as roci, avg(legs) as roci_grid_units from ends group by all) e on {at.format('e')})"""


CLOSED_ONLY = f", closed as materialized (select m.* from minima m where not exists (select 1 from open_ o where {same('o', 'm')} and o.x=m.x and o.y=m.y))"


def radii(spark, sf_dir):
    c, f = minima_of(spark, sf_dir, [])
    return grid.radius_of_closed_isobar(grid.closed_isobar(c, f, GRID), f, GRID, degrees=10)


@query("outermost_isobar", CELLS + MINIMA + CLOSED + CLOSED_ONLY + outer(10, "closed") + f" select {KEY}, x, y, closed_isobar_delta, mass_x, mass_y from ob")
def outermost_isobar(spark, sf_dir):
    return radii(spark, sf_dir).select(*grid.CELL, "closed_isobar_delta", "mass_x", "mass_y")


@query("roci", CELLS + MINIMA + CLOSED + CLOSED_ONLY + outer(10, "closed") + f" select {KEY}, x, y, round(roci,3) as roci, round(roci_grid_units,6) as roci_grid_units from ob")
def roci(spark, sf_dir):
    return radii(spark, sf_dir).select(*grid.CELL, F.round("roci", 3).alias("roci"), F.round("roci_grid_units", 6).alias("roci_grid_units"))


LIMITS = "(values " + ", ".join(f"('{m}','{b}',{w},{r},{t})" for m, b, w, r, t in dims.THRESHOLDS) + ") lim(model_name, basin, ws, rv, thkn)"


@query(
    "threshold_flags",
    CELLS + MINIMA + f""" select c.model_name, init_time, time_step, x, y, c.basin, a>=ws as wind_met, b*(case when lat<0 then -1 else 1 end)>=rv*0.00001e0 as vorticity_met, t>=thkn as thickness_met,
      a>=ws and b*(case when lat<0 then -1 else 1 end)>=rv*0.00001e0 and t>=thkn as all_met from
      (select *, {basin_case('lat', 'lon')} as basin, (x+y)%30+0.5e0 as a, (y-20)*0.00001e0 as b, 9450.0e0+(x*7+y)%120 as t from minima) c join {LIMITS}
      on lim.model_name=c.model_name and lim.basin=c.basin""",
)
def threshold_flags(spark, sf_dir):
    c = grid.assign_basin(grid.local_minima(field_strips(spark, sf_dir, ["mslp"])))
    c = c.withColumns(
        {"vmax925": (F.col("x") + F.col("y")) % 30 + 0.5, "rv850max": (F.col("y") - 20) * F.lit(0.00001),
         "gp250_850_thickness": F.lit(9450.0) + (F.col("x") * 7 + F.col("y")) % 120}
    )
    out = grid.threshold_flags(c, dims.thresholds(spark))
    k = F.col("criteria")
    return out.select(
        *grid.CELL, "basin", k["vmax925"].alias("wind_met"), k["rv850max"].alias("vorticity_met"),
        k["gp250_850_thickness"].alias("thickness_met"), k["all"].alias("all_met"),
    )


DETECT = (
    CELLS + MINIMA + VORT + CLOSED + CLOSED_ONLY
    + f""", cand as materialized (select * from (select *, {basin_case('lat', 'lon')} as basin from closed) t where basin is not null),
  dr as {box(2, 'case when any_value(c.lat)<0 then min(g.vort) else max(g.vort) end as rv', 'vort')},
  dt as {box(2, 'max(g.gh250-g.gh850) as thick')}, dw as {box(5, 'max(sqrt(g.u925*g.u925+g.v925*g.v925)) as wind')},
  strong as materialized (select cand.* from cand join dr using (model_name, init_time, time_step, x, y) join dt using (model_name, init_time, time_step, x, y)
    join dw using (model_name, init_time, time_step, x, y) join {LIMITS} on lim.model_name=cand.model_name and lim.basin=cand.basin
    where wind>=lim.ws and dr.rv*(case when lat<0 then -1 else 1 end)>=lim.rv*0.00001e0 and thick>=lim.thkn)"""
    + outer(15, "strong")
)


@query(
    "detect_disturbances",
    DETECT + f""" select s.model_name, s.init_time, s.time_step, s.x, s.y, s.lat, s.lon, s.basin, s.mslp, round(any_value(roci),3) as roci, any_value(closed_isobar_delta) as closed_isobar_delta,
      round(max(sqrt(g.u10*g.u10+g.v10*g.v10)),6) as vmax10m_in_roci from strong s join ob using (model_name, init_time, time_step, x, y)
      left join (range(-15,16) dx(i) cross join range(-15,16) dy(j)) on greatest(abs(dx.i),abs(dy.j))<=round_even(roci_grid_units,0)
      left join grid_cells g on g.model_name=s.model_name and g.init_time=s.init_time and g.time_step=s.time_step
        and g.x=((s.x+dx.i)%{NX}+{NX})%{NX} and g.y=((s.y+dy.j)%{NY}+{NY})%{NY} group by 1,2,3,4,5,6,7,8,9""",
)
def detect_disturbances(spark, sf_dir):
    found = grid.detect(view(spark, sf_dir, "grid_cells"), GRID, dims.thresholds(spark))
    return found.select(
        *grid.CELL, "lat", "lon", "basin", "mslp", F.round("roci", 3).alias("roci"), "closed_isobar_delta",
        F.round("vmax10m_in_roci", 6).alias("vmax10m_in_roci"),
    )
