"""Storm-shaped views derived from the star-schema tables.

Each view is plain SQL that both engines accept, so a query and its oracle
start from the same rows. ``grid_cells`` and ``nadir`` fan rows out and are
written once per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_ROWS, GRID_COLS = 24, 48

VIEWS = {
    "track_points": """
        select concat('M', cast(cast(floor(user_id/30) as bigint) as string)) as model_name,
          date_trunc('day', ts) as init_time, 6*cast(extract(hour from ts) as int) as time_step, event_id, ts,
          8.0e0+(user_id%4)*9+(event_id%20)/10.0e0 as lat, -150.0e0+(user_id%4)*80+((event_id*3)%20)/10.0e0 as lon,
          round(1010-value/10,3) as mslp, round(15+value/10,3) as vmax,
          cast(20000+(event_id%10)*5000 as int) as rmw, cast(100000+(event_id%7)*20000 as int) as roci,
          case when event_type='click' then 'Y' when event_type='view' then 'N' else 'U' end as core_flag
        from {events}""",
    "pair_points": """
        select concat('M', cast(cast(floor(user_id/60) as bigint) as string)) as model_name,
          date_trunc('day', ts) as init_time, 6*cast(extract(hour from ts) as int) as time_step, event_id,
          8.0e0+(user_id%2)*20+(event_id%20)/10.0e0 as lat,
          -150.0e0+(user_id%2)*80+((event_id*3)%5)/10.0e0+case when event_id%7=0 then 3 else (event_id%2)*6 end as lon,
          round(1010-value/10,3) as mslp, round(15+value/10,3) as vmax
        from {events}""",
    "file_arrivals": """
        select event_id, concat('M', cast(cast(floor(user_id/30) as bigint) as string)) as model_name, date_trunc('day', ts) as init_time,
          6*cast(extract(hour from ts) as int) as time_step, cast(user_id%30 as string) as member, concat('f', cast(event_id as string)) as path,
          event_id%61=0 as is_marker, cast(case when event_id%97=0 then 3 when extract(day from ts)+(event_id%5)*2<=12 then 1
            when extract(day from ts)+(event_id%5)*2<=22 then 2 else 3 end as int) as part
        from {events}""",
    "schedule": """
        select distinct model_name, init_time, cast(45+8*(n%4) as int) as expected_files, cast(22+n%3 as int) as expected_members
        from (select concat('M', cast(cast(floor(user_id/30) as bigint) as string)) as model_name, date_trunc('day', ts) as init_time,
          cast(floor(user_id/30) as int) as n from {events}) p where n%5<>4""",
    "coast_corners": """
        select cast(o_orderkey%5 as int) as rank, concat('R', cast(o_orderkey%5 as string)) as region, cast(floor(o_orderkey/5) as bigint) as corner,
          round(-130+40*(o_orderkey%5)+(16+4*sin(2*pi()*5*floor(o_orderkey/5)/n)+(o_custkey%40)/20.0e0)*cos(2*pi()*floor(o_orderkey/5)/n),6) as lon,
          round(15+(16+4*sin(2*pi()*5*floor(o_orderkey/5)/n)+(o_custkey%40)/20.0e0)*sin(2*pi()*floor(o_orderkey/5)/n),6) as lat
        from (select o_orderkey, o_custkey, count(*) over (partition by o_orderkey%5) as n from {orders}) o""",
    "storm_points": """
        select model_name, init_time, storm_no, time_step, init_time + interval '1' hour * time_step as valid_time, event_id, lat, lon, vmax, rmw, roci
        from (select *, row_number() over (partition by model_name, init_time, storm_no, time_step order by event_id) as r
          from (select concat('M', cast(cast(floor(user_id/30) as bigint) as string)) as model_name, date_trunc('day', ts) as init_time,
            cast(user_id%4 as int) as storm_no, 6*cast(extract(hour from ts) as int) as time_step, event_id,
            8.0e0+(user_id%4)*9+(event_id%20)/10.0e0 as lat, -150.0e0+(user_id%4)*80+((event_id*3)%20)/10.0e0 as lon,
            round(15+value/10,3) as vmax, cast(20000+(event_id%10)*5000 as int) as rmw,
            case when event_id%6<>0 then cast(100000+(event_id%7)*20000 as int) end as roci
            from {events}) p) t where r=1""",
    "tracker_rows": """
        select event_id, concat('M', cast(cast(floor(user_id/30) as bigint) as string)) as member,
          date_trunc('day', ts) as init_time, 6*cast(extract(hour from ts) as int) as time_step,
          concat(case when event_id%100<10 then '0' else '' end, cast(event_id%100 as string),
            case event_id%6 when 0 then 'L' when 1 then 'W' when 2 then 'E' when 3 then 'Z' when 4 then 'B' else '' end) as code,
          cast(80+(user_id%4)*90+event_id%20 as int) as lat10, case when event_id%9=0 then 'S' else 'N' end as ns,
          cast((event_id*37)%1800 as int) as lon10, case when event_id%2=0 then 'W' else 'E' end as ew,
          cast(20+event_id%120 as int) as vmax_kt, cast(1010-floor(value/10) as int) as mslp,
          case event_id%4 when 0 then 50 when 1 then 64 else 34 end as threshold,
          cast(event_id%90 as int) as ne, cast(event_id%80 as int) as se, cast(event_id%70 as int) as sw, cast(event_id%60 as int) as nw,
          case when event_id%3=0 then -999 else cast(1010-floor(value/10)+event_id%7 as int) end as pouter,
          case when event_id%5=0 then -999 else cast(50+event_id%200 as int) end as router,
          case when event_id%11=0 then -999 else cast(10+event_id%60 as int) end as rmw_nmi,
          case when event_id%13=0 then -999 else cast((event_id*7)%300 as int) end as b10,
          case when event_id%17=0 then -9999 else cast((event_id*11)%400-150 as int) end as vtl10,
          case when event_id%19=0 then -9999 else cast((event_id*13)%400-200 as int) end as vtu10,
          case when event_type='click' then 'Y' when event_type='view' then 'N' else 'U' end as core_flag,
          cast((event_id*3)%360 as int) as moving_dir, cast(event_id%150 as int) as speed10, cast(event_id%500 as int) as vort
        from {events}""",
    "advisories": """
        select concat('S', cast(cast(floor(o_orderkey/300) as bigint) as string)) as storm_id,
          timestamp '2024-01-01 03:00:00' + interval '6' hour * cast(o_orderkey%60 as int) as advisory_time,
          round(min(10+(o_orderkey%300)/10.0e0),1) as lat, round(min(-90+(o_orderkey%500)/10.0e0),1) as lon,
          avg(20+o_totalprice/5000)*0.539956803e0 as vmax_kt, 1010-50*abs(sin(avg(o_totalprice)/50000)) as mslp_hpa,
          180+180*sin(avg(o_custkey)/700) as heading, avg(o_custkey%30)*0.539956803e0 as speed_kt
        from {orders} group by 1,2""",
    "deck_points": """
        select concat('S', cast(cast(floor(l_orderkey/300) as bigint) as string)) as storm_id,
          concat('H', cast(l_suppkey%4 as string)) as model_id,
          timestamp '2024-01-01 00:00:00' + interval '12' hour * cast(l_partkey%20 as int) as init_time,
          cast(3*((l_partkey*7+l_suppkey)%40) as int) as tau,
          timestamp '2024-01-01 00:00:00' + interval '12' hour * cast(l_partkey%20 as int)
            + interval '3' hour * cast((l_partkey*7+l_suppkey)%40 as int) as valid_time,
          cast(20+2*l_quantity as int) as vmax, cast(1010-l_quantity as int) as mslp,
          10+(l_orderkey%300)/10.0e0 as lat, -90+(l_orderkey%500)/10.0e0 as lon,
          cast((l_partkey*7)%360 as int) as dir, cast(l_suppkey%30 as int) as speed,
          cast(l_extendedprice*100 as bigint) as line_no
        from {lineitem}""",
    "wind_cells": """
        select l_orderkey as cell_id, l_linenumber as rank_no, round(l_quantity*0.7e0,2) as speed,
          cast((l_partkey*37)%16777216 as int) as qc,
          -30+(l_partkey%600)/10.0e0 as lat, cast((l_suppkey*7+l_orderkey)%360 as double) as lon360,
          -l_discount*10 as log10_likelihood, l_shipdate as obs_time,
          cast(l_extendedprice*100 as bigint) as sample_no
        from {lineitem}""",
    "mw_samples": """
        select l_orderkey as scan, l_linenumber as pixel, round(min(10+(l_partkey%200)/10.0e0),1) as lat,
          round(min(-80+(l_suppkey%100)/10.0e0),1) as lon, round(max(200+l_quantity*2),2) as tb_v,
          round(max(180+l_quantity*2+l_discount*100),2) as tb_h, min(l_linenumber) as pdq
        from {lineitem} group by 1,2""",
    "runs_completed": """
        select model_name, init_time as init_date, init_time + interval '5' hour as completed_date
        from (select distinct concat('M', cast(cast(floor(user_id/30) as bigint) as string)) as model_name,
          date_trunc('day', ts) as init_time, cast(floor(user_id/30) as int) as n from {events}) p
        where (extract(day from init_time)+n)%7<>0""",
    "tc_candidates": """
        select model_name, init_date, component_id, start_time_step, start_valid_date, start_lat, start_lon, ws_max_10m, n_points,
          case when start_lon between -100 and 0 then 'AL' when start_lon between -180 and -100 then 'EP'
            when start_lon between 100 and 180 then 'WP' when start_lon between 30 and 100 then 'IO' end as start_basin
        from (select concat('M', cast(cast(floor(user_id/30) as bigint) as string)) as model_name,
          date_trunc('day', ts) as init_date, cast(user_id%4 as int) as component_id,
          min(6*cast(extract(hour from ts) as int)) as start_time_step,
          date_trunc('day', min(ts)) + interval '6' hour * min(cast(extract(hour from ts) as int)) as start_valid_date,
          min_by(8.0e0+(user_id%4)*9+(event_id%20)/10.0e0, ts) as start_lat,
          min_by(-150.0e0+(user_id%4)*80+((event_id*3)%20)/10.0e0, ts) as start_lon,
          max(round(15+value/10,3)) as ws_max_10m, count(*) as n_points
        from {events} group by 1,2,3) t""",
    "ens_status": """
        select ensemble_name, init_date, n as num_files_processed,
          case when extract(day from init_date)%5=0 then -1 else expected end as expected_num_files_processed,
          extract(day from init_date)%5<>0 and n=expected as completed
        from (select concat('E', cast(cast(floor(floor(user_id/30)/3) as bigint) as string)) as ensemble_name,
          date_trunc('day', ts) as init_date,
          count(distinct case when (extract(day from ts)+cast(floor(user_id/30) as int))%7<>0 or extract(day from ts)%3=0
            then floor(user_id/30) end) as n
          from {events} group by 1,2) s
        join (select concat('E', cast(cast(floor(floor(user_id/30)/3) as bigint) as string)) as ensemble_name,
          count(distinct floor(user_id/30)) as expected from {events} group by 1) e using (ensemble_name)""",
    "members": """
        select distinct concat('M', cast(cast(floor(user_id/30) as bigint) as string)) as model_name,
          concat('E', cast(cast(floor(floor(user_id/30)/3) as bigint) as string)) as ensemble_name from {events} where floor(user_id/30)%4<>3""",
    "all_members": """
        select distinct concat('M', cast(cast(floor(user_id/30) as bigint) as string)) as model_name,
          concat('E', cast(cast(floor(floor(user_id/30)/3) as bigint) as string)) as ensemble_name from {events}""",
}

# fixed values: model of a grid run, by run number modulo five
GRID_MODELS = ["GFS", "ECM", "CMC", "NAV", "UKM"]

GRID_AGG = {
    "mslp": "avg(l_extendedprice)/60000-0.87e0",
    "u": "avg(l_quantity)/5-5",
    "v": "avg(l_discount)*100-5",
    "gh250": "avg(l_tax)*1000",
    "gh850": "avg(l_discount)*500",
}
GRID_FIELDS = {
    "mslp": "round(1006+6*cos(2*pi()*(x+run_no)/12)*cos(2*pi()*(y+time_step/3)/16)+coalesce(d_mslp,0),3)",
    "u": "round(-18*sin(2*pi()*(x+run_no)/12)+coalesce(d_u,0),3)",
    "v": "round(18*sin(2*pi()*(y+time_step/3)/16)+coalesce(d_v,0),3)",
    "gh250": "round(10940+coalesce(d_gh250,0),3)",
    "gh850": "round(1390+coalesce(d_gh850,0),3)",
    "u925": "round(-20*sin(2*pi()*(x+run_no+1)/12)+coalesce(d_u,0),3)",
    "v925": "round(21*sin(2*pi()*(y+2+time_step/3)/16)+coalesce(d_v,0),3)",
    "u10": "round(-12*sin(2*pi()*(x+run_no+2)/12)+coalesce(d_v,0),3)",
    "v10": "round(13*sin(2*pi()*(y+1+time_step/3)/16)+coalesce(d_u,0),3)",
}
GRID_HEAD = {
    "model_name": "case run_no%5 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(GRID_MODELS)) + " end",
    "init_time": "timestamp '2024-01-01 00:00:00' + interval '12' hour * run_no",
    "time_step": "time_step",
    "x": "x",
    "y": "y",
    "lat": "11.5e0-x",
    "lon": "cast((280+60*(run_no%5)+y)%360 as double)-180.0e0",
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "grid_cells":
        return grid_cells(spark, sf_dir)
    if name == "nadir":
        return nadir(spark, sf_dir)
    if name == "coast_corners":
        return coast_corners(spark, sf_dir)
    text = VIEWS[name]
    used = [t for t in ("events", "orders", "lineitem") if "{" + t + "}" in text]
    return spark.sql(text, **tables(spark, sf_dir, *used))


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full grids, one per (run, step). Skeleton cells and measured cells meet
    in one aggregation, so filling the gaps costs no join."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "cast(floor(l_orderkey/1500) as int) as run_no", "6*(l_linenumber-1) as time_step",
        f"cast(l_partkey%{GRID_ROWS} as int) as x", f"cast((l_partkey+l_orderkey)%{GRID_COLS} as int) as y",
        "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    )
    gaps = (
        lines.select("run_no", "time_step").distinct()
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(GRID_ROWS - 1))))
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(GRID_COLS - 1))))
    )
    sums = [F.expr(e).alias(f"d_{n}") for n, e in GRID_AGG.items()]
    cells = lines.unionByName(gaps, allowMissingColumns=True).groupBy("run_no", "time_step", "x", "y").agg(*sums)
    return cells.selectExpr(*[f"{e} as {n}" for n, e in (GRID_HEAD | GRID_FIELDS).items()])


NADIR = {
    "satellite": "concat('SAT', cast(k as string))",
    "minute_id": "o_orderkey",
    "valid_time": "timestamp '2024-01-01 00:00:00' + interval '1' minute * cast(o_orderkey as int)",
    "lat": "round(65*sin(2*pi()*(o_orderkey+37*k)/101),6)",
    "lon": "round((((o_orderkey*13+k*90)*0.27e0)%360)-180,6)",
}


def nadir(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return orders.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr(
        *[f"{e} as {n}" for n, e in NADIR.items()]
    )


def coast_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of five rings. Their numbers are counted before, so no ring is one task."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").withColumn("ring", F.expr("o_orderkey%5"))
    sizes = orders.groupBy("ring").agg(F.count(F.lit(1)).alias("n"))  # nine rows at most
    head, _, _ = VIEWS["coast_corners"].partition("from (select")
    return spark.sql(f"{head} from {{counted}}", counted=orders.join(F.broadcast(sizes), "ring", "left"))


def oracle_view(name: str) -> str:
    """The same view as a SELECT over the registered tables."""
    if name == "grid_cells":
        head = ", ".join(f"{e} as {n}" for n, e in (GRID_HEAD | GRID_FIELDS).items())
        agg = ", ".join(f"{e} as d_{n}" for n, e in GRID_AGG.items())
        lines = (
            "select cast(floor(l_orderkey/1500) as int) as run_no, 6*(l_linenumber-1) as time_step, "
            f"cast(l_partkey%{GRID_ROWS} as int) as x, cast((l_partkey+l_orderkey)%{GRID_COLS} as int) as y, "
            "l_extendedprice, l_quantity, l_discount, l_tax from lineitem"
        )
        return (
            f"select {head} from (select distinct run_no, time_step from ({lines})) s "
            f"cross join (select cast(range as int) as x from range({GRID_ROWS})) gx "
            f"cross join (select cast(range as int) as y from range({GRID_COLS})) gy "
            f"left join (select run_no, time_step, x, y, {agg} from ({lines}) group by 1,2,3,4) g "
            "using (run_no, time_step, x, y)"
        )
    if name == "nadir":
        head = ", ".join(f"{e} as {n}" for n, e in NADIR.items())
        return f"select {head} from orders cross join (select range as k from range(2)) k"
    return VIEWS[name].format(events="events", orders="orders", lineitem="lineitem")


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause for an oracle; further CTEs may follow after a comma."""
    body = ",\n".join(f"{n} as materialized ({oracle_view(n)})" for n in names)
    return f"with {'recursive ' if recursive else ''}{body}"
