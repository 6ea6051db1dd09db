"""Sources: text, documents, dimensions and decoded tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from galespark.functions import text as text_fn
from galespark.operators import catalog, ensemble, microwave, winds
from galespark.plans.base import basin_case, hav, registry
from galespark.session import scratch_path
from galespark.sources import advisory, deck, dims, files, grid, tracker
from galespark.sources.adapters import oracle_view, tables, view, with_views

QUERIES, ORACLE, query = registry()


# ---------------------------------------------------------------- tracker text


def tracker_lines(spark, sf_dir):
    r = view(spark, sf_dir, "tracker_rows")
    pad = F.lpad(F.col("time_step").cast("string"), 3, "0")
    return r.select(
        F.concat_ws(
            ", ",
            F.lit("TG"), "code",
            F.concat_ws("_", F.date_format("init_time", "yyyyMMddHH"), F.concat(F.lit("F"), pad), F.col("event_id").cast("string")),
            F.date_format("init_time", "yyyyMMddHH"), F.lit("03"), "member", pad,
            F.concat("lat10", "ns"), F.concat("lon10", "ew"),
            *[F.col(c).cast("string") for c in ("vmax_kt", "mslp")],
            F.lit("XX"), F.col("threshold").cast("string"), F.lit("NEQ"),
            *[F.col(c).cast("string") for c in ("ne", "se", "sw", "nw", "pouter", "router", "rmw_nmi", "b10", "vtl10", "vtu10")],
            "core_flag", *[F.col(c).cast("string") for c in ("moving_dir", "speed10", "vort", "vort", "vort", "vort")],
            *[F.lit("0")] * 8,
        ).alias("value")
    )


def parsed(spark, sf_dir):
    # through real text files, so the reader and its width check run too
    path = scratch_path(spark)
    tracker_lines(spark, sf_dir).write.text(path)
    rows = tracker.read_tracker(spark, path)
    return rows.withColumn("event_id", F.element_at(F.split("cyclogenesis_id", "_"), -1).cast("long"))


LAT = "(case when ns='N' then lat10/10.0e0 else -(lat10/10.0e0) end)"
LON = "(case when ew='E' then lon10/10.0e0 else -(lon10/10.0e0) end)"


@query(
    "src_tracker_text",
    with_views("tracker_rows")
    + f""" select event_id, member, init_time, time_step as forecast_hour, {LAT} as lat, {LON} as lon, mslp as min_mslp,
      threshold as threshold_wind, core_flag as warm_core_flag, {basin_case(LAT, LON)} as basin,
      init_time + interval '1' hour * time_step as valid_time from tracker_rows""",
)
def src_tracker_text(spark, sf_dir):
    return parsed(spark, sf_dir).select(
        "event_id", "member", "init_time", "forecast_hour", "lat", "lon", "min_mslp", "threshold_wind",
        "warm_core_flag", "basin", "valid_time",
    )


@query("latlon_parse", with_views("tracker_rows") + f" select event_id, {LAT} as lat, {LON} as lon from tracker_rows")
def latlon_parse(spark, sf_dir):
    return parsed(spark, sf_dir).select("event_id", "lat", "lon")


@query(
    "unit_convert",
    with_views("tracker_rows")
    + """ select event_id, round(vmax_kt*0.514444e0,4) as max_10m_wind, round(ne*1852.0e0,1) as ne_radius, round(nw*1852.0e0,1) as nw_radius,
      cast(nullif(pouter,-999) as double) as pressure_last_closed, round(nullif(router,-999)*1852.0e0,1) as radius_last_closed,
      round(nullif(rmw_nmi,-999)*1852.0e0,1) as rmw, round(nullif(b10,-999)/10.0e0,2) as cps_b, round(nullif(vtl10,-9999)/10.0e0,2) as cps_vtl,
      round(nullif(vtu10,-9999)/10.0e0,2) as cps_vtu, round(speed10/10.0e0,2) as storm_speed, round(vort/1.0e6,8) as max_vort850 from tracker_rows""",
)
def unit_convert(spark, sf_dir):
    return parsed(spark, sf_dir).select(
        "event_id", F.round("max_10m_wind", 4).alias("max_10m_wind"), F.round("ne_radius", 1).alias("ne_radius"),
        F.round("nw_radius", 1).alias("nw_radius"), "pressure_last_closed",
        F.round("radius_last_closed", 1).alias("radius_last_closed"), F.round("rmw", 1).alias("rmw"),
        *[F.round(c, 2).alias(c) for c in ("cps_b", "cps_vtl", "cps_vtu", "storm_speed")],
        F.round("max_vort850", 8).alias("max_vort850"),
    )


LETTERS = "case right(code,1) " + " ".join(f"when '{k}' then '{v}'" for k, v in dims.BASIN_OF_LETTER.items()) + " end"


@query(
    "storm_id",
    with_views("tracker_rows")
    + f""" select event_id, case when b is not null then concat(b, left(code,2), cast(year(init_time) as string)) end as atcf_id,
      coalesce(b is not null and cast(left(code,2) as int)<70, false) as named,
      coalesce(b is not null and cast(left(code,2) as int)>=90, false) as invest
      from (select *, {LETTERS} as b from tracker_rows) t""",
)
def storm_id(spark, sf_dir):
    return parsed(spark, sf_dir).select("event_id", "atcf_id", "named", "invest")


@query(
    "cps_class",
    with_views("tracker_rows")
    + """ select event_id, b10<>-999 and b10<100 and vtl10<>-9999 and vtl10>0 and vtu10<>-9999 and vtu10>0 as tropical,
      b10<>-999 and b10<100 and vtl10<>-9999 and vtl10>0 and vtu10<>-9999 and vtu10<=0 as subtropical from tracker_rows""",
)
def cps_class(spark, sf_dir):
    flags = tracker.phase_class(F.col("cps_b"), F.col("cps_vtl"), F.col("cps_vtu"))
    return parsed(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in flags.items()])


@query(
    "warm_core",
    with_views("tracker_rows")
    + " select event_id, case core_flag when 'Y' then 'True' when 'N' then 'False' else 'Unknown' end as warm_core from tracker_rows",
)
def warm_core(spark, sf_dir):
    flag = tracker.warm_core(F.col("warm_core_flag"))
    label = F.when(flag, "True").when(~flag, "False").otherwise("Unknown")
    return parsed(spark, sf_dir).select("event_id", label.alias("warm_core"))


@query(
    "closed_isobar_prune",
    with_views("tracker_rows")
    + """ select event_id, case when pouter>100 then cast(pouter-mslp as double) end as closed_isobar_delta
      from tracker_rows where not (pouter>100 and pouter-mslp<2)""",
)
def closed_isobar_prune(spark, sf_dir):
    return tracker.prune_open(parsed(spark, sf_dir)).select("event_id", "closed_isobar_delta")


@query(
    "valid_time",
    with_views("track_points")
    + " select event_id, init_time + interval '1' hour * time_step as valid_time from track_points",
)
def valid_time(spark, sf_dir):
    p = view(spark, sf_dir, "track_points")
    return p.select("event_id", tracker.valid_time(F.col("init_time"), F.col("time_step")).alias("valid_time"))


# ---------------------------------------------------------------- decks

DECK_SQL = """, lines as (select *, dir%17=0 as short, case when dir%5=0 then '02' else '03' end as technum,
  case when dir%3=0 then 0 else vmax end as v, case when dir%7=0 then 0 else mslp+speed end as pouter, speed*9 as router,
  case when dir%11=0 then null else speed end as rmw_n from deck_points)"""


def deck_lines(spark, sf_dir):
    d = view(spark, sf_dir, "deck_points")
    tenths = lambda c, plus, minus: F.concat(
        F.round(F.abs(F.col(c)) * 10).cast("int").cast("string"), F.when(F.col(c) < 0, minus).otherwise(plus)
    )
    number = F.substring("storm_id", 2, 10)
    init = F.date_format("init_time", "yyyyMMddHH")
    full = F.concat_ws(
        ", ",
        F.lit("AL"), number, init, F.when(F.col("dir") % 5 == 0, "02").otherwise("03"), "model_id",
        F.lpad(F.col("tau").cast("string"), 3, "0"), tenths("lat", "N", "S"), tenths("lon", "E", "W"),
        F.when(F.col("dir") % 3 == 0, 0).otherwise(F.col("vmax")).cast("string"), F.col("mslp").cast("string"),
        F.lit("XX"), F.lit("34"), F.lit("NEQ"), *[F.lit("0")] * 4,
        F.when(F.col("dir") % 7 == 0, 0).otherwise(F.col("mslp") + F.col("speed")).cast("string"),
        (F.col("speed") * 9).cast("string"),
        F.when(F.col("dir") % 11 == 0, "x").otherwise(F.col("speed").cast("string")),
        F.lit("0"), F.lit("0"), F.lit(""), F.lit("0"), F.lit(""), F.col("dir").cast("string"), F.col("speed").cast("string"),
    )
    lines = d.select(F.when(F.col("dir") % 17 == 0, F.concat_ws(", ", F.lit("AL"), number, init)).otherwise(full).alias("value"))
    # real text files, as decks come
    path = scratch_path(spark)
    lines.write.text(path)
    return spark.read.text(path)


@query(
    "src_adeck_lines",
    with_views("deck_points") + DECK_SQL
    + " select concat('AL', substring(storm_id,2), '2024') as atcf_id, model_id as tech, count(*) as n_lines from lines where not short and technum='03' group by 1,2",
)
def src_adeck_lines(spark, sf_dir):
    rows = deck.decode(deck.forecast_lines(deck_lines(spark, sf_dir)))
    return rows.groupBy(deck.storm_of_deck().alias("atcf_id"), "tech").agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "deck_decode",
    with_views("deck_points") + DECK_SQL
    + " select model_id as tech, tau, lat, lon, v as vmax, mslp, pouter, router, rmw_n as rmw, speed, technum from lines where not short",
)
def deck_decode(spark, sf_dir):
    return deck.decode(deck_lines(spark, sf_dir)).select(
        "tech", "tau", "lat", "lon", "vmax", "mslp", "pouter", "router", "rmw", "speed", "technum"
    )


@query(
    "deck_derive",
    with_views("deck_points") + DECK_SQL
    + """ select concat('AL', substring(storm_id,2), '2024') as atcf_id, model_id as tech, init_time, valid_time, router*1852.0e0 as roci, rmw_n*1852.0e0 as rmw,
      nullif(v,0) as vmax10m, mslp as mslp_value, case when pouter>0 then pouter-mslp end as closed_isobar_delta
      from lines where not short and technum='03'""",
)
def deck_derive(spark, sf_dir):
    return deck.derive(deck.decode(deck.forecast_lines(deck_lines(spark, sf_dir)))).select(
        "atcf_id", "tech", "init_time", "valid_time", "roci", "rmw", "vmax10m", "mslp_value", "closed_isobar_delta"
    )


# ---------------------------------------------------------------- bulletins


def bulletins(spark, sf_dir):
    """Bulletin pages written from the advisories, zone by storm number."""
    a = view(spark, sf_dir, "advisories").withColumn("n", F.substring("storm_id", 2, 10).cast("int"))
    zones = ["CST", "EST", "MST", "PST", "AST", "CVT"]
    pick = F.element_at(F.array(*[F.lit(z) for z in zones]), (F.col("n") % len(zones) + 1).cast("int"))
    name = dims.literal_map(advisory.ZONES)
    a = a.withColumn("zone", pick).withColumn("local", F.from_utc_timestamp("advisory_time", name[F.col("zone")]))
    hhmm, half = F.date_format("local", "hmm"), F.date_format("local", "a")
    fmt = F.format_string(
        "<html><body><pre>old</pre><pre>\n%s %s %s Number  %d\nNWS National Hurricane Center Miami FL       AL%s2024\n"
        "%s %s %s %s\n\nSUMMARY OF %s %s %s...INFORMATION\n-----\nLOCATION...%.1f%s %.1f%s\n"
        "MAXIMUM SUSTAINED WINDS...%d MPH...%d KM/H\nPRESENT MOVEMENT...NNE OR %d DEGREES AT %d MPH...%d KM/H\n"
        "MINIMUM CENTRAL PRESSURE...%d MB...29.77 INCHES\n\nLOCATION...99.9N 99.9W\n</pre></body></html>",
        F.when(F.col("n") % 2 == 0, "Tropical Storm").otherwise("Hurricane"),
        F.concat(F.lit("Storm"), F.col("n").cast("string")),
        F.when(F.col("n") % 3 == 0, "Intermediate Advisory").otherwise("Advisory"),
        F.col("n") + 1, F.col("n").cast("string"), hhmm, half, F.col("zone"), F.date_format("local", "EEE MMM dd yyyy"),
        hhmm, half, F.col("zone"),
        F.abs("lat"), F.when(F.col("lat") < 0, "S").otherwise("N"), F.abs("lon"), F.when(F.col("lon") < 0, "W").otherwise("E"),
        F.col("vmax_kt").cast("int"), F.round(F.col("vmax_kt") * 2).cast("int"),
        F.col("heading").cast("int"), F.col("speed_kt").cast("int"), F.round(F.col("speed_kt") * 2).cast("int"),
        F.col("mslp_hpa").cast("int"),
    )
    return a.select(fmt.alias("value"))


@query(
    "advisory_parse",
    with_views("advisories")
    + """ select concat('AL', substring(storm_id,2), '2024') as atcf_id, concat('Storm', substring(storm_id,2)) as storm_name,
      case when cast(substring(storm_id,2) as int)%2=0 then 'Storm' else 'Hurricane' end as init_storm_type, advisory_time, true as advisory, lat, lon,
      round(round(vmax_kt*2)*0.539956803e0,6) as vmax_kt, floor(mslp_hpa) as mslp_hpa, 'NNE' as storm_direction, floor(heading) as heading,
      round(round(speed_kt*2)*0.539956803e0,6) as speed_kt from advisories""",
)
def advisory_parse(spark, sf_dir):
    rows = advisory.parse_advisories(bulletins(spark, sf_dir))
    return rows.withColumns({"vmax_kt": F.round("vmax_kt", 6), "speed_kt": F.round("speed_kt", 6)})


@query(
    "local_to_utc",
    with_views("advisories")
    + """ select storm_id, advisory_time as local_time, advisory_time + interval '1' hour *
      (case cast(substring(storm_id,2) as int)%4 when 0 then 6 when 1 then 5 when 2 then 4 else 1 end) as utc_time from advisories""",
)
def local_to_utc(spark, sf_dir):
    a = view(spark, sf_dir, "advisories")
    zone = F.element_at(
        F.array(*[F.lit(z) for z in ("CST", "EST", "AST", "CVT")]), (F.substring("storm_id", 2, 10).cast("int") % 4 + 1).cast("int")
    )
    utc = advisory.local_to_utc(
        F.date_format("advisory_time", "hmm"), F.date_format("advisory_time", "a"), zone, F.date_format("advisory_time", "yyyy-MMM-d")
    )
    return a.select("storm_id", F.col("advisory_time").alias("local_time"), utc.alias("utc_time"))


# ---------------------------------------------------------------- stored documents


@query(
    "disturbances_for_run",
    with_views("track_points")
    + """ select time_step, lat, lon, mslp as mslp_value, vmax as vmax10m_in_roci from track_points
      where model_name='M1' and init_time=timestamp '2024-01-10 00:00:00'""",
)
def disturbances_for_run(spark, sf_dir):
    store = catalog.disturbance_store(view(spark, sf_dir, "track_points"))
    return catalog.disturbances_of_run(store, "M1", "2024-01-10 00:00:00").select(
        "time_step", "lat", "lon", "mslp_value", "vmax10m_in_roci"
    )


@query(
    "disturbances_complete",
    with_views("track_points")
    + """ , full_runs as (select model_name, init_time from track_points group by 1,2 having count(distinct time_step)=24)
      select model_name, init_time as init_date, time_step, count(*) as candidates from track_points join full_runs using (model_name, init_time) group by 1,2,3""",
)
def disturbances_complete(spark, sf_dir):
    p = view(spark, sf_dir, "track_points")
    rows = catalog.complete_disturbances(catalog.disturbance_store(p), catalog.step_completeness(p, 24))
    return rows.groupBy("model_name", "init_date", "time_step").agg(F.count(F.lit(1)).alias("candidates"))


# ---------------------------------------------------------------- dimensions


@query(
    "dim_thresholds",
    """select concat('M', cast(l_linenumber as string)) as model_name, l_returnflag as basin, criterion, threshold from
      (select l_linenumber, l_returnflag, round(avg(l_quantity),4) as WS, round(avg(l_discount)*100,4) as RV, round(avg(l_extendedprice),4) as THKN
       from lineitem group by 1,2) t unpivot (threshold for criterion in (WS, RV, THKN))""",
)
def dim_thresholds(spark, sf_dir):
    # a model holds at most a handful of basins, so its document is bounded
    lines = tables(spark, sf_dir, "lineitem")["lineitem"]
    means = lines.groupBy("l_linenumber", "l_returnflag").agg(
        F.round(F.avg("l_quantity"), 4).alias("WS"), F.round(F.avg(F.col("l_discount")) * 100, 4).alias("RV"),
        F.round(F.avg("l_extendedprice"), 4).alias("THKN"),
    )
    docs = means.groupBy("l_linenumber").agg(
        F.to_json(
            F.create_map(
                F.concat(F.lit("M"), F.first(F.col("l_linenumber").cast("string"))),
                F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.struct("WS", "RV", "THKN")))),
            )
        ).alias("value")
    )
    return dims.thresholds_from_json(docs)


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


@query(
    "dim_theta",
    """select cast(l_partkey%23*5-55 as double) as lat, cast(month(l_shipdate) as int) as month, round(avg(l_discount)*10,6) as theta
      from lineitem group by 1,2""",
)
def dim_theta(spark, sf_dir):
    lines = tables(spark, sf_dir, "lineitem")["lineitem"]
    wide = (
        lines.select((F.col("l_partkey") % 23 * 5 - 55).cast("double").alias("lat"), F.month("l_shipdate").alias("m"), "l_discount")
        .groupBy("lat")
        .pivot("m", list(range(1, 13)))
        .agg(F.round(F.avg("l_discount") * 10, 6))
        .toDF("lat", *MONTHS)
    )
    return dims.unpivot_months(wide).filter(F.col("theta").isNotNull())


@query(
    "dim_category_mslp",
    """select o_orderstatus as basin, o_orderpriority as category, cast(1000+o_custkey%20 as double) as mslp, cast(count(*) as double) as percent
      from orders group by 1,2,3""",
)
def dim_category_mslp(spark, sf_dir):
    # twenty pressures per category at most: the collected lists are bounded
    o = tables(spark, sf_dir, "orders")["orders"]
    counts = o.groupBy("o_orderstatus", "o_orderpriority", (1000 + F.col("o_custkey") % 20).cast("double").alias("p")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    pairs = counts.groupBy("o_orderstatus", "o_orderpriority").agg(F.collect_list(F.array("p", "n")).alias("pairs"))
    docs = pairs.groupBy("o_orderstatus").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "pairs"))).alias("m"))
    return dims.categories_from_json(docs.select(F.to_json(F.create_map("o_orderstatus", "m")).alias("value")))


# ---------------------------------------------------------------- decoded tables


def long_grid(spark, sf_dir):
    """Decoded rows with units as found in files; one step of one model lacks a row of cells."""
    g = view(spark, sf_dir, "grid_cells")
    rows = F.array(
        *[
            F.struct(F.lit(p).alias("param"), F.lit(lv).alias("level"), F.lit(u).alias("unit"), (F.col(c) * k).alias("value"))
            for p, lv, u, c, k in (
                ("prmsl", 0, "Pa", "mslp", 100.0), ("u", 850, "m/s", "u", 1.0), ("v", 850, "knots", "v", 2.0),
                ("gh", 250, "gpm", "gh250", 1.0), ("gh", 850, "gpm", "gh850", 1.0), ("t", 850, "K", "u", 1.0),
                ("u", 925, "m/s", "u925", 1.0), ("v", 925, "knots", "v925", 2.0), ("u", 10, "m/s", "u10", 1.0), ("v", 10, "m/s", "v10", 1.0),
            )
        ]
    )
    long = g.select(*grid.RUN, "x", "y", F.explode(rows).alias("r")).select(*grid.RUN, "x", "y", "r.*")
    gap = (F.col("model_name") == "ECM") & (F.col("time_step") == 12) & (F.col("x") == 0) & (F.col("param") == "v") & (F.col("level") == 850)
    return long.filter(~gap)


@query(
    "grid_select_fields",
    with_views("grid_cells")
    + """ select model_name, init_time, time_step, x, y, round(mslp,3) as mslp, u, round(v*2*0.514444e0,5) as v, gh250, gh850,
      u925, round(v925*2*0.514444e0,5) as v925, u10, v10
      from grid_cells where not (model_name='ECM' and time_step=12)""",
)
def grid_select_fields(spark, sf_dir):
    g = grid.select_fields(long_grid(spark, sf_dir))
    return g.withColumns({"mslp": F.round("mslp", 3), "v": F.round("v", 5), "v925": F.round("v925", 5)}).drop("vort850")


EPS_VIEW = """, raw as (select *, case event_id%6 when 0 then 0 when 1 then 1 else 4 end as ftype, cast(event_id%50+1 as int) as num,
   case when event_id%13=0 then null else case when event_id%29=0 then -70.0e0 else lat end end as clat, case when event_id%13=0 then null else lon end as clon,
   case when event_id%17=0 then null else lat+0.3e0 end as wlat, lon+0.4e0 as wlon, case when event_id%19=0 then null else mslp end as p from track_points)"""


def eps_rows(spark, sf_dir):
    p = view(spark, sf_dir, "track_points")
    missing = F.lit(-1e100)
    gone = F.col("event_id") % 13 == 0
    return p.select(
        "event_id", "init_time", "model_name", F.col("time_step").alias("period"),
        F.when(F.col("event_id") % 6 == 0, 0).when(F.col("event_id") % 6 == 1, 1).otherwise(4).alias("forecast_type"),
        (F.col("event_id") % 50 + 1).cast("int").alias("member_no"),
        F.when(gone, missing).when(F.col("event_id") % 29 == 0, -70.0).otherwise(F.col("lat")).alias("lat"),
        F.when(gone, missing).otherwise(F.col("lon")).alias("lon"),
        F.when(F.col("event_id") % 17 == 0, missing).otherwise(F.col("lat") + 0.3).alias("lat_max_wind"),
        (F.col("lon") + 0.4).alias("lon_max_wind"),
        F.when(F.col("event_id") % 19 == 0, missing).otherwise(F.col("mslp") * 100).alias("pressure_pa"),
        F.lit("WP").alias("start_basin"),
    )


EPS_MEMBER = "case ftype when 4 then concat('EE', case when num<10 then '0' else '' end, cast(num as string)) when 1 then 'ECME' else 'ECHR' end"


@query(
    "eps_clean_points",
    with_views("track_points") + EPS_VIEW
    + f""" select event_id, {EPS_MEMBER} as member, round(clat,4) as lat, round(clon,4) as lon, round(p,3) as mslp,
      coalesce(round({hav('clat', 'clon', 'wlat', 'wlon')},0),0) as rmw from raw""",
)
def eps_clean_points(spark, sf_dir):
    return ensemble.clean_points(eps_rows(spark, sf_dir)).select(
        "event_id", "member", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("mslp", 3).alias("mslp"), "rmw"
    )


@query(
    "basin_carry",
    with_views("track_points") + EPS_VIEW
    + f""" select event_id, coalesce(last_value(b ignore nulls) over (partition by model_name, init_time, {EPS_MEMBER} order by time_step, event_id
      rows between unbounded preceding and current row), 'WP') as basin from (select *, {basin_case('clat', 'clon')} as b from raw) t""",
)
def basin_carry(spark, sf_dir):
    rows = ensemble.clean_points(eps_rows(spark, sf_dir))
    return ensemble.carry_basin(rows, ["model_name", "init_time", "member"], ["period", "event_id"]).select("event_id", "basin")


@query(
    "scalar_broadcast",
    with_views("track_points")
    + """ select event_id, i as member_no, case when event_id%3=0 then mslp else mslp+i end as value
      from track_points, (select range as i from range(4)) where event_id%3<>2""",
)
def scalar_broadcast(spark, sf_dir):
    p = view(spark, sf_dir, "track_points")
    values = (
        F.when(F.col("event_id") % 3 == 0, F.array("mslp"))
        .when(F.col("event_id") % 3 == 1, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("mslp") + i))
        .otherwise(F.array("mslp", "mslp"))
    )
    return p.select("event_id", F.posexplode(ensemble.fill_from_scalar(values, F.lit(4))).alias("member_no", "value"))


@query(
    "wind_select_ambiguity",
    with_views("wind_cells")
    + " select cell_id, rank_no, speed, lat, lon360, round(pow(10.0e0,log10_likelihood),6) as likelihood from wind_cells where rank_no=1",
)
def wind_select_ambiguity(spark, sf_dir):
    w = winds.select_ambiguity(view(spark, sf_dir, "wind_cells"), 1)
    return w.select("cell_id", "rank_no", "speed", "lat", "lon360", F.round("likelihood", 6).alias("likelihood"))


@query(
    "wind_union_products",
    with_views("wind_cells")
    + """ select 'bufr' as product, cell_id, speed, qc from wind_cells where rank_no<4
      union all select 'netcdf', cell_id, speed, null from wind_cells where rank_no>=4""",
)
def wind_union_products(spark, sf_dir):
    w = view(spark, sf_dir, "wind_cells")
    return winds.union_products(
        {"bufr": w.filter("rank_no<4"), "netcdf": w.filter("rank_no>=4").drop("qc").withColumnRenamed("speed", "wind_speed")}
    ).select("product", "cell_id", "speed", "qc")


FILE_NAME = """case cast(page_id%5 as int) when 0 then concat('/d/GPMCOR_GMI_', page_id, '_1BS_G1B_07B.h5') when 1 then concat('/d/1B.GPM.GMI.TB2021.', page_id, '.HDF5')
  when 2 then concat('/d/1C.GPM.GMI.XCAL2016-C.', page_id, '.HDF5') when 3 then concat('/d/GW1AM2_', page_id, '_038D.h5') else concat('/d/other_', page_id, '.h5') end"""


@query(
    "mw_file_type",
    f"""select path, case k when 3 then 'GCOMW1_AMSR2' when 4 then null else 'GPMGMI' end as sensor, case k when 2 then 'Tc' when 4 then null else 'Tb' end as variable,
      case when k<3 then 'S1' end as swath from (select {FILE_NAME} as path, page_id%5 as k from pages) t""",
)
def mw_file_type(spark, sf_dir):
    pages = tables(spark, sf_dir, "pages")["pages"].selectExpr(f"{FILE_NAME} as path")
    return pages.withColumn("t", files.product_type(F.col("path"))).select("path", "t.*")


@query(
    "mw_scale",
    with_views("mw_samples")
    + """ select scan, pixel, round(floor(tb_v*100)*(case when scan%2=0 then 0.01e0 else 0.02e0 end),3) as tb_v,
      round(floor(tb_h*100)*(case when scan%2=0 then 0.01e0 else 0.02e0 end),3) as tb_h from mw_samples""",
)
def mw_scale(spark, sf_dir):
    s = view(spark, sf_dir, "mw_samples").select(
        "scan", "pixel", (F.col("scan") % 2).alias("file_id"), F.floor(F.col("tb_v") * 100).alias("tb_v"), F.floor(F.col("tb_h") * 100).alias("tb_h")
    )
    attributes = s.select("file_id").distinct().withColumn("scale_factor", F.when(F.col("file_id") == 0, 0.01).otherwise(0.02))
    out = microwave.scale(s, attributes, "file_id", ["tb_v", "tb_h"])
    return out.select("scan", "pixel", F.round("tb_v", 3).alias("tb_v"), F.round("tb_h", 3).alias("tb_h"))


@query(
    "file_inventory",
    with_views("track_points")
    + """ select event_id, case cast(event_id%5 as int) when 0 then 'GFS' when 1 then 'ECM' when 2 then 'CMC' when 3 then 'NAV' else 'GEFS-TCGEN' end as model_name,
      case when event_id%5<4 then time_step end as time_step, case when event_id%5=4 then concat('AP', cast(event_id%10 as string)) end as member
      from track_points where event_id%7<>0""",
)
def file_inventory(spark, sf_dir):
    p = view(spark, sf_dir, "track_points")
    k, step = F.col("event_id") % 5, F.lpad(F.col("time_step").cast("string"), 3, "0")
    ext = F.when(F.col("event_id") % 7 == 0, "idx").otherwise("grib2")
    model = F.when(k == 0, "GFS").when(k == 1, "ECM").when(k == 2, "CMC").when(k == 3, "NAV").otherwise("GEFS-TCGEN")
    name = (
        F.when(k == 0, F.concat(F.lit("gfs.f"), step, F.lit("_mslp.")))
        .when(k == 1, F.concat(F.lit("20240101-"), F.col("time_step").cast("string"), F.lit("h-oper-fc.")))
        .when(k == 2, F.concat(F.lit("CMC_2024010100_P"), step, F.lit(".")))
        .when(k == 3, F.concat(F.lit("navgem_2024010100f"), step, F.lit(".")))
        .otherwise(F.concat(F.lit("storms.ap"), (F.col("event_id") % 10).cast("string"), F.lit(".atcf.")))
    )
    listed = p.select("event_id", model.alias("model_name"), F.concat(F.lit("/data/"), name, ext).alias("path"))
    return files.inventory(listed).select("event_id", "model_name", "time_step", "member")


@query("nadir_path", oracle_view("nadir"))
def nadir_path(spark, sf_dir):
    return view(spark, sf_dir, "nadir")


# ---------------------------------------------------------------- text helpers


@query(
    "coef_map",
    """select o_orderkey, round((case when o_custkey%2=0 then -1 else 1 end)*(1.5e0+o_custkey%100/1000.0e0),6) as c_6g, round(1.4e0+o_orderkey%100/1000.0e0,6) as c_36g from orders""",
)
def coef_map(spark, sf_dir):
    o = tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", "o_custkey")
    text = F.concat(
        F.lit("6G-"), F.when(F.col("o_custkey") % 2 == 0, "-").otherwise(""),
        F.lit("1."), (500 + F.col("o_custkey") % 100).cast("string"), F.lit(",7G-0.5,10G-0.25,36G-1."), (400 + F.col("o_orderkey") % 100).cast("string"),
    )
    coef = text_fn.coefficient_map(text)
    return o.select("o_orderkey", F.round(coef["6G"], 6).alias("c_6g"), F.round(coef["36G"], 6).alias("c_36g"))
