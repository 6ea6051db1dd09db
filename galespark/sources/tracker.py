"""Tracker text: 39 comma-separated columns per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galespark.functions import units
from galespark.sources.dims import BASIN_OF_LETTER, basin_of, literal_map

# fixed values: column names in file order
COLUMNS = (
    "track_type num_cyclogenesis cyclogenesis_id init_text record_type member forecast_hour lat_text lon_text "
    "max_10m_wind min_mslp storm_type threshold_wind radii_quadrant ne_radius se_radius sw_radius nw_radius "
    "pressure_last_closed radius_last_closed rmw cps_b cps_vtl cps_vtu warm_core_flag storm_direction storm_speed "
    "mean_vort850 max_vort850 mean_vort700 max_vort700 "
    "unknown_32 unknown_33 unknown_34 unknown_35 unknown_36 unknown_37 unknown_38 unknown_39"
).split()


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of every well-formed file. A file holding any line of another
    width is left out whole; an empty file gives no rows."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    fields = lines.filter(F.trim("value") != "").withColumn("width", F.size(F.split("value", ",")))
    bad = fields.filter(F.col("width") != len(COLUMNS)).select("file_path").distinct()
    return parse_tracker(fields.join(bad, "file_path", "left_anti"))


def parse_tracker(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add the typed and derived columns of a tracker line to its row."""
    schema = ", ".join(f"{n} string" for n in COLUMNS)
    trim = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    text = lines.withColumn("fields", F.from_csv(F.col(column), schema, trim)).select(*lines.columns, "fields.*")

    def num(name, missing=-999):
        return units.clean(F.col(name).try_cast("double"), missing)

    ints = ("record_type", "forecast_hour", "min_mslp", "threshold_wind")
    typed = text.withColumns(
        {n: F.col(n).try_cast("int") for n in ints}
        | {n: units.nmi_to_m(F.col(n).try_cast("double")) for n in ("ne_radius", "se_radius", "sw_radius", "nw_radius")}
        | {
            "max_10m_wind": units.kt_to_ms(F.col("max_10m_wind").try_cast("double")),
            "pressure_last_closed": num("pressure_last_closed"),
            "radius_last_closed": units.nmi_to_m(num("radius_last_closed")),
            "rmw": units.nmi_to_m(num("rmw")),
            "cps_b": num("cps_b") / 10,
            "cps_vtl": num("cps_vtl", -9999) / 10,
            "cps_vtu": num("cps_vtu", -9999) / 10,
            "storm_direction": num("storm_direction"),
            "storm_speed": num("storm_speed") / 10,
            "init_time": F.to_timestamp("init_text", "yyyyMMddHH"),
            "lat": hemisphere_tenths(F.col("lat_text"), "N", "S"),
            "lon": hemisphere_tenths(F.col("lon_text"), "E", "W"),
        }
        | {n: num(n) / 1e6 for n in ("mean_vort850", "max_vort850", "mean_vort700", "max_vort700")}
    )
    return typed.withColumns(
        {
            "valid_time": valid_time(F.col("init_time"), F.col("forecast_hour")),
            "basin": basin_of(F.col("lat"), F.col("lon")),
        }
    ).withColumns(storm_id_columns(F.col("num_cyclogenesis"), F.col("init_time")))


def hemisphere_tenths(text: Column, plus: str, minus: str) -> Column:
    """'201N' -> 20.1; a missing or unknown suffix gives NULL."""
    value = F.substring(text, F.lit(1), F.length(text) - 1).try_cast("double") / 10
    return F.when(text.endswith(plus), value).when(text.endswith(minus), -value)


def valid_time(init: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours, init)


def storm_id_columns(code: Column, init: Column) -> dict[str, Column]:
    """Storm id and the named / invest flags from a code such as '18L'."""
    letter = F.right(code, F.lit(1))
    digits = F.substring(code, F.lit(1), F.length(code) - 1)
    basin = literal_map(BASIN_OF_LETTER)[letter]
    number = F.when(basin.isNotNull(), digits.try_cast("int"))
    return {
        "atcf_id": F.when(number.isNotNull(), F.concat(basin, digits, F.year(init).cast("string"))),
        "named": F.coalesce(number < 70, F.lit(False)),
        "invest": F.coalesce(number >= 90, F.lit(False)),
    }


def phase_class(b: Column, vtl: Column, vtu: Column) -> dict[str, Column]:
    """Tropical and subtropical flags; a missing parameter counts as False."""
    warm = (b < 10) & (vtl > 0)
    return {
        "tropical": F.coalesce(warm & (vtu > 0), F.lit(False)),
        "subtropical": F.coalesce(warm & (vtu <= 0), F.lit(False)),
    }


def warm_core(flag: Column) -> Column:
    """Three-valued flag: Y, N, anything else unknown (NULL)."""
    return F.when(flag == "Y", True).when(flag == "N", False)


def prune_open(points: DataFrame, min_delta: float = 2.0, need_warm_core: bool = False) -> DataFrame:
    """Drop points whose outermost closed isobar is too close to the centre
    pressure; a point without that pressure stays, with a NULL difference."""
    known = F.col("pressure_last_closed") > 100
    delta = F.when(known, F.col("pressure_last_closed") - F.col("min_mslp"))
    kept = points.withColumn("closed_isobar_delta", delta).filter(
        F.coalesce(F.col("closed_isobar_delta") >= min_delta, F.lit(True))
    )
    if need_warm_core:
        kept = kept.filter(F.coalesce(F.col("warm_core_flag") != "N", F.lit(True)))
    return kept


def track_points(rows: DataFrame) -> DataFrame:
    """Tracker rows in the track-point shape used by linking."""
    kept = prune_open(rows)
    radii = F.array(*[F.round(c, 4) for c in ("ne_radius", "se_radius", "sw_radius", "nw_radius")])
    return kept.select(
        F.col("member").alias("model_name"),
        "init_time",
        F.col("forecast_hour").alias("time_step"),
        "valid_time",
        F.round("lat", 4).alias("lat"),
        F.round("lon", 4).alias("lon"),
        F.round(F.col("min_mslp").cast("double"), 4).alias("mslp"),
        F.round("max_10m_wind", 1).alias("vmax"),
        F.round(F.when(F.col("radius_last_closed") > 1, F.col("radius_last_closed")), 0).alias("roci"),
        F.round("rmw", 0).alias("rmw"),
        "closed_isobar_delta",
        F.col("max_vort850").alias("rv850max"),
        F.col("max_vort700").alias("rv700max"),
        *[F.round(c, 4).alias(c) for c in ("cps_b", "cps_vtl", "cps_vtu", "storm_direction", "storm_speed")],
        warm_core(F.col("warm_core_flag")).alias("warm_core"),
        *[c.alias(n) for n, c in phase_class(F.col("cps_b"), F.col("cps_vtl"), F.col("cps_vtu")).items()],
        "basin", "named", "invest",
        F.when(F.length("atcf_id") >= 4, F.col("atcf_id")).alias("atcf_id"),
        *[F.when(F.col("threshold_wind") == s, radii).alias(f"wind_radii_{s}") for s in (34, 50, 64)],
    )
