"""A/B-deck lines: up to 37 comma-separated fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galespark.functions.units import NMI_TO_M
from galespark.sources.tracker import valid_time

# fixed values: field names in line order
FIELDS = (
    "basin cy init_text technum tech tau lat_text lon_text vmax mslp ty rad windcode rad1 rad2 rad3 rad4 pouter router "
    "rmw gusts eye subregion maxseas initials dir speed stormname depth seas seascode seas1 seas2 seas3 seas4 "
    "userdefined userdata"
).split()
INTEGERS = {"tau", "vmax", "mslp", "rmw", "gusts", "router", "pouter", "speed"}
FORECAST_TECHNUM = "03"


def read_deck(spark: SparkSession, path: str) -> DataFrame:
    """Decoded forecast lines of deck files."""
    return derive(decode(forecast_lines(spark.read.text(path))))


def forecast_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Keep lines of more than four fields made by forecast models."""
    parts = F.split(F.col(column), ",")
    return lines.filter((F.size(parts) > 4) & (F.trim(F.get(parts, F.lit(3))) == FORECAST_TECHNUM))


def _signed(text: Column, plus: str) -> Column:
    # any suffix other than the positive one means the negative hemisphere
    value = F.substring(text, F.lit(1), F.length(text) - 1).try_cast("double") / 10
    return F.when(text != "", F.when(text.endswith(plus), value).otherwise(-value))


def decode(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed fields of a line; fields past the end of the line are NULL."""
    schema = ", ".join(f"{n} string" for n in FIELDS)
    trim = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    long_enough = F.size(F.split(F.col(column), ",")) > 4
    rows = lines.filter(long_enough).withColumn("fields", F.from_csv(F.col(column), schema, trim))
    out = rows.select(*lines.columns, "fields.*").withColumns({n: F.col(n).try_cast("int") for n in INTEGERS})
    return out.withColumns({"lat": _signed(F.col("lat_text"), "N"), "lon": _signed(F.col("lon_text"), "E")})


def derive(rows: DataFrame) -> DataFrame:
    """Metric radii, cleaned intensity, isobar difference, init and valid time."""
    mslp = F.when(F.col("mslp") > 0, F.col("mslp"))
    outer = F.when(F.col("pouter") > 0, F.col("pouter"))
    init = F.to_timestamp("init_text", "yyyyMMddHH")
    return rows.withColumns(
        {
            "roci": F.col("router") * NMI_TO_M,
            "rmw": F.col("rmw") * NMI_TO_M,
            "vmax10m": F.when(F.col("vmax") != 0, F.col("vmax")),
            "mslp_value": mslp,
            "outer_slp": outer,
            "closed_isobar_delta": outer - mslp,
            "init_time": init,
            "valid_time": valid_time(init, F.col("tau")),
            "atcf_id": storm_of_deck(),
        }
    )


def storm_of_deck() -> Column:
    """Storm a deck line belongs to: basin, number and year of the run."""
    return F.concat("basin", "cy", F.substring("init_text", 1, 4))
