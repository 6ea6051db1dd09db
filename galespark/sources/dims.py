"""Fixed dimensions and readers for the parameter files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galespark.functions.geo import covers

# fixed values: basin name -> closed region as (lon, lat) corners, first match wins
BASINS = [
    ("AL", [(-100.0, 0.0), (0.0, 0.0), (0.0, 60.0), (-100.0, 60.0)]),
    ("EP", [(-180.0, 0.0), (-100.0, 0.0), (-100.0, 60.0), (-180.0, 60.0)]),
    ("WP", [(100.0, 0.0), (180.0, 0.0), (180.0, 60.0), (100.0, 60.0)]),
    ("IO", [(30.0, 0.0), (100.0, 0.0), (100.0, 60.0), (30.0, 60.0)]),
    ("SH", [(-180.0, -60.0), (180.0, -60.0), (180.0, 0.0), (-180.0, 0.0)]),
]

# fixed values: tracker basin letter -> basin
BASIN_OF_LETTER = {
    "E": "EP", "L": "AL", "C": "CP", "S": "SH", "B": "IO", "A": "IO", "Q": "SH", "P": "SH", "W": "WP",
}

# fixed values: model, basin, 925-hPa wind (m/s), 850-hPa vorticity (1e-5/s), 250-850 thickness (m)
THRESHOLDS = [
    ("NAV", "EP", 15.96, 12.61, 9498.6),
    ("NAV", "AL", 17.4, 13.88, 9454.4),
    ("NAV", "WP", 17.8, 14.0, 9545.5),
    ("NAV", "IO", 16.9, 13.3, 9525.8),
    ("NAV", "SH", 17.8, 14.1, 9538.3),
    ("CMC", "EP", 15.79, 14.92, 9483.3),
    ("CMC", "AL", 17.01, 15.29, 9478.5),
    ("CMC", "WP", 19.6, 20.1, 9551.0),
    ("CMC", "IO", 18.3, 19.4, 9527.1),
    ("CMC", "SH", 19.4, 20.2, 9538.4),
    ("GFS", "EP", 13.74, 12.7, 9480.2),
    ("GFS", "AL", 16.07, 13.87, 9471.1),
    ("GFS", "WP", 18.6, 24.8, 9540.0),
    ("GFS", "IO", 16.6, 23.21, 9522.3),
    ("GFS", "SH", 19.0, 26.8, 9532.6),
    ("UKM", "EP", 15.06, 14.2, 9490.0),
    ("UKM", "AL", 15.68, 14.53, 9471.0),
    ("UKM", "WP", 18.6, 28.8, 9542.0),
    ("UKM", "IO", 18.9, 32.12, 9540.0),
    ("UKM", "SH", 20.1, 33.3, 9540.0),
    ("ECM", "EP", 15.9, 20.6, 9491.3),
    ("ECM", "AL", 15.4, 20.3, 9473.0),
    ("ECM", "WP", 19.6, 30.0, 9541.2),
    ("ECM", "IO", 18.0, 31.41, 9518.6),
    ("ECM", "SH", 19.4, 30.9, 9531.9),
]

# fixed values: model, hours between runs, last forecast hour, zero-padded width of the step in file names
MODELS = [("GFS", 6, 384, 3), ("ECM", 12, 240, 0), ("CMC", 12, 240, 3), ("NAV", 6, 180, 3)]

# fixed values: files expected for one forecast step, members expected for one ensemble cycle
FILES_PER_STEP = 9
MEMBERS_PER_CYCLE = {"GEFS-TCGEN": 32, "GEPS-TCGEN": 22, "FNMOC-TCGEN": 22, "EPS-TCGEN": 52}


def ensemble_of_member() -> dict[str, str]:
    """Member name -> ensemble; control and deterministic names first, then the
    numbered perturbations, then the deterministic models grouped with them."""
    out = {"GFSO": "GEFS-TCGEN", "AC00": "GEFS-TCGEN", "CMC": "GEPS-TCGEN", "CC00": "GEPS-TCGEN"}
    out |= {"ECHR": "EPS-TCGEN", "ECME": "EPS-TCGEN", "NGX": "FNMOC-TCGEN", "NC00": "FNMOC-TCGEN"}
    for prefix, count, name in (
        ("AP", 30, "GEFS-TCGEN"), ("CP", 20, "GEPS-TCGEN"), ("EE", 50, "EPS-TCGEN"), ("NP", 20, "FNMOC-TCGEN"),
    ):
        out |= {f"{prefix}{i:02d}": name for i in range(1, count + 1)}
    return out | {"GFS": "GEFS-TCGEN", "ECM": "EPS-TCGEN", "NAV": "FNMOC-TCGEN"}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def basin_of(lat: Column, lon: Column, basins=BASINS) -> Column:
    """First basin that covers the point. The fixed regions are compiled into
    one expression, so the lookup is a projection and needs no join at all."""
    out = None
    for name, ring in basins:
        test = covers(ring, lat, lon)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THRESHOLDS, "model_name string, basin string, ws double, rv double, thkn double")


def thresholds_from_json(df: DataFrame, column: str = "value") -> DataFrame:
    """model -> basin -> criterion nested JSON text to one row per criterion."""
    nested = F.from_json(column, "map<string,map<string,map<string,double>>>")
    return (
        df.select(F.explode(nested).alias("model_name", "by_basin"))
        .select("model_name", F.explode("by_basin").alias("basin", "by_criterion"))
        .select("model_name", "basin", F.explode("by_criterion").alias("criterion", "threshold"))
    )


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return thresholds_from_json(spark.read.text(path, wholetext=True))


def categories_from_json(df: DataFrame, column: str = "value") -> DataFrame:
    """basin -> category -> [[pressure, percent], ...] to one row per pair."""
    nested = F.from_json(column, "map<string,map<string,array<array<double>>>>")
    return (
        df.select(F.explode(nested).alias("basin", "by_category"))
        .select("basin", F.explode("by_category").alias("category", "pairs"))
        .select("basin", "category", F.explode("pairs").alias("pair"))
        .select("basin", "category", F.col("pair")[0].alias("mslp"), F.col("pair")[1].alias("percent"))
    )


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return categories_from_json(spark.read.text(path, wholetext=True))


def unpivot_months(wide: DataFrame, key: str = "lat", value: str = "theta") -> DataFrame:
    """Latitude by month matrix to (lat, month, theta); months are the columns in order."""
    months = [c for c in wide.columns if c != key]
    numbers = literal_map({m: i for i, m in enumerate(months, 1)})
    long = wide.unpivot(key, months, "month_name", value)
    return long.select(F.col(key), numbers[F.col("month_name")].alias("month"), F.col(value))


def read_theta(spark: SparkSession, path: str) -> DataFrame:
    names = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    schema = "lat double, " + ", ".join(f"{m} double" for m in names)
    return unpivot_months(spark.read.csv(path, header=True, schema=schema))
