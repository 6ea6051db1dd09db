"""File inventories: what lies in a run folder, without reading it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: extensions that are not data
IGNORED = ["asc", "idx", "json", "index"]

# fixed values: what stands before and after the forecast step in a file name ('#' is any digit), and the step's digits (0: any number)
STEP_PLACE = {
    "GFS": (".f", 3, "_"),
    "ECM": ("-", 0, "h-oper-fc"),
    "CMC": ("#_P", 0, ""),
    "NAV": ("navgem_##########f", 3, ""),
}


def step_pattern(before: str, digits: int, after: str) -> str:
    literal = lambda text: "".join("[0-9]" if c == "#" else re.escape(c) for c in text)
    return f"{literal(before)}([0-9]{f'{{{digits}}}' if digits else '+'}){literal(after)}"


STEP_PATTERN = {model: step_pattern(*place) for model, place in STEP_PLACE.items()}
MEMBER_PATTERN = {
    "EPS-TCGEN": r"A_JSXX\d+(EC..)",
    "GEFS-TCGEN": r"storms\.([a-z0-9]+)\.",
    "GEPS-TCGEN": r"storms\.([a-z0-9]+)\.",
    "FNMOC-TCGEN": r"storms\.([a-z0-9]+)\.",
}


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and time of each file; contents are pruned from the scan."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "modificationTime", "length")
    )


def extract_by_model(path: Column, model: Column, patterns: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in patterns.items():
        out = F.when(model == name, F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))).otherwise(out)
    return out


def inventory(files: DataFrame) -> DataFrame:
    """Data files with the step or member named in their file name."""
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    return (
        files.filter(~ext.isin(IGNORED))
        .withColumn("time_step", extract_by_model(F.col("path"), F.col("model_name"), STEP_PATTERN).cast("int"))
        .withColumn("member", F.upper(extract_by_model(F.col("path"), F.col("model_name"), MEMBER_PATTERN)))
    )


def older_than(files: DataFrame, as_of: Column, hours: int = 48, extension: str = "grib2") -> DataFrame:
    """Files to drop: of one extension and past the age limit."""
    return files.filter(
        F.col("path").endswith("." + extension)
        & (F.col("modificationTime") < F.timestamp_add("HOUR", F.lit(-hours), as_of))
    )


def product_type(path: Column) -> Column:
    """Microwave product named by a file: sensor, variable, swath group."""
    name = F.element_at(F.split(path, "/"), -1)
    gmi = name.contains("GPM") & name.contains("GMI")
    none = F.lit(None).cast("string")

    def kind(sensor, variable, swath):
        return F.struct(F.lit(sensor).alias("sensor"), F.lit(variable).alias("variable"), swath.alias("swath"))

    return (
        F.when(gmi & (name.contains("G1B") | name.startswith("1B.")), kind("GPMGMI", "Tb", F.lit("S1")))
        .when(gmi & name.startswith("1C"), kind("GPMGMI", "Tc", F.lit("S1")))
        .when(~gmi & name.contains("GW1AM2"), kind("GCOMW1_AMSR2", "Tb", none))
    )
