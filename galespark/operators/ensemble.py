"""Decoded ensemble rows: cleaning, member names, carried basin, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galespark.functions import geo, units
from galespark.sources.dims import basin_of, ensemble_of_member, literal_map


def member_name(forecast_type: Column, number: Column) -> Column:
    """4 = numbered perturbation, 1 = control, 0 = high resolution."""
    return (
        F.when(forecast_type == 4, F.format_string("EE%02d", number))
        .when(forecast_type == 1, "ECME")
        .when(forecast_type == 0, "ECHR")
    )


def clean_points(rows: DataFrame) -> DataFrame:
    """Sentinels to NULL, pressure to hPa, radius of maximum wind from the two
    positions (0 where either is missing), basin of the cleaned position."""
    deg = {c: units.clean_below(F.col(c), -500) for c in ("lat", "lon", "lat_max_wind", "lon_max_wind")}
    out = rows.withColumns(deg | {"mslp": units.clean_below(F.col("pressure_pa"), -99) / 100})
    rmw = geo.distance_m(F.col("lat"), F.col("lon"), F.col("lat_max_wind"), F.col("lon_max_wind"))
    return out.withColumns(
        {
            "member": member_name(F.col("forecast_type"), F.col("member_no")),
            "rmw": F.coalesce(F.round(rmw, 0), F.lit(0.0)),
            "basin_here": basin_of(F.col("lat"), F.col("lon")),
        }
    )


def carry_basin(rows: DataFrame, keys: list[str], order: list[str], start: str = "start_basin") -> DataFrame:
    """Last known basin of a member along its run, the storm's own basin before
    that. ``keys`` name one member of one run, so a partition holds no more
    rows than the run has periods."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("basin", F.coalesce(F.last("basin_here", ignorenulls=True).over(w), F.col(start)))


def fill_from_scalar(values: Column, n: Column) -> Column:
    """A single value is repeated, a full array passes, any other length is NULL."""
    return F.when(F.size(values) == n, values).when(F.size(values) == 1, F.array_repeat(F.element_at(values, 1), n))


def ensemble_name(member: Column) -> Column:
    return literal_map(ensemble_of_member())[member]


def merge_first(sources: list[DataFrame], payload: list[str]) -> DataFrame:
    """Union in order of trust; of exact duplicates the most trusted stays.

    The duplicates meet in an aggregation, so each partition forwards one row
    per distinct payload however often it occurs."""
    ranked = None
    for i, s in enumerate(sources):
        part = s.withColumn("source_rank", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy(*payload).agg(F.min("source_rank").alias("source_rank"))
