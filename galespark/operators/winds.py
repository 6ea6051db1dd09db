"""Scatterometer wind cells: ambiguity, quality masks, extents, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galespark.functions import geo, units

# fixed values: quality flag -> bit number
FLAG_BITS = {
    "not_enough_good_sigma0_for_wind_retrieval": 22,
    "poor_azimuth_diversity": 21,
    "any_beam_noise_content_above_threshold": 20,
    "product_monitoring_not_used": 19,
    "product_monitoring_event_flag": 18,
    "knmi_quality_control_fails": 17,
    "variational_quality_control_fails": 16,
    "some_portion_of_wvc_is_over_land": 15,
    "some_portion_of_wvc_is_over_ice": 14,
    "wind_inversion_not_successful": 13,
    "large_wind_greater_than_30_m_s": 12,
    "small_wind_less_than_or_equal_to_3_m_s": 11,
    "no_meteorological_background_used": 8,
    "data_are_redundant": 7,
    "distance_to_gmf_too_large": 6,
    "rain_detected": 5,
}
ALL_BITS = (1 << 24) - 1


def select_ambiguity(cells: DataFrame, rank: int = 1) -> DataFrame:
    """Solutions of one rank, with the likelihood out of its logarithm."""
    return cells.filter(F.col("rank_no") == rank).withColumn("likelihood", F.pow(F.lit(10.0), F.col("log10_likelihood")))


def union_products(products: dict[str, DataFrame]) -> DataFrame:
    """Products of different layout in one schema; absent columns are NULL."""
    out = None
    for name, df in products.items():
        part = df.withColumnRenamed("wind_speed", "speed").withColumn("product", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def mask_of(flags: list[str]) -> int:
    return sum(1 << FLAG_BITS[f] for f in flags if f in FLAG_BITS)


def mask_speed(speed: Column, qc: Column, flags: list[str]) -> Column:
    """NULL where an active flag is set or every bit is (a missing value)."""
    bad = (qc == ALL_BITS) | units.any_bit(qc, mask_of(flags))
    return F.when(~F.coalesce(bad, F.lit(False)), speed)


def mask_speed_named(speed: Column, qc: Column, masks: Column, meanings: Column, flags: list[str]) -> Column:
    """The same where masks and meanings come as parallel lists in metadata."""
    pairs = F.arrays_zip(masks.alias("mask"), F.split(meanings, " ").alias("meaning"))
    active = F.aggregate(
        F.filter(pairs, lambda p: p["meaning"].isin(flags)),
        F.lit(0).cast("long"),
        lambda acc, p: acc.bitwiseOR(p["mask"].cast("long")),
    )
    return F.when(qc.cast("long").bitwiseAND(active) == 0, speed)


def in_extent(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Box as (lon min, lon max, lat min, lat max), edges included."""
    return lon.between(box[0], box[1]) & lat.between(box[2], box[3])


def extent_stats(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Strongest wind, its likelihood and the sensing times of each extent."""
    best = F.when(F.col("speed").isNotNull(), F.struct("speed", "tie"))
    return cells.groupBy(*keys).agg(
        F.max("speed").alias("vmax"),
        F.max_by("likelihood", best).alias("vmax_likelihood"),
        F.min("obs_time").alias("time_min"),
        F.max("obs_time").alias("time_max"),
    )


def strong_or_top(cells: DataFrame, keys: list[str], threshold: float = 34.0, top: int = 20) -> DataFrame:
    """All winds at the threshold or more; a group without any gives its top
    few instead. The top rows are limited before the shuffle, and only that
    small set meets the list of groups already served."""
    valid = cells.filter(F.col("speed").isNotNull())
    strong = valid.filter(F.col("speed") >= threshold)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("speed"), "tie"))
    best = valid.withColumn("rank_in_group", rank).filter(F.col("rank_in_group") <= top).drop("rank_in_group")
    served = strong.select(*keys).distinct()
    return strong.unionByName(best.join(served, keys, "left_anti"))


def swath_width(cells: DataFrame, keys: list[str], scan: str = "scan", pixel: str = "pixel") -> DataFrame:
    """Distance between the edge cells of each scan, summarised per pass."""
    first, last = F.min_by(F.struct("lat", "lon"), pixel), F.max_by(F.struct("lat", "lon"), pixel)
    scans = cells.groupBy(*keys, scan).agg(first.alias("a"), last.alias("b"))
    width = geo.distance_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) / 1000
    return scans.withColumn("width_km", width).groupBy(*keys).agg(
        F.min("width_km").alias("min_km"),
        F.max("width_km").alias("max_km"),
        F.avg("width_km").alias("mean_km"),
        F.count(F.lit(1)).alias("scans"),
    )
