"""Unit conversion, sentinel cleaning and small numeric rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: conversion factors
KT_TO_MS = 0.514444
MS_TO_KT = 1.94384
KMH_TO_KT = 0.539956803
NMI_TO_M = 1852.0
M_PER_DEGREE = 111320.0

# fixed values: intensity class lower bounds in knots
INTENSITY_KT = [(34, "TD"), (64, "TS"), (83, "Cat 1"), (96, "Cat 2"), (113, "Cat 3"), (137, "Cat 4")]
# fixed values: wind bands in knots
WIND_BAND_KT = [0, 12, 25, 34, 50, 64, 100, 120, 200]
# fixed values: upper bounds of the coarse lead ranges in hours
LEAD_RANGES = [(48, "0-48"), (120, "49-120"), (168, "121-168"), (240, "169-240"), (336, "241-336")]


def clean(value: Column, sentinel: float) -> Column:
    """NULL where the value is the sentinel, NaN or infinite."""
    v = value.cast("double")
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf"))) | (v == F.lit(float(sentinel)))
    return F.when(~bad, v)


def clean_below(value: Column, floor: float) -> Column:
    """NULL where the value lies under ``floor``, is NaN or infinite."""
    v = value.cast("double")
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf"))) | (v < F.lit(float(floor)))
    return F.when(~bad, v)


def kt_to_ms(v: Column) -> Column:
    return v * F.lit(KT_TO_MS)


def ms_to_kt(v: Column) -> Column:
    return v * F.lit(MS_TO_KT)


def nmi_to_m(v: Column) -> Column:
    return v * F.lit(NMI_TO_M)


def by_unit(value: Column, unit: Column) -> Column:
    """Bring a value to the internal unit named by its own attribute."""
    return (
        F.when(unit == "Pa", value * F.lit(0.01))
        .when(unit == "knots", value * F.lit(KT_TO_MS))
        .otherwise(value)
    )


def positive(v: Column) -> Column:
    return F.when(v > 0, v)


def signed_lon(lon: Column) -> Column:
    """0..360 or any longitude to [-180, 180)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def wrap_over_180(lon: Column) -> Column:
    return F.when(lon > 180, lon - F.lit(360.0)).otherwise(lon)


def intensity_class(kt: Column) -> Column:
    out = F.when(kt < INTENSITY_KT[0][0], INTENSITY_KT[0][1])
    for bound, name in INTENSITY_KT[1:]:
        out = out.when(kt < bound, name)
    return out.when(kt.isNotNull(), "Cat 5")


def wind_band(kt: Column, edges: list[float] = WIND_BAND_KT) -> Column:
    """Number of band edges at or under the speed (0 = below the first)."""
    total = F.lit(0)
    for e in edges:
        total = total + F.when(kt >= F.lit(float(e)), 1).otherwise(0)
    return F.when(kt.isNotNull(), total)


def lead_range(hours: Column) -> Column:
    out = F.when(hours <= LEAD_RANGES[0][0], LEAD_RANGES[0][1])
    for bound, name in LEAD_RANGES[1:]:
        out = out.when(hours <= bound, name)
    return out.when(hours.isNotNull(), "337+")


def normalise(v: Column, low: float, high: float) -> Column:
    """Min-max scale clipped to 0..1."""
    scaled = (v - F.lit(float(low))) / F.lit(float(high - low))
    return F.when(v.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))


def any_bit(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask)) != 0


def lead_day_bin(hours: Column, legend: int | None = None) -> Column:
    """Day of the lead time, -1 before the valid day. A legend of some days has
    no bin (NULL) for what lies beyond it; without one every day has its bin."""
    day = F.when(hours < 0, -1).otherwise(F.floor(hours / 24)).cast("int")
    return day if legend is None else F.when(day < legend, day)
