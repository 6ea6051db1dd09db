"""WGS84 inverse and direct problems as Arrow-batched functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: WGS84 semi-major axis and flattening
AXIS = 6378137.0
FLAT = 1 / 298.257223563
MINOR = AXIS * (1 - FLAT)


def _series_terms(cos2_alpha):
    u2 = cos2_alpha * (AXIS**2 - MINOR**2) / MINOR**2
    a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    return a, b


def _delta_sigma(b, sin_s, cos_s, cos_2m):
    return b * sin_s * (
        cos_2m
        + b / 4 * (cos_s * (-1 + 2 * cos_2m**2) - b / 6 * cos_2m * (-3 + 4 * sin_s**2) * (-3 + 4 * cos_2m**2))
    )


def _longitude(alpha, beta1, beta2):
    """Arc and longitude gained by the geodesic that leaves ``beta1`` (reduced,
    south, at least as far out as ``beta2``) with an azimuth, until it rises to
    ``beta2``; and its azimuth at the equator."""
    s1, c1, s2, c2 = np.sin(beta1), np.cos(beta1), np.sin(beta2), np.cos(beta2)
    sin_a = np.sin(alpha) * c1
    forward = np.cos(alpha) * c1
    rising = np.sqrt(np.maximum(0.0, forward**2 + (c2 - c1) * (c2 + c1)))
    sigma1, sigma2 = np.arctan2(s1, forward), np.arctan2(s2, rising)
    omega = np.arctan2(sin_a * s2, rising) - np.arctan2(sin_a * s1, forward)
    sigma = sigma2 - sigma1
    cos2_a = 1 - sin_a**2
    cos_2m = np.cos(sigma1 + sigma2)
    c = FLAT / 16 * cos2_a * (4 + FLAT * (4 - 3 * cos2_a))
    bend = sigma + c * np.sin(sigma) * (cos_2m + c * np.cos(sigma) * (-1 + 2 * cos_2m**2))
    return sigma, omega - (1 - c) * FLAT * sin_a * bend, cos2_a, cos_2m, sin_a


def _by_azimuth(u1, u2, gap):
    """The inverse problem by its azimuth, for pairs anywhere on the globe.

    With the point farther from the equator put first and south, the longitude
    gained rises with the azimuth from none (due north) to half a turn (due
    south). The equation is solved between two bounds: by the secant through
    them, or by their middle where the secant is slow. That ends for every pair."""
    swap = np.abs(u1) < np.abs(u2)
    b1, b2 = np.where(swap, u2, u1), np.where(swap, u1, u2)
    south = np.where(b1 > 0, -1.0, 1.0)
    b1, b2 = np.minimum(b1 * south, -1e-14), b2 * south  # on the equator as from just below it
    goal = np.abs(gap)
    low, high = np.zeros_like(goal), np.full_like(goal, np.pi)
    f_low, f_high = -goal, np.pi - goal
    for i in range(120):
        with np.errstate(divide="ignore", invalid="ignore"):
            mid = low - f_low * (high - low) / (f_high - f_low)
        mid = np.where((i % 3 == 2) | ~((mid > low) & (mid < high)), (low + high) / 2, mid)
        f = _longitude(mid, b1, b2)[1] - goal
        up = f > 0
        high, f_high = np.where(up, mid, high), np.where(up, f, f_high)
        low, f_low = np.where(up, low, mid), np.where(up, f_low, f)
    alpha = np.where(goal == 0, np.where(b2 >= b1, 0.0, np.pi), np.where(np.abs(f_low) < np.abs(f_high), low, high))
    sigma, _, cos2_a, cos_2m, sin_a = _longitude(alpha, b1, b2)
    a, b = _series_terms(cos2_a)
    dist = MINOR * a * (sigma - _delta_sigma(b, np.sin(sigma), np.cos(sigma), cos_2m))
    # back to the pair as given: at the second point the azimuth follows from Clairaut's relation
    end = np.arctan2(sin_a, np.sqrt(np.maximum(0.0, np.cos(b2) ** 2 - sin_a**2)))
    first = np.where(swap, end, alpha)
    first = np.where(south < 0, np.pi - first, first)
    # swapped, the way is run in the other direction
    first = np.where(swap, np.pi - first, first)
    return dist, np.degrees(np.where(gap < 0, -first, first))


def inverse(lat1, lon1, lat2, lon2):
    """Distance in metres and forward azimuth in degrees, on numpy arrays.

    The quick iteration settles but for nearly opposite points; those go by
    their azimuth. Opposite points have many shortest ways; one is given."""
    lat1, lon1, lat2, lon2 = np.broadcast_arrays(*(np.radians(np.asarray(v, dtype="float64")) for v in (lat1, lon1, lat2, lon2)))
    u1, u2 = np.arctan((1 - FLAT) * np.tan(lat1)), np.arctan((1 - FLAT) * np.tan(lat2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    gap = (lon2 - lon1 + np.pi) % (2 * np.pi) - np.pi
    lam = gap.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(30):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cos_s = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, cu1 * cu2 * sl / sin_s, 0.0)
            cos2_a = 1 - sin_a**2
            cos_2m = np.where(cos2_a > 0, cos_s - 2 * su1 * su2 / cos2_a, 0.0)
            c = FLAT / 16 * cos2_a * (4 + FLAT * (4 - 3 * cos2_a))
            nxt = gap + (1 - c) * FLAT * sin_a * (
                sigma + c * sin_s * (cos_2m + c * cos_s * (-1 + 2 * cos_2m**2))
            )
            step = np.abs(nxt - lam)
            lam = nxt
            if np.nanmax(step, initial=0.0) < 1e-13:
                break
        a, b = _series_terms(cos2_a)
        dist = MINOR * a * (sigma - _delta_sigma(b, sin_s, cos_s, cos_2m))
        az = np.degrees(np.arctan2(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam)))
    dist = np.where((sin_s == 0) & (cos_s > 0), 0.0, dist)
    # steps that grow small only beyond half a turn have left the shortest way
    hard = np.isfinite(gap + u1 + u2) & (~(step < 1e-12) | (np.abs(lam) > np.pi))
    dist, az = np.atleast_1d(dist).copy(), np.atleast_1d(az).copy()
    at = np.flatnonzero(np.atleast_1d(hard))
    if len(at):
        dist[at], az[at] = _by_azimuth(*(np.atleast_1d(v)[at] for v in (u1, u2, gap)))
    lost = ~np.isfinite(np.atleast_1d(gap + u1 + u2))
    return np.where(lost, np.nan, dist), np.where(lost, np.nan, az)


def direct(lat1, lon1, az, dist):
    """Latitude and longitude reached, on numpy arrays."""
    lat1, lon1, az = (np.radians(np.asarray(v, dtype="float64")) for v in (lat1, lon1, az))
    dist = np.asarray(dist, dtype="float64")
    u1 = np.arctan((1 - FLAT) * np.tan(lat1))
    su1, cu1 = np.sin(u1), np.cos(u1)
    sigma1 = np.arctan2(np.tan(u1), np.cos(az))
    sin_a = cu1 * np.sin(az)
    cos2_a = 1 - sin_a**2
    a, b = _series_terms(cos2_a)
    base = dist / (MINOR * a)
    sigma = base
    for _ in range(200):
        cos_2m = np.cos(2 * sigma1 + sigma)
        nxt = base + _delta_sigma(b, np.sin(sigma), np.cos(sigma), cos_2m)
        step = np.abs(nxt - sigma)
        sigma = nxt
        if np.nanmax(step, initial=0.0) < 1e-13:
            break
    cos_2m = np.cos(2 * sigma1 + sigma)
    ss, cs = np.sin(sigma), np.cos(sigma)
    lat2 = np.arctan2(
        su1 * cs + cu1 * ss * np.cos(az),
        (1 - FLAT) * np.hypot(sin_a, su1 * ss - cu1 * cs * np.cos(az)),
    )
    lam = np.arctan2(ss * np.sin(az), cu1 * cs - su1 * ss * np.cos(az))
    c = FLAT / 16 * cos2_a * (4 + FLAT * (4 - 3 * cos2_a))
    gap = lam - (1 - c) * FLAT * sin_a * (sigma + c * ss * (cos_2m + c * cs * (-1 + 2 * cos_2m**2)))
    lon2 = (np.degrees(lon1 + gap) + 180) % 360 - 180
    settled = step < 1e-11
    return np.where(settled, np.degrees(lat2), np.nan), np.where(settled, lon2, np.nan)


@F.pandas_udf(T.StructType().add("distance_m", T.DoubleType()).add("azimuth", T.DoubleType()))
def wgs84_inverse(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
    dist, az = inverse(lat1, lon1, lat2, lon2)
    return pd.DataFrame({"distance_m": dist, "azimuth": az})


@F.pandas_udf(T.StructType().add("lat", T.DoubleType()).add("lon", T.DoubleType()))
def wgs84_direct(lat: pd.Series, lon: pd.Series, az: pd.Series, dist: pd.Series) -> pd.DataFrame:
    lat2, lon2 = direct(lat, lon, az, dist)
    return pd.DataFrame({"lat": lat2, "lon": lon2})
