"""Shared pieces of the plan modules: registration and oracle fragments."""

from __future__ import annotations

from galespark.sources import dims


def registry():
    """A query table, an oracle table and the decorator that fills both."""
    queries, oracle = {}, {}

    def query(name: str, sql: str | None = None):
        def add(fn):
            queries[name] = fn
            if sql is not None:
                oracle[name] = sql
            return fn

        return add

    return queries, oracle, query


def basin_case(lat: str, lon: str) -> str:
    whens = " ".join(
        f"when {lon} between {min(x for x, _ in ring)} and {max(x for x, _ in ring)} "
        f"and {lat} between {min(y for _, y in ring)} and {max(y for _, y in ring)} then '{name}'"
        for name, ring in dims.BASINS
    )
    return f"(case {whens} end)"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance in metres."""
    return (
        f"(2*6371008.8e0*asin(least(1.0e0, sqrt(pow(sin(radians(({lat2})-({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*"
        f"pow(sin(radians(({lon2})-({lon1}))/2),2)))))"
    )


def azimuth(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"degrees(atan2(sin(radians(({lon2})-({lon1})))*cos(radians({lat2})), cos(radians({lat1}))*sin(radians({lat2}))"
        f"-sin(radians({lat1}))*cos(radians({lat2}))*cos(radians(({lon2})-({lon1})))))"
    )


def dest_lat(lat: str, az: str, dist: str) -> str:
    d = f"(({dist})/6371008.8e0)"
    return (
        f"degrees(asin(greatest(-1.0e0,least(1.0e0,sin(radians({lat}))*cos({d})+cos(radians({lat}))*sin({d})*cos(radians({az}))))))"
    )


def pmod(a: str, b: str) -> str:
    return f"((({a})%({b}))+({b}))%({b})"


def signed(lon: str) -> str:
    return f"({pmod(f'({lon})+180.0e0', '360.0e0')}-180.0e0)"


def dest_lon(lat: str, lon: str, az: str, dist: str) -> str:
    d = f"(({dist})/6371008.8e0)"
    lat2 = f"radians({dest_lat(lat, az, dist)})"
    return signed(
        f"({lon})+degrees(atan2(sin(radians({az}))*sin({d})*cos(radians({lat})), cos({d})-sin(radians({lat}))*sin({lat2})))"
    )
